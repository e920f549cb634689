"""Quality by ordinal cumulative-link regression on graded ratings, over hashed text.

One weight vector scores a text; ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold_k - score). All grades share the weights, so
what moves a text from junk to usable and from usable to good is learned from
every rating. Selection uses the expected grade and the tail probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remembered, store, working

#: Hash buckets of words and of word shapes together.
BUCKETS = 1 << 18
#: Rated documents that the model is fitted on, at most.
SAMPLE = 20_000
#: Tasks that fit side by side, rounds in which their weights are averaged, passes of a round.
SHARDS, ROUNDS, PASSES = 8, 5, 2
#: A bucket counts only if at least three rated documents have it and the chi-square of presence by grade is this high.
LEAST_CHI = 20.0
RATE, RIDGE = 0.15, 2e-5
#: Weight of the share of a word shape among the words of a text.
SHAPE_SCALE = 8.0
#: Tokens added to a text's own for those shares, so that a few of a short text say little.
SMOOTH = 3
#: A longer word also counts by its first so many letters.
STEM = 5
#: Bucket of tokens that repeat the one before; none else hashes to it.
REPEAT = BUCKETS - 1
#: A document is kept when it is in the best grade with this probability or more.
KEEP_FROM = 0.5
#: Tokens a worker process remembers, of at most 64 characters: about 65 MB when full, kept until another operator's task comes.
TABLE = 1 << 19
_FIRST, _LAST = regex.compile(r"[\p{L}\p{N}]"), regex.compile(r"(?r)[\p{L}\p{N}]")
_RUNS = regex.compile(r"(.)\1+")
_UPPER, _LOWER, _DIGIT = regex.compile(r"\p{Lu}"), regex.compile(r"[\p{Ll}\p{Lo}]"), regex.compile(r"\p{N}")


def grade(quality: Column, toxic: Column) -> Column:
    """0 junk, 1 usable but toxic, 2 good; null where either mark is."""
    return F.when(quality == 0, 0).when((quality == 1) & (toxic == 1), 1).when((quality == 1) & (toxic == 0), 2)


def bare(token: str) -> str:
    """The token from its first letter or digit to its last; empty if it has none."""
    first = _FIRST.search(token)
    return token[first.start():_LAST.search(token).end()] if first else ""


class _Tokens(dict):
    """Buckets of a token's word, of its first letters and of its shape, 20 bits each; 2 * BUCKETS for none."""

    def __missing__(self, token: str) -> int:
        word = bare(token).lower()
        shape = _RUNS.sub(r"\1", _DIGIT.sub("9", _LOWER.sub("x", _UPPER.sub("X", token))))[:6]
        half = BUCKETS // 2
        first = zlib.crc32(word.encode("utf-8", "surrogatepass")) % half if word else 2 * BUCKETS
        stem = zlib.crc32(word[:STEM].encode("utf-8", "surrogatepass")) % half if len(word) > STEM else 2 * BUCKETS
        both = first << 40 | stem << 20 | (half + zlib.crc32(b"shape " + shape.encode("utf-8", "surrogatepass")) % (half - 1))
        if len(self) >= TABLE:
            self.clear()
        if len(token) <= 64:
            self[token] = both
        return both


_TOKENS = remembered("quality", _Tokens())


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: 1 for every word and word beginning it has, a scaled share for every word shape and for
    tokens that repeat the one before."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    get = _TOKENS.__getitem__
    both = np.fromiter(map(get, tokens), np.int64, len(tokens))
    distinct = np.unique(both)
    words = np.unique(np.concatenate([distinct >> 40, distinct >> 20 & 0xFFFFF]))
    words = words[words < BUCKETS]
    shapes, n = np.unique(both & 0xFFFFF, return_counts=True)
    again = np.count_nonzero(both[1:] == both[:-1])
    shares = SHAPE_SCALE * np.append(n, again) / (len(tokens) + SMOOTH)
    values = np.concatenate([np.ones(len(words)), shares])
    return np.concatenate([words, shapes, [REPEAT]]).astype(np.int32), values.astype(np.float32)


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray  # float32, one per bucket; 0 where a bucket is too rare
    low: float           # the first threshold
    steps: np.ndarray    # logarithms of the distances to the next ones

    def thresholds(self) -> np.ndarray:
        return self.low + np.concatenate([[0.0], np.cumsum(np.exp(self.steps))])

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return float(self.weights[idx] @ val) if len(idx) else 0.0

    def tails(self, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 - _sigmoid(self.thresholds() - self.score(idx, val))


def fit_shard(rows: list[tuple[int, np.ndarray, np.ndarray]], model: Model, allowed: np.ndarray, passes: int = PASSES) -> Model:
    """Passes of adaptive gradient steps over ``rows`` of (grade, buckets, values), from ``model`` on."""
    w, low, steps = model.weights.copy(), model.low, model.steps.copy()
    square = np.full(len(w), 1e-3, np.float32)
    cut_square = np.full(1 + len(steps), 1e-3)
    kept = [(g, i[m], v[m]) for g, i, v in rows for m in (allowed[i],)]
    for _ in range(passes):
        for g, idx, val in kept:
            cuts = low + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
            score = float(w[idx] @ val)
            upper = _sigmoid(cuts[g] - score) if g < len(cuts) else 1.0
            lower = _sigmoid(cuts[g - 1] - score) if g else 0.0
            p = max(upper - lower, 1e-9)
            up, down = upper * (1 - upper), lower * (1 - lower)
            slope = (up - down) / p  # of the loss by the score
            step = slope * val + RIDGE * w[idx]
            square[idx] += step * step
            w[idx] -= RATE * step / np.sqrt(square[idx])
            by_cut = np.zeros(len(cuts))
            if g < len(cuts):
                by_cut[g] -= up / p
            if g:
                by_cut[g - 1] += down / p
            total = np.cumsum(by_cut[::-1])[::-1]
            move = np.concatenate([[total[0]], total[1:] * np.exp(steps)])
            cut_square += move * move
            move = RATE * move / np.sqrt(cut_square)
            low -= move[0]
            steps -= move[1:]
    return Model(w, low, steps)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [
        (g, np.frombuffer(i, np.int32), np.frombuffer(v, np.float32))
        for b in batches for g, i, v in zip(*(b.column(c).to_pylist() for c in ("grade", "idx", "val")), strict=True)
    ]


def rated_sample(docs: DataFrame, ratings: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """At most ``bound`` rated documents as (grade, idx, val), chosen by a hash of their ids.

    ``ratings`` has doc_id and grade; of several for one document the least
    holds. The chosen ids, whose number is bounded, go to every task.
    """
    known = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    chosen = known.where(place <= int((1 << 40) * min(1.0, 1.2 * bound / max(n, 1)))).orderBy(place, "doc_id").limit(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("grade"), pa.array([i.tobytes() for i, _ in found], pa.binary()),
                 pa.array([v.tobytes() for _, v in found], pa.binary())], names=["doc_id", "grade", "idx", "val"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text")
    return store(rows.mapInArrow(run, "doc_id BIGINT, grade INT, idx BINARY, val BINARY"))


def telling(seen: np.ndarray, by_grade: np.ndarray) -> np.ndarray:
    """Buckets whose presence depends on the grade, from counts of presence by grade."""
    have = seen.sum(axis=0)
    expected = np.outer(by_grade / by_grade.sum(), have)
    chi = np.divide((seen - expected) ** 2, expected, out=np.zeros(seen.shape), where=expected > 0).sum(axis=0)
    allowed = (have >= 3) & (chi >= LEAST_CHI)
    allowed[REPEAT] = True  # every text has this bucket; its value tells
    return allowed


def fit(rows: DataFrame, rounds: int = ROUNDS, shards: int = SHARDS) -> Model | None:
    """The model of stored ``rows`` of (grade, idx, val), or None without any.

    In each round every task makes passes over its rows from the common weights,
    and the results are averaged by row count. The driver sees one weight vector
    of fixed size per task.
    """
    top = rows.agg(F.max("grade")).first()[0]
    if top is None:
        return None
    top = max(1, top)
    dealt = rows.coalesce(shards)

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = np.zeros(top + 1, np.int64), np.zeros((top + 1, BUCKETS), np.int32)
        for g, idx, _ in _rows_of(batches):
            seen[g, idx] += 1
            n[g] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], names=["n", "seen"])

    parts = dealt.mapInArrow(presence, "n BINARY, seen BINARY").collect()
    by_grade = sum(np.frombuffer(p.n, np.int64) for p in parts)
    total = int(by_grade.sum())
    allowed = telling(sum(np.frombuffer(p.seen, np.int32).reshape(top + 1, BUCKETS) for p in parts), by_grade)
    model = Model(np.zeros(BUCKETS, np.float32), -2.0, np.zeros(top - 1))
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        now = context.broadcast((model, allowed))

        def one(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            mine = _rows_of(batches)
            if mine:
                got = fit_shard(mine, *now.value)
                cuts = np.concatenate([[got.low], got.steps])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(mine)], pa.int64()), pa.array([got.weights.tobytes()], pa.binary()), pa.array([cuts.tobytes()], pa.binary())],
                    names=["n", "weights", "cuts"])

        got = dealt.mapInArrow(one, "n BIGINT, weights BINARY, cuts BINARY").collect()
        weights = sum(np.frombuffer(g.weights, np.float32) * np.float32(g.n / total) for g in got)
        cuts = sum(np.frombuffer(g.cuts) * (g.n / total) for g in got)
        model = Model(weights, float(cuts[0]), cuts[1:])
        now.unpersist()
    return model


def judged(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep_from: float = KEEP_FROM) -> DataFrame:
    """doc_id, expected_grade, tail (array of P(grade >= k), k = 1, 2, ...), p_best and kept of every document.

    A null text and one without words has grade 0 for certain and is not kept.
    Without a model nothing can be judged: the figures are null and every
    document is kept. Rows stand for themselves; other columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return base.selectExpr("doc_id", "CAST(NULL AS DOUBLE) AS expected_grade", "CAST(NULL AS ARRAY<DOUBLE>) AS tail", "CAST(NULL AS DOUBLE) AS p_best", "TRUE AS kept")
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        m = shared_model.value
        none = np.zeros(1 + len(m.steps))
        for batch in batches:
            tails = []
            for text in batch.column("text"):
                idx, val = features(text.as_py())
                tails.append(m.tails(idx, val) if len(idx) else none)
            best = [float(t[-1]) for t in tails]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array(tails, pa.list_(pa.float64())),
                 pa.array(best, pa.float64()), pa.array([b >= keep_from for b in best], pa.bool_())],
                names=["doc_id", "expected_grade", "tail", "p_best", "kept"])

    return base.mapInArrow(run, "doc_id BIGINT, expected_grade DOUBLE, tail ARRAY<DOUBLE>, p_best DOUBLE, kept BOOLEAN")


def rated(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Fit on the labelled documents among ``docs``, then judge all of them."""
    ratings = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return judged(docs, fit(rated_sample(docs, ratings, bound)))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents, with all their columns, that are in the best grade with probability ``keep_from`` or more.

    Every row is judged where it lies, by what ``judged`` says of it; nothing is
    shuffled. Without labelled documents all stay.
    """
    ratings = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade"))
    model = fit(rated_sample(docs, ratings, bound))
    if model is None:
        return docs
    shared_model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("quality")
        m = shared_model.value

        def good(text: str | None) -> bool:
            idx, val = features(text)
            return len(idx) > 0 and m.tails(idx, val)[-1] >= keep_from

        for batch in batches:
            yield batch.filter(pa.array([bool(good(t.as_py())) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
