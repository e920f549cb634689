"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent n-grams in order. A document's own most
frequent n-grams are compared to it by their out-of-place distance: how many
ranks each lies off, or the most possible where the profile lacks it.
"""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import store, working

#: n-grams of a profile, of a document, and the longest n.
PROFILE, TOP, LONGEST = 400, 300, 3
#: Languages there may be; profiles of at most this many go to every task.
LANGUAGES = 1000
UNKNOWN = "und"
#: Code points looked at together; counts of a longer text are added up.
BLOCK = 1 << 20
#: Distinct (language, n-gram) counts that a task holds before it hands them on.
HELD = 300_000
#: A prediction less certain than this is no language at all, whatever was learned.
LEAST_SCORE = 0.05
#: A document must reach this part of the score that all but LOW_PART of the training documents of its language and size
#: reach; sizes are numbers of n-grams, and fewer than FEW documents set no bound.
MARGIN, LOW_PART, FEW = 0.8, 0.01, 30
SIZES = (25, 50, 100, 200, 300)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def grams(text: str | None, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams, n from 1 to ``longest`` (3 at most), of the words of a text in lower case, and their counts.

    A word is a run of letters with a border, written 0, on each side. An n-gram
    is one integer, 21 bits a code point; it never spans two words.
    """
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = text.lower()
    found = []
    for at in range(0, len(low), BLOCK):
        piece = ("" if at else " ") + low[max(0, at - 2):at + BLOCK] + (" " if at + BLOCK >= len(low) else "")
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        c = np.where(_letters()[c], c, 0)
        skip = min(at, 2)  # n-grams that end in the part seen before were counted there
        parts = [c[skip:][c[skip:] != 0]]
        if longest > 1:
            two = c[:-1] << 21 | c[1:]
            parts.append(two[max(0, skip - 1):][two[max(0, skip - 1):] != 0])
        if longest > 2:
            three = c[:-2] << 42 | two[1:]
            parts.append(three[(c[1:-1] != 0)])
        found.append(np.unique(np.concatenate(parts), return_counts=True))
    if len(found) == 1:
        return found[0]
    keys, where = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(where, np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams in order; among equals the smaller key first."""
    return keys[np.lexsort((keys, -counts))[:top]]


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE,
             longest: int = LONGEST) -> dict[str, np.ndarray]:
    """The profile of every language of ``docs``, from all its rows with a language and a text.

    Tasks count n-grams and hand on sums; Spark adds them per language and
    n-gram and ranks them. What comes to the driver is ``size`` n-grams for each
    of at most LANGUAGES languages; more languages than that are an error.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        held = 0

        def handed() -> Iterator[pa.RecordBatch]:
            for lang, parts in sums.items():
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])

        def fold() -> int:
            for lang, parts in sums.items():
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                sums[lang] = [(keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64))]
            return sum(len(p[0][0]) for p in sums.values())

        loose = 0
        working("language")
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                keys, n = grams(text.as_py(), longest)
                sums.setdefault(lang, []).append((keys, n))
                loose += len(keys)
                if loose > 10 * HELD:
                    held, loose = fold(), 0
                    if held > HELD:
                        yield from handed()
                        sums.clear()
        yield from handed()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    totals = rows.mapInArrow(count, "lang STRING, gram BIGINT, n BIGINT").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = store(totals.withColumn("place", place).where(F.col("place") <= size))
    many = best.select("lang").distinct().count()
    if many > LANGUAGES:
        raise ValueError(f"{many} languages; at most {LANGUAGES} have profiles")
    out: dict[str, list] = {}
    for lang, gram in best.orderBy("lang", "place").select("lang", "gram").toLocalIterator():
        out.setdefault(lang, []).append(gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Matcher:
    """Out-of-place distances of a document to every profile at once."""

    def __init__(self, found: dict[str, np.ndarray], size: int = PROFILE) -> None:
        self.names = sorted(found)
        self.size = size
        self.keys = np.unique(np.concatenate([found[k] for k in self.names])) if found else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.names), len(self.keys)), -1, np.int64)
        for i, k in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.keys, found[k])] = np.arange(len(found[k]))

    def distances(self, order: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, order)
        at[at == len(self.keys)] = 0
        ranks = np.where(self.keys[at] == order, self.ranks[:, at], -1)
        off = np.abs(ranks - np.arange(len(order)))
        return np.where(ranks < 0, self.size, np.minimum(off, self.size)).sum(axis=1)

    def predict(self, text: str | None, top: int = TOP, longest: int = LONGEST) -> tuple[str, float]:
        return self.judged(text, top, longest)[:2]

    def judged(self, text: str | None, top: int = TOP, longest: int = LONGEST) -> tuple[str, float, int]:
        """The language, its score, and the class of SIZES that the text's number of n-grams is in."""
        keys, counts = grams(text, longest)
        if not len(keys) or not self.names:
            return UNKNOWN, 0.0, 0
        order = ranked(keys, counts, top)
        far = self.distances(order)
        best = int(far.argmin())
        return self.names[best], float(1 - far[best] / (self.size * len(order))), bisect.bisect_right(SIZES, len(order))


def predict(docs: DataFrame, found: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text",
            size: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score of every document.

    The language at the least distance, of equals the first by name; the score
    is 1 less its share of the largest distance possible. A text that is null or
    has no letter, and every text where nothing was learned, is ``und`` with
    score 0. Rows stand for themselves; other columns are ignored.
    """
    profile_of = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("language")
        matcher = Matcher(profile_of.value, size)
        for batch in batches:
            said = [matcher.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id BIGINT, lang_pred STRING, score DOUBLE")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, then predict all: doc_id, held_out, lang_pred, score."""
    found = profiles(docs.where(~held_out(F.col(id_col))), text_col, lang_col)
    said = predict(docs, found, id_col, text_col)
    return said.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def least_scores(docs: DataFrame, found: dict[str, np.ndarray], text_col: str = "text") -> dict[tuple, float]:
    """The score that a document must have, by (language, size), (language, None) and (None, None).

    It is MARGIN of a low percentile of the scores of ``docs``, which are the
    training documents. A group of fewer than FEW has no entry, and the next
    wider one counts. What comes to the driver is one row a group.
    """
    profile_of = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(profile_of.value)
        for batch in batches:
            said = [matcher.judged(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in said], pa.string()), pa.array([int(s[1] * 1000) for s in said], pa.int64()), pa.array([s[2] for s in said], pa.int64())],
                names=["lang", "mille", "size"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "lang STRING, mille BIGINT, size BIGINT").where(F.col("lang") != UNKNOWN)
    low = rows.rollup("lang", "size").agg(F.count(F.lit(1)).alias("n"), F.percentile("mille", LOW_PART).alias("low"))
    return {(r.lang, r.size): MARGIN * r.low / 1000 for r in low.where(F.col("n") >= FEW).collect()}


def drop_unknown(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with all their columns, that are in a learned language: not ``und``, and of enough score.

    Enough is what ``least_scores`` finds for the language and size, ``least``
    where there are too few documents to tell. The profiles and those bounds come
    from the documents with a language that are not held out. Every row is judged
    where it lies; nothing but counts is shuffled. Where nothing can be learned,
    all documents stay.
    """
    training = docs.where(~held_out(F.col("doc_id")))
    found = profiles(training)
    if not found:
        return docs
    bounds = least_scores(training.where("lang IS NOT NULL AND text IS NOT NULL"), found)
    shared = docs.sparkSession.sparkContext.broadcast((found, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("language")
        profile_of, bound_of = shared.value
        matcher = Matcher(profile_of)

        def stays(text: str | None) -> bool:
            lang, score, size = matcher.judged(text)
            bound = next((bound_of[k] for k in ((lang, size), (lang, None), (None, None)) if k in bound_of), least)
            return lang != UNKNOWN and score >= max(bound, least)

        for batch in batches:
            yield batch.filter(pa.array([stays(t.as_py()) for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
