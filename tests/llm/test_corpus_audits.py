"""Source divergence, projection collisions and the dataset manifest against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendloom.llm import common, divergence, manifest, vectors

from .conftest import LONG


# --- source divergence


def plain_audit(rows, least=30, most=50):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = set()
    for lang in docs:
        kept = [w for w, n in docs[lang].items() if n >= least]

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 5) // (total + 5 * len(kept)) for w in kept}

        groups = [g for g in counts if g[0] == lang]
        whole = sum((counts[g] for g in groups), Counter())
        own = {g: shares(counts[g]) for g in groups}
        all_of = shares(whole)
        for g in groups:
            pairs = sorted((-sum(abs(own[g][w] - own[o][w]) for w in kept), o[1].encode(), o[1]) for o in groups if o != g)
            out |= {(lang, g[1], "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            terms = sorted((all_of[w] - own[g][w], w.encode(), w) for w in kept if counts[g][w] and own[g][w] > all_of[w])[:most]
            out |= {(lang, g[1], "term", w, -v, i + 1) for i, (v, _, w) in enumerate(terms)}
    return out


def test_divergence_of_edge_rows(edge_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in edge_docs.collect()]
    assert {tuple(r) for r in divergence.audited(edge_docs).collect()} == plain_audit(rows)
    assert divergence.audited(no_docs).collect() == []


def test_divergence_over_many_blocks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [("en" if i % 3 else None, f"s{draw.integers(9)}" if i % 7 else None, " ".join(f"W{chr(97 + int(k))}É" for k in draw.geometric(0.2, 30) % 26))
            for i in range(400)]
    rows += [("xx", "lone", "never kept"), ("xx", "other", None), ("en", "bare", "12 34")]
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "PIECE", 7)
    audit = divergence.Audit(spark.createDataFrame(rows, "lang string, source string, text string"), least_docs=10, group_block=2, term_block=3)
    got = {(r.lang, r.source, "pair", r.item, r.value, r["rank"]) for r in audit.pairs().collect()}
    got |= {(r.lang, r.source, "term", r.item, r.value, r["rank"]) for r in audit.terms(4).collect()}
    assert got == plain_audit(rows, 10, 4)
    assert audit.slices().groupBy("lang").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] > 3


def test_shares_are_exact_beyond_longs(spark):
    n, total, terms = 4 * 10**12 + 7, 9 * 10**12 + 1, 12345
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (total + 5 * terms)


# --- projection collisions


def plain_links(rows, threshold=0.93):
    unit = {}
    for i, (_, label, v) in enumerate(rows):
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not np.any(v):
            continue
        u = np.asarray(v, float) / max(map(abs, v))
        unit[i] = (label, u / np.linalg.norm(u))
    near = {i: set() for i in range(len(rows))}
    for i, (a, x) in unit.items():
        for j, (b, y) in unit.items():
            if i != j and a == b and len(x) == len(y) and x @ y >= threshold:
                near[i].add(j)
    out = []
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def cloud(n, dim, seed):
    """Groups of vectors around common centres, close to and far from the threshold."""
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((5, dim))
    out = []
    for i in range(n):
        v = centres[draw.integers(5)] + draw.choice([0, 0.1, 0.2, 0.35, 0.6]) * draw.standard_normal(dim)
        out.append((i, int(draw.integers(2)), [float(x) for x in v * draw.uniform(0.1, 9)]))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_links_match_all_pairs(spark, block):
    rows = cloud(300, 24, 1) + cloud(40, 3, 2)
    rows = [(i, label, v) for i, (_, label, v) in enumerate(rows)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, vectors.near_groups(df, block=block).collect()), key=str) == plain_links(rows)


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, 0, one, "a"), (2, 0, [2.0, 4.0, 6.0], "a"), (2, 0, one, "a"), (3, None, one, "a"), (4, 0, None, "a"), (5, 0, [], "a"), (6, 0, [0.0, -0.0, 0.0], "a"),
            (7, 0, [1.0, None, 3.0], "a"), (8, 0, [1.0, float("nan"), 3.0], "a"), (9, 0, [float("inf"), 2.0, 3.0], "a"), (10, 0, [1.0, 2.0], "a"), (11, 1, one, "a"),
            (None, 0, one, "a"), (None, 3, one, "a"), (12, 0, [1e300, 2e300, 3e300], "a"), (13, 0, [1e-300, 2e-300, 3e-300], "a"), (14, 0, [1.0, 0.0, -1.0], "a"),
            (15, 0, [1.0, -0.0, -1.0], "a"), (16, 0, [0.0, 0.0, 1.0], "a")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, node string").withColumn("kind", F.lit("clash"))
    assert sorted(map(tuple, vectors.near_groups(df).collect()), key=str) == plain_links([r[:3] for r in rows])
    assert vectors.near_groups(df.limit(0)).collect() == []


def test_collision_counts_match_windows():
    draw = np.random.default_rng(5)
    x, y = draw.standard_normal((70, 13)), draw.standard_normal((131, 13))
    count = (np.abs(x[:, None] - y[None]) <= 0.8).sum(2)
    for least in (1, 5, 8, 13):
        assert (vectors.candidates(x, y, 0.8, least) == (count >= least)).all()


def test_count_is_calibrated():
    """Pairs just at the threshold reach the count as often as asked for, and random ones hardly ever."""
    draw = np.random.default_rng(6)
    x = draw.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = draw.standard_normal(x.shape)
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * other
    half = vectors.reach(0.93) * vectors.HALF_WINDOW
    basis = vectors.directions(64)
    hits = (np.abs(x @ basis - y @ basis) <= half).sum(1)
    for recall in (0.5, 0.9, 0.999):
        assert (hits >= vectors.least_count(recall)).mean() >= recall - 0.03
    assert (hits >= vectors.least_count(vectors.RECALL)).all()
    assert vectors.candidates(x[:500] @ basis, other[500:1000] @ basis, half, vectors.least_count(vectors.RECALL)).mean() < 0.001


# --- manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_manifest(rows, arity=3):
    """Rows as (doc_id, source, lang, n_chars, text)."""
    def grown(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i:i + arity]) for i in range(0, len(levels[-1]), arity)])
        return levels

    def path(levels, at):
        out = []
        for nodes in levels[:-1]:
            start = at - at % arity
            out.append((nodes[start:at], nodes[at + 1:start + arity]))
            at //= arity
        return out

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, digest(*map(part, r)), r))
    trees = {s: (sorted(v, key=lambda x: x[:3]), None) for s, v in by.items()}
    trees = {s: (v, grown([x[2] for x in v])) for s, (v, _) in trees.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = grown([trees[s][1][-1][0] for s in order])
    out = []
    for s, (members, levels) in trees.items():
        for i, (_, _, leaf, r) in enumerate(members):
            steps = path(levels, i) + path(top, order.index(s))
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = digest(*map(part, (*r[:4], None if r[4] is None else r[4].replace("\n", ""))))
            for left, right in steps:
                now = digest(*left, now, *right)
            proof = digest(*(x for left, right in steps for x in left + right))
            out.append((r[0], leaf, levels[-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows():
    rows = [(i, f"s{i % 4}" if i % 4 else None, "en", 5, f"line {i}\nend\n" if i % 3 else f"line {i}") for i in range(300)]
    rows += [(i, f"lone{i}" if i % 2 else "é" * (i % 5), None, None, None) for i in range(400, 420)]
    return rows + [(500, "big", "en", len(LONG), LONG), (501, "", None, 0, ""), (502, "dup", "de", 1, "a\n"), (502, "dup", "de", 1, "a\n"), (502, "dup", "de", 1, "b"),
                   (None, "dup", None, 1, "a\n"), (None, None, None, None, None)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("stride", [1, 2, 4])
def test_manifest(spark, stride, monkeypatch):
    monkeypatch.setattr(manifest, "build", lambda docs, extra, f=manifest.build: f(docs, extra=extra, stride=stride))
    df = spark.createDataFrame(manifest_rows(), SCHEMA).select("*", F.lit("x").alias("key"), F.lit("y").alias("pos"), F.lit(1).alias("digest"))
    assert sorted(map(tuple, manifest.audited(df.repartition(3)).collect()), key=str) == plain_manifest(manifest_rows())


def test_manifest_of_little(spark, no_docs):
    assert manifest.audited(no_docs).collect() == []
    assert manifest.build(no_docs).root is None
    lone = [(1, "a", None, 3, "b\nc")]
    assert [tuple(r) for r in manifest.audited(spark.createDataFrame(lone, SCHEMA)).collect()] == plain_manifest(lone)


def test_proofs_of_some(spark):
    """Wanted proofs are those of the whole manifest, fold to the root, and touch only their own subtrees."""
    built = manifest.build(spark.createDataFrame(manifest_rows(), SCHEMA), stride=2)
    wanted = spark.createDataFrame([(7,), (101,), (405,), (9999,)], "doc_id long")
    some = {r.doc_id: r for r in built.proofs(wanted).collect()}
    every = {r.doc_id: r for r in built.proofs().collect() if r.doc_id in some}
    assert sorted(some) == [7, 101, 405] and some == every
    for r in some.values():
        assert manifest.fold(r.digest, [(s.left, s.right) for s in r.path]) == built.root
        assert manifest.fold("0" * 64, [(s.left, s.right) for s in r.path]) != built.root
    stored = [level.count() for level in built.sources.levels]
    assert stored[1] < stored[0] / 4


def test_places_in_groups(spark):
    """Places are dense in each group however many ranges it is cut into."""
    rows = spark.range(1000).selectExpr("IF(id % 3 < 2, 'hot', concat('g', id % 50)) AS g", "id * 7919 % 1000 AS v")
    got = common.ranked(common.store(rows), ["g"], ["v"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r)
    for members in by.values():
        members.sort(key=lambda r: r.v)
        assert [r.pos for r in members] == list(range(len(members))) and {r.size for r in members} == {len(members)}
