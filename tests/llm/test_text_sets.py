"""Shingles, near and exact duplicates, and fingerprints against plain versions."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spendloom.llm import common, exact_dedup, merkle, near_dedup, shingles

from .conftest import LONG


def plain_set(text, width=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def plain_components(docs, width=5):
    sets = {d: plain_set(t, width) for d, t in docs.items()}
    label = {d: d for d in docs}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((top(a), top(b)))
                label[high] = low
    return {d: (len(sets[d]), top(d)) for d in docs}


@pytest.mark.parametrize("block", [1 << 20, 64])
def test_shingle_sets(monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK", block)
    monkeypatch.setattr(shingles, "_POWERS", {})
    draw = random.Random(2)
    words = ["a", "B", "b", "É", "é", "x y", "漢", "long" * 40, "."]
    known = {}
    for _ in range(400):
        text = "".join(draw.choice(words) + draw.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(draw.randint(0, 25)))
        got, want = shingles.shingle_set(text), plain_set(text)
        assert len(got) == len(want)
        key = frozenset(want)
        assert known.setdefault(key, got.tolist()) == got.tolist()
    other = shingles.shingle_set("a b c d e f")
    assert shingles.shared(other, shingles.shingle_set("a b c d e g")) == 1
    assert len(shingles.shingle_set(None)) == 0 and len(shingles.shingle_set(" \n")) == 0


def test_densified_sketch_estimates_likeness():
    draw = np.random.default_rng(3)
    pool = shingles.stream(400, 50)
    for size in (8, 40, 300):
        agree = []
        for _ in range(60):
            both = draw.permutation(pool)[: size + size // 4]
            a, b = np.sort(both[:size]), np.sort(both[size // 4:])
            agree.append(np.mean(near_dedup.sketch(a, 120) == near_dedup.sketch(b, 120)))
        want = (size - size // 4) / (size + size // 4)
        assert abs(np.mean(agree) - want) < 0.06


def family(draw, n, words=120, edits=8):
    base = [f"w{draw.randint(0, 5000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randint(0, edits)):
            copy[draw.randrange(words)] = f"e{draw.randint(0, 10**6)}"
        yield " ".join(copy)


def test_near_groups_are_those_of_all_pairs(spark, edge_docs):
    draw = random.Random(4)
    texts = [t for n, words, edits in ((60, 120, 9), (30, 40, 4), (20, 300, 20)) for t in family(draw, n, words, edits)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"o{draw.randint(0, 10**6)}" for _ in range(draw.randint(10, 90))) for _ in range(60)]
    texts += texts[:5]
    draw.shuffle(texts)
    docs = {100 + i: t for i, t in enumerate(texts)} | {r.doc_id: r.text for r in edge_docs.collect() if r.doc_id is not None}
    rows = [(i, t, *["clash"] * 6) for i, t in docs.items()] + [(12, docs[12], *["clash"] * 6), (None, docs[12], *["clash"] * 6)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, id STRING, rep STRING, key STRING, a STRING, share STRING, hashes STRING")
    got = near_dedup.near_groups(frame).collect()
    assert len(got) == len(docs) + 1
    known = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert known == plain_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]


def test_small_sets_link_whatever_buckets_they_share(spark):
    """Pairs at or just above the threshold, with so few bands that most of them share no bucket."""
    draw = random.Random(8)
    docs = {}
    for i in range(60):
        n = draw.choice([3, 6, 12, 40, 90])
        words = [f"w{draw.randint(0, 10**6)}" for _ in range(n + 4)]
        docs[2 * i] = " ".join(words)
        docs[2 * i + 1] = " ".join(words[: n + 4 - n // 4])
    got = near_dedup.near_groups(spark.createDataFrame(list(docs.items()), "doc_id BIGINT, text STRING"), bands=1, rows=8)
    want = plain_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want
    assert sum(d != c for d, (_, c) in want.items()) > 50


def test_rarest_shingles_are_rare_whatever_the_size(spark):
    """Every set shares a tenth with the next one and a passage with all: too little to link, so no key may bring two together."""
    passage, at = shingles.stream(100, 1), shingles.stream(300 * 1900, 1000)
    own = [at[1900 * i:1900 * i + 1900] for i in range(300)]
    rows = [(i, np.unique(np.concatenate([own[i], own[i - 1][:200], passage])).tobytes()) for i in range(300)]
    rows += [(1000 + i, np.unique(np.concatenate([own[i][:1900 - i], passage])).tobytes()) for i in range(3)]
    sets = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id BIGINT, hashes BINARY")
    keys = near_dedup._prefixes(sets, 75)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.collect_set("rep").alias("reps")).where("n > 1")
    assert {tuple(sorted(r.reps)) for r in shared.collect()} == {(i, 1000 + i) for i in range(3)}
    assert keys.count() == keys.distinct().count() and {r.n_shingles for r in keys.where("rep < 1000").collect()} == {2200}


def test_near_empty(no_docs):
    assert near_dedup.near_groups(no_docs).count() == 0


def test_stored_tables_leave_no_shuffles(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    left = lambda: {n for n in (str(f.getName()) for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks.getAllFiles())) if n.startswith("shuffle_")}
    before, conf = left(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    rows = spark.range(0, 10_000, 1, 4).withColumn("k", F.col("id") % 100)
    frame = rows.groupBy("k").count().join(rows.hint("merge"), "k").distinct()
    once, again = common.store(frame), common.store(frame)
    deadline = time.time() + 20
    while left() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not left() - before
    assert once.count() == again.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == conf


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(chain, "a BIGINT, b BIGINT")).collect()}
    assert {i: got.get(i, i) for i in range(41)} == dict.fromkeys(range(41), 0)
    assert got[100] == got[95] == 90 and got[201] == 200
    assert common.components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0


def plain_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    unique = {(i, t) for i, t in rows}
    out = {}
    for i, t in unique:
        same = sorted([(-len(x or ""), j is None, j or 0, j) for j, x in {(j, x or "") for j, x in unique} if norm(x) == norm(t)])
        out[(i, len(t or ""))] = (same[0][-1], len({s for s in same}), hashlib.sha256(norm(t).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hasher", [F.xxhash64, lambda c: (F.length(c) % 3).cast("long")])
def test_exact_groups(spark, edge_docs, hasher):
    a, b = "abcdefgh, " * 300, "abcdefgx, " * 300
    more = spark.createDataFrame([(50, a), (51, b), (52, a + "\n"), (53, b[:-2]), (54, a.replace(" ", ""))], "doc_id BIGINT, text STRING")
    docs = edge_docs.select("doc_id", "text", "kept", "hashes").union(more.selectExpr("*", "'x'", "'y'"))
    got = exact_dedup.exact_groups(docs, hasher=hasher).collect()
    want = plain_exact([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.doc_id, r.n_chars): (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert len(got) == len(want) and all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_dropped_rows_do_not_come_back_under_a_shared_or_missing_id(spark):
    """The text of an id that stays is the one judged, and null ids are judged like others."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, b), (5, a), (5, b), (None, b), (None, c), (None, c), (7, a + " "), (7, a)]
    for repeat in (1, 4):
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id BIGINT, text STRING, mark STRING").repartition(repeat)
        got = exact_dedup.drop_copies(docs)
        assert got.columns == docs.columns
        assert sorted(map(str, got.select("doc_id", "text").collect())) == sorted(
            f"Row(doc_id={i}, text={t!r})" for i, t in [(1, b), (7, a + " "), (None, c)])
    near = near_dedup.drop_near(spark.createDataFrame(
        [(5, a), (5, b), (1, b + " end"), (None, c), (None, c), (None, c + " end"), (None, "alone here")], "doc_id BIGINT, text STRING"))
    got = sorted((str(r.doc_id), r.text) for r in near.collect())
    assert got[:3] == [("1", b + " end"), ("5", a), ("None", "alone here")] and len(got) == 4 and got[3][1] in (c, c + " end")


def test_exact_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_chunks_resynchronise_after_an_edit(spark):
    draw = random.Random(9)
    text = "".join(draw.choice("abcdefght") + (draw.choice(".,;") if draw.random() < 0.1 else "") for _ in range(20_000))
    cut = spark.createDataFrame([(0, text), (1, "inserted" + text)], "i INT, t STRING").select(exact_dedup.chunks(F.col("t")).alias("c")).collect()
    one, two = cut[0].c, cut[1].c
    assert "".join(one) == text and len(set(one) & set(two)) >= 0.8 * len(one)


@pytest.mark.parametrize("run_chars", [2_000_000, 300])
def test_fingerprints(spark, sf, monkeypatch, run_chars):
    monkeypatch.setattr(merkle, "RUN_CHARS", run_chars)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 1").withColumn("tree", F.lit(1)).withColumn("next", F.lit(2))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in merkle.fingerprints(docs).collect()}
    assert set(got) == set(texts)
    for i, d in enumerate(order):
        t, following = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {}
    for d, r in got.items():
        assert same.setdefault(r.fingerprint, texts[d]) == texts[d]
    mean = lambda c: sum(getattr(r, c) for r in got.values()) / len(got)
    assert mean("near_edited") > 0.4 and mean("near_next") < 0.1


def test_fingerprint_edges(edge_docs, no_docs, spark):
    got = merkle.fingerprints(edge_docs).collect()
    assert len(got) == edge_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[4].fingerprint == by[5].fingerprint and by[4].near_edited == 1.0
    assert by[11].fingerprint == by[12].fingerprint
    assert by[8].n_chars == len(LONG) and by[9].near_next > 0.9
    assert merkle.fingerprints(no_docs).count() == 0
    alone = merkle.fingerprints(spark.createDataFrame([(1, "abc def.")], "doc_id BIGINT, text STRING")).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abc abc ").hexdigest()


def test_differing_branches(spark):
    old = "First line here.\nSecond line.\n\nOther part.\nLast line."
    new = "First line here.\nSecond row.\n\nOther part.\nLast line."
    row = spark.createDataFrame([(old, new)], "o STRING, n STRING").select(
        merkle.differing(merkle.tree(F.col("n")), merkle.tree(F.col("o"))).alias("d"),
        merkle.differing(merkle.tree(F.col("o")), merkle.tree(F.col("o"))).alias("same"),
        merkle.tree(F.col("n")).alias("t")).first()
    assert len(row.d) == 1 and row.same == []
    assert len(row.t.sections) > 1
