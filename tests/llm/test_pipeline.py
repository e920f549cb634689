"""The stages of the corpus pipeline, each on what the one before it kept."""

import collections
import re

import pytest

import corpus_pipeline
from spendloom.llm.common import store

from .test_text_sets import plain_components


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "'x' AS hashes", "doc_id AS id")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], sf)))
    return out


def test_columns_and_rows(steps):
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0
    assert "sequence_id" in steps[5].columns


def test_good_documents_stay(spark, steps, sf):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    good = [d for d, mark in labels.items() if mark == (1, 0)]
    assert sum(d in kept for d in good) >= 0.95 * len(good)
    assert steps[2].count() >= 0.99 * steps[1].count()


def test_exact_copies_go(steps):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in steps[2].collect():
        groups[norm(r.text)].append((-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(min(g)[1] for g in groups.values())


def test_near_copies_go(steps):
    want = plain_components({r.doc_id: r.text for r in steps[3].collect()})
    assert sorted(r.doc_id for r in steps[4].collect()) == sorted(d for d, (_, c) in want.items() if d == c)


def test_everything_left_is_packed(steps):
    assert {r.doc_id for r in steps[5].collect()} == {r.doc_id for r in steps[4].collect()}
    fill = collections.Counter()
    for r in steps[5].collect():
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_edges(spark, sf, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = store(stage(spark, at, sf))
            assert at.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, at, sf).collect()
