"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

A normalised text is cut where its own characters say so, every chunk becomes a
verified identifier, and a text is then the ordered list of its identifiers.
Chunk texts travel once, to be verified; everything after moves lists of longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACES, keep_documents, store

# A chunk ends behind a sentence mark that follows one of a few letters, at the
# earliest after 128 code points; where no such place comes, after 4096.
CHUNK = r"(?s).{128,4094}?[aeht][.,!?;:](?=.)|.{1,4096}"


def normal_text(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def chunks(normal: Column, pattern: str = CHUNK) -> Column:
    """The content-defined chunks of a normalised text, in order; none of an empty one."""
    return F.regexp_extract_all(normal, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNK,
            hasher=F.xxhash64) -> DataFrame:
    """One row per document: id, n_chars, text_sha256, and its recipe of verified identifiers.

    An identifier is a chunk's hash; where two different chunks share a hash,
    which the grouping by whole content finds out, their ordinals tell them
    apart and are part of the recipe.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = base.select(
        "doc_id",
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        normal_text(F.col("text")).alias("normal"),
    ).select("doc_id", "n_chars", F.sha2("normal", 256).alias("text_sha256"), chunks(F.col("normal"), pattern).alias("pieces"))
    text_key = ["doc_id", "n_chars", "text_sha256"]
    rows = store(cut.select(*text_key, F.transform("pieces", lambda c: hasher(c)).alias("hashes")))
    pieces = cut.select(*text_key, F.posexplode("pieces").alias("pos", "piece")).withColumn("hash", hasher(F.col("piece")))
    contents = pieces.select("hash", "piece").distinct()
    clashing = store(contents.groupBy("hash").count().where("count > 1").select("hash"))
    if clashing.isEmpty():
        return rows.withColumn("ordinals", F.array().cast("array<struct<pos:int,ordinal:int>>"))
    unsure = pieces.join(clashing, "hash", "left_semi")
    order = Window.partitionBy("hash").orderBy("piece")
    ordinal = unsure.select("hash", "piece").distinct().withColumn("ordinal", F.dense_rank().over(order))
    lists = (
        unsure.join(ordinal, ["hash", "piece"]).select(*text_key, "pos", "ordinal").distinct().groupBy(*text_key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "ordinal"))).alias("ordinals"))
    )
    return (
        rows.alias("r").join(lists.alias("l"), F.expr("r.doc_id <=> l.doc_id AND r.n_chars = l.n_chars AND r.text_sha256 = l.text_sha256"), "left")
        .select("r.*", F.coalesce("l.ordinals", F.array().cast("array<struct<pos:int,ordinal:int>>")).alias("ordinals"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = CHUNK,
                 hasher=F.xxhash64) -> DataFrame:
    """Which document stays of every group of equal texts.

    Texts are equal when they are identical without their white space. Of equal
    ones the row with the most code points stays, then the one with the smallest
    id, an unknown id last. Columns: doc_id, keep_id, group_size, kept,
    text_sha256, n_chars. Rows that repeat an id with the same text are one
    document. Null and empty texts form one group; an empty table gives an empty
    result; other columns of ``docs`` are ignored whatever they are called.

    Groups shrink to one row in the map tasks. Only groups of two and more are
    joined back, between two stored tables, so that Spark can split a hot group.
    """
    key = ["hashes", "ordinals"]
    rows = store(recipes(docs, id_col, text_col, pattern, hasher).distinct())
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("back"), "doc_id"))
    groups = store(
        rows.groupBy(*key).agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(*key, F.col("best.doc_id").alias("keep"), "group_size")
    )
    out = rows.join(groups, key, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "n_chars",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The document that stays of every group of equal texts, with all its columns."""
    kept = exact_groups(docs).where("kept").select("doc_id", "text_sha256")
    longest = F.length(F.coalesce("text", F.lit(""))).desc()
    return keep_documents(docs, kept, F.sha2(normal_text(F.col("text")), 256), [longest, F.col("text")])
