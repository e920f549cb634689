"""What the operators share: reading tables, intermediate tables in the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# What counts as white space in the contracts: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"


#: What a worker process keeps between tasks, with the operator it belongs to.
_REMEMBERED: list[tuple[str, dict]] = []


def remembered(owner: str, held: dict) -> dict:
    """``held``, known as something that the tasks of ``owner`` keep in their worker process."""
    _REMEMBERED.append((owner, held))
    return held


def working(owner: str) -> None:
    """Called by a task: forget what the tasks of other operators left in this process, which outlives its stage."""
    for other, held in _REMEMBERED:
        if other != owner:
            held.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a folder of its own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    It cuts the lineage like a checkpoint, survives lost executors, and later
    readers take only the columns they need. What was shuffled for it is removed
    once the table is written, so a job holds the shuffles of one table at a time.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in their group by ``order``, and ``size``, the group's rows.

    Rows are cut into sorted ranges over group and order together, so a group
    of any size spreads over many tasks; a table with one row per range and
    group tells how many stand before. ``rows`` must come from a stored table,
    group columns must not be null, and ``order`` must be total up to equal rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*group, *order]
    placed = store(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    # The upper bits of that id are the range's number, the lower 33 the row's place in it.
    part = F.shiftright("__at", 33).alias("__part")
    before = Window.partitionBy(*group)
    runs = placed.groupBy(*group, part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).select(
        *group, "__part", "__first", F.sum("__n").over(before).alias("size"),
        (F.sum("__n").over(before.orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.select("*", part).join(runs, [*group, "__part"]).select(
        *rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("pos"), "size")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges(u, v)`` is either a centre or has exactly one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    counts = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    return counts.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as rows ``(node, component)``, the smallest node naming each.

    Alternates the large-star and small-star steps until only stars are left:
    every node hands its larger neighbours, then its smaller ones, to its
    smallest neighbour. Each step is a grouping with map-side minimum and an
    equi-join, and the edges of one round are a stored table, so neither depth
    nor a hot node gathers in one task.
    """
    now = store(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _are_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = store(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = store(
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .where("u <> v").distinct()
        )
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def keep_documents(docs: DataFrame, kept: DataFrame, mark: Column, order: list[Column], id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``kept(id, mark)`` names; one row per id and mark.

    ``mark`` says, on a row of ``docs``, which text it is; so texts that share
    an id, or have none, are told apart. Of rows with one id and mark the first
    by ``order`` stays. The window follows the join on the same key, so the
    texts are shuffled once, and no group is larger than the copies of one id
    and text.
    """
    def keys(ident: Column, text: Column) -> list[Column]:
        return [ident.isNull().alias("__no_id"), F.coalesce(ident.cast("string"), F.lit("")).alias("__id"), text.alias("__mark")]

    names = ["__no_id", "__id", "__mark"]
    wanted = kept.select(*keys(*(F.col(c) for c in kept.columns[:2]))).distinct()
    named = docs.select("*", *keys(F.col(id_col), mark)).join(wanted, names, "left_semi")
    first = F.row_number().over(Window.partitionBy(*names).orderBy(*order))
    return named.withColumn("__row_of_id", first).where(F.col("__row_of_id") == 1).select(*docs.columns)
