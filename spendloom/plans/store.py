"""The stored tables as plain Parquet that is only ever appended to.

Every pass writes its rows below ``<table>/pass=<name>`` and, when all of them
are there, its own row below ``passes``, which gives it a number. A reader takes
the passes that are published, drops what a later one reset, and keeps the
newest row per key. So a report never sees half a pass, a lost pass leaves rows
nobody reads, what a pass writes is in proportion to what it read, and two
passes at once both count, whichever began first.

A compaction names the passes it takes the place of and stands in their place in
the order, so a pass published while it ran is neither lost nor outdated by it.
Compacted rows have one row per key: a read merges only the keys that later
passes touch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import state
from ..session import no_rows
from ..sources import resume

# Key columns, schema, columns that stay as first written, and those that only a non-empty value replaces.
TABLES = {
    "calls": (["session_uid", "call_key"], schemas.CALLS, ["agent", "project"], []),
    "tool_calls": (["session_uid", "call_key"], schemas.TOOL_CALLS, ["agent", "project"], ["tool"]),
    "identities": (["uid"], schemas.IDENTITIES, ["title"], ["project"]),
    "file_state": (["path"], schemas.FILE_STATE, [], []),
    "scan_status": (["agent"], schemas.SCAN_STATUS, [], []),
    "failures": (["path"], schemas.FAILURES, [], []),
    "tails": (["path"], resume.TAIL, [], []),
    "closed": (["path", "key"], resume.CLOSED, [], []),
    "sessions": (["uid"], schemas.SESSIONS, [], []),
    "cursors": (["source"], schemas.CURSORS, [], []),
    "votes": (["conversation", "path"], schemas.VOTES, [], []),
}
# A pass is seen from its number on; rank is its place in the order of writes, which of a compaction is that of what it replaces.
PASSES = "pass STRING, number BIGINT, rank BIGINT, replaces ARRAY<STRING>"
RESETS = "target STRING, key STRING, pass STRING"


class OldBaseError(RuntimeError):
    """A write that depends on what it read found that another one came first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop_path)

    def _load(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        empty = no_rows(self.spark, schema)
        if not self._exists(path):
            return empty
        return self.spark.read.schema(empty.schema).parquet(path).select(*empty.columns)

    def has(self, table: str) -> bool:
        """Whether any pass has written rows of a table."""
        return self._exists(f"{self.root}/{table}")

    # -- passes

    def passes(self) -> list:
        """Published passes in order; a compaction keeps their number small."""
        if not self._exists(f"{self.root}/passes"):
            return []
        rows = self.spark.read.schema(PASSES).parquet(f"{self.root}/passes").collect()
        return sorted(rows, key=lambda r: (r.number, r["pass"]))

    def version(self) -> int:
        """Number of the newest published pass, 0 before the first."""
        return max((r.number for r in self.passes()), default=0)

    def _shown(self, version: int | None) -> list:
        """The passes that make up a version, less those a compaction of it replaced."""
        rows = [r for r in self.passes() if version is None or r.number <= version]
        gone = {name for r in rows for name in r.replaces}
        return [r for r in rows if r["pass"] not in gone]

    # -- tables

    def _rows(self, table: str, shown: list, schema: str, path: str | None = None) -> DataFrame:
        """Rows of some passes, with ``pass`` and ``at``, which orders passes."""
        rows = self._load(path or table, f"{schema}, pass STRING").where(F.col("pass").isin([r["pass"] for r in shown]) if shown else F.lit(False))
        ranks = [x for r in shown for x in (F.lit(r["pass"]), F.lit(f"{r.rank:012d}-{r['pass']}"))]
        return rows.withColumn("at", F.create_map(*ranks)[F.col("pass")] if ranks else F.lit(None).cast("string"))

    def _kept(self, table: str, shown: list, resets_of: list) -> DataFrame:
        keys, schema, *_ = TABLES[table]
        resets = self._rows(table, resets_of, "target STRING, key STRING", "resets").where(F.col("target") == table)
        last = resets.groupBy("key").agg(F.max("at").alias("reset")).withColumnRenamed("key", keys[0])
        return self._rows(table, shown, schema).join(last, keys[0], "left").where("reset IS NULL OR at >= reset").drop("reset")

    def deltas(self, table: str, version: int | None = None) -> DataFrame:
        """Every written row of a version with its pass, less those a later pass reset."""
        shown = self._shown(version)
        return self._kept(table, shown, shown).drop("at")

    def read(self, table: str, version: int | None = None, also: list | None = None) -> DataFrame:
        """A table as of a version: the newest row per key. A filter on the key reaches the scan.

        ``also`` are passes that are written and not yet published.
        """
        keys, schema, keep, keep_if_empty = TABLES[table]
        shown = [*self._shown(version), *(also or [])]
        base = [r for r in shown if len(r.replaces)]
        newer = [r for r in shown if not len(r.replaces)]
        none = no_rows(self.spark, f"at STRING, {schema}")

        def merged(rows: DataFrame) -> DataFrame:
            # With the pass in front, the order of rows is by pass and then total.
            return state.upsert(none, rows.select(*none.columns), keys=keys, keep=keep, keep_if_empty=keep_if_empty).drop("at")

        if len(base) != 1:
            return merged(self._kept(table, shown, shown))
        whole = self._kept(table, base, newer)
        if not newer:
            return whole.select(*none.drop("at").columns)
        delta = self._kept(table, newer, newer)
        touched = delta.select(*keys).distinct()
        again = merged(whole.join(touched, keys, "left_semi").select(*none.columns).unionByName(delta.select(*none.columns)))
        return whole.join(touched, keys, "left_anti").select(*again.columns).unionByName(again)

    def append(self, changes: dict[str, DataFrame], resets: dict[str, DataFrame] | None = None, after: int | None = None,
               derive: Callable[[Callable[[str], DataFrame], Callable[[str], DataFrame]], tuple[dict, dict]] | None = None) -> int:
        """Write rows of some tables, and keys whose earlier rows no longer count, and publish both at once.

        ``after`` is the version the rows were derived from where they hold only
        if nothing came since; a newer one raises OldBaseError before anything
        is published. ``derive`` gives rows and resets of further tables from a
        reader of the tables as this pass leaves them and one of what the pass
        itself has written, its resets among it; it is asked again if another
        pass comes in between.
        """
        if after is not None and self.version() != after:
            raise OldBaseError(f"version {self.version()} is newer than {after}, which this write was made from")
        name = uuid.uuid4().hex
        self._write(name, changes, resets or {})
        number = self.version() + 1
        while derive is not None:
            own = [Row(**{"pass": name, "number": number, "rank": number, "replaces": []})]
            self._write(name, *derive(lambda table, base=number - 1, own=own: self.read(table, base, own), lambda table: self._written(name, table)))
            if self.version() + 1 == number:
                break
            number = self.version() + 1
        if after is not None and self.version() != after:
            raise OldBaseError(f"version {after} was overtaken while this write ran")
        number = self.version() + 1
        self._publish([(name, number, number, [])])
        return number

    def _written(self, name: str, table: str) -> DataFrame:
        return self._load(f"{table}/pass={name}", TABLES[table][1] if table in TABLES else "target STRING, key STRING")

    def _write(self, name: str, changes: dict[str, DataFrame], resets: dict[str, DataFrame]) -> None:
        for table, rows in changes.items():
            # What is derived anew replaces what was derived before.
            rows.write.mode("overwrite").parquet(f"{self.root}/{table}/pass={name}")
        for table, keys in resets.items():
            if table in TABLES:
                named = keys.select(F.lit(table).alias("target"), F.col(keys.columns[0]).alias("key")).distinct()
                named.write.mode("append").parquet(f"{self.root}/resets/pass={name}")

    def _publish(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, PASSES).coalesce(1).write.mode("append").parquet(f"{self.root}/passes")

    def compact(self) -> int:
        """Rewrite every table as one pass in the place of those there are; passes published meanwhile stay as they are."""
        version = self.version()
        names = [r["pass"] for r in self._shown(version)]
        name = uuid.uuid4().hex
        self._write(name, {t: self.read(t, version) for t in TABLES if self.has(t)}, {})
        number = self.version() + 1
        self._publish([(name, number, version, names)])
        return number
