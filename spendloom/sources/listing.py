"""Which files lie below some roots, found by tasks that walk the directories."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# Directories below a root that hold no logs.
NOISE_DIRS = ["node_modules", ".git", "__pycache__", "target", "dist", "build"]
#: Names that a task looks at before it hands the directories still ahead back to be dealt anew.
ENTRIES = 2000


def opened(path: str):
    """The file system of a path, and the path as it names it. A path without a scheme is a local one, taken as it is."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(quote(path, safe="/:@"))


def can_seek(path: str) -> bool:
    """Whether tasks can list a path of this kind, and open it at an offset."""
    try:
        opened(path)
    except Exception:  # noqa: BLE001 - a file system that pyarrow does not know
        return False
    return True


def dealt(rows: DataFrame, count: int, *by: str) -> DataFrame:
    """A few small rows, each of which stands for much work, spread over tasks.

    The number of partitions is stated: by their bytes they would all be put together again.
    """
    tasks = max(1, min(count, 4 * rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(tasks, *by)


def walk(spark: SparkSession, roots: Sequence[str], ext: str, recurse: bool, entries: int = ENTRIES) -> DataFrame:
    """``path, size, mtime`` of the files with an extension below some roots, in no order.

    The directories ahead are a table. A task walks down from those it is given
    until it has seen ``entries`` names, and what is then still ahead of it is
    the table of the next round; so a small tree takes one round, and a large
    one as many as it is deep at most. A directory is listed by one task. Hidden
    and noise directories are not entered (a root's own name does not count),
    hidden files not taken; names that start with an underscore are. A root that
    is missing or is a file gives nothing.
    """
    ending = ext.lower()

    def down(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for top in batch.column("path").to_pylist():
                system, inner = opened(top)
                ahead, rows, seen = [(top, inner)], [], 0
                if system.get_file_info(inner).type != fs.FileType.Directory:
                    ahead = []
                # A directory at a time at least, and those nearest to the root first.
                at = 0
                while at < len(ahead) and (at == 0 or seen < entries):
                    path, inner = ahead[at]
                    at += 1
                    for info in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                        name = info.base_name
                        seen += 1
                        if name.startswith("."):
                            continue
                        below = f"{path.rstrip('/')}/{name}"
                        if info.type == fs.FileType.Directory:
                            if recurse and name not in NOISE_DIRS:
                                ahead.append((below, info.path))
                        elif info.type == fs.FileType.File and name.lower().endswith(ending):
                            rows.append((below, info.size, (info.mtime_ns or 0) // 1_000_000, False))
                rows += [(path, 0, 0, True) for path, _ in ahead[at:]]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows[i : i + 10_000]])

    names = ["path", "size", "ms", "ahead"]
    tops = list(dict.fromkeys(root.rstrip("/") or "/" for root in roots))
    ahead, left = spark.createDataFrame([(top,) for top in tops], "path STRING"), len(tops)
    found = None
    while left:
        got = cut_lineage(dealt(ahead, left, "path").mapInArrow(down, "path STRING, size BIGINT, ms BIGINT, ahead BOOLEAN"))
        files = got.filter("NOT ahead")
        found = files if found is None else found.unionByName(files)
        ahead = got.filter("ahead").select("path")
        left = ahead.count()
    if found is None:
        found = spark.createDataFrame([], "path STRING, size BIGINT, ms BIGINT, ahead BOOLEAN")
    # Only roots within each other can find a file twice.
    nested = any(a != b and b.startswith(a.rstrip("/") + "/") for a in tops for b in tops)
    out = found.select(F.regexp_replace("path", r"\Afile:/+", "/").alias("path"), "size", F.timestamp_millis("ms").alias("mtime"))
    return out.distinct() if nested else out
