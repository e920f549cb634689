"""From log files to numbered lines, and from lines to decoded records."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .listing import NOISE_DIRS, can_seek, dealt, opened, walk

#: Bytes at the start and at the end of what was consumed whose digest tells whether a log still begins with it.
WINDOW = 4096
#: Bytes of a file that one task reads from an offset.
RANGE = 64 << 20


# ---------------------------------------------------------------- discovery


def _existing(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """Paths the file system has for these paths or globs; none is not an error."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for pattern in patterns:
        path = hadoop.Path(pattern)
        found = path.getFileSystem(conf).globStatus(path)
        out += [status.getPath().toString() for status in (found or [])]
    return out


def _any_case(ext: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\Afile:/+", "/")


def _underscored(spark: SparkSession, roots: Sequence[str], recurse: bool) -> tuple[list[str], list[tuple]]:
    """Directories, and files as (path, size, mtime), below some roots whose own name starts with an underscore.

    A Spark listing hides both. Level by level the file system is asked for such
    names only, down to where nothing lies deeper.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()

    def glob(pattern: str):
        path = hadoop.Path(pattern)
        return path.getFileSystem(conf).globStatus(path) or []

    dirs, files = [], []
    for root in roots:
        level = root.rstrip("/")
        while True:
            for status in glob(f"{level}/_*"):
                name = status.getPath().toString()
                if status.isDirectory():
                    dirs += [name] if recurse else []
                else:
                    files.append((name, status.getLen(), status.getModificationTime()))
            level += "/*"
            if not recurse or not len(glob(level + "/*")):
                break
    return list(dict.fromkeys(dirs)), list(dict.fromkeys(files))


def _shown(files: DataFrame, roots: Sequence[str], recurse: bool) -> DataFrame:
    """Drop files below a hidden or noise directory; a root's own name does not count."""
    keep = F.lit(False)
    for root in roots:
        base = root.rstrip("/") + "/"
        below = F.substring(F.col("path"), len(base) + 1, 1 << 30)
        dirs = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
        noisy = F.exists(dirs, lambda d: F.startswith(d, F.lit(".")) | d.isin(NOISE_DIRS))
        here = F.startswith(F.col("path"), F.lit(base)) & ~noisy
        keep = keep | (here if recurse else here & (F.size(dirs) == 0))
    return files.filter(keep)


def discover(
    spark: SparkSession, roots: Sequence[str], ext: str = ".jsonl", recurse: bool = True
) -> DataFrame:
    """``path, size, mtime`` of the log files below some roots, in no order. Missing roots are skipped.

    Tasks walk the directories; only a file system that they cannot open is listed by the driver.
    """
    if all(map(can_seek, roots)):
        return walk(spark, roots, ext, recurse)
    dirs, more = _underscored(spark, roots, recurse)
    named = [(p, n, t) for p, n, t in more if p.lower().endswith(ext.lower())]
    found = spark.createDataFrame(named, "path STRING, size BIGINT, ms BIGINT").select(
        _plain_path(F.col("path")).alias("path"), "size", F.timestamp_millis("ms").alias("mtime"))
    paths = list(dict.fromkeys(_existing(spark, roots) + dirs))
    if paths:
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", _any_case(ext))
            .load(paths)
            .select(
                _plain_path(F.col("path")).alias("path"),
                F.col("length").alias("size"),
                F.col("modificationTime").alias("mtime"),
            )
        )
        found = listed.unionByName(found)
    return _shown(found, roots, recurse).distinct()


# ---------------------------------------------------------------- lines


def complete_lines(docs: DataFrame, text: str = "content") -> DataFrame:
    """Numbered newline-terminated lines of whole documents.

    What follows the last newline is either nothing or a record still being
    written, and is left for a later pass.
    """
    rest = [c for c in docs.columns if c != text]
    parts = F.split(F.col(text), "\n")
    whole = F.slice(parts, 1, F.size(parts) - 1)
    return docs.select(*rest, F.posexplode(whole).alias("ordinal", "line")).withColumn(
        "ordinal", F.col("ordinal").cast("bigint")
    )


def read_lines(
    spark: SparkSession,
    roots: Sequence[str],
    agent: str,
    ext: str = ".jsonl",
    recurse: bool = True,
    files: Sequence[str] | None = None,
) -> DataFrame:
    """``path, agent, ordinal, line`` of every complete line below some roots, or of some files.

    All files are read as split text, so no task ever sees more than a split and
    the line that ends it. Lines are numbered inside their split and shifted by
    what the splits before hold.
    """
    if files is None:
        dirs, more = _underscored(spark, roots, recurse)
        paths = list(dict.fromkeys(_existing(spark, roots) + dirs))
        hidden = [p for p, *_ in more if p.lower().endswith(ext.lower())]
    else:
        paths = [p for p in files if not p.rsplit("/", 1)[-1].startswith("_")]
        hidden = [p for p in files if p.rsplit("/", 1)[-1].startswith("_")]
    parts = []
    if paths:
        split = (
            spark.read.option("lineSep", "\n")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", _any_case(ext))
            .text(paths)
            .select(
                F.col("value").alias("line"),
                # This column is percent-encoded, unlike a listing's.
                _plain_path(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))).alias("path"),
                F.col("_metadata.file_block_start").alias("block"),
                F.col("_metadata.file_size").alias("size"),
                F.monotonically_increasing_id().alias("_at"),
            )
        )
        parts.append(_split_lines(split if files is not None else _shown(split, roots, recurse)))
    if hidden:
        streamed = _stream_lines(spark.createDataFrame([(p,) for p in hidden], "path STRING"))
        parts.append(streamed if files is not None else _shown(streamed, roots, recurse))
    if not parts:
        return spark.createDataFrame([], "path STRING, agent STRING, ordinal BIGINT, line STRING")
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return lines.select("path", F.lit(agent).alias("agent"), "ordinal", "line")


def _stream_lines(files: DataFrame) -> DataFrame:
    """Complete lines of the files no Spark reader lists, each streamed by one task, a line at a time."""

    def read(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, inner = opened(path)
                rows, held = [], 0
                with system.open_input_stream(inner) as raw:
                    for i, line in enumerate(io.BufferedReader(raw, 1 << 20)):
                        if line.endswith(b"\n"):
                            rows.append((i, line[:-1]))
                            held += len(line)
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist([{"path": path, "ordinal": i, "raw": x} for i, x in rows])
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{"path": path, "ordinal": i, "raw": x} for i, x in rows])

    rows = files.repartition("path").mapInArrow(read, "path STRING, ordinal BIGINT, raw BINARY")
    return rows.select(_plain_path(F.col("path")).alias("path"), "ordinal", F.col("raw").cast("string").alias("line"))


def windows(files: DataFrame) -> DataFrame:
    """``path, windows`` of ``files(path, upto)``: a digest of the first and the last WINDOW bytes before ``upto``.

    Null where the file is shorter than that or cannot be read.
    """

    def digest(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for path, upto in zip(batch.column("path").to_pylist(), batch.column("upto").to_pylist(), strict=True):
                try:
                    system, inner = opened(path)
                    with system.open_input_file(inner) as raw:
                        head = raw.read(min(WINDOW, upto))
                        raw.seek(max(0, upto - WINDOW))
                        tail = raw.read(min(WINDOW, upto))
                    whole = len(head) == len(tail) == min(WINDOW, upto)
                    out.append(hashlib.sha256(head + tail).hexdigest() if whole else None)
                except Exception:  # noqa: BLE001 - told by whoever reads the file
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "windows"])

    files = cut_lineage(files.select("path", F.col("upto").cast("bigint").alias("upto")))
    return dealt(files, files.count(), "path").mapInArrow(digest, "path STRING, windows STRING")


def read_ranges(files: DataFrame, agent: str, chunk: int = RANGE) -> DataFrame:
    """``path, agent, ordinal, line`` of the complete lines of ``files(path, start, size, first)`` from byte ``start`` on.

    ``start`` is where a line begins and ``first`` its number. A file is cut into
    ranges of ``chunk`` bytes, each read by a task that opens it there; a line
    belongs to the range it begins in. Of files of several ranges the line ends
    are counted first, so that a line is numbered where it is read.
    """

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for job in batch.to_pylist():
                system, inner = opened(job["path"])
                at, n = max(job["start"], job["begin"] - 1), 0
                with system.open_input_file(inner) as raw:
                    raw.seek(at)
                    while at < job["end"] - 1:
                        block = raw.read(min(1 << 22, job["end"] - 1 - at))
                        if not block:
                            break
                        n += block.count(b"\n")
                        at += len(block)
                out.append({"path": job["path"], "begin": job["begin"], "n": n})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("begin", pa.int64()), ("n", pa.int64())]))

    def read(batches):
        import io

        import pyarrow as pa

        def packed(path, first, rows):
            n = len(rows)
            columns = [pa.array([path] * n), pa.array(range(first, first + n), pa.int64()), pa.array(rows, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "ordinal", "raw"])

        for batch in batches:
            for job in batch.to_pylist():
                system, inner = opened(job["path"])
                with system.open_input_file(inner) as raw:
                    at = job["begin"]
                    # A range that does not begin a file begins behind the next newline.
                    raw.seek(at - (at > job["start"]))
                    source = io.BufferedReader(raw, 1 << 20)
                    if at > job["start"]:
                        at += len(source.readline()) - 1
                    rows, held, n = [], 0, job["first"]
                    while at < job["end"]:
                        line = source.readline()
                        if not line.endswith(b"\n"):
                            break
                        rows.append(line[:-1])
                        at += len(line)
                        held += len(line)
                        if held > 1 << 22:
                            yield packed(job["path"], n, rows)
                            rows, held, n = [], 0, n + len(rows)
                    if rows:
                        yield packed(job["path"], n, rows)

    begins = F.sequence("start", F.greatest("start", F.col("size") - 1), F.lit(chunk).cast("bigint"))
    ranges = cut_lineage(files.filter("size > start").select("path", "start", "size", "first", F.explode(begins).alias("begin")).select(
        "path", "start", "first", "begin", F.least("size", F.col("begin") + chunk).alias("end"), (F.col("size") - F.col("start") > chunk).alias("cut")))
    known = ranges.agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("cut")).first()
    numbered = ranges
    if known.cut:
        counted = dealt(ranges.filter("cut"), known.cut, "path", "begin").mapInArrow(count, "path STRING, begin BIGINT, n BIGINT")
        before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
        # Lines that begin before a later range: one, and one behind every newline.
        shift = counted.select("path", "begin", (1 + F.sum("n").over(before)).alias("shift"))
        numbered = ranges.join(shift, ["path", "begin"], "left").withColumn("first", F.col("first") + F.coalesce("shift", F.lit(0)))
    jobs = numbered.select("path", "start", F.col("first").cast("bigint").alias("first"), "begin", "end")
    rows = dealt(jobs, known.n, "path", "begin").mapInArrow(read, "path STRING, ordinal BIGINT, raw BINARY")
    return rows.select("path", F.lit(agent).alias("agent"), "ordinal", F.col("raw").cast("string").alias("line"))


def read_files(files: DataFrame, roots: Sequence[str], agent: str, ext: str = ".jsonl", chunk: int = RANGE) -> DataFrame:
    """Complete lines of ``files(path, size)``, up to the sizes they were listed with.

    Their names stay a table. Only files that tasks cannot open at an offset are
    named to Spark's own reader by the driver.
    """
    if all(map(can_seek, roots)):
        from_start = files.select("path", F.lit(0).cast("bigint").alias("start"), "size", F.lit(0).cast("bigint").alias("first"))
        return read_ranges(from_start, agent, chunk)
    return read_lines(files.sparkSession, roots, agent, ext, files=[r.path for r in files.select("path").collect()])


def unreadable(files: DataFrame) -> DataFrame:
    """``path, error`` of every one of ``files(path)`` that cannot be opened or read to its end, found by one job.

    A file system that is unknown to pyarrow says nothing about its files.
    """

    def probe(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                if not can_seek(path):
                    continue
                system, inner = opened(path)
                try:
                    with system.open_input_stream(inner) as raw:
                        while raw.read(1 << 20):
                            pass
                except Exception as error:  # noqa: BLE001 - told per file
                    rows.append({"path": path, "error": f"{type(error).__name__}: {error}"})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return cut_lineage(dealt(files.select("path"), files.count(), "path").mapInArrow(probe, "path STRING, error STRING"))


def _split_lines(split: DataFrame) -> DataFrame:
    """Number the lines of split text files and drop an unterminated last one.

    ``_at`` counts up without gaps inside a split, so a line's place in it is the
    distance to the split's first; one row per split carries that and the shift.
    """
    along = Window.partitionBy("path").orderBy("block")
    held = (
        split.groupBy("path", "block")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"),
            F.sum(F.octet_length("line") + 1).alias("bytes"), F.max("size").alias("size"),
        )
        .select(
            "path",
            "block",
            "first",
            F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
            F.sum("n").over(Window.partitionBy("path")).alias("lines"),
            # Every line but an unterminated last one is followed by a newline.
            (F.sum("bytes").over(Window.partitionBy("path")) > F.col("size")).alias("open_end"),
        )
    )
    return (
        split.drop("size").join(held, ["path", "block"])
        .withColumn("ordinal", F.col("shift") + F.col("_at") - F.col("first"))
        .filter(~(F.col("open_end") & (F.col("ordinal") == F.col("lines") - 1)))
        .select("path", "ordinal", "line")
    )


# ---------------------------------------------------------------- records


def decode(lines: DataFrame, members: str, keep: Sequence[str] = ("path", "ordinal")) -> DataFrame:
    """Decode each line's JSON object into struct ``r`` with the given members.

    ``r`` is null for a line that is no valid object. The wrapper object makes
    trailing text after the record an error. A member of the wrong type marks the
    record as corrupt although the rest of it is good, so only those few lines are
    parsed a second time to tell the two cases apart.
    """
    wrapped = F.concat(F.lit('{"r":'), F.col("line"), F.lit("}"))
    parsed = F.from_json(
        wrapped, f"r STRUCT<{members}>, _corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"}
    )
    good = F.col("_p._corrupt").isNull() | F.try_parse_json(wrapped).isNotNull()
    return lines.select(*keep, "line", parsed.alias("_p")).select(
        *keep, F.when((F.octet_length("line") >= 2) & good, F.col("_p.r")).alias("r")
    )


def rejects(lines: DataFrame) -> DataFrame:
    """Lines that hold no JSON object, as ``path, ordinal``: reported, never fatal."""
    return decode(lines, "_none: STRING").filter("r is null").select("path", "ordinal")
