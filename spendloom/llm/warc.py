"""WARC archives: writing captures, streaming them back, and assembling each capture's records.

An archive is written by Spark's own text writer: a record's value is its header
block and payload, and the line separator is the blank lines that end a record.
So task retries and lost executors are the writer's business. Archives are read
by one task each, as a stream that holds one record at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, store

CRLF = "\r\n"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource", "conversion")

# A payload this long or longer is stored once.
REVISIT_FROM = 100
# Rows of an archive file at most; a file is the unit of reading.
RECORDS_PER_FILE = 60_000


def _lines(*lines: Column) -> Column:
    """Header lines; a line whose value is null is left out."""
    return F.concat_ws(CRLF, *lines)


def _field(name: str, value: Column) -> Column:
    """``name: value``, null for a null value; line breaks would end the header, so they become spaces."""
    return F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "))


def _record(kind: str, head: list[Column], block: Column) -> Column:
    """One whole record but for the two line ends behind it. ``block`` is binary."""
    top = _lines(F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}"), *head,
                 _field("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.encode(F.concat(top, F.lit(CRLF * 2)), "UTF-8"), block)


def _uuid(kind: str, *parts: Column) -> Column:
    """A record id that is the same whenever the same capture is written."""
    hexes = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexes, r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
             revisit_from: int = REVISIT_FROM) -> DataFrame:
    """Pages with payload, digest, record id, and the id of the record each one revisits (null: it is the response).

    Among equal payloads of ``revisit_from`` bytes and more the smallest id is
    the response. Only ids and digests are joined; hot digests are reduced in
    the map tasks and Spark may split them in the join. Repeated equal rows are
    one capture.
    """
    payload = F.col(payload_col)
    as_bytes = F.coalesce(payload if dict(pages.dtypes)[payload_col] == "binary" else F.encode(payload, "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), as_bytes.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    rows = rows.withColumn("record_id", _uuid("response", F.col("page_id"), F.col("url"), F.col("digest")))
    narrow = store(rows.where(F.col("size") >= revisit_from).select("record_id", "page_id", "digest").distinct())
    first = store(
        narrow.groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", F.col("first.record_id").alias("refers"))
    )
    again = narrow.join(first, "digest").where("record_id <> refers").select("record_id", "refers")
    return rows.join(again, "record_id", "left")


def write_archives(found: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z",
                   per_file: int = RECORDS_PER_FILE) -> None:
    """Write request, response or revisit, and metadata record of every capture below ``path``.

    Request and metadata name the response in WARC-Concurrent-To. A revisit has
    the HTTP header and the digest of the payload but not the payload itself.
    """
    when, rid = F.lit(f"WARC-Date: {date}"), F.col("record_id")
    target = _field("WARC-Target-URI", F.col("url"))
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                  _field("Content-Length", F.col("size").cast("string")), F.lit(CRLF))
    page = F.when(F.col("refers").isNull(), F.concat(F.encode(http, "UTF-8"), F.col("payload"))).otherwise(F.encode(http, "UTF-8"))
    ids = [_field("WARC-Record-ID", rid), when, target]
    digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    kind = F.lit("Content-Type: application/http; msgtype=response")
    main = F.when(F.col("refers").isNull(), _record("response", [*ids, digest, kind], page)).otherwise(
        _record("revisit", [*ids, digest, F.lit(f"WARC-Profile: {PROFILE}"), _field("WARC-Refers-To", F.col("refers")), kind], page))

    def beside(what: str, media: str, block: Column) -> Column:
        own = [_field("WARC-Record-ID", _uuid(what, F.col("page_id"), F.col("url"), F.col("digest"))), when, target]
        return _record(what, [*own, _field("WARC-Concurrent-To", rid), F.lit(f"Content-Type: {media}")], F.encode(block, "UTF-8"))

    path_part = F.coalesce(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^\s]*)", 1), F.lit(""))
    request = beside("request", "application/http; msgtype=request", F.concat(F.lit("GET "), F.when(path_part == "", "/").otherwise(path_part), F.lit(" HTTP/1.1"), F.lit(CRLF * 2)))
    metadata = beside("metadata", "application/warc-fields", F.concat(
        F.coalesce(_field("page-id", F.col("page_id").cast("string")), F.lit("page-id:")), F.lit(CRLF)))
    records = found.select(F.explode(F.array(request, main, metadata)).alias("record"))
    (records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", CRLF * 2)
     .option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path))


def _records(stream) -> Iterator[tuple[dict[str, list[str]], object, int]]:
    """(header fields, stream at the block, block length) of each record; the caller reads the block to its end."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        yield fields, stream, int(fields.get("content-length", ["0"])[0])


def _http_header(stream, length: int) -> tuple[bytes, int]:
    """The HTTP header block at the start of a record's block, and how many bytes are left behind it."""
    head = bytearray()
    while length > 0 and (line := stream.readline(length)):
        head += line
        length -= len(line)
        if line in (b"\r\n", b"\n"):
            break
    return bytes(head), length


READ_SCHEMA = (
    "record_id STRING, record_type STRING, target_uri STRING, date STRING, concurrent_to ARRAY<STRING>, refers_to STRING,"
    " declared_digest STRING, declared_size BIGINT, payload_digest STRING, payload_bytes BIGINT, header STRING, payload BINARY"
)
ARROW_SCHEMA = pa.schema([
    *[(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "date")], ("concurrent_to", pa.list_(pa.string())),
    ("refers_to", pa.string()), ("declared_digest", pa.string()), ("declared_size", pa.int64()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("header", pa.string()), ("payload", pa.binary()),
])
STEP = 1 << 20
#: Payloads of at most this size in other records than captures (requests, metadata) are always kept.
SMALL = 1 << 16


def _parsed(stream, payloads: bool) -> Iterator[dict]:
    for fields, body, length in _records(stream):
        one = lambda n: fields.get(n, [None])[0]
        kind = (one("warc-type") or "").lower()
        http = (one("content-type") or "").startswith("application/http")
        header, left = _http_header(body, length) if http else (b"", length)
        whole, size = hashlib.sha256(), left
        keep = bytearray() if payloads or (kind not in ANCHORS and left <= SMALL) else None
        while left > 0 and (part := body.read(min(STEP, left))):
            whole.update(part)
            left -= len(part)
            if keep is not None:
                keep += part
        if left:
            raise ValueError(f"record {one('warc-record-id')} ends {left} bytes early")
        names = dict(x.lower().split(":", 1) for x in header.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
        told = names.get("content-length", "").strip()
        yield {
            "record_id": one("warc-record-id"), "record_type": kind, "target_uri": one("warc-target-uri"), "date": one("warc-date"),
            "concurrent_to": fields.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
            "declared_digest": one("warc-payload-digest"), "declared_size": int(told) if told.isdigit() else None,
            "payload_digest": whole.hexdigest(), "payload_bytes": size, "header": header.decode("utf-8", "replace"),
            "payload": bytes(keep) if keep is not None else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``, plain or gzip, one member or many.

    Spark lists the files; each is one task's stream. Without ``payloads`` the
    payload of a capture is only measured and digested as it passes by.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    count = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name in batch.column("path").to_pylist():
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_stream(inner, compression=None) as raw:
                    plain = io.BufferedReader(raw, STEP)
                    stream = gzip.GzipFile(fileobj=plain) if plain.peek(2)[:2] == b"\x1f\x8b" else plain
                    rows, held = [], 0
                    for row in _parsed(io.BufferedReader(stream, STEP), payloads):
                        rows.append(row)
                        held += len(row["payload"] or b"") + 500
                        if held > 8 * STEP:
                            yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, ARROW_SCHEMA)

    return files.select("path").repartition(count, "path").mapInArrow(read, READ_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its request, the response or revisit itself, and its metadata records.

    Captures are the response, revisit, resource and conversion records. Another
    record belongs to a capture when either names the other in
    WARC-Concurrent-To, or when it is concurrent to a record that does. A record
    that several captures claim goes to the one with the smallest record id; one
    that belongs to none is left out. A record id that occurs twice counts once.
    Of several requests the one with the smallest record id is taken. All joins
    are on record ids, without payloads; what is gathered is a capture's own
    request and metadata, never captures.
    """
    is_anchor = F.col("record_type").isin(*ANCHORS)
    links = records.where("record_id IS NOT NULL").select("record_id", is_anchor.alias("anchor"), F.explode("concurrent_to").alias("other"))
    pairs = store(
        links.select(F.col("record_id").alias("a"), F.col("other").alias("b"))
        .union(links.select(F.col("other").alias("a"), F.col("record_id").alias("b"))).where("a <> b").distinct()
    )
    anchors = records.where(is_anchor & F.col("record_id").isNotNull()).select(F.col("record_id").alias("capture")).distinct()
    beside = pairs.join(anchors, pairs.a == anchors.capture, "left_anti")
    near = store(beside.join(anchors, beside.b == anchors.capture).groupBy("a").agg(F.min("capture").alias("capture")))
    via = beside.join(near.select(F.col("a").alias("b"), "capture"), "b").join(near.select("a"), "a", "left_anti")
    member = near.union(via.groupBy("a").agg(F.min("capture").alias("capture")))
    rest = records.where(~is_anchor & F.col("record_id").isNotNull()).dropDuplicates(["record_id"])
    gathered = (
        rest.join(member, rest.record_id == member.a)
        .groupBy("capture").agg(
            F.min(F.when(F.col("record_type") == "request", F.struct("record_id", "header", "payload"))).alias("request"),
            F.sort_array(F.collect_list(F.when(F.col("record_type") != "request", F.struct("record_id", "record_type", "payload")))).alias("metadata"),
        )
    )
    main = records.where(is_anchor & F.col("record_id").isNotNull()).dropDuplicates(["record_id"])
    return main.join(gathered, main.record_id == gathered.capture, "left").select(
        "record_id", "record_type", "target_uri", "date", "refers_to",
        F.struct("header", "declared_digest", "declared_size", "payload_digest", "payload_bytes", "payload").alias("response"),
        "request", F.coalesce("metadata", F.array().cast("array<struct<record_id:string,record_type:string,payload:binary>>")).alias("metadata"),
    )


def page_captures(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read them back, and tell of every page what its assembled capture holds.

    A revisit's digest and size are those its record declares of the full
    payload; a response's are measured on the payload read back. Null html is an
    empty payload; a null page_id stays null; equal rows are one capture.
    """
    path = shared_folder(spark)
    write_archives(captures(pages), path)
    whole = store(assemble(store(read_archives(spark, path, payloads=False))))
    got = whole.select(
        F.expr("try_cast(regexp_extract(CAST(get(metadata, 0).payload AS STRING), 'page-id: ?([-0-9]*)', 1) AS BIGINT)").alias("page_id"),
        "record_id", "record_type", F.col("refers_to").alias("refers_record"), F.col("target_uri").alias("url"), "response")
    known = got.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"))
    wanted = got.where("refers_record IS NOT NULL").select("refers_record").distinct()
    named = known.join(wanted, "refers_record", "left_semi")
    revisit = F.col("record_type") == "revisit"
    return got.join(named, "refers_record", "left").select(
        "page_id",
        F.when(revisit, F.col("response.declared_size")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("response.declared_digest", "^sha256:", "")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        "record_type", "refers_to", "url",
    )
