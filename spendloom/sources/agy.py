"""agy store: a steps table whose metadata and payload are binary wire-format blobs.

The only place in the batch jobs that needs Python workers: the blobs are decoded
batch by batch with ``mapInPandas``; naming, pricing and the workspace vote are
DataFrame work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import hyphenate_label
from ..session import cut_lineage
from . import common
from .landed import Landed
from .listing import dealt

AGENT = "agy"

# Step types and the status of a failed step.
CALL_STEPS = (15, 23)
TOOL_STEP = 132
FAILED = 7
# Field numbers of the step metadata and of its usage message.
META_START, META_TOOL, META_END, META_USAGE = 1, 4, 8, 9
USAGE_MODEL, USAGE_INPUT, USAGE_OUTPUT, USAGE_CACHE_READ, USAGE_REASONING = 1, 2, 3, 5, 9
TOOL_NAME = 2
# Field paths in a step payload that may hold the working directory.
WORKSPACE_PATHS = [(28, 2), (140, 1, 2), (19, 12, 1, 42, 11, 1)]

# Display label of each model id.
MODEL_LABELS = {
    342: "Gemini 3.1 Flash Lite",
    1016: "Gemini 3.8 Flash (Low)",
    1020: "Gemini 3.8 Flash (Medium)",
    1021: "Gemini 3.8 Flash (High)",
    1026: "Claude Opus 4.6 (Thinking)",
    1035: "Claude Sonnet 4.6 (Thinking)",
    1036: "Claude Sonnet 4.6",
    1037: "Claude Opus 4.6",
    1050: "Gemini 3.8 Pro (Low)",
    1071: "Gemini 3.8 Pro (Medium)",
    1072: "Gemini 3.8 Pro (High)",
    1073: "Gemini 3.8 Pro (Thinking)",
    1196: "GPT-OSS 120B (Medium)",
    1266: "GPT-OSS 120B",
    1298: "Gemini 3.1 Pro (Low)",
    1299: "Gemini 3.1 Pro (Medium)",
    1300: "Gemini 3.1 Pro (High)",
    1318: "Gemini 3.1 Flash (Low)",
    1319: "Gemini 3.8 Flash (Medium)",
    1320: "Gemini 3.1 Flash (Medium)",
    1322: "Gemini 3.1 Flash (High)",
    1400: "Claude Opus 5.5 (Low)",
    1401: "Claude Opus 5.5 (Medium)",
    1402: "Claude Opus 5.5 (High)",
    1403: "Claude Sonnet 5.5 (Low)",
    1404: "Claude Sonnet 5.5 (Medium)",
    1405: "Claude Sonnet 5.5 (High)",
    1416: "Gemini 4 Argon (Low)",
    1417: "Gemini 4 Argon (High)",
    1418: "Gemini 4 Argon (Medium)",
}
# Fixed value: what an id without a label is called, before the id.
UNKNOWN_LABEL = "Antigravity Model "

STEPS = "conversation STRING, idx BIGINT, step_type INT, status INT, metadata BINARY, step_payload BINARY"
DECODED = """conversation STRING, idx BIGINT, step_type INT, status INT,
             start_s BIGINT, end_s BIGINT, tool STRING, has_usage BOOLEAN,
             model_id BIGINT, input BIGINT, generated BIGINT, cache_read BIGINT, reasoning BIGINT,
             has_meta BOOLEAN, directories ARRAY<STRING>"""


def _varint(blob: bytes, at: int) -> tuple[int, int] | None:
    value = 0
    for i, byte in enumerate(blob[at : at + 10]):
        value |= (byte & 0x7F) << (7 * i)
        if byte < 0x80:
            return value & 0xFFFFFFFFFFFFFFFF, at + i + 1
    return None


def wire_fields(blob: bytes) -> dict[int, int | bytes]:
    """First value of each field of a wire-format message, up to the first fault.

    Numbers are signed 64-bit. Fixed-width fields and groups are passed over.
    """
    out: dict[int, int | bytes] = {}
    at, depth = 0, 0
    while at < len(blob):
        head = _varint(blob, at)
        if head is None:
            break
        (key, at), number, shape = head, head[0] >> 3, head[0] & 7
        if not 0 < number < 1 << 29:
            break
        value: int | bytes | None = None
        if shape == 0 or shape == 2:
            got = _varint(blob, at)
            if got is None:
                break
            value, at = got
            if shape == 2:
                if value > len(blob) - at:
                    break
                value, at = blob[at : at + value], at + value
            elif value >= 1 << 63:
                value -= 1 << 64
        elif shape in (1, 5):
            at += 8 if shape == 1 else 4
        elif shape == 3:
            depth += 1
        elif shape == 4:
            depth = max(0, depth - 1)
        else:
            break
        if value is not None and depth == 0:
            out.setdefault(number, value)
    return out


def _message(fields: dict, number: int) -> bytes:
    value = fields.get(number)
    return value if isinstance(value, bytes) else b""


def _number(fields: dict, number: int) -> int:
    value = fields.get(number, 0)
    return value if isinstance(value, int) else 0


def _instant(blob: bytes) -> int | None:
    """Seconds of a timestamp message, None when it has none."""
    fields = wire_fields(blob)
    seconds = _number(fields, 1)
    return seconds + int(_number(fields, 2) / 1e9) if seconds else None


def _plain_text(blob: bytes) -> str:
    """Text without any byte that can only continue a longer character."""
    return "" if any(0x80 <= b < 0xC0 for b in blob) else blob.decode("utf-8", "replace")


#: So many steps are worth a task that decodes them.
STEPS_PER_TASK = 2000


def decode_steps(steps: DataFrame) -> DataFrame:
    """Times, usage and tool name of every step, and every absolute path where its working directory may be.

    Each blob is decoded once; steps without metadata have ``has_meta`` false.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for step in batch.itertuples(index=False):
                meta = wire_fields(bytes(step.metadata or b""))
                usage = {k: v for k, v in wire_fields(_message(meta, META_USAGE)).items() if isinstance(v, int)}
                rows.append((
                    step.conversation, step.idx, step.step_type, step.status,
                    _instant(_message(meta, META_START)), _instant(_message(meta, META_END)),
                    _plain_text(_message(wire_fields(_message(meta, META_TOOL)), TOOL_NAME)),
                    bool(usage),
                    *[usage.get(f, 0) for f in (USAGE_MODEL, USAGE_INPUT, USAGE_OUTPUT, USAGE_CACHE_READ, USAGE_REASONING)],
                    bool(step.metadata), _directories(bytes(step.step_payload or b"")),
                ))
            names = [c.split()[0] for c in DECODED.split(",")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"step_type": "Int32", "status": "Int32", "start_s": "Int64", "end_s": "Int64"})

    return steps.select("conversation", "idx", "step_type", "status", "metadata", "step_payload").mapInPandas(run, DECODED)


def _directories(payload: bytes) -> list[str]:
    found = []
    for route in WORKSPACE_PATHS:
        blob = payload
        for number in route:
            blob = _message(wire_fields(blob), number)
        if blob[:1] == b"/":
            found.append(blob.decode("utf-8", "replace"))
    return found


def workspace_votes(decoded: DataFrame) -> DataFrame:
    """``conversation, path, votes``: how often the steps of a conversation name a working directory."""
    named = decoded.select("conversation", F.explode("directories").alias("path"))
    return named.groupBy("conversation", "path").agg(F.count(F.lit(1)).alias("votes"))


def most_frequent(votes: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key, the smallest of equally frequent ones."""
    return _ahead(votes.groupBy(key, value).agg(F.count(F.lit(1)).alias("votes")), key, value)


def _ahead(tally: DataFrame, key: str, value: str) -> DataFrame:
    return tally.groupBy(key).agg(F.min_by(value, F.struct(-F.col("votes"), F.col(value))).alias(value))


def homes(tally: DataFrame) -> DataFrame:
    """``conversation, project``: the directory with the most votes of each conversation."""
    return _ahead(tally, "conversation", "path").withColumnRenamed("path", "project")


def normalise(steps: DataFrame, since: int | None = None) -> common.Normalised:
    """Rows of the steps past a cursor; the working directory is voted on over all of them."""
    decoded = cut_lineage(decode_steps(steps))
    new = decoded if since is None else decoded.filter(F.col("idx") > since)
    return _rows(new, homes(workspace_votes(decoded)), decoded.select("conversation").distinct())


def read_on(tables: Mapping[str, DataFrame], stored: Callable[[str], DataFrame]) -> Landed | None:
    """The steps behind each conversation's own cursor; None if there are none.

    Votes for working directories are kept as a tally. Where another directory
    takes the lead, the conversation's stored rows move to it; no step is decoded
    a second time. A step that is written below the cursor later is not seen.
    """
    steps, key = tables["steps"], F.concat(F.lit(f"{AGENT}/"), "conversation")
    ends = steps.groupBy("conversation").agg(F.max("idx").alias("end")).withColumn("source", key)
    read = stored("cursors").filter(F.col("agent") == AGENT).select("source", "position")
    ahead = cut_lineage(ends.join(read, "source", "left").filter("position IS NULL OR end > position"))
    if ahead.isEmpty():
        return None
    grown = ahead.select("conversation")
    new = steps.join(ahead.select("conversation", "position"), "conversation").filter("position IS NULL OR idx > position")
    # Blobs are small and dear: by their bytes they would all be one task's.
    new = cut_lineage(decode_steps(dealt(new, 1 + new.count() // STEPS_PER_TASK, "conversation", "idx")))
    told = stored("votes").join(grown, "conversation", "left_semi")
    tally = cut_lineage(told.unionByName(workspace_votes(new)).groupBy("conversation", "path").agg(F.sum("votes").alias("votes")))
    home, was = homes(tally), homes(told).withColumnRenamed("project", "was")
    begun = ahead.filter("position IS NOT NULL").select("conversation")
    moved = home.join(was, "conversation", "left").filter("NOT (project <=> was)").join(begun, "conversation", "left_semi")
    moved = cut_lineage(moved.select(F.col("conversation").alias("session_uid"), F.col("project").alias("_home")))
    anew = ahead.filter("position IS NULL").select(F.col("conversation").alias("uid"))
    rows = _rows(new, home, grown)
    spans = stored("identities").select("uid", F.nullif("seen_first_ts", F.lit(0)).alias("_low"), F.nullif("seen_last_ts", F.lit(0)).alias("_high"))
    spanned = rows.identities.join(spans, "uid", "left")
    seen = spanned.withColumns({
        "seen_first_ts": F.coalesce(F.least(F.nullif("seen_first_ts", F.lit(0)), "_low"), F.lit(0)),
        "seen_last_ts": F.coalesce(F.greatest(F.nullif("seen_last_ts", F.lit(0)), "_high"), F.lit(0)),
    }).select(*rows.identities.columns)

    def carried(table: str) -> DataFrame:
        whole = stored(table)
        return whole.join(moved, "session_uid").withColumn("project", F.col("_home")).select(*whole.columns)

    cursors = ahead.select("source", F.lit(AGENT).alias("agent"), F.col("end").alias("position"), F.lit("").alias("ties"))
    return Landed(
        common.Normalised(rows.calls, rows.tools, seen), moved.select(F.col("session_uid").alias("uid")).union(anew),
        {"cursors": cursors, "votes": tally}, {t: carried(t) for t in ("calls", "tool_calls")},
    )


def _rows(decoded: DataFrame, home: DataFrame, conversations: DataFrame) -> common.Normalised:
    took = F.col("end_s") - F.col("start_s")
    decoded = (
        decoded.filter("has_meta")
        .join(home, "conversation", "left")
        .withColumn("session_uid", F.col("conversation"))
        .withColumn("us", F.col("start_s") * 1_000_000)
        .withColumn(
            "seconds",
            F.when((took > 0) & (took <= common.SLOWEST_RESPONSE), took.cast("double")).otherwise(F.lit(0.0)),
        )
    )
    labels = F.create_map(*[F.lit(x) for pair in MODEL_LABELS.items() for x in pair])
    short_id = F.col("model_id").bitwiseAND(F.lit(0xFFFFFFFF))
    signed_id = F.when(short_id >= 1 << 31, short_id - (1 << 32)).otherwise(short_id)
    label = F.coalesce(F.try_element_at(labels, signed_id.cast("int")), F.concat(F.lit(UNKNOWN_LABEL), signed_id))

    def n(name):
        return F.greatest(F.col(name), common.zero()).alias(name)

    calls = decoded.filter(F.col("step_type").isin(*CALL_STEPS) & F.col("has_usage")).select(
        "session_uid", "project", "us",
        F.concat(F.lit("step"), "idx").alias("call_key"),
        hyphenate_label(label).alias("model"),
        n("input"), n("generated"), n("cache_read"),
        common.zero().alias("cache_write"), common.zero().alias("cache_write_1h"),
        n("reasoning"),
        F.col("seconds").alias("llm_seconds"),
    )
    tools = decoded.filter((F.col("step_type") == TOOL_STEP) & (F.col("tool") != "")).select(
        "session_uid", "project", "us",
        F.concat(F.lit("t"), "idx").alias("call_key"),
        "tool", "seconds", (F.col("status") == FAILED).alias("is_error"),
    )
    known = (
        conversations.join(home, "conversation", "left")
        .join(
            decoded.groupBy("conversation").agg(F.min("start_s").alias("low"), F.max("start_s").alias("high")),
            "conversation",
            "left",
        )
        .select(
            F.col("conversation").alias("uid"), F.lit(AGENT).alias("agent"),
            F.coalesce("project", F.lit("")).alias("project"),
            F.lit("").alias("path"), F.lit("").alias("title"),
            F.coalesce("low", F.lit(0)).alias("seen_first_ts"), F.coalesce("high", F.lit(0)).alias("seen_last_ts"),
            F.lit(False).alias("orphaned"),
        )
    )
    return common.Normalised(common.finish_calls(calls, AGENT), common.finish_tools(tools, AGENT), known)
