"""What the four line-oriented log formats share once their records are decoded.

A format turns its lines into *events*, one row per line of interest:

=============  ==============================================================
path, ordinal  where the line is
us             its time in microseconds, null if unknown
uid_seen       session id the line states, else null
project_seen   working directory the line states, else null
title_seen     title the line states, else null
mark           null, or a struct whose ``us`` is the time of a request (null: the
               request was answered or its time is unknown)
call           null, or the usage of the response on this line
tools          tool runs on this line
=============  ==============================================================
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.names import file_stem
from ..functions.tokens import reasoning_share, total, visible_output

# Responses slower than this were idle time, not a response.
SLOWEST_RESPONSE = 600

CALL_PARTS = ["input", "generated", "cache_read", "cache_write", "cache_write_1h", "reasoning"]


@dataclass(frozen=True)
class Normalised:
    """Rows of one source: unpriced calls, tool calls and session identities."""

    calls: DataFrame
    tools: DataFrame
    identities: DataFrame


def request(us: Column) -> Column:
    return F.struct(us.cast("bigint").alias("us"))


def answered() -> Column:
    return request(F.lit(None))


def zero() -> Column:
    return F.lit(0).cast("bigint")


def session_uid(seen: Column) -> Column:
    return F.coalesce(seen, file_stem(F.col("path")))


def response_seconds(asked_us: Column, us: Column, slowest: int = SLOWEST_RESPONSE) -> Column:
    """Time from a request to its response; 0 when unknown or out of bounds."""
    return F.coalesce(fields.span_seconds(asked_us, us, below=slowest), F.lit(0.0))


def positional(prefix: str, ordinal: Column, position: Column | None = None) -> Column:
    """Key of a record that carries no id: its place in the log."""
    parts = [F.lit(prefix), ordinal.cast("string")]
    if position is not None:
        parts += [F.lit("-"), position.cast("string")]
    return F.concat(*parts)


def finish_calls(rows: DataFrame, agent: str) -> DataFrame:
    """Call columns from session_uid, call_key, project, model, us, llm_seconds and the token parts.

    ``generated`` is what the output rate bills; reasoning is the part of it shown
    apart. A format that stores other figures than it bills passes ``output``. A
    row whose tokens are all zero is no call unless its size is merely unknown.
    """
    output = F.col("output") if "output" in rows.columns else visible_output(F.col("generated"), F.col("reasoning"))
    sized = F.col("sized") if "sized" in rows.columns else F.lit(True)
    shown = rows.select(
        "session_uid",
        "call_key",
        F.lit(agent).alias("agent"),
        F.coalesce("project", F.lit("")).alias("project"),
        "model",
        fields.epoch_seconds(F.col("us")).alias("ts"),
        fields.local_day(F.col("us")).alias("day"),
        F.col("input").alias("input_tokens"),
        output.alias("output_tokens"),
        F.col("cache_read").alias("cache_read_tokens"),
        F.col("cache_write").alias("cache_write_tokens"),
        F.least("cache_write_1h", "cache_write").alias("cache_write_1h_tokens"),
        (F.col("reasoning") if "output" in rows.columns else reasoning_share(F.col("generated"), F.col("reasoning"))).alias(
            "reasoning_tokens"
        ),
        F.col("generated").alias("billable_output_tokens"),
        "llm_seconds",
        sized.alias("sized"),
    )
    parts = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens"]
    shown = shown.withColumn("total_tokens", total(*map(F.col, parts)))
    return shown.filter((F.col("total_tokens") > 0) | ~F.col("sized"))


def finish_tools(rows: DataFrame, agent: str) -> DataFrame:
    """Tool-call columns from session_uid, call_key, project, tool, us, seconds, is_error."""
    return rows.select(
        "session_uid",
        "call_key",
        F.lit(agent).alias("agent"),
        F.coalesce("project", F.lit("")).alias("project"),
        "tool",
        fields.epoch_seconds(F.col("us")).alias("ts"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"),
        F.coalesce("is_error", F.lit(False)).alias("is_error"),
    )


def identities(events: DataFrame, agent: str, project: Column | None = None) -> DataFrame:
    """One row per log: session id, project, title and the observed time span."""

    def oldest(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), F.col("ordinal")))

    def newest(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("ordinal")))

    per_path = events.groupBy("path").agg(
        oldest("uid_seen").alias("uid_seen"),
        oldest("project_seen").alias("project_seen"),
        oldest("title_seen").alias("title_seen"),
        oldest("us").alias("first_us"),
        newest("us").alias("last_us"),
    )
    return per_path.select(
        session_uid(F.col("uid_seen")).alias("uid"),
        F.lit(agent).alias("agent"),
        F.coalesce(F.col("project_seen") if project is None else project, F.lit("")).alias("project"),
        "path",
        F.coalesce("title_seen", F.lit("")).alias("title"),
        fields.epoch_seconds(F.col("first_us")).alias("seen_first_ts"),
        fields.epoch_seconds(F.col("last_us")).alias("seen_last_ts"),
        F.lit(False).alias("orphaned"),
    )
