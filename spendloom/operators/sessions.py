"""Sessions: always a rollup of both facts, never patched in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TOKEN_COLUMNS
from .rollups import flag_sum, micros


def sessions_rollup(calls: DataFrame, tools: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """One row per session.

    Calls, tool calls and identities are stacked and grouped once: the facts never
    meet as a join, so they cannot multiply, and each is summed in its own map
    tasks before the single shuffle.
    """
    call_side = calls.select(
        F.col("session_uid").alias("uid"), "agent", "project",
        F.lit(1).cast("bigint").alias("calls"), *TOKEN_COLUMNS, "cost_usd",
        micros("llm_seconds").alias("llm_us"),
        F.nullif(F.col("ts"), F.lit(0)).alias("low"), F.col("ts").alias("high"),
    )
    tool_side = tools.select(
        F.col("session_uid").alias("uid"), "agent", "project",
        F.lit(1).cast("bigint").alias("tool_calls"),
        micros("seconds").alias("tool_us"),
        F.col("is_error").cast("bigint").alias("tool_errors"),
    )
    rows = call_side.unionByName(tool_side, allowMissingColumns=True)
    if identities is not None:
        known = identities.select(
            "uid", F.col("agent").alias("known_agent"), F.col("project").alias("known_project"),
            "path", "title", "orphaned",
        )
        rows = rows.unionByName(known, allowMissingColumns=True)
        who = [
            F.coalesce(F.max("known_agent"), F.max("agent")).alias("agent"),
            F.coalesce(F.nullif(F.max("known_project"), F.lit("")), F.max("project"), F.lit("")).alias("project"),
            F.coalesce(F.max("path"), F.lit("")).alias("path"),
            F.coalesce(F.max("title"), F.lit("")).alias("title"),
            F.coalesce(F.max("orphaned"), F.lit(False)).alias("orphaned"),
        ]
    else:
        who = [
            F.max("agent").alias("agent"),
            F.max("project").alias("project"),
            F.lit("").alias("path"),
            F.lit("").alias("title"),
            F.lit(False).alias("orphaned"),
        ]
    sums = ["calls", *TOKEN_COLUMNS, "cost_usd", "tool_calls", "tool_errors"]
    grouped = rows.groupBy("uid").agg(
        *who,
        F.coalesce(F.min("low"), F.lit(0)).alias("first_ts"),
        F.coalesce(F.max("high"), F.lit(0)).alias("last_ts"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        (F.coalesce(F.sum("llm_us"), F.lit(0)) / 1e6).alias("llm_seconds"),
        (F.coalesce(F.sum("tool_us"), F.lit(0)) / 1e6).alias("tool_seconds"),
    )
    open_for = F.greatest(F.col("last_ts") - F.col("first_ts"), F.lit(0)).cast("double")
    return grouped.withColumn("wall_seconds", open_for)


def sessions_top(sessions: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest sessions first: all, or the first ``limit``."""
    ordered = sessions.orderBy(F.desc("last_ts"), "uid")
    return ordered if limit is None else ordered.limit(limit)


def session_by_uid(sessions: DataFrame, uid) -> DataFrame:
    """Zero or one row."""
    return sessions.filter(F.col("uid") == uid)


def session_calls(calls: DataFrame, uid) -> DataFrame:
    """A session's calls in time order."""
    return calls.filter(F.col("session_uid") == uid).orderBy("ts", "call_key")
