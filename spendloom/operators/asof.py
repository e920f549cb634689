"""Forward as-of: a tool call is charged the first model call at or after it.

Which call that is depends on the session and the second alone, so both sides are
first reduced to one row per session and second. A session is then handled in
chunks of a day, at most 86,400 distinct seconds a side, however many rows it
has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import whole_div
from .ordered import carry

CHUNK_SECONDS = 86_400
COST = "decimal(24,12)"


def _call_moments(calls: DataFrame) -> DataFrame:
    """Cheapest call of each second: the first one in (ts, cost, key) order."""
    return calls.groupBy("session_uid", "ts").agg(F.min("cost_usd").alias("moment_cost"))


def _answers(tools: DataFrame, calls: DataFrame) -> DataFrame:
    """``session_uid, ts, charge`` for every second some tool ran in: the cost of the next call."""
    seconds = tools.select("session_uid", "ts").distinct()
    line = seconds.withColumn("side", F.lit(0)).unionByName(
        _call_moments(calls).withColumn("side", F.lit(1)), allowMissingColumns=True
    )
    # What each chunk holds follows from the bare rows: the cheapest call of a
    # chunk's first second wins because cost is part of the order here.
    bare = tools.select("session_uid", "ts", F.lit(0).alias("side")).unionByName(
        calls.select("session_uid", "ts", F.lit(1).alias("side"), F.col("cost_usd").alias("moment_cost")),
        allowMissingColumns=True,
    )
    carried = carry(
        line,
        ["session_uid"],
        # A tool comes before the calls of its second.
        ["ts", "side", "moment_cost"],
        chunk=whole_div(F.col("ts"), CHUNK_SECONDS),
        first_from={"charge": F.col("moment_cost")},
        summary_of=bare,
    )
    return carried.filter("side = 0 and charge is not null").select("session_uid", "ts", "charge")


def tool_cost_asof(tools: DataFrame, calls: DataFrame) -> DataFrame:
    """Every tool call with ``cost_usd``, the cost of the call that read its result, else 0."""
    # One answer per (session, second): a hot second splits on the tools' side.
    charged = tools.join(_answers(tools, calls), ["session_uid", "ts"], "left")
    return charged.withColumn("cost_usd", F.coalesce("charge", F.lit(0).cast(COST))).drop("charge")


def tool_rollup(tools: DataFrame, calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, seconds, errors and attributed cost of tool calls per ``by``."""
    return tool_cost_asof(tools, calls).groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        (F.sum(F.round(F.col("seconds") * 1e6).cast("bigint")) / 1e6).alias("seconds"),
        F.sum(F.col("is_error").cast("bigint")).alias("errors"),
        F.sum("cost_usd").alias("cost_usd"),
    )
