"""Composed reports: the nested project payload, the page and the text summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display
from ..operators import activity, rollups, sessions
from ..operators.filters import NO_FILTER, Filter, filter_calls, filter_sessions, filter_tools
from ..session import cut_lineage


def numbered(ordered_rows: DataFrame, name: str) -> DataFrame:
    """Add each row's place in an ordered DataFrame, from 1.

    The order is already a range partitioning. It is written once, each row with
    its partition and its place inside it; adding the sizes of the partitions
    before gives the place. No row is moved into a common task.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fixed = cut_lineage(ordered_rows.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        fixed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    return (
        fixed.join(shifts, "_part")
        .withColumn(name, F.col("_shift") + F.col("_at") + 1)
        .drop("_part", "_at", "_shift")
    )


# ---------------------------------------------------------------- project tree


def _listed(df: DataFrame, order: list[Column], members: list[Column], name: str) -> DataFrame:
    """Per project an array of structs in the given order."""
    entry = F.struct(F.struct(*order).alias("_o"), F.struct(*members).alias("_v"))
    ranked = F.array_sort(F.collect_list(entry))
    return df.groupBy("project").agg(F.transform(ranked, lambda e: e["_v"]).alias(name))


def project_tree(calls: DataFrame, tools: DataFrame, session_rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Projects with their listed sessions, models and tools nested; lists are empty, never null.

    The lists hold aggregates: one entry per session, model or tool of a project.
    With a ``limit`` only the newest so many sessions over all projects are
    listed, and ``truncated`` tells of each project whether that left some out.
    """
    heads = rollups.projects(session_rows, calls)
    cost = rollups.money("cost_usd").alias("cost")
    listed = _listed(
        session_rows if limit is None else sessions.sessions_top(session_rows, limit),
        [(-F.col("last_ts")).alias("a"), F.col("uid").alias("b")],
        [
            F.col("uid"), F.col("agent"), F.col("title"), F.col("calls"), F.col("total_tokens"), cost,
            F.col("first_ts"), F.col("last_ts"), F.col("wall_seconds"), F.col("llm_seconds"), F.col("tool_seconds"),
            F.col("tool_calls"), F.col("tool_errors"), F.col("orphaned"),
            rollups.ratio(F.col("output_tokens"), F.col("llm_seconds")).alias("avg_tps"),
            display.duration(F.col("wall_seconds")).alias("duration"),
        ],
        "sessions_list",
    )
    used = _listed(
        rollups.project_models(calls),
        [(-F.col("cost_usd")).alias("a"), F.col("model").alias("b")],
        [
            F.col("model"), cost, F.col("calls"), F.col("total_tokens"), F.col("output_tokens"),
            rollups.ratio(F.col("output_tokens"), F.col("llm_seconds")).alias("avg_tps"),
            display.duration(F.col("llm_seconds")).alias("llm_time"),
        ],
        "models",
    )
    run = _listed(
        rollups.project_tools(tools),
        [(-F.col("calls")).alias("a"), F.col("tool").alias("b")],
        [
            F.col("tool"), F.col("calls"), F.col("seconds"), F.col("errors"),
            display.duration(rollups.ratio(F.col("seconds"), F.col("calls"))).alias("avg_time"),
        ],
        "tools",
    )
    tree = heads
    for part in (listed, used, run):
        tree = tree.join(part, "project", "left")
    lists = {n: F.coalesce(n, F.array().cast(tree.schema[n].dataType)).alias(n) for n in ("sessions_list", "models", "tools")}
    whole = tree.select(*[lists.get(c, F.col(c)) for c in tree.columns])
    return whole.withColumn("truncated", F.size("sessions_list") < F.col("sessions"))


def flat_project_tree(tree: DataFrame) -> DataFrame:
    """The tree with each list as text, for comparison across engines."""

    def line(column: str, *members: str) -> Column:
        parts = F.transform(column, lambda e: F.concat_ws(":", *[e[m].cast("string") for m in members]))
        return F.array_join(parts, ";").alias(column)

    return tree.select(
        "project",
        F.array_join("agents", ",").alias("agents"),
        rollups.money("cost_usd").alias("cost"),
        "sessions", "calls", "last_activity",
        line("sessions_list", "uid", "calls", "last_ts", "duration"),
        line("models", "model", "calls", "total_tokens", "llm_time"),
        line("tools", "tool", "calls", "errors", "avg_time"),
    )


# ---------------------------------------------------------------- page


def page(
    calls: DataFrame, tools: DataFrame, session_rows: DataFrame, f: Filter = NO_FILTER, now: Column | None = None
) -> dict[str, DataFrame]:
    """Every report of one page over the same filtered rows.

    The three filtered inputs are marked for caching so that the reports share
    them; the caller unpersists ``calls``, ``tools`` and ``sessions`` when done.
    """
    c = filter_calls(calls, f).cache()
    t = filter_tools(tools, calls, f).cache()
    s = filter_sessions(session_rows, calls, f).cache()
    newest = c.agg(F.max("ts")).scalar()
    return {
        "calls": c,
        "tools": t,
        "sessions": s,
        "totals": rollups.totals(c, t, s),
        "daily": rollups.daily(c),
        "monthly": rollups.monthly(c),
        "models": rollups.models_report(c),
        "providers": rollups.providers(c),
        "project_tree": project_tree(c, t, s),
        "tool_report": rollups.tools(t, calls),
        "sessions_top": sessions.sessions_top(s),
        "burn_windows": rollups.burn_windows(c, newest if now is None else now),
        "facets": rollups.facets(calls),
    }


def as_json(report: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


def activity_page(
    calls: DataFrame, f: Filter = NO_FILTER, range_seconds: int = 86400, step: int = 0, generated_at: int | None = None
) -> tuple[dict, DataFrame]:
    """The shown window and its filled buckets.

    The window is one small row and decides the bucket width, so it is fetched
    first; an empty history has no window and no buckets.
    """
    shown = filter_calls(calls, f)
    row = activity.activity_window(shown, range_seconds, step, generated_at).first()
    if row is None:
        return {"oldest": 0, "newest": 0}, activity.activity(shown.filter("false"), activity.ALLOWED_STEPS[0])
    window = row.asDict()
    buckets = activity.activity(shown, window["step"], window["from_ts"], window["to_ts"])
    return window, activity.activity_metrics(activity.activity_filled(buckets, window["step"]))


# ---------------------------------------------------------------- summary


def summary(calls: DataFrame, tools: DataFrame, session_rows: DataFrame, status: DataFrame) -> DataFrame:
    """The text report: totals, history, a line per provider and a line per source, as ``section, line``."""
    t = rollups.totals(calls, tools, session_rows).withColumn("cost", rollups.money("cost_usd"))

    def day(ts: str) -> Column:
        return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")

    lines = [
        F.format_string("calls      %d", "calls"),
        F.format_string("sessions   %d", "sessions"),
        F.format_string("projects   %d", "projects"),
        F.format_string("tokens     %d", "total_tokens"),
        F.concat(F.lit("cost       $"), display.fixed(F.col("cost"), 2)),
        F.when(F.col("unpriced") > 0, F.format_string("unpriced   %d calls", "unpriced")),
        F.when(F.col("first_ts") > 0, F.concat(F.lit("history    "), day("first_ts"), F.lit(" to "), day("last_ts"))),
    ]
    head = t.select(F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("line"))
    vendors = rollups.providers(calls).select(
        F.format_string(
            "  %-12s $%10s (%5s%%)  %7d calls",
            "provider", display.fixed(F.col("cost"), 2), display.fixed(F.col("pct"), 1), "calls",
        ).alias("line")
    )
    state = F.when(F.col("error") == "", "ok").otherwise(F.col("error"))
    sources = status.select(
        F.format_string("%-9s %6d files  %6d changed  %6d calls  %s", "agent", "files_seen", "files_changed", "calls_ingested", state).alias("line")
    )
    out = None
    for name, part in (("totals", head), ("providers", vendors), ("sources", sources)):
        part = part.select(F.lit(name).alias("section"), "line")
        out = part if out is None else out.unionByName(part)
    return out
