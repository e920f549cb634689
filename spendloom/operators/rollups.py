"""Grouped reports over calls, tool calls and sessions.

Money is summed as DECIMAL and durations as whole microseconds, so no figure
depends on the order in which partitions are added up. ``money`` rounds at the
edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import OTHER, provider_of_model
from ..schemas import TOKEN_COLUMNS
from .asof import tool_rollup

# A provider table names this many vendors before it folds the rest together.
MAX_NAMED_PROVIDERS = 10


def micros(seconds: str) -> Column:
    return F.round(F.col(seconds) * 1e6).cast("bigint")


def sum_seconds(column: str) -> Column:
    return F.coalesce(F.sum(micros(column)), F.lit(0)) / 1e6


def zero_sum(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def flag_sum(column: str | Column) -> Column:
    return zero_sum((F.col(column) if isinstance(column, str) else column).cast("bigint"))


def money(column: str | Column) -> Column:
    """A DECIMAL amount as DOUBLE, rounded to a millionth of a dollar."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6).cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def share(part: str, exact: Column, digest=lambda total: total) -> Column:
    """``part`` as a percentage of its whole over all rows; 0 when that is not positive.

    Used on reports only, where rows are already one per distinct name, so the
    window without partition sees names, never calls. A scalar subquery would
    scan the calls a second time. ``exact`` must add up exactly, so that the whole
    does not depend on the order of addition; ``digest`` turns it into the unit
    of ``part``.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = digest(F.sum(exact).over(everything))
    return F.when(total > 0, F.col(part) / total * 100).otherwise(F.lit(0.0))


def cost_share() -> Column:
    """Share of ``cost``, of which ``cost_usd`` is the exact amount."""
    return share("cost", F.col("cost_usd"), money)


def first_ts() -> Column:
    return F.coalesce(F.min(F.nullif(F.col("ts"), F.lit(0))), F.lit(0))


def last_ts() -> Column:
    return F.coalesce(F.max("ts"), F.lit(0))


def usage_sums() -> list[Column]:
    return [
        zero_sum("cost_usd").alias("cost_usd"),
        F.count(F.lit(1)).alias("calls"),
        *[zero_sum(c).alias(c) for c in TOKEN_COLUMNS],
        sum_seconds("llm_seconds").alias("llm_seconds"),
        flag_sum(~F.col("priced")).alias("unpriced"),
    ]


# ------------------------------------------------------------------ overall


def totals(calls: DataFrame, tools: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row over everything. Inputs are already filtered."""
    parts = [
        calls.agg(*usage_sums(), first_ts().alias("first_ts"), last_ts().alias("last_ts")),
        sessions.agg(
            F.count(F.lit(1)).alias("sessions"),
            F.count_distinct("project").alias("projects"),
            F.count_distinct("agent").alias("agents"),
        ),
        tools.agg(sum_seconds("seconds").alias("tool_seconds")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    # Three one-row parts with disjoint columns; the maximum picks the value.
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def history_range(calls: DataFrame) -> DataFrame:
    return calls.agg(first_ts().alias("oldest"), last_ts().alias("newest"))


def facets(calls: DataFrame) -> DataFrame:
    """Sorted distinct values of each filter axis, as (axis, value) rows, and the time span."""
    axes = ["model", "agent", "project"]
    # One pass: a row becomes up to three (axis, value) pairs that collapse in
    # the map tasks.
    pairs = calls.select(F.stack(F.lit(3), *[x for a in axes for x in (F.lit(a), F.col(a))]).alias("axis", "value"))
    values = pairs.filter("value != ''").distinct()
    span = history_range(calls).select(
        F.stack(
            F.lit(2),
            F.lit("min_ts"), F.col("oldest").cast("string"),
            F.lit("max_ts"), F.col("newest").cast("string"),
        ).alias("axis", "value")
    )
    return values.unionByName(span).orderBy("axis", "value")


# ------------------------------------------------------------------ by model


def models(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(*usage_sums(), first_ts().alias("first_ts"), last_ts().alias("last_ts"))


def models_report(calls: DataFrame) -> DataFrame:
    """Models with their share of the shown cost and output tokens per second, dearest first."""
    table = models(calls).withColumn("cost", money("cost_usd"))
    return (
        table.withColumn("pct", cost_share())
        .withColumn("avg_tps", ratio(F.col("output_tokens"), F.col("llm_seconds")))
        .drop("cost_usd")
        .orderBy(F.desc("cost"), "model")
    )


def providers(calls: DataFrame, named: int = MAX_NAMED_PROVIDERS) -> DataFrame:
    """Vendors by cost; those after the first ``named`` and the unknown are one last row."""
    return providers_from_models(models(calls).withColumn("provider", provider_of_model(F.col("model"))), named)


def _fold(rows: DataFrame) -> DataFrame:
    sums = ["cost_usd", "calls", *TOKEN_COLUMNS, "llm_us", "unpriced"]
    return rows.groupBy("provider").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.coalesce(F.min(F.nullif("first_ts", F.lit(0))), F.lit(0)).alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.array_sort(F.flatten(F.collect_list("models"))).alias("models"),
    )


def providers_from_models(per_model: DataFrame, named: int = MAX_NAMED_PROVIDERS) -> DataFrame:
    """Provider table from per-model rows that carry a ``provider`` column."""
    per_model = per_model.withColumn("llm_us", micros("llm_seconds")).withColumn("models", F.array("model"))
    vendors = _fold(per_model)
    # One row per vendor name; the names come from the fixed rule lists.
    order = Window.partitionBy(F.col("provider") == OTHER).orderBy(
        F.desc("cost_usd"), F.desc("calls"), F.desc("total_tokens"), "provider"
    )
    ranked = vendors.withColumn("rank", F.row_number().over(order))
    folded = _fold(ranked.withColumn("provider", F.when(F.col("rank") > named, OTHER).otherwise(F.col("provider"))))
    shown = (
        folded.filter((F.col("provider") != OTHER) | (F.col("calls") > 0))
        .withColumn("llm_seconds", F.col("llm_us") / 1e6)
        .withColumn("cost", money("cost_usd"))
    )
    return (
        shown.withColumn("pct", cost_share())
        .withColumn("avg_tps", ratio(F.col("output_tokens"), F.col("llm_seconds")))
        .drop("llm_us", "cost_usd")
        .orderBy(F.col("provider") == OTHER, F.desc("cost"), F.desc("calls"), F.desc("total_tokens"), "provider")
    )


# ------------------------------------------------------------------ by day


def daily_by_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("day", "model").agg(
        zero_sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("calls")
    )


def daily(calls: DataFrame) -> DataFrame:
    """Per day the cost and a model -> cost map; an unnamed model counts in the cost only."""
    entry = F.when(F.col("model") != "", F.struct("model", "cost_usd"))
    return (
        daily_by_model(calls)
        .groupBy("day")
        .agg(
            F.sum("cost_usd").alias("cost_usd"),
            F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("models"),
        )
    )


def daily_recent(calls: DataFrame, days: int = 14) -> DataFrame:
    """The newest days that have data, oldest first."""
    return daily(calls).orderBy(F.desc("day")).limit(days).orderBy("day")


def monthly(calls: DataFrame) -> DataFrame:
    """Cost per calendar month and model."""
    return (
        daily_by_model(calls)
        .groupBy(F.substring("day", 1, 7).alias("month"), "model")
        .agg(F.sum("cost_usd").alias("cost_usd"))
    )


def model_legend(calls: DataFrame) -> DataFrame:
    """Models by cost over all days, dearest first."""
    table = calls.filter("model != ''").groupBy("model").agg(zero_sum("cost_usd").alias("cost_usd"))
    return table.orderBy(F.desc("cost_usd"), "model")


def burn_windows(calls: DataFrame, now: Column) -> DataFrame:
    """Spend today, over 7 and 30 days and this month, each against the period before it.

    ``now`` is epoch seconds. One pass over the daily costs: each window is a pair
    of conditional sums, so nothing is joined.
    """
    per_day = (
        calls.groupBy("day")
        .agg(zero_sum("cost_usd").alias("cost_usd"))
        .withColumn("date", F.col("day").try_cast("date"))
        .withColumn("today", F.to_date(F.timestamp_seconds(now)))
    )
    today, date = F.col("today"), F.col("date")
    end = F.date_add(today, 1)
    month = F.trunc(today, "MM")
    before = F.add_months(month, -1)
    spans = []
    # The labels.
    for label, prior, n in [
        ("Today", "Yesterday", 1),
        ("Last 7 days", "the 7 days before", 7),
        ("Last 30 days", "the 30 days before", 30),
    ]:
        start = F.date_sub(end, n)
        spans.append((F.lit(label), F.lit(prior), F.lit(n), (start, end), (F.date_sub(start, n), start)))
    dom = F.dayofmonth(today)
    spans.append((
        F.lit("Month to date"),
        F.concat(F.lit("the first "), dom.cast("string"), F.lit(" days of last month")),
        dom,
        (month, end),
        (before, F.date_add(before, dom)),
    ))

    def spent(span):
        return F.coalesce(F.sum(F.when((date >= span[0]) & (date < span[1]), F.col("cost_usd"))), F.lit(0))

    sums = [spent(s).cast("decimal(38,12)").alias(f"{k}{i}") for i, w in enumerate(spans) for k, s in (("c", w[3]), ("p", w[4]))]
    flat = per_day.agg(F.max("today").alias("today"), *sums)
    rows = flat.select(
        F.inline(F.array(*[
            F.struct(
                w[0].alias("label"), w[1].alias("prior_label"), w[2].cast("bigint").alias("days"),
                F.col(f"c{i}").alias("cost_usd"), F.col(f"p{i}").alias("prior_usd"),
            )
            for i, w in enumerate(spans)
        ]))
    )
    cost, prior = money("cost_usd"), money("prior_usd")
    delta = F.when(prior > 0, (cost - prior) / prior * 100)
    return rows.select(
        "label", "prior_label", "days",
        cost.alias("cost"), prior.alias("prior_cost"),
        (cost / F.col("days")).alias("per_day"),
        delta.alias("delta_pct"),
        F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat").alias("trend"),
    )


# ------------------------------------------------------------------ tools


def tools(tool_calls: DataFrame, calls: DataFrame) -> DataFrame:
    """Tools with attributed cost, average and shares, most used first.

    ``calls`` is every stored call: what a tool is charged does not depend on
    which calls the report shows.
    """
    table = tool_rollup(tool_calls, calls, ["tool"]).withColumn("cost", money("cost_usd"))
    return (
        table.withColumn("pct", share("seconds", micros("seconds"), lambda us: us / 1e6))
        .withColumn("cost_pct", cost_share())
        .withColumn("avg_seconds", ratio(F.col("seconds"), F.col("calls")))
        .drop("cost_usd")
        .orderBy(F.desc("calls"), "tool")
    )


def project_models(calls: DataFrame) -> DataFrame:
    return (
        calls.groupBy("project", "model")
        .agg(
            zero_sum("cost_usd").alias("cost_usd"),
            F.count(F.lit(1)).alias("calls"),
            zero_sum("total_tokens").alias("total_tokens"),
            zero_sum("output_tokens").alias("output_tokens"),
            sum_seconds("llm_seconds").alias("llm_seconds"),
        )
        .orderBy("project", F.desc("cost_usd"), "model")
    )


def project_tools(tool_calls: DataFrame) -> DataFrame:
    return (
        tool_calls.groupBy("project", "tool")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            sum_seconds("seconds").alias("seconds"),
            flag_sum("is_error").alias("errors"),
        )
        .orderBy("project", F.desc("calls"), "tool")
    )


# ------------------------------------------------------------------ projects


def projects_by_agent(sessions: DataFrame) -> DataFrame:
    """Per project and agent, latest activity first."""
    return (
        sessions.groupBy("project", "agent")
        .agg(
            zero_sum("cost_usd").alias("cost_usd"),
            zero_sum("calls").alias("calls"),
            F.count(F.lit(1)).alias("sessions"),
            F.coalesce(F.min(F.nullif("first_ts", F.lit(0))), F.lit(0)).alias("first_ts"),
            F.coalesce(F.max("last_ts"), F.lit(0)).alias("last_ts"),
            zero_sum("total_tokens").alias("total_tokens"),
            sum_seconds("llm_seconds").alias("llm_seconds"),
            sum_seconds("tool_seconds").alias("tool_seconds"),
        )
        .orderBy(F.desc("last_ts"), "project", "agent")
    )


def projects(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per project over all its agents; throughput comes from its calls."""
    per_agent = projects_by_agent(sessions)
    # At most one entry per agent, and the agents are a closed set.
    seen = F.array_sort(F.collect_list(F.struct((-F.col("last_ts")).alias("age"), "agent")))
    merged = per_agent.groupBy("project").agg(
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("calls").alias("calls"),
        F.sum("sessions").alias("sessions"),
        F.sum("total_tokens").alias("total_tokens"),
        (F.sum(micros("llm_seconds")) / 1e6).alias("llm_seconds"),
        (F.sum(micros("tool_seconds")) / 1e6).alias("tool_seconds"),
        F.max("last_ts").alias("last_activity"),
        F.transform(seen, lambda s: s["agent"]).alias("agents"),
    )
    speed = calls.groupBy("project").agg(
        ratio(F.sum("output_tokens"), sum_seconds("llm_seconds")).alias("avg_tps")
    )
    return (
        merged.join(speed, "project", "left")
        .fillna({"avg_tps": 0.0})
        .orderBy(F.desc("last_activity"), "project")
    )
