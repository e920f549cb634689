"""Activity over time: tumbling buckets aligned to the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import whole_div
from .rollups import flag_sum, history_range, micros, ratio, zero_sum

# Bucket widths a caller may ask for, in seconds.
ALLOWED_STEPS = [300, 900, 3600, 21600, 86400]
# Fixed values: (longest span, width chosen for it), in seconds.
STEP_FOR_SPAN = [(6 * 3600, 300), (12 * 3600, 900), (7 * 86400, 3600), (90 * 86400, 21600)]
LONGEST_STEP = 86400

BUCKET_SUMS = [
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    "reasoning_tokens", "total_tokens",
]

# Buckets of one block of a filled grid.
BLOCK_BUCKETS = 10_000


def auto_step(span: Column) -> Column:
    """Bucket width for a span of seconds."""
    chain = None
    for longest, step in STEP_FOR_SPAN:
        chain = F.when(span <= longest, step) if chain is None else chain.when(span <= longest, step)
    return chain.otherwise(LONGEST_STEP).cast("bigint")


def activity_window(
    calls: DataFrame, range_seconds: int = 86400, step: int = 0, generated_at: int | None = None
) -> DataFrame:
    """One row: the window to show, its bucket width and the history it was cut from.

    The window ends at the newest call, or at ``generated_at`` once that is a day
    later, and never starts before the oldest call. ``range_seconds`` 0 is all of
    it. No dated call gives no row.
    """
    if step and step not in ALLOWED_STEPS:
        raise ValueError(f"step must be one of {', '.join(map(str, ALLOWED_STEPS))} seconds")
    end = F.col("newest")
    if generated_at is not None:
        end = F.when(F.col("newest") + 86400 <= generated_at, F.lit(generated_at)).otherwise(end)
    start = F.greatest("oldest", F.col("to_ts") - range_seconds) if range_seconds > 0 else F.col("oldest")
    span = F.col("to_ts") - F.col("from_ts")
    return (
        history_range(calls)
        .filter("oldest > 0")
        .withColumn("to_ts", end)
        .withColumn("from_ts", start)
        .withColumn("auto_step", auto_step(span))
        .withColumn("step", F.lit(step).cast("bigint") if step else auto_step(span))
    )


def activity(calls: DataFrame, step: int, from_ts=None, to_ts=None) -> DataFrame:
    """Non-empty buckets of ``step`` seconds between two instants, both included."""
    if step <= 0:
        raise ValueError(f"activity step must be positive, got {step}")
    dated = calls.filter("ts > 0")
    if from_ts is not None:
        dated = dated.filter(F.col("ts") >= from_ts)
    if to_ts is not None:
        dated = dated.filter(F.col("ts") <= to_ts)
    return bucket_sums(dated.groupBy((whole_div(F.col("ts"), step) * step).alias("bucket")))


def bucket_sums(grouped) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("messages"),
        *[zero_sum(c).alias(c) for c in BUCKET_SUMS],
        (zero_sum(micros("llm_seconds")) / 1e6).alias("llm_seconds"),
        zero_sum("cost_usd").alias("cost_usd"),
        flag_sum(~F.col("priced")).alias("unpriced"),
    )


def activity_filled(buckets: DataFrame, step: int) -> DataFrame:
    """Every bucket from the first to the last, empty ones as zeros, the newest marked partial."""
    if step not in ALLOWED_STEPS:
        raise ValueError(f"step must be one of {', '.join(map(str, ALLOWED_STEPS))} seconds")
    ends = buckets.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    # Laid out in blocks of bounded length that are dealt to tasks, however far the ends are apart.
    block = F.lit(step * BLOCK_BUCKETS).cast("bigint")
    blocks = ends.filter("low is not null").select(F.explode(F.sequence("low", "high", block)).alias("start"), "high").repartition("start")
    inside = F.sequence("start", F.least(F.col("start") + block - step, F.col("high")), F.lit(step).cast("bigint"))
    grid = blocks.select(F.explode(inside).alias("bucket"), "high")
    figures = [c for c in buckets.columns if c != "bucket"]
    return (
        grid.join(buckets, "bucket", "left")
        .select(
            "bucket",
            *[F.coalesce(c, F.lit(0).cast(buckets.schema[c].dataType)).alias(c) for c in figures],
            (F.col("bucket") == F.col("high")).alias("partial"),
        )
        .orderBy(F.desc("bucket"))
    )


def activity_metrics(buckets: DataFrame) -> DataFrame:
    """Throughput and response time of each bucket."""
    return buckets.withColumn("throughput", ratio(F.col("output_tokens"), F.col("llm_seconds"))).withColumn(
        "latency", ratio(F.col("llm_seconds"), F.col("messages"))
    )


METRICS = ["messages", "output_tokens", "total_tokens", "throughput", "latency", "cost_usd"]


def activity_summary(buckets: DataFrame, step: int) -> DataFrame:
    """One row over a window's buckets: sums, averages, the peak of each metric, active time."""
    shown = activity_metrics(buckets)
    sums = shown.agg(
        zero_sum("messages").alias("messages"),
        *[zero_sum(c).alias(c) for c in BUCKET_SUMS],
        (zero_sum(micros("llm_seconds")) / 1e6).alias("llm_seconds"),
        zero_sum("cost_usd").alias("cost_usd"),
        zero_sum("unpriced").alias("unpriced"),
        *[F.greatest(F.coalesce(F.max(m), F.lit(0)), F.lit(0)).alias(f"peak_{m}") for m in METRICS],
        (F.count_if(F.col("messages") > 0) * step).alias("active_seconds"),
    )
    return sums.withColumn("throughput", ratio(F.col("output_tokens"), F.col("llm_seconds"))).withColumn(
        "avg_response", ratio(F.col("llm_seconds"), F.col("messages"))
    )


def activity_sessions(calls: DataFrame, gap: int, by: str = "project") -> DataFrame:
    """Spells of work per ``by``: a dated call more than ``gap`` seconds after the one before begins a new one.

    ``start`` and ``end`` are the times of a spell's first and last call. Calls of
    one epoch-aligned bucket of ``gap`` seconds are of one spell in any case, so
    they are added up first; what is then ordered per key is a row per bucket,
    however many calls a key has.
    """
    if gap <= 0:
        raise ValueError(f"gap must be positive, got {gap}")
    sums = ["messages", *BUCKET_SUMS, "llm_us", "cost_usd", "unpriced"]
    dated = calls.filter("ts > 0")
    buckets = dated.groupBy(by, whole_div(F.col("ts"), gap).alias("bucket")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("messages"),
        *[zero_sum(c).alias(c) for c in BUCKET_SUMS], zero_sum(micros("llm_seconds")).alias("llm_us"),
        zero_sum("cost_usd").alias("cost_usd"), flag_sum(~F.col("priced")).alias("unpriced"),
    )
    along = Window.partitionBy(by).orderBy("bucket")
    opens = F.coalesce(F.col("start") - F.lag("end").over(along) > gap, F.lit(True))
    numbered = buckets.withColumn("_opens", opens).withColumn("spell", F.count_if("_opens").over(along))
    return (
        numbered.groupBy(by, "spell")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.sum(c).alias(c) for c in sums])
        .select(by, "start", "end", *[c for c in sums if c != "llm_us"], (F.col("llm_us") / 1e6).alias("llm_seconds"))
    )
