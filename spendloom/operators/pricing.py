"""Prices: which rates a model pays, what a call costs, repricing, coverage."""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_model

# A one-hour cache write costs this many times the input rate.
ONE_HOUR_WRITE_FACTOR = 2

COST = "decimal(24,12)"
RATES = ["input", "output", "cache_read", "cache_write"]
_ARROW_RATES = [(r, pa.decimal128(18, 6)) for r in RATES]
ARROW_PRICES = pa.schema([
    ("key", pa.string()), ("source", pa.string()), *_ARROW_RATES,
    ("tiers", pa.list_(pa.struct([("min_prompt", pa.int64()), *_ARROW_RATES]))),
])


def prices_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(key, source, input, output, cache_read, cache_write, tiers) rows as a price DataFrame."""

    def rates(*values):
        return {r: Decimal(str(v)).quantize(Decimal("0.000001")) for r, v in zip(RATES, values)}

    clean = [
        {"key": key, "source": source, **rates(i, o, cr, cw),
         "tiers": [{"min_prompt": start, **rates(*tier)} for start, *tier in tiers]}
        for key, source, i, o, cr, cw, tiers in rows
    ]
    # An Arrow table becomes a local relation: no task is needed to read it.
    return spark.createDataFrame(pa.Table.from_pylist(clean, ARROW_PRICES))


def rate_bands(prices: DataFrame) -> DataFrame:
    """One row per (price, prompt-size band): a tiered price becomes an equi-join plus a range test.

    Rates are turned into whole millionths of a dollar per million tokens, so a
    token count times a rate is a whole number of 1e-12 dollars.
    """
    base = F.array(F.struct(F.lit(0).cast("bigint").alias("min_prompt"), *RATES))
    ladder = F.array_sort(F.concat(base, F.coalesce("tiers", F.array().cast(prices.schema["tiers"].dataType))))
    steps = prices.select("key", "source", ladder.alias("ladder")).select(
        "key", "source", "ladder", F.posexplode("ladder").alias("i", "step")
    )
    return steps.select(
        F.concat_ws("|", "source", "key").alias("rate_key"),
        F.col("step.min_prompt").alias("band_from"),
        F.coalesce(F.try_element_at("ladder", F.col("i") + 2).getField("min_prompt"), F.lit(2**63 - 1)).alias("band_to"),
        *[(F.col(f"step.{r}") * 1_000_000).cast("bigint").alias(f"rate_{r}") for r in RATES],
    ).filter("band_from < band_to")


class PriceList:
    """A price DataFrame with one row per source and key, the last of several winning."""

    def __init__(self, prices: DataFrame):
        row = F.struct(*[c for c in prices.columns if c not in ("source", "key")])
        latest = prices.withColumn("_n", F.monotonically_increasing_id()).groupBy("source", "key").agg(F.max_by(row, "_n").alias("_row"))
        self.prices = latest.select("key", "source", "_row.*").select(*prices.columns)

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple]) -> PriceList:
        """Price list of literal rows, see ``prices_frame``."""
        return cls(prices_frame(spark, rows))


def resolve_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """``model`` -> ``rate_key`` for a table of distinct models, by equi-joins alone.

    The substring test becomes a join as well: a model is exploded into its
    substrings of the lengths that occur among the patterns.
    """
    named = models.select("model").distinct().withColumn("normal", normalize_model(F.col("model")))
    exact = prices.filter("source != 'manual'").select(
        F.col("key").alias("normal"),
        F.when(F.col("source") == "override", 0).otherwise(1).alias("rank"),
        F.concat_ws("|", "source", "key").alias("rate_key"),
    ).distinct()
    # At most two rows per key here, so the aggregate is over a bounded group.
    best = exact.groupBy("normal").agg(F.min_by("rate_key", "rank").alias("exact_key"))
    patterns = prices.filter("source = 'manual'").select(
        F.col("key").alias("piece"), F.concat_ws("|", "source", "key").alias("pattern_key")
    ).distinct()
    lengths = patterns.select(F.sort_array(F.collect_set(F.length("piece"))).alias("ls")).scalar()
    low = F.lower(F.col("model"))
    starts = F.when(F.length(low) > 0, F.sequence(F.lit(1), F.length(low)))
    pieces = (
        named.filter("model != ''")
        .select("model", low.alias("low"), F.explode(starts).alias("at"), lengths.alias("ls"))
        .select("model", "low", "at", F.explode("ls").alias("n"))
        .filter(F.col("at") + F.col("n") - 1 <= F.length("low"))
        .select("model", F.col("low").substr(F.col("at"), F.col("n")).alias("piece"))
        .distinct()
    )
    by_pattern = (
        pieces.join(patterns, "piece")
        .groupBy("model")
        .agg(F.min_by("pattern_key", F.struct(-F.length("piece"), "piece")).alias("pattern_key"))
    )
    return (
        named.join(best, "normal", "left")
        .join(by_pattern, "model", "left")
        .select(
            "model",
            F.when(F.col("model") != "", F.coalesce("exact_key", "pattern_key")).alias("rate_key"),
        )
    )


def with_rate_key(calls: DataFrame, prices: PriceList, models: DataFrame | None = None) -> DataFrame:
    """Add ``rate_key``; null where nothing prices the model.

    Distinct models are resolved, once each, and joined back; how is Spark's choice.
    ``models`` are those of the calls, and may be more, where they are known already.
    """
    resolved = resolve_models(calls.select("model") if models is None else models, prices.prices)
    return calls.join(resolved, "model", "left")


def prompt_tokens() -> Column:
    return F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_write_tokens")


def cost_units() -> Column:
    """Cost of a call in 1e-12 dollars from its token columns and its ``rate_*`` columns."""
    long_write = F.least(F.greatest("cache_write_1h_tokens", F.lit(0)), F.col("cache_write_tokens"))
    terms = [
        (F.col("input_tokens"), F.col("rate_input")),
        (F.col("billable_output_tokens"), F.col("rate_output")),
        (F.col("cache_read_tokens"), F.col("rate_cache_read")),
        (F.col("cache_write_tokens") - long_write, F.col("rate_cache_write")),
        (long_write, F.col("rate_input") * ONE_HOUR_WRITE_FACTOR),
    ]
    products = [n.cast("decimal(19,0)") * r.cast("decimal(19,0)") for n, r in terms]
    return sum(products[1:], products[0])


def price_calls(calls: DataFrame, prices: PriceList, models: DataFrame | None = None) -> DataFrame:
    """Set ``cost_usd`` and ``priced`` on every call from its token columns.

    A call whose ``sized`` column is false happened but its size is unknown: it
    stays unpriced. Each call meets exactly one band of its rate key.
    """
    sized = F.col("sized") if "sized" in calls.columns else F.lit(True)
    keyed = with_rate_key(calls.drop("cost_usd", "priced"), prices, models).withColumn("_prompt", prompt_tokens())
    bands = rate_bands(prices.prices).withColumnRenamed("rate_key", "_band_key")
    hit = (
        (F.col("rate_key") == F.col("_band_key"))
        & (F.col("_prompt") >= F.col("band_from"))
        & (F.col("_prompt") < F.col("band_to"))
    )
    # Null beyond a trillion dollars, which no record can mean.
    exact = (F.col("_units").try_cast("decimal(24,0)") * F.lit(Decimal("0.000000000001"))).try_cast(COST)
    priced = F.col("_band_key").isNotNull() & sized & exact.isNotNull()
    return (
        keyed.join(bands, hit, "left")
        .withColumn("_units", cost_units())
        .withColumn("cost_usd", F.when(priced, exact).otherwise(F.lit(0).cast(COST)))
        .withColumn("priced", priced)
        .drop("rate_key", "_prompt", "_band_key", "band_from", "band_to", "_units", *[f"rate_{r}" for r in RATES])
    )


def reprice(calls: DataFrame, prices: PriceList, models: DataFrame | None = None) -> DataFrame:
    """Cost and priced flag of stored calls under another price list.

    Everything needed is in the stored columns. A call stored without any token
    is one whose size was never known, so it stays unpriced.
    """
    known = prompt_tokens() + F.col("billable_output_tokens") > 0
    return price_calls(calls.withColumn("sized", known), prices, models).drop("sized")


def affected_calls(calls: DataFrame, old: PriceList, new: PriceList, models: DataFrame | None = None) -> DataFrame:
    """The calls that two price lists may price differently; all others have the same cost under both.

    A call is among them if its model resolves to another key, or if its prompt
    size lies in a band of its key that only one of the lists has. Both tests
    are made on distinct models and on bands; calls are only looked up.
    """
    models = calls.select("model").distinct() if models is None else models
    was = resolve_models(models, old.prices).select("model", F.col("rate_key").alias("_old_key"))
    now = resolve_models(models, new.prices).select("model", F.col("rate_key").alias("_new_key"))
    resolved = was.join(now, "model")
    moved = resolved.filter("NOT (_old_key <=> _new_key)").select("model", F.lit(None).cast("bigint").alias("_from"), F.lit(None).cast("bigint").alias("_to"))
    before, after = rate_bands(old.prices), rate_bands(new.prices)
    differing = before.exceptAll(after).union(after.exceptAll(before)).groupBy("rate_key", "band_from", "band_to").agg(F.lit(1))
    same = resolved.filter("_old_key <=> _new_key")
    rated = same.join(differing, same["_new_key"] == differing["rate_key"]).select(
        "model", F.col("band_from").cast("bigint").alias("_from"), F.col("band_to").cast("bigint").alias("_to"))
    wanted = moved.union(rated).withColumnRenamed("model", "_model")
    prompt = prompt_tokens()
    hit = (F.col("model") == F.col("_model")) & (F.col("_from").isNull() | ((prompt >= F.col("_from")) & (prompt < F.col("_to"))))
    return calls.join(wanted, hit, "left_semi")


def fallback_reachability(prices: DataFrame) -> DataFrame:
    """For each fallback pattern, whether the catalogue leaves it the only price."""
    live = prices.filter("source = 'catalogue'").select(F.col("key").alias("normal")).distinct()
    return (
        prices.filter("source = 'manual'")
        .select(F.col("key").alias("pattern"))
        .distinct()
        .withColumn("normal", normalize_model(F.col("pattern")))
        .join(live.withColumn("live", F.lit(True)), "normal", "left")
        .select("pattern", F.col("live").isNull().alias("reachable"))
    )


def known_model_keys(prices: DataFrame) -> DataFrame:
    """Every model key the catalogue or the fallback table knows, sorted."""
    return prices.filter("source != 'override'").select("key").distinct().orderBy("key")


def price_list_sizes(prices: DataFrame) -> DataFrame:
    """How many keys each source contributes."""
    return prices.groupBy("source").agg(F.count_distinct("key").alias("keys"))
