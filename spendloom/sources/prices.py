"""Price lists: the live catalogue, overrides and the fallback table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import normalize_model
from ..operators.pricing import RATES, prices_frame
from ..schemas import PRICES
from . import price_tables

# Rate columns in the catalogue's spelling, in the order of RATES.
LISTED = ["prompt", "completion", "input_cache_read", "input_cache_write"]
_PRICE_MEMBERS = ", ".join(f"{name}: STRING" for name in LISTED)
ENTRY = f"""id: STRING, pricing: STRUCT<{_PRICE_MEMBERS},
            overrides: ARRAY<STRUCT<min_prompt_tokens: BIGINT, {_PRICE_MEMBERS}>>>"""
RATE = "decimal(18,6)"


def _per_million(listed: Column, base: Column) -> Column:
    """Dollars per token as text -> dollars per million; absent takes ``base``, nonsense is 0."""
    value = F.greatest(listed.try_cast("decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))
    rate = (F.coalesce(value, F.lit(0).cast("decimal(38,18)")) * 1_000_000).cast(RATE)
    return F.when(listed.isNull(), base).otherwise(rate)


def catalogue_prices(entries: DataFrame) -> DataFrame:
    """Price rows from catalogue entries ``pos, id, pricing``, later entries winning.

    A variant listed as free never hides a priced entry of the same key. A tier
    lists only the rates that change; the rest carry over from the base price.
    """
    zero = F.lit(0).cast(RATE)
    p = F.col("pricing")
    based = entries.filter("id != ''").select(
        "pos",
        normalize_model(F.col("id")).alias("key"),
        *[_per_million(p[name], zero).alias(rate) for name, rate in zip(LISTED, RATES)],
        p.overrides.alias("overrides"),
    )

    def tier(o: Column) -> Column:
        return F.struct(
            o["min_prompt_tokens"].alias("min_prompt"),
            *[_per_million(o[name], F.col(rate)).alias(rate) for name, rate in zip(LISTED, RATES)],
        )

    kept = F.filter(F.coalesce("overrides", F.array()), lambda o: F.coalesce(o["min_prompt_tokens"], F.lit(0)) > 0)
    rows = based.select("pos", "key", F.struct(*RATES, F.array_sort(F.transform(kept, tier)).alias("tiers")).alias("entry"))
    charged = (F.col("entry.input") != 0) | (F.col("entry.output") != 0)
    picked = rows.groupBy("key").agg(
        F.max_by("entry", F.when(charged, F.col("pos"))).alias("charged"),
        F.max_by("entry", "pos").alias("last"),
    )
    winner = F.when(F.col("charged.input") != 0, F.col("charged")).otherwise(F.col("last"))
    return picked.select("key", F.lit("catalogue").alias("source"), winner.alias("entry")).select(
        "key", "source", "entry.*"
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Price rows of a catalogue file, one JSON document with a ``data`` array."""
    docs = spark.read.option("multiLine", True).schema(f"data ARRAY<STRUCT<{ENTRY}>>").json(path)
    entries = docs.select(F.posexplode("data").alias("pos", "entry")).select("pos", "entry.*")
    return catalogue_prices(entries)


def rate_map_prices(docs: DataFrame, source: str, text: str = "value") -> DataFrame:
    """Price rows of JSON documents that map a key to its rates."""
    rates = "STRUCT<" + ", ".join(f"{r}: DOUBLE" for r in RATES) + ">"
    rows = docs.select(F.explode(F.from_json(text, f"MAP<STRING, {rates}>")).alias("key", "r"))
    key = normalize_model(F.col("key")) if source == "override" else F.col("key")
    return rows.select(
        key.alias("key"),
        F.lit(source).alias("source"),
        *[F.coalesce(F.col(f"r.{r}").cast(RATE), F.lit(0).cast(RATE)).alias(r) for r in RATES],
        F.array().cast("array<struct<min_prompt:bigint,input:decimal(18,6),output:decimal(18,6),cache_read:decimal(18,6),cache_write:decimal(18,6)>>").alias("tiers"),
    )


def read_rate_map(spark: SparkSession, path: str, source: str) -> DataFrame:
    return rate_map_prices(spark.read.option("wholetext", True).text(path), source)


def builtin_prices(spark: SparkSession) -> DataFrame:
    """The shipped overrides and fallback table."""
    rows = [(k, "manual", *rates, []) for k, *rates in price_tables.FALLBACK]
    rows += [(k, "override", *rates, []) for k, *rates in price_tables.OVERRIDES]
    table = prices_frame(spark, rows)
    key = F.when(F.col("source") == "override", normalize_model(F.col("key"))).otherwise(F.col("key"))
    return table.withColumn("key", key)


def load_prices(spark: SparkSession, catalogue: str | None = None, fallback: str | None = None) -> DataFrame:
    """Everything a price is looked up in. Without a catalogue the fallback table is all there is."""
    prices = builtin_prices(spark)
    if fallback is not None:
        prices = prices.filter("source = 'override'").unionByName(read_rate_map(spark, fallback, "manual"))
    if catalogue is not None:
        prices = prices.unionByName(read_catalogue(spark, catalogue))
    return prices
