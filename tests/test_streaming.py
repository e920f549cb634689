"""A stream over the same rows gives what the batch job gives."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendloom.operators import activity, ordered
from spendloom.plans import fixtures as fx
from spendloom.plans.store import Store
from spendloom.sources import claude, codex
from spendloom.streaming import live, stateful


def drain(stream, name, mode, tmp_path):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


def land(df, folder, parts):
    """Land rows in several files, one per part in the given order."""
    for i, test in enumerate(parts):
        df.filter(test).coalesce(1).write.mode("append").parquet(str(folder))


@pytest.fixture(scope="module")
def calls(spark, sf):
    return fx.calls(spark, sf).cache()


def test_activity_equals_batch(spark, calls, tmp_path):
    folder = tmp_path / "calls"
    land(calls, folder, ["ts < 1705000000", "ts >= 1705000000"])
    stream = live.live_activity(live.read_landed_calls(spark, str(folder)), 3600, "40 days")
    got = drain(stream, "live_activity", "complete", tmp_path)
    want = activity.activity(calls, 3600)
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_duplicates_are_dropped(spark, calls, tmp_path):
    folder = tmp_path / "twice"
    dated = calls.filter("ts > 0")
    land(dated, folder, ["true", "true"])
    stream = live.first_of_each(live.read_landed_calls(spark, str(folder)), "60 days")
    got = drain(stream, "first_of_each", "append", tmp_path)
    assert got.count() == dated.count()


def test_upserts_into_the_store(spark, calls, tmp_path):
    """Late and repeated rows are merged; a second run over the same checkpoint adds nothing."""
    folder = tmp_path / "in"
    land(calls, folder, ["call_key like '%1'"])
    store = Store(spark, str(tmp_path / "store"))

    def once():
        stream = live.read_landed(spark, str(folder), fx_schema())
        live.start(stream, live.upsert_into(store), str(tmp_path / "cp"), once=True).awaitTermination()

    once()
    assert store.read("calls").count() == calls.filter("call_key like '%1'").count()
    land(calls.withColumn("cost_usd", F.lit(Decimal(7)).cast("decimal(24,12)")), folder, ["call_key like '%1'"])
    land(calls, folder, ["call_key not like '%1'"])
    once()
    got = store.read("calls")
    assert got.count() == calls.count()
    assert got.filter("call_key like '%1' and cost_usd != 7").count() == 0
    version = store.version()
    once()
    assert store.version() == version


def fx_schema():
    from spendloom import schemas

    return schemas.CALLS


def counter_rows(spark, sf):
    e = fx.table(spark, sf, "events").select(
        F.concat(F.lit("u"), "user_id").alias("session_uid"), F.col("event_id").alias("ordinal"), "event_type",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    base = F.when(F.col("event_type") == "click", F.col("k")).otherwise(F.col("ordinal") * 10 + F.col("k"))
    has_total, has_last = F.col("k") % 10 != 3, (F.col("event_type") == "signup") | (F.col("k") % 10 == 3)
    scale = [4, 1, 2, 1]
    return e.select(
        "session_uid", "ordinal",
        *[F.when(has_total, base * s).alias(f"total_{c}") for c, s in zip(codex.COUNTERS, scale)],
        *[F.when(has_last & (F.col("k") % s != 1), F.col("k") * s).alias(f"last_{c}") for c, s in zip(codex.COUNTERS, [7, 5, 3, 2])],
    )


def test_counter_deltas_keep_state(spark, sf, tmp_path):
    rows = counter_rows(spark, sf).cache()
    folder = tmp_path / "counters"
    land(rows, folder, ["ordinal < 300", "ordinal >= 300"])
    some_total = F.greatest(*[f"total_{c}" for c in codex.COUNTERS]).isNotNull()
    some_last = F.greatest(*[f"last_{c}" for c in codex.COUNTERS]).isNotNull()
    batch = ordered.carry(
        rows.filter(some_total | some_last).select(
            "session_uid", "ordinal",
            F.when(some_total, F.struct(*[F.col(f"total_{c}").alias(c) for c in codex.COUNTERS])).alias("total"),
            F.when(some_last, F.struct(*[F.col(f"last_{c}").alias(c) for c in codex.COUNTERS])).alias("last"),
        ),
        ["session_uid"], ["ordinal"], last_before={"before": F.col("total")}, rows_per_chunk=50,
    )
    columns = ["session_uid", "ordinal", "input", "cache_read", "generated", "reasoning", "sized"]
    want = codex.counter_deltas(batch).select(columns)
    stream = stateful.counter_deltas(live.read_landed(spark, str(folder), rows.schema.simpleString()[7:-1].replace(":", " "), 1))
    got = drain(stream, "counters", "append", tmp_path).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_tool_pairs_keep_state(spark, tmp_path):
    schema = "session_uid STRING, ordinal BIGINT, pos INT, use BOOLEAN, id STRING, name STRING, us BIGINT, is_error BOOLEAN"
    rows = spark.createDataFrame([
        ("a", 1, 0, True, "x", "read", 1_000_000, False),
        ("a", 2, 0, True, "y", "write", 2_000_000, False),
        ("a", 3, 0, False, "x", "", 4_500_000, True),
        ("b", 4, 0, False, "old", "", 5_000_000, False),
        ("a", 5, 0, False, "y", "", 6_000_000, False),
    ], schema)
    folder = tmp_path / "blocks"
    land(rows, folder, ["ordinal <= 2", "ordinal > 2"])
    got = drain(stateful.pair_tools(live.read_landed(spark, str(folder), schema, 1)), "pairs", "append", tmp_path)
    # Later rows of a key win, as in the keyed write: the completed ones.
    newest = {(r.session_uid, r.call_key): (r.tool, r.us, r.seconds, r.is_error) for r in got.orderBy("us").collect()}
    batch = claude.pair_tools(rows.withColumn("path", F.col("session_uid")).withColumn("project", F.lit("")))
    want = {(r.session_uid, r.call_key): (r.tool, r.us, r.seconds, r.is_error) for r in batch.collect()}
    assert newest == want
