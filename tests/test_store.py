"""Stored tables: passes that meet a compaction, reads that merge only what is newer, sessions and prices kept by difference."""

import pytest
from pyspark.sql import functions as F

from spendloom.operators import pricing
from spendloom.operators.sessions import sessions_rollup
from spendloom.plans import fixtures as fx
from spendloom.plans import ingest
from spendloom.plans.store import TABLES, Store


@pytest.fixture(scope="module")
def facts(spark, sf):
    columns = spark.createDataFrame([], TABLES["calls"][1]).columns
    tools = spark.createDataFrame([], TABLES["tool_calls"][1]).columns
    return fx.calls(spark, sf).select(*columns).limit(200).cache(), fx.tool_calls(spark, sf).select(*tools).limit(100).cache()


def some(calls, uid, model="m"):
    return calls.limit(1).select(*[F.lit(uid).alias(c) if c == "session_uid" else F.lit(model).alias(c) if c == "model" else F.col(c) for c in calls.columns])


def models(store, version=None):
    return sorted((r.session_uid, r.model) for r in store.read("calls", version).collect())


def test_a_pass_that_began_before_a_compaction_is_neither_lost_nor_outdated(spark, tmp_path, facts, monkeypatch):
    calls, _ = facts
    store, other = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    store.append({"calls": some(calls, "a").union(some(calls, "b"))})
    publish = Store._publish

    def meanwhile(self, rows):
        """What the slow pass wrote is published after the compaction that began later is."""
        monkeypatch.setattr(Store, "_publish", publish)
        other.compact()
        publish(self, rows)

    monkeypatch.setattr(Store, "_publish", meanwhile)
    store.append({"calls": some(calls, "b", "new").union(some(calls, "c"))})
    assert models(store) == [("a", "m"), ("b", "new"), ("c", "m")]

    def overtaken(self, rows):
        """A pass is published while a compaction runs: the compacted rows are older."""
        monkeypatch.setattr(Store, "_publish", publish)
        other.append({"calls": some(calls, "a", "newest")}, {"calls": spark.createDataFrame([("c",)], "uid STRING")})
        publish(self, rows)

    monkeypatch.setattr(Store, "_publish", overtaken)
    before = store.version()
    store.compact()
    assert models(store) == [("a", "newest"), ("b", "new")]
    assert models(store, before) == [("a", "m"), ("b", "new"), ("c", "m")]


def test_a_compacted_table_is_read_without_a_merge(spark, tmp_path, facts):
    calls, _ = facts
    store = Store(spark, str(tmp_path / "s"))
    store.append({"calls": calls})
    store.append({"calls": calls.withColumn("model", F.lit("x"))})
    plan = lambda: store.read("calls")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan()
    want = models(store)
    store.compact()
    assert models(store) == want and "max_by" not in plan()


def rolled(store):
    columns = store.spark.createDataFrame([], TABLES["sessions"][1]).columns
    whole = sessions_rollup(store.read("calls"), store.read("tool_calls"), store.read("identities")).select(*columns)
    return sorted(map(str, whole.collect())), sorted(map(str, ingest.sessions(store).select(*columns).collect()))


def test_sessions_follow_every_kind_of_write(spark, tmp_path, facts, monkeypatch):
    calls, tools = facts
    store = Store(spark, str(tmp_path / "s"))
    ingest.publish(store, {"calls": calls.filter("ts % 2 = 0"), "tool_calls": tools})
    uid = calls.filter("ts % 2 = 0").first().session_uid
    ingest.publish(store, {"calls": calls.withColumn("total_tokens", F.col("total_tokens") + 1)})
    want, got = rolled(store)
    assert want == got and len(got) > 3
    written = store._load("sessions", TABLES["sessions"][1] + ", pass STRING").count()
    monkeypatch.setattr(ingest, "NAMED_SESSIONS", 0)
    ingest.publish(store, {"calls": some(calls, uid, "again")})
    # One session was touched and one row written.
    assert store._load("sessions", TABLES["sessions"][1] + ", pass STRING").count() == written + 1
    want, got = rolled(store)
    assert want == got
    ingest.forget(store, uid)
    want, got = rolled(store)
    assert want == got and not any(f"'{uid}'" in r for r in got)


def test_only_calls_whose_price_changes_are_priced_again(spark, sf, tmp_path):
    calls = fx.calls(spark, sf)
    columns = spark.createDataFrame([], TABLES["calls"][1]).columns
    old = fx.price_list(spark).prices
    store = Store(spark, str(tmp_path / "s"))
    ingest.publish(store, {"calls": calls.select(*columns)})
    version = store.version()
    assert ingest.reprice_store(store, old, old) == version and ingest.reprice_store(store, old) == version
    key = calls.filter("priced").first().model
    hit = pricing.resolve_models(calls.select("model"), pricing.PriceList(old).prices).filter(F.col("model") == key).first().rate_key
    new = old.withColumn("output", F.when(F.concat_ws("|", "source", "key") == hit, F.col("output") + 7).otherwise(F.col("output")))
    lists = pricing.PriceList(old), pricing.PriceList(new)
    affected = pricing.affected_calls(calls, *lists)
    assert 0 < affected.count() < calls.count()
    ingest.reprice_store(store, new, old)
    want = sorted(map(str, pricing.reprice(calls.select(*columns), lists[1]).select(*columns).collect()))
    assert sorted(map(str, store.read("calls").select(*columns).collect())) == want
    assert store.version() == version + 1
    # A model that only the new list knows resolves anew.
    more = new.unionByName(new.limit(1).withColumn("key", F.lit("mystery-1")).withColumn("source", F.lit("override")))
    assert pricing.affected_calls(calls, lists[1], pricing.PriceList(more)).select("model").distinct().collect()[0].model == "mystery-1"


def counted(spark, rows):
    """The same rows, and how many of them were worked out so far."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            n.add(len(batch))
            yield batch

    return rows.mapInPandas(run, rows.schema), n


def test_the_work_behind_a_pass_is_done_once(spark, tmp_path, facts):
    """Which sessions a pass touches is read from what it wrote."""
    calls, _ = facts
    rows, n = counted(spark, calls)
    store = Store(spark, str(tmp_path / "once"))
    ingest.publish(store, {"calls": rows})
    assert n.value == calls.count() and store.read("sessions").count() == calls.select("session_uid").distinct().count()


def test_repricing_merges_stored_calls_once(spark, facts):
    """With the models at hand neither the choice of calls nor their new price looks at the calls a second time."""
    calls, _ = facts
    rows, n = counted(spark, calls)
    was, now, models = fx.price_list(spark), fx.doubled_price_list(spark), calls.select("model").distinct()
    got = pricing.reprice(pricing.affected_calls(rows, was, now, models), now, models)
    want = pricing.reprice(pricing.affected_calls(calls, was, now), now)
    got = sorted(map(str, got.select(*calls.columns).collect()))
    assert n.value == calls.count()
    assert got and got == sorted(map(str, want.select(*calls.columns).collect()))
