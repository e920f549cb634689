"""Operators against brute force, with one key holding most rows, and their invariants."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spendloom.functions import names
from spendloom.operators import activity, asof, filters, ordered, pricing, rollups, sessions, state
from spendloom.plans import fixtures as fx
from spendloom.plans import report
from spendloom.sources import prices


@pytest.fixture(scope="module")
def rows(spark, sf):
    c, t = fx.calls(spark, sf).cache(), fx.tool_calls(spark, sf).cache()
    return c, t, sessions.sessions_rollup(c, t).cache()


# ---------------------------------------------------------------- ordered state


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_carry_against_brute_force(spark, chunk):
    rng = random.Random(chunk)
    data, brute = [], []
    for key, n in [("hot", 400), ("a", 3), ("b", 50)]:
        at, seen = 0, []
        per_key = []
        for _ in range(n):
            at += rng.choice([1, 1, 1, 20])
            per_key.append((key, at, rng.choice([None, None, rng.randrange(100)])))
        values = [v for *_, v in per_key]
        for i, (k, o, v) in enumerate(per_key):
            past = [x for x in values[:i] if x is not None]
            ahead = [x for x in values[i:] if x is not None]
            every = [x for x in values if x is not None]
            brute.append((k, o, past[-1] if past else None, past[0] if past else None, ahead[0] if ahead else None, every[0] if every else None))
        data += per_key
    df = spark.createDataFrame(data, "k STRING, o BIGINT, v INT")
    v = F.col("v")
    got = ordered.carry(
        df, ["k"], ["o"], last_before={"l": v}, first_before={"f": v}, first_from={"n": v}, first_of_key={"w": v}, rows_per_chunk=chunk
    )
    assert sorted((tuple(r) for r in got.select("k", "o", "l", "f", "n", "w").collect()), key=str) == sorted(brute, key=str)


def test_asof_with_one_hot_session(spark):
    rng = random.Random(5)
    calls, tools = [], []
    for i in range(600):
        s = "hot" if i % 3 else f"s{i % 40}"
        calls.append((s, f"c{i}", rng.choice([0, rng.randrange(40_000)]), Decimal(rng.randrange(1000))))
    for i in range(900):
        s = "hot" if i % 3 else f"s{i % 50}"
        tools.append((s, f"t{i}", f"tool{i % 4}", rng.choice([0, rng.randrange(45_000)]), 0.5, i % 5 == 0))
    c = spark.createDataFrame(calls, "session_uid STRING, call_key STRING, ts BIGINT, cost_usd DECIMAL(24,12)")
    t = spark.createDataFrame(tools, "session_uid STRING, call_key STRING, tool STRING, ts BIGINT, seconds DOUBLE, is_error BOOLEAN")

    def charge(s, ts):
        after = [(x[2], x[3], x[1]) for x in calls if x[0] == s and x[2] >= ts]
        return min(after)[1] if after else Decimal(0)

    got = {r.call_key: r.cost_usd for r in asof.tool_cost_asof(t, c).collect()}
    assert got == {x[1]: charge(x[0], x[3]) for x in tools}
    want = defaultdict(Decimal)
    for x in tools:
        want[x[2]] += charge(x[0], x[3])
    rolled = {r.tool: r for r in asof.tool_rollup(t, c, ["tool"]).collect()}
    assert {k: r.cost_usd for k, r in rolled.items()} == dict(want)
    assert sum(r.calls for r in rolled.values()) == 900


def test_numbered_is_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = report.numbered(df.orderBy("x"), "place").collect()
    assert [r.x for r in sorted(got, key=lambda r: r.place)] == sorted(r.x for r in got)
    assert sorted(r.place for r in got) == list(range(1, 5001))


# ---------------------------------------------------------------- pricing


def test_keys_given_twice_price_a_call_once(spark, sf):
    """Of several prices for one source and key the last holds, and no call is multiplied."""
    calls = fx.unpriced_calls(spark, sf)
    first = [(k, s, 99, 99, 99, 99, [(1, 98, 98, 98, 98)]) for k, s, *_ in fx.PRICE_ROWS]
    twice = pricing.price_calls(calls, pricing.PriceList.of(spark, [*first, *fx.PRICE_ROWS]))
    once = pricing.price_calls(calls, fx.price_list(spark))
    columns = ["call_key", "cost_usd", "priced"]
    got = twice.select(columns).collect()
    assert sorted(got) == sorted(once.select(columns).collect()) and len(got) == calls.count()


def call_frame(spark, rows):
    rows = [(*r, i) for i, r in enumerate(rows)]
    cols = "model STRING, input_tokens BIGINT, billable_output_tokens BIGINT, cache_read_tokens BIGINT, cache_write_tokens BIGINT, cache_write_1h_tokens BIGINT, n INT"
    return spark.createDataFrame(rows, cols)


def test_tiers_one_hour_writes_and_precedence(spark):
    table = pricing.prices_frame(spark, [
        ("m", "catalogue", "1", "10", "0.1", "1.25", [(200, "2", "20", "0.2", "2.5"), (300, "4", "40", "0.4", "5")]),
        ("m2", "override", "7", "0", "0", "0", []), ("m2", "catalogue", "8", "0", "0", "0", []),
        ("m2", "manual", "9", "0", "0", "0", []), ("gpt-5", "manual", "1", "0", "0", "0", []), ("gpt-5-mini", "manual", "2", "0", "0", "0", []),
    ])
    got = pricing.price_calls(call_frame(spark, [
        ("m", 199, 1, 0, 0, 0), ("m", 100, 1, 50, 50, 0), ("v/M-20260101", 300, 1, 0, 0, 0), ("m", 0, 0, 0, 100, 500),
        ("m2", 1, 0, 0, 0, 0), ("x/gpt-5-mini-high", 1, 0, 0, 0, 0), ("gpt-5-big", 1, 0, 0, 0, 0), ("zz", 1, 0, 0, 0, 0), ("", 1, 0, 0, 0, 0),
        ("m", 10**15, 0, 0, 0, 0), ("m2", 2 * 10**9 + 1, 0, 0, 0, 0),
    ]), pricing.PriceList(table)).collect()
    got.sort(key=lambda r: r.n)
    micro = [round(float(r.cost_usd) * 1e6, 6) for r in got]
    assert micro == [209.0, 100 * 2 + 20 + 10 + 125, 1240.0, 200.0, 7.0, 2.0, 1.0, 0.0, 0.0, 4e15, 14000000007.0]
    assert [r.priced for r in got] == [True] * 7 + [False, False, True, True]


def test_catalogue_free_variant_and_tiers(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text("""{"data": [
        {"id": "v/a.1", "pricing": {"prompt": "0.000002", "completion": "0.00001", "overrides": [
            {"min_prompt_tokens": 200000, "prompt": "0.000004"}, {"min_prompt_tokens": 0, "prompt": "9"}]}},
        {"id": "w/a-1", "pricing": {"prompt": "0", "completion": "0"}},
        {"id": "v/b", "pricing": {"prompt": "-1", "completion": "x"}}, {"id": "", "pricing": {}}]}""")
    got = {r.key: r for r in prices.read_catalogue(spark, str(path)).collect()}
    assert set(got) == {"a-1", "b"}
    assert (float(got["a-1"].input), float(got["a-1"].output)) == (2.0, 10.0)
    assert [(t.min_prompt, float(t.input), float(t.output)) for t in got["a-1"].tiers] == [(200000, 4.0, 10.0)]
    assert float(got["b"].input) == 0
    every = prices.load_prices(spark, str(path))
    assert {r.source for r in pricing.price_list_sizes(every).collect()} == {"override", "catalogue", "manual"}
    assert pricing.known_model_keys(every).count() == 46
    assert all(r.reachable for r in pricing.fallback_reachability(every).collect())


def test_names(spark):
    df = spark.createDataFrame([
        ("anthropic/claude-opus-4.8",), ("claude-opus-4-8-20260528",), ("Gemini 3.1 Pro (High)",), ("o3",), ("o3-mini",), ("OpenAI: x",), ("",),
    ], "m STRING")
    got = df.select(names.normalize_model(F.col("m")), names.hyphenate_label(F.col("m")), names.provider_of_model(F.col("m"))).collect()
    assert [r[0] for r in got][:2] == ["claude-opus-4-8"] * 2
    assert got[2][1] == "gemini-3.1-pro"
    assert [r[2] for r in got] == ["Anthropic", "Anthropic", "Google", "Other", "OpenAI", "OpenAI", "Other"]


# ---------------------------------------------------------------- reports


def test_every_axis_adds_up(rows):
    c, t, s = rows
    total = rollups.totals(c, t, s).first()
    for table in (rollups.models(c), rollups.project_models(c), rollups.daily_by_model(c), s, activity.activity(c, 300)):
        if "messages" in table.columns:
            continue
        assert table.agg(F.sum("cost_usd")).first()[0] == total.cost_usd
        assert table.agg(F.sum("calls")).first()[0] == total.calls
    per_provider = rollups.providers(c)
    assert per_provider.agg(F.sum("calls")).first()[0] == total.calls
    assert per_provider.agg(F.sum("pct")).first()[0] == pytest.approx(100)
    assert sum(r.calls for r in rollups.tools(t, c).collect()) == t.count()
    assert activity.activity(c, 300).agg(F.sum("messages")).first()[0] == c.filter("ts > 0").count()


def test_one_filter_through_every_door(rows):
    c, t, s = rows
    f = filters.parse_filter({"model": "gpt-5.5", "agent": ["pi", "claude"], "date_from": "2024-01-03", "date_to": "2024-01-20"})
    shown = filters.filter_calls(c, f)
    assert shown.filter("ts = 0").count() == 0
    users = {r.session_uid for r in c.filter("model = 'gpt-5.5'").collect()}
    assert {r.session_uid for r in filters.filter_tools(t, c, f).collect()} <= users
    assert {r.uid for r in filters.filter_sessions(s, c, f).collect()} <= users
    page = report.page(c, t, s, f)
    assert page["totals"].first().calls == shown.count() == page["models"].agg(F.sum("calls")).first()[0]
    assert page["project_tree"].filter("sessions_list is null or models is null or tools is null").count() == 0
    assert report.as_json(page["totals"]).first().value.startswith("{")
    for name in ("calls", "tools", "sessions"):
        page[name].unpersist()


def test_filter_arguments():
    f = filters.parse_filter({"model": ["a, b", "", "c"], "date_to": "2026-03-29"}, "Europe/Berlin")
    assert f.models == ("a", "b", "c")
    # The day is 23 hours long and ends one second before the next begins.
    g = filters.parse_filter({"date_from": "2026-03-29"}, "Europe/Berlin")
    assert f.to_ts - g.from_ts == 23 * 3600 - 1
    with pytest.raises(ValueError, match="not a date"):
        filters.parse_filter({"date_from": "yesterday"})


def test_a_project_of_two_agents_is_one_row(spark):
    c = spark.createDataFrame([
        ("s1", "a", "pi", "/p", "m", 100, 5, 1.0, Decimal(1)), ("s2", "b", "claude", "/p", "m", 200, 5, 1.0, Decimal(2)),
    ], "session_uid STRING, call_key STRING, agent STRING, project STRING, model STRING, ts BIGINT, output_tokens BIGINT, llm_seconds DOUBLE, cost_usd DECIMAL(24,12)")
    for n in ("input", "cache_read", "cache_write", "reasoning", "total"):
        c = c.withColumn(f"{n}_tokens", F.lit(0).cast("bigint"))
    t = spark.createDataFrame([], "session_uid STRING, agent STRING, project STRING, seconds DOUBLE, is_error BOOLEAN")
    (row,) = rollups.projects(sessions.sessions_rollup(c, t), c).collect()
    assert (row.cost_usd, row.agents, row.sessions, row.llm_seconds, row.avg_tps) == (3, ["claude", "pi"], 2, 2.0, 5.0)


def test_reports_are_ordered(rows):
    c, t, s = rows
    costs = [r.cost for r in rollups.models_report(c).collect()]
    assert costs == sorted(costs, reverse=True)
    legend = [r.cost_usd for r in rollups.model_legend(c).collect()]
    assert legend == sorted(legend, reverse=True)
    last = [r.last_ts for r in sessions.sessions_top(s, 20).collect()]
    assert last == sorted(last, reverse=True) and len(last) == 20
    days = [r.day for r in rollups.daily_recent(c, 5).collect()]
    assert days == sorted(days) and len(days) == 5
    uid = c.groupBy("session_uid").count().orderBy(F.desc("count")).first().session_uid
    order = [(r.ts, r.call_key) for r in sessions.session_calls(c, uid).collect()]
    assert order == sorted(order) and len(order) > 1
    assert rollups.providers(c, named=2).collect()[-1].provider == "Other"


def test_activity_window_and_page(rows):
    c, *_ = rows
    window, buckets = report.activity_page(c, range_seconds=6 * 3600)
    assert window["step"] == 300 and window["to_ts"] - window["from_ts"] == 6 * 3600
    got = buckets.collect()
    assert [r.bucket for r in got] == sorted((r.bucket for r in got), reverse=True) and got[0].partial and not got[1].partial
    everything = activity.activity_window(c, 0).first()
    assert everything.from_ts == everything.oldest and everything.step == 21600
    later = activity.activity_window(c, 86400, generated_at=everything.newest + 10 * 86400).first()
    assert later.to_ts == everything.newest + 10 * 86400
    assert report.activity_page(c, filters.Filter(models=["none"]))[0] == {"oldest": 0, "newest": 0}
    with pytest.raises(ValueError):
        activity.activity_window(c, step=7)
    with pytest.raises(ValueError):
        activity.activity(c, 0)


def test_summary_text(spark, rows):
    c, t, s = rows
    status = spark.createDataFrame([("pi", 3, 1, 20, ""), ("codex", 1, 1, 0, "boom")], "agent STRING, files_seen BIGINT, files_changed BIGINT, calls_ingested BIGINT, error STRING")
    lines = [r.line for r in report.summary(c, t, s, status).collect()]
    assert f"calls      {c.count()}" in lines
    assert any(x.startswith("history    2024-01-01 to 2024-01-") for x in lines)
    assert lines[-1] == "codex          1 files       1 changed       0 calls  boom"


# ---------------------------------------------------------------- state

KEYED = "session_uid STRING, call_key STRING, agent STRING, project STRING, n INT"


def test_upsert_twice_is_once_and_keeps_owner(spark):
    old = spark.createDataFrame([("s", "a", "pi", "/p", 1), ("s", "b", "pi", "/p", 2)], KEYED)
    new = spark.createDataFrame([("s", "a", "claude", "/q", 9), ("s", "c", "pi", "/q", 3)], KEYED)
    once = state.upsert_calls(old, new)
    want = [("s", "a", "pi", "/p", 9), ("s", "b", "pi", "/p", 2), ("s", "c", "pi", "/q", 3)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, state.upsert_calls(once, new).collect())) == want


def test_upsert_with_very_many_copies(spark):
    new = spark.range(20_000).select(
        F.lit("s").alias("session_uid"), F.lit("k").alias("call_key"), F.lit("pi").alias("agent"), F.lit("/p").alias("project"), F.col("id").cast("int").alias("n")
    )
    got = state.upsert_calls(spark.createDataFrame([], KEYED), new, seq="n").collect()
    assert [r.n for r in got] == [19_999]


def test_status_remembers(spark):
    cols = "agent STRING, last_scan_at TIMESTAMP, last_full_at TIMESTAMP, files_seen BIGINT, files_changed BIGINT, calls_ingested BIGINT, error STRING"
    from datetime import datetime

    a, b = datetime(2026, 1, 1), datetime(2026, 1, 2)
    stored = spark.createDataFrame([("pi", a, a, 5, 2, 9, "old"), ("codex", a, None, 1, 0, 0, "")], cols)
    now = spark.createDataFrame([("pi", b, None, 5, 0, 0, "")], cols)
    got = {r.agent: r for r in state.record_status(stored, now).collect()}
    assert (got["pi"].last_scan_at, got["pi"].last_full_at, got["pi"].error) == (b, a, "")
    assert got["codex"].last_scan_at == a
    agents = spark.createDataFrame([("pi",), ("agy",)], "agent STRING")
    states = state.source_states(agents, state.record_status(stored, now))
    assert state.source_summary(states).first().summary == "1 of 2 sources found · 1 not scanned"


def test_cursor_reset(spark):
    st = spark.createDataFrame([("/a", "pi"), ("/b", "claude")], "path STRING, agent STRING")
    assert [r.path for r in state.reset_cursors(st, "claude").collect()] == ["/a"]


def test_pages_by_key_are_the_order(spark):
    """Numbers, numbers as text, text of any case, nulls and equal values, page by page in both directions."""
    values = ["10", "9", " 9 ", "b", "B", "a", None, "", "-1", "NaN", "1e3", "b", None, "z", "9"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v STRING, id INT").cache()
    for up in (True, False):
        want = [r.id for r in filters.sort_rows(df, "v", up, ["id"]).collect()]
        got, last = [], None
        while True:
            rows = filters.page_after(df, "v", up, ["id"], 4, last).collect()
            if not rows:
                break
            got, last = got + [r.id for r in rows], rows[-1].asDict()
        assert got == want


def test_spells_against_a_plain_loop(spark):
    import random

    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([0, None, *range(1, 4000)])) for _ in range(400)] + [("c", 100), ("c", 160), ("c", 221)]
    zero = ", ".join(f"1L AS {c}" for c in activity.BUCKET_SUMS)
    calls = spark.createDataFrame(rows, "project STRING, ts BIGINT").selectExpr(
        "*", *zero.split(", "), "0.5D AS llm_seconds", "CAST(1 AS DECIMAL(24,12)) AS cost_usd", "true AS priced")
    want = []
    for who in {p for p, _ in rows}:
        spell = []
        for ts in [*sorted(t for p, t in rows if p == who and t), None]:
            if spell and (ts is None or ts - spell[-1] > 60):
                want.append((who, spell[0], spell[-1], len(spell)))
                spell = []
            spell.append(ts)
    got = activity.activity_sessions(calls, 60)
    assert sorted(map(str, got.select("project", "start", "end", "messages").collect())) == sorted(
        f"Row(project={p!r}, start={s}, end={e}, messages={n})" for p, s, e, n in want)
    assert got.filter("input_tokens != messages OR cost_usd != messages OR llm_seconds != messages / 2").isEmpty()
    assert activity.activity_sessions(calls.limit(0), 60).isEmpty()
