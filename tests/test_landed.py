"""Landed tables in a pass: several passes give what one gives, whatever comes late, and only what is touched is written."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spendloom import schemas
from spendloom.plans import fixture_logs as logs
from spendloom.plans import fixtures as fx
from spendloom.plans import ingest
from spendloom.plans.store import Store
from spendloom.schemas import CURSORS
from spendloom.sources import agy, opencode
from spendloom.sources.landed import TableSource, past_cursor

READ_ON = {"opencode": opencode.read_on, "agy": agy.read_on}
NOW = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def prices(spark):
    return fx.price_list(spark).prices.cache()


def a_pass(spark, store, prices, agent, tables):
    return ingest.run_pass(spark, store, [TableSource(agent, lambda _: tables, READ_ON[agent])], prices, NOW)


def rows(store, table):
    out = store.read(table)
    return sorted(map(str, out.select(*sorted(out.columns)).collect()))


def same(store, other, tables=("calls", "tool_calls", "identities", "sessions")):
    for table in tables:
        assert rows(store, table) == rows(other, table), table
    assert rows(store, "calls") and rows(store, "tool_calls")


def data(**fields):
    return json.dumps(fields)


SESSION = "id STRING, directory STRING, title STRING, model STRING, time_created BIGINT, time_updated BIGINT"
MESSAGE = "id STRING, session_id STRING, time_created BIGINT, time_updated BIGINT, data STRING"
PART = "id STRING, message_id STRING, session_id STRING, time_updated BIGINT, rowid BIGINT, data STRING"


def asked(name, updated=10, sid="s1", tool=None, tokens=7):
    content = [{"type": "tool", "id": "x", "name": tool}] if tool else []
    return (name, sid, 1000, updated, data(role="assistant", modelID="o3", tokens={"input": tokens}, content=content))


def ran(name, message, updated=10, sid="s1", tool="ls"):
    return (name, message, sid, updated, 1, data(type="tool", tool=tool, state={"time": {"start": 1, "end": 2001}}))


def store_tables(spark, session, message, part):
    return {
        "session": spark.createDataFrame(session, SESSION), "message": spark.createDataFrame(message, MESSAGE),
        "part": spark.createDataFrame(part, PART),
    }


# What a session's rows are in the first pass and in the second: of sessions, messages and parts.
SESSIONS = {
    "part": "a part comes passes after its message, in place of the tool inside it",
    "message": "a message comes after its part",
    "session": "a session comes after its messages",
    "again": "a message is written again without its tool",
    "tie": "a row lands late with the position of the cursor",
    "null": "a row without an update time lands late",
    "moved": "a message moves to the newer generation with another figure",
    "still": "nothing comes",
}


def owner(sid, updated=10):
    return (sid, f"/w/{sid}", sid, "m", 1000, updated)


def growth(spark):
    late = {"part": [ran("p1", "m1", 20, "part")]}
    messages = [asked("m1", sid="part", tool="in"), asked("m3", sid="session"), asked("m5", sid="tie", tool="in"), asked("m7", sid="null"),
                asked("m9", sid="moved", tool="in"), asked("m0", 5, "still", tool="in")]
    again = asked("m4", sid="again", tool="in")
    parts = [ran("p2", "m2", sid="message"), ran("p3", "m3", sid="session")]
    first = store_tables(spark, [owner(s) for s in SESSIONS if s != "session"], [*messages, again], parts)
    more = [asked("m2", 20, "still-other"), asked("m4", 20, "again", tokens=9), asked("m6", sid="tie"), asked("m8", None, "null")]
    second = store_tables(spark, [owner(s, 20 if s == "session" else 10) for s in SESSIONS], [*messages, *more], [*parts, *late["part"]])
    second["session_message"] = spark.createDataFrame(
        [("m9", "moved", "assistant", 1000, 10, data(modelID="o3", tokens={"input": 99}))], MESSAGE.replace("time_created", "type STRING, time_created"))
    return first, second


def test_two_opencode_passes_equal_one(spark, tmp_path, prices):
    """Whatever comes late; the pass writes the sessions it touches, and one that finds nothing writes nothing."""
    first, second = growth(spark)
    store, once = Store(spark, str(tmp_path / "two")), Store(spark, str(tmp_path / "one"))
    assert a_pass(spark, store, prices, "opencode", first).changed == len(SESSIONS) - 1
    assert {r.call_key for r in store.read("tool_calls").collect()} == {"inline:m1:x", "inline:m4:x", "inline:m5:x", "inline:m9:x", "inline:m0:x"}
    assert a_pass(spark, store, prices, "opencode", second).changed == len(SESSIONS) - 1
    a_pass(spark, once, prices, "opencode", second)
    same(store, once, ("calls", "tool_calls", "sessions"))
    assert {r.call_key for r in store.read("tool_calls").collect()} == {"part:p1", "part:p2", "part:p3", "inline:m5:x", "inline:m0:x"}
    assert {r.session_uid: r.input_tokens for r in store.read("calls").collect() if r.session_uid in ("again", "moved")} == {"again": 9, "moved": 99}
    last = max(store.passes(), key=lambda r: r.number)["pass"]
    assert {r.session_uid for r in store.deltas("calls").filter(F.col("pass") == last).collect()} == {"part", "session", "again", "tie", "null", "moved"}
    version = store.version()
    assert a_pass(spark, store, prices, "opencode", second).changed == 0 and store.version() == version


def test_cursor_of_an_empty_table(spark):
    none = {"t": spark.createDataFrame([], "time_updated BIGINT, v STRING")}
    news, ends = past_cursor(none, spark.createDataFrame([], CURSORS), "a", "time_updated")
    assert news["t"].count() == 0 and ends.first().position is None
    assert past_cursor(none, ends, "a", "time_updated")[0] == {}
    one = {"t": spark.createDataFrame([(3, "x")], "time_updated BIGINT, v STRING")}
    assert past_cursor(one, ends, "a", "time_updated")[0]["t"].count() == 1


def agy_steps(spark, homes, upto=99):
    """Conversations with one step that runs a tool or calls a model per directory named."""
    from tests.test_logs import num, sub

    made = []
    for name, named in homes.items():
        for i, home in enumerate(named[:upto], 1):
            times = sub(1, num(1, 1767225600 + i)) + sub(8, num(1, 1767225604 + i))
            meta = times + (sub(9, num(1, 1402) + num(2, 10) + num(3, 20)) if i % 2 else sub(4, sub(2, b"view")))
            made.append((name, i, 15 if i % 2 else 132, 3, bytearray(meta), bytearray(sub(28, sub(2, home.encode()))) if home else None))
    return {"steps": spark.createDataFrame(made, agy.STEPS)}


HOMES = {"turns": ["/b", "/b", "/a", "/a", "/a"], "begins": ["", "", "/a"], "stays": ["/b", "/b", "/b", "/a"], "ties": ["/b", "/b", "/a", "/a"], "ends": ["/c"]}


def test_agy_passes_equal_one(spark, tmp_path, prices):
    """The lead changes, comes about or stays; stored rows follow it without being decoded again."""
    store, once = Store(spark, str(tmp_path / "two")), Store(spark, str(tmp_path / "one"))
    for upto, changed in ((2, 5), (99, 4), (99, 0)):
        assert a_pass(spark, store, prices, "agy", agy_steps(spark, HOMES, upto)).changed == changed
    assert store.version() == 2
    a_pass(spark, once, prices, "agy", agy_steps(spark, HOMES))
    same(store, once, ("calls", "tool_calls", "identities", "sessions", "votes"))
    assert {r.uid: r.project for r in store.read("sessions").collect()} == {"turns": "/a", "begins": "/a", "stays": "/b", "ties": "/a", "ends": "/c"}


def test_agy_decodes_once(spark, sf):
    out = agy.normalise(logs.agy_steps(spark, sf).limit(50))
    for frame in (out.calls, out.tools, out.identities):
        assert "MapInPandas" not in frame._jdf.queryExecution().toString()


def test_a_failing_source_and_a_reread_of_one_agent(spark, tmp_path, prices, monkeypatch):
    """A source that fails leaves the other alone. After a normaliser changes, one agent is read again; its rows stay
    visible until then, and the other is not read."""
    def broken(_):
        raise ValueError

    store = Store(spark, str(tmp_path / "s"))
    steps, tables = agy_steps(spark, {"c1": ["/b", "/a", "/a"]}), store_tables(spark, [owner("s1")], [asked("m1")], [ran("p1", "m1")])
    good, other = TableSource("agy", lambda _: steps, agy.read_on), TableSource("opencode", lambda _: tables, opencode.read_on)
    result = ingest.run_pass(spark, store, [TableSource("agy", broken, agy.read_on), other], prices, NOW)
    assert result.errors == {"agy": "ValueError: "} and store.read("calls").count() == 1
    assert {r.agent: r.error for r in store.read("scan_status").collect()} == {"agy": "ValueError: ", "opencode": ""}
    assert ingest.run_pass(spark, store, [good, other], prices, NOW).changed == 1
    before = rows(store, "calls")
    monkeypatch.setitem(agy.MODEL_LABELS, 1402, "Renamed")
    ingest.reread(store, "agy")
    assert rows(store, "calls") == before
    assert ingest.run_pass(spark, store, [good, other], prices, NOW).changed == 1
    assert {(r.agent, r.model) for r in store.read("calls").collect()} == {("agy", "renamed"), ("opencode", "o3")}
    assert {(r.path, r.votes) for r in store.read("votes").collect()} == {("/a", 2), ("/b", 1)}


def test_steps_are_decoded_by_many_tasks(spark, sf, monkeypatch):
    """Blobs that are small in bytes are not put into one task."""
    steps, dealt_to, decode = logs.agy_steps(spark, sf), [], agy.decode_steps
    monkeypatch.setattr(agy, "STEPS_PER_TASK", 20, raising=False)
    monkeypatch.setattr(agy, "decode_steps", lambda rows: dealt_to.append(rows.rdd.getNumPartitions()) or decode(rows))
    stored = {"cursors": schemas.CURSORS, "votes": schemas.VOTES, "identities": schemas.IDENTITIES, "calls": schemas.CALLS, "tool_calls": schemas.TOOL_CALLS}
    got = agy.read_on({"steps": steps}, lambda table: spark.createDataFrame([], stored[table]))
    assert dealt_to and dealt_to[0] > 1
    assert got.rows.calls.count() == agy.normalise(steps).calls.count()
