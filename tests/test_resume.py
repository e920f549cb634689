"""Logs read in two parts, the second from the tail of the first, give what one read gives."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spendloom.operators import state
from spendloom.plans import ingest
from spendloom.plans.store import Store
from spendloom.sources import claude, codex, gemini, pi, registry, resume
from spendloom.sources.lines import read_lines, read_ranges, windows
from spendloom.sources.prices import builtin_prices


def at(i):
    return f"2026-03-01T00:{i:02d}:00Z"


def c_said(i, mid, blocks=(), tokens=10, **more):
    usage = {"input_tokens": tokens, "output_tokens": tokens * 2}
    return {"type": "assistant", "timestamp": at(i), "uuid": f"u{i}", "message": {"id": mid, "model": "claude-sonnet-4", "content": list(blocks), "usage": usage}, **more}


def use(i):
    return {"type": "tool_use", "id": f"t{i}", "name": f"tool{i}"}


def result(i, wrong=False):
    return {"type": "tool_result", "tool_use_id": f"t{i}", "is_error": wrong}


CLAUDE = [
    {"type": "summary", "summary": "x"}, {"type": "user", "timestamp": at(1), "cwd": "/w/a", "message": {"content": "hi"}},
    c_said(2, "m1", [{"type": "thinking", "thinking": "long thought " * 9}]), c_said(3, "m1", [use(1)], 20), {"type": "user", "timestamp": at(4), "message": {"content": [result(1)]}},
    c_said(5, "m1", [use(2), use(3)], 30), c_said(6, "m2", [{"type": "thinking", "thinking": "more"}], 0), c_said(7, "m2", [use(4)], 5, cwd="/w/b"), {"type": "user", "timestamp": at(8), "message": {"content": [result(3, True)]}},
    {"type": "user", "timestamp": at(9), "message": {"content": [result(2), result(9)]}}, c_said(10, None), c_said(11, "m4"), {"type": "user", "timestamp": at(12), "message": {"content": [result(4)]}}, c_said(13, "m5", [{"type": "tool_use", "name": "noid"}]),
    {"type": "user", "timestamp": at(14)}, {"type": "user", "timestamp": at(15)}, c_said(17, "m6"), c_said(18, "m6", [use(6)]), {"type": "user", "timestamp": at(19), "message": {"content": [result(6)]}}, c_said(20, "m6"),
]
PI = [
    {"type": "session", "id": "pi-1", "cwd": "/w", "timestamp": at(0)}, {"type": "message", "id": "a", "timestamp": at(1), "message": {"role": "user", "content": [{"type": "text"}]}},
    {"type": "message", "id": "b", "timestamp": at(2), "message": {"role": "assistant", "model": "o3", "usage": {"input": 9, "output": 4}, "content": [{"type": "toolCall", "id": "t1", "name": "read"}, {"type": "toolCall", "id": "t2", "name": "write"}]}},
    {"type": "message", "id": "c", "timestamp": at(3), "message": {"role": "toolResult", "content": [{"type": "toolResult", "toolCallId": "t2", "startTime": at(2), "endTime": at(3)}]}}, "broken",
    {"type": "message", "timestamp": at(4), "message": {"role": "assistant", "model": "o3", "usage": {"input": 5, "output": 4}, "content": []}},
    {"type": "message", "id": "e", "timestamp": at(5), "message": {"role": "user", "content": [{"type": "toolResult", "toolCallId": "t1"}, {"type": "toolResult", "toolCallId": "t8"}]}},
    {"type": "message", "id": "f", "timestamp": at(6), "message": {"role": "assistant", "model": "o3", "usage": {"input": 7, "output": 1}, "content": []}},
]


def counted(i, total=None, last=None, **more):
    def usage(n):
        return {"input_tokens": n * 4, "cached_input_tokens": n, "output_tokens": n * 2, "reasoning_output_tokens": n}

    info = {k: usage(v) for k, v in (("total_token_usage", total), ("last_token_usage", last)) if v is not None}
    return {"type": "event_msg", "timestamp": at(i), "payload": {"type": "token_count", "info": info, **more}}


CODEX = [
    counted(0, 3), {"type": "session_meta", "timestamp": at(1), "payload": {"id": "cx", "cwd": "/w"}}, counted(2, 10), {"type": "turn_context", "payload": {"model": "gpt-5"}}, counted(3, 14), counted(4, None, 5),
    counted(5, 30, 0), {"type": "turn_context", "payload": {"model": "o3"}}, counted(6, 2), counted(7, 9, model="gpt-5-mini"),
]
GEMINI = [
    {"sessionId": "g1", "startTime": at(0)}, {"type": "user", "timestamp": at(1)}, {"type": "gemini", "id": "x", "timestamp": at(2), "model": "gemini-2.5-pro", "tokens": {"input": 9, "cached": 2, "output": 3}, "toolCalls": [{"name": "ls"}, {}]},
    {"type": "gemini", "timestamp": at(3), "tokens": {"input": 4}}, {"type": "user", "timestamp": at(4)}, {"type": "user", "timestamp": at(5)}, {"type": "gemini", "id": "z", "timestamp": at(6), "model": "m", "tokens": {"output": 3}},
]
LOGS = {"claude": (claude, CLAUDE), "pi": (pi, PI), "codex": (codex, CODEX), "gemini": (gemini, GEMINI)}


def texts(agent):
    return [json.dumps(r) if isinstance(r, dict) else r for r in LOGS[agent][1]]


def everything(rows):
    return [sorted(map(str, t.collect())) for t in (rows.calls, rows.tools)]


@pytest.mark.parametrize("agent", sorted(LOGS))
def test_every_cut_gives_what_one_read_gives(spark, lines_of, agent):
    """One path for each place to cut at, all read side by side; the second part sees no line of the first but its tail.

    Where the log states its session, all copies are one.
    """
    module, lines = LOGS[agent][0], texts(agent)
    every = None
    for k in range(len(lines) + 1):
        part = lines_of(lines, f"/logs/s{k}.jsonl", agent).withColumn("cut", F.lit(k))
        every = part if every is None else every.unionByName(part)
    every = every.repartition(4).cache()
    first, second = every.filter("ordinal < cut").drop("cut"), every.filter("ordinal >= cut").drop("cut")
    whole, start = module.normalise(every.drop("cut")), module.normalise(first)
    rest, again = resume.read_on(module.normalise, module.needs, first, second)
    assert [r.path for r in again.collect()] == []
    for table, put in (("calls", state.upsert_calls), ("tools", state.upsert_tools)):
        got = put(getattr(start, table), getattr(rest, table))
        assert sorted(map(str, got.collect())) == sorted(set(map(str, getattr(whole, table).collect()))), table
    mine = {r.path: (r.uid, r.project, r.title, r.seen_first_ts, r.seen_last_ts) for r in rest.identities.collect()}
    full = {r.path: (r.uid, r.project, r.title, r.seen_first_ts, r.seen_last_ts) for r in whole.identities.collect()}
    assert mine and all(full[p] == v for p, v in mine.items())
    every.unpersist()


def test_a_closed_response_that_goes_on_asks_for_the_whole_log(spark, lines_of, monkeypatch):
    monkeypatch.setattr(resume, "RECENT_LINES", 1)
    lines = [json.dumps(c_said(i, f"m{i}", [use(i)])) for i in range(4)]
    lines += [json.dumps({"type": "user", "timestamp": at(5), "message": {"content": [result(1)]}})]
    first = lines_of(lines, "/l/a.jsonl", "claude").unionByName(lines_of(lines, "/l/b.jsonl", "claude")).unionByName(lines_of(lines, "/l/c.jsonl", "claude"))
    more = {"a": c_said(6, "m0"), "b": c_said(6, "m9"), "c": {"type": "user", "timestamp": at(6), "message": {"content": [result(1, True)]}}}
    second = None
    for name, record in more.items():
        part = lines_of([json.dumps(record)], f"/l/{name}.jsonl", "claude").withColumn("ordinal", F.lit(5).cast("bigint"))
        second = part if second is None else second.unionByName(part)
    _, again = resume.read_on(claude.normalise, claude.needs, first, second)
    assert sorted(r.path for r in again.collect()) == ["/l/a.jsonl", "/l/c.jsonl"]


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_ranges(spark, tmp_path, chunk):
    body = ["", "a", "é" * 9, "x" * 70, "", "last\r"]
    (tmp_path / "f.jsonl").write_bytes(("\n".join(body) + "\nhalf").encode())
    (tmp_path / "_g.jsonl").write_bytes(b"only half")
    path = str(tmp_path / "f.jsonl")
    size = os.path.getsize(path)
    for start, first in ((0, 0), (1, 1), (3, 2), (size, 9)):
        files = spark.createDataFrame([(path, start, size, first), (str(tmp_path / "_g.jsonl"), 0, 9, 0)], "path STRING, start BIGINT, size BIGINT, first BIGINT")
        got = {r.ordinal: r.line for r in read_ranges(files, "x", chunk).collect()}
        assert got == ({first + i: x for i, x in enumerate(body[first:])} if start < size else {})


def test_windows_tell_rewritten_ends(spark, tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"a" * 20_000)
    one = lambda upto: windows(spark.createDataFrame([(str(path), upto)], "path STRING, upto BIGINT")).first().windows
    before = one(15_000)
    path.write_bytes(b"a" * 30_000)
    assert one(15_000) == before and one(40_000) is None
    path.write_bytes(b"a" * 14_000 + b"b" * 16_000)
    assert one(15_000) != before


@pytest.fixture()
def home(spark, tmp_path):
    sources = registry.log_sources(str(tmp_path))
    store, prices, clock = Store(spark, str(tmp_path / "store")), builtin_prices(spark), [datetime(2026, 4, 1)]
    roots = {s.agent: s.roots[0] for s in sources}
    for root in roots.values():
        os.makedirs(root, exist_ok=True)

    def run():
        clock[0] += timedelta(minutes=1)
        return ingest.run_pass(spark, store, sources, prices, clock[0])

    def write(agent, name, lines, mode="w"):
        with open(os.path.join(roots[agent], name), mode) as f:
            f.write("".join(x + "\n" for x in lines))

    return store, run, write, roots


def stored(store, uid=None):
    calls = store.read("calls").drop("cost_usd")
    return sorted(map(str, calls.collect())), sorted(map(str, store.read("tool_calls").collect()))


def test_two_passes_over_all_formats_equal_one(home, spark, tmp_path):
    store, run, write, roots = home
    for agent in LOGS:
        write(agent, "s.jsonl", texts(agent)[:5])
    run()
    for agent in LOGS:
        write(agent, "s.jsonl", texts(agent)[5:], "a")
    assert run().changed == 4
    state_of = {(r.agent, os.path.basename(r.path)): r for r in store.read("file_state").collect()}
    assert all(r.consumed == r.size and r.prefix_len == len(texts(a)) for (a, _), r in state_of.items())
    once = Store(spark, str(tmp_path / "once"))
    ingest.run_pass(spark, once, registry.log_sources(str(tmp_path)), builtin_prices(spark), datetime(2026, 5, 1))
    assert stored(store) == stored(once) and len(stored(store)[0]) > 10
    digests = lambda s: {r.path: (r.prefix_hash, r.windows) for r in s.read("file_state").collect()}
    assert digests(store) == digests(once)


def test_consumed_bytes_are_not_read_again(home, monkeypatch):
    """What lies between the ends of the part consumed may even be lost: a pass never looks at it."""
    store, run, write, roots = home
    body = [json.dumps(c_said(i % 60, f"m{i}")) for i in range(200)]
    write("claude", "s.jsonl", body)
    run()
    path = os.path.join(roots["claude"], "s.jsonl")
    data = bytearray(open(path, "rb").read())
    data[6000:7000] = b"#" * 1000
    open(path, "wb").write(bytes(data))
    write("claude", "s.jsonl", [json.dumps(c_said(1, "n1")), json.dumps(c_said(2, "n2"))], "a")
    asked = []
    monkeypatch.setattr(registry.LogSource, "lines", lambda self, files: asked.append(files))
    run()
    assert asked == [] and store.read("calls").count() == 202
    newest = store.passes()[-1]["pass"]
    assert store.deltas("calls").where(f"pass = '{newest}'").count() == 2
    # Another head, or a shorter file, is read from its start.
    monkeypatch.undo()
    write("claude", "s.jsonl", body[100:] + body[:100] + body[:9])
    run()
    assert store.read("calls").count() == 200
    write("claude", "s.jsonl", body[:3])
    run()
    assert store.read("calls").count() == 3


@pytest.mark.parametrize("module", [claude, pi, codex, gemini])
def test_lines_are_decoded_once_for_rows_and_needs(spark, module):
    """What is made of a log's events holds no JSON any more, and events are not decoded again."""
    lines = spark.createDataFrame([("/l/a.jsonl", "x", i, json.dumps(r)) for i, r in enumerate(CLAUDE[:6] + PI[:4])], "path STRING, agent STRING, ordinal BIGINT, line STRING")
    events = module.events(resume.flagged(lines))
    rows, needs = module.normalise(lines), resume.settled(module.needs(events))
    frames = [rows.calls, rows.identities, needs.points, *([needs.keyed] if needs.keyed is not None else [])]
    assert module.events(events) is events
    assert not any("from_json" in f._jdf.queryExecution().toString() for f in frames)
