"""Each log format on small logs with known figures."""

import json

import pytest
from pyspark.sql import functions as F

from spendloom.operators.pricing import PriceList, price_calls
from spendloom.sources import agy, claude, codex, gemini, lines, opencode, pi
from spendloom.sources.prices import builtin_prices


def log(*records):
    return [r if isinstance(r, str) else json.dumps(r) for r in records]


def by_key(df):
    return {r.call_key: r for r in df.collect()}


# ---------------------------------------------------------------- decoding


def test_decode_tolerates(lines_of):
    texts = [
        '{"type":"a","n":1.9}', '{"type":"b","n":"5"}', '{"type":"c"', "[1]", "7", "", "x",
        '{"type":"d"} trailing', '{"type":"e"}{"type":"f"}', '{"type":"g"}\r', '{"type":"h","n":{}}',
    ]
    rec = lines.decode(lines_of(texts), "type: STRING, n: DOUBLE").orderBy("ordinal").collect()
    assert [r.r.type if r.r else None for r in rec] == ["a", "b", None, None, None, None, None, None, None, "g", "h"]
    assert [r.r.n if r.r else None for r in rec][:2] == [1.9, None]
    assert [r.ordinal for r in lines.rejects(lines_of(texts)).orderBy("ordinal").collect()] == [2, 3, 4, 5, 6, 7, 8]


def test_complete_lines_leave_the_fragment(spark):
    docs = spark.createDataFrame([("a", "1\n2\n3"), ("b", "1\n\n"), ("c", "none"), ("d", "")], "path STRING, content STRING")
    got = [(r.path, r.ordinal, r.line) for r in lines.complete_lines(docs).orderBy("path", "ordinal").collect()]
    assert got == [("a", 0, "1"), ("a", 1, "2"), ("b", 0, "1"), ("b", 1, "")]


# ---------------------------------------------------------------- codex


def totals(i, c, o, r, last=None, **payload):
    names = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"]
    info = {}
    if i is not None:
        info["total_token_usage"] = dict(zip(names, (i, c, o, r)))
    if last is not None:
        info["last_token_usage"] = last
    return {"type": "event_msg", "timestamp": "2026-01-01T00:00:00Z", "payload": {"type": "token_count", "info": info, **payload}}


META = {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "sid", "cwd": "/w"}}
CONTEXT = {"type": "turn_context", "payload": {"model": "gpt-5.4"}}


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_codex_differences_totals(lines_of, chunk):
    rows = codex.normalise(
        lines_of(log(META, CONTEXT, totals(1000, 400, 50, 0), totals(2700, 1100, 130, 20), totals(5400, 2600, 330, 75))),
        rows_per_chunk=chunk,
    ).calls.orderBy("call_key").collect()
    got = [(r.input_tokens, r.cache_read_tokens, r.output_tokens, r.reasoning_tokens) for r in rows]
    assert got == [(1000, 700, 80, 20), (1200, 1500, 200, 55)]
    assert {(r.session_uid, r.project, r.model) for r in rows} == {("sid", "/w", "gpt-5.4")}


def test_codex_per_call_block_wins_also_when_zero(lines_of):
    last = {"input_tokens": 300, "cached_input_tokens": 0, "output_tokens": 41, "reasoning_output_tokens": 0}
    first = {"input_tokens": 8100, "cached_input_tokens": 6000, "output_tokens": 77, "reasoning_output_tokens": 31}
    rows = codex.normalise(lines_of(log(META, CONTEXT, totals(8100, 6000, 77, 31, first), totals(8400, 6000, 118, 52, last)))).calls
    a, b = rows.orderBy("call_key").collect()
    assert (a.input_tokens, a.cache_read_tokens, a.output_tokens, a.reasoning_tokens) == (2100, 6000, 77, 31)
    assert (b.input_tokens, b.cache_read_tokens, b.reasoning_tokens) == (300, 0, 0)


def test_codex_reset_is_kept_unpriced(spark, lines_of):
    rows = codex.normalise(lines_of(log(META, CONTEXT, totals(700, 0, 10, 0), totals(1900, 0, 20, 0), totals(250, 0, 5, 0), totals(410, 0, 9, 0)))).calls
    priced = price_calls(rows, PriceList(builtin_prices(spark))).orderBy("call_key").collect()
    assert [(r.input_tokens, r.priced) for r in priced] == [(1200, True), (0, False), (160, True)]
    assert priced[1].cost_usd == 0


def test_codex_model_before_and_after_the_context(lines_of):
    last = {"input_tokens": 1}
    rows = codex.normalise(lines_of(log(META, totals(None, 0, 0, 0, last), CONTEXT, totals(None, 0, 0, 0, last), totals(None, 0, 0, 0, last, model="own")))).calls
    assert [r.model for r in rows.orderBy("call_key").collect()] == ["unknown", "gpt-5.4", "own"]


# ---------------------------------------------------------------- pi


def pi_log(usage, **message):
    return log(
        {"type": "session", "id": "p1", "cwd": "/w", "timestamp": "2026-01-01T00:00:00Z"},
        {"type": "message", "timestamp": "2026-01-01T00:00:10Z", "message": {"role": "user", "content": [{"type": "text"}]}},
        {"type": "message", "id": "a", "timestamp": "2026-01-01T00:00:14.5Z",
         "message": {"role": "assistant", "model": "claude-sonnet-4", "usage": usage, **message}},
    )


def test_pi_bills_the_whole_output(spark, lines_of):
    rows = pi.normalise(lines_of(pi_log({"input": 1800, "output": 1900, "reasoning": 640}))).calls
    r = price_calls(rows, PriceList(builtin_prices(spark))).first()
    assert (r.output_tokens, r.reasoning_tokens, r.billable_output_tokens, r.total_tokens) == (1260, 640, 1900, 3700)
    assert float(r.cost_usd) == pytest.approx(1800 * 3e-6 + 1900 * 15e-6)
    assert (r.session_uid, r.call_key, r.llm_seconds, r.ts, r.day) == ("p1", "msg:a", 4.5, 1767225614, "2026-01-01")


def test_pi_tools(lines_of):
    extra = log({"type": "message", "timestamp": "2026-01-01T00:00:20Z", "message": {"role": "tool", "content": [
        {"type": "toolResult", "toolCallId": "k", "isError": "true", "startTime": 1767225614000, "endTime": 1767225616500},
        {"type": "tool_result", "id": "z"},
    ]}})
    texts = pi_log({"input": 1}, content=[{"type": "toolCall", "id": "k", "name": "grep"}]) + extra
    tools = sorted(pi.normalise(lines_of(texts)).tools.collect(), key=lambda r: r.call_key)
    assert [(t.tool, t.seconds, t.is_error) for t in tools] == [("grep", 2.5, True), ("tool", 0.0, False)]


def test_zero_calls_are_no_calls_but_answer_the_request(lines_of):
    texts = pi_log({"input": 0, "output": 0}) + log(
        {"type": "message", "id": "b", "timestamp": "2026-01-01T00:00:20Z", "message": {"role": "assistant", "usage": {"input": 5}}}
    )
    rows = by_key(pi.normalise(lines_of(texts)).calls)
    assert set(rows) == {"msg:b"} and rows["msg:b"].llm_seconds == 0 and rows["msg:b"].model == "unknown"


# ---------------------------------------------------------------- claude


def block(at, mid, usage, content=(), model="claude-sonnet-4", **more):
    return {"type": "assistant", "timestamp": f"2026-01-01T00:00:{at:02d}Z", "uuid": f"u{at}",
            "message": {"id": mid, "model": model, "usage": usage, "content": list(content)}, **more}


def user(at, content="hi"):
    return {"type": "user", "timestamp": f"2026-01-01T00:00:{at:02d}Z", "cwd": "/w", "message": {"content": content}}


@pytest.mark.parametrize("chunk", [1, 1000])
def test_claude_folds_blocks_and_pairs_tools(lines_of, chunk):
    usage = {"input_tokens": 10, "output_tokens": 100, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 20,
             "cache_creation": {"ephemeral_1h_input_tokens": 30}}
    texts = log(
        user(0),
        block(5, "m1", {**usage, "output_tokens": 1}, [{"type": "thinking", "thinking": "é" * 40}]),
        block(6, "m1", usage, [{"type": "tool_use", "id": "t1", "name": "Bash"}]),
        user(9, [{"type": "tool_result", "tool_use_id": "t1", "is_error": True}]),
        # A late block of m1 neither opens a call nor answers the new request.
        block(10, "m1", usage),
        block(12, "m2", {"input_tokens": 0, "output_tokens": 0}),
        block(13, "m2", usage),
        block(14, "m3", usage, model="<synthetic>"),
        block(15, "m4", {}),
        user(20, [{"type": "tool_result", "tool_use_id": "elsewhere"}]),
        "not json",
    )
    rows = claude.normalise(lines_of(texts, "/logs/sess-1.jsonl"), rows_per_chunk=chunk)
    calls = by_key(rows.calls)
    assert set(calls) == {"msg:m1", "msg:m2"}
    one = calls["msg:m1"]
    assert (one.session_uid, one.project, one.llm_seconds, one.ts % 60) == ("sess-1", "/w", 5.0, 5)
    # 80 bytes of thinking are 20 tokens; the last line's usage counts.
    assert (one.input_tokens, one.output_tokens, one.reasoning_tokens, one.billable_output_tokens) == (10, 80, 20, 100)
    assert (one.cache_read_tokens, one.cache_write_tokens, one.cache_write_1h_tokens) == (7, 20, 20)
    # The empty first line answered the request, the second opened the call.
    assert (calls["msg:m2"].llm_seconds, calls["msg:m2"].ts % 60) == (0.0, 13)
    tools = by_key(rows.tools)
    assert (tools["tool:t1"].tool, tools["tool:t1"].seconds, tools["tool:t1"].is_error, tools["tool:t1"].ts % 60) == ("Bash", 3.0, True, 9)
    assert tools["tool:elsewhere"].tool == ""


def test_claude_stated_reasoning_and_types(lines_of):
    texts = log(
        block(1, "a", {"output_tokens": 50, "thinking_tokens": 30}),
        block(2, "b", {"output_tokens": 50, "completion_tokens_details": {"thinking_tokens": 70}}),
        block(3, 5, {"input_tokens": "9", "output_tokens": 4.9}),
        block(4, "c", "no usage"),
    )
    rows = by_key(claude.normalise(lines_of(texts)).calls)
    assert {k: (r.output_tokens, r.reasoning_tokens) for k, r in rows.items()} == {
        "msg:a": (20, 30), "msg:b": (0, 50), "msg:u3": (4, 0),
    }


# ---------------------------------------------------------------- gemini


def test_gemini_input_includes_the_cache(lines_of):
    texts = log(
        {"sessionId": "g1", "startTime": "2026-01-01T00:00:00Z"},
        {"type": "user", "timestamp": "2026-01-01T00:00:00Z"},
        {"type": "gemini", "id": "x", "timestamp": "2026-01-01T00:04:59Z", "model": "gemini-2.5-pro",
         "tokens": {"input": 12000, "cached": 8000, "output": 900, "thoughtsTokenCount": 250}, "toolCalls": [{"name": "ls"}, {}]},
        {"type": "user", "timestamp": "2026-01-01T00:05:00Z"},
        {"type": "gemini", "timestamp": "2026-01-01T00:10:00Z", "tokens": {"input": 5}},
    )
    rows = gemini.normalise(lines_of(texts, "/h/proj/chats/s.jsonl"))
    calls = by_key(rows.calls)
    r = calls["msg:x"]
    assert (r.session_uid, r.project, r.input_tokens, r.output_tokens, r.llm_seconds) == ("g1", "proj", 4000, 650, 299.0)
    assert calls["n4"].llm_seconds == 0
    assert sorted(t.tool for t in rows.tools.collect()) == ["ls", "tool"]


# ---------------------------------------------------------------- opencode


def test_opencode_total_and_late_part(spark):
    sess = spark.createDataFrame([("s1", "/w/app", None, "build", '{"id":"gpt-5.4"}', 1, 9)],
                                 "id STRING, directory STRING, title STRING, agent STRING, model STRING, time_created BIGINT, time_updated BIGINT")
    data = {"role": "assistant", "tokens": {"input": 7300, "output": 1210, "reasoning": 530, "cache": {"read": 4100, "write": 640}},
            "time": {"completed": 1767225605000}, "content": [{"type": "tool", "name": "inline"}]}
    msg = spark.createDataFrame([("m1", "s1", 1767225600000, 10, json.dumps(data)), ("m2", "s1", 1767225600000, 10, "broken")],
                                "id STRING, session_id STRING, time_created BIGINT, time_updated BIGINT, data STRING")
    part = spark.createDataFrame([
        ("p1", "m1", "s1", 50, json.dumps({"type": "tool", "tool": "bash", "state": {"time": {"start": 1767225600000, "end": 1767225602000}}})),
        ("p2", "gone", "s1", 50, json.dumps({"type": "tool", "tool": "bash"})),
    ], "id STRING, message_id STRING, session_id STRING, time_updated BIGINT, data STRING")
    rows = opencode.normalise({"session": sess, "message": msg, "part": part})
    (call,) = rows.calls.collect()
    assert (call.total_tokens, call.billable_output_tokens, call.llm_seconds, call.model) == (13780, 1740, 5.0, "gpt-5.4")
    (tool,) = rows.tools.collect()
    assert (tool.call_key, tool.tool, tool.seconds) == ("part:p1", "bash", 2.0)
    assert rows.identities.first().title == "app"
    # Past the message but not past the part: the part still finds its message.
    late = opencode.normalise({"session": sess, "message": msg, "part": part}, since=20)
    assert late.calls.count() == 0 and late.tools.count() == 1


# ---------------------------------------------------------------- agy


def varint(n):
    out = b""
    while True:
        out += bytes([(n & 127) | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def num(field, n):
    return varint(field << 3) + varint(n)


def sub(field, body):
    return varint(field << 3 | 2) + varint(len(body)) + body


def test_agy_blobs(spark):
    times = sub(1, num(1, 1767225600)) + sub(8, num(1, 1767225604))
    usage = sub(9, num(1, 1402) + num(2, 10) + num(3, 20) + num(5, 30) + num(9, 25))
    tool = sub(4, sub(2, b"view"))
    home, other = (sub(28, sub(2, p)) for p in (b"/b", b"/a"))
    rows = [
        ("c1", 1, 15, 3, times + usage, home),
        ("c1", 2, 132, 7, times + tool, other),
        ("c1", 3, 23, 3, times + usage[:-4], sub(140, sub(1, sub(2, b"/b")))),
        ("c1", 4, 23, 3, times + sub(9, b"\xff\xff"), None),
        ("c1", 5, 15, 3, times + sub(9, num(1, 7) + num(2, 1)), sub(19, sub(12, sub(1, sub(42, sub(11, sub(1, b"/a"))))))),
        ("c1", 6, 15, 3, b"\x0f\xff", b"relative"),
        ("c1", 7, 15, 3, b"", b""),
    ]
    steps = spark.createDataFrame([(a, b, c, d, bytearray(e), bytearray(f) if f is not None else None) for a, b, c, d, e, f in rows], agy.STEPS)
    out = agy.normalise(steps)
    calls = by_key(out.calls)
    assert set(calls) == {"step1", "step5"}
    r = calls["step1"]
    assert (r.model, r.project, r.input_tokens, r.output_tokens, r.reasoning_tokens, r.cache_read_tokens, r.llm_seconds) == (
        "claude-opus-5.5", "/a", 10, 0, 20, 30, 4.0)
    assert calls["step5"].model == "antigravity-model-7"
    (t,) = out.tools.collect()
    assert (t.tool, t.is_error, t.seconds) == ("view", True, 4.0)
    assert agy.normalise(steps, since=4).calls.count() == 1


def test_wire_reader_never_fails():
    import random

    rng = random.Random(1)
    for _ in range(3000):
        blob = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        for value in agy.wire_fields(blob).values():
            assert isinstance(value, (int, bytes))
