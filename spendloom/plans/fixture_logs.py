"""Agent logs and stores derived from the ``conversations`` table.

Every conversation becomes one session in the shape of one agent's log; each of
its turns becomes the JSON lines that agent would have written. All figures are
closed forms of the conversation id, the turn and the text length, so the lines
come from a projection and an explode, and the expected rows can be computed
from the table without any JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from .fixtures import MODELS, table

START = 1704067200
# Every format writes every conversation; where they are dealt out among the agents, by conv_id % 4.
CLAUDE, CODEX, GEMINI, PI = 0, 1, 2, 3
LINES_PER_TURN = 4


def _iso(t: Column) -> Column:
    return F.date_format(F.timestamp_seconds(t), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _model(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MODELS)), (i % 12 + 1).cast("int"))


def _obj(**members: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in members.items()])


def _when(test: Column, value: Column) -> Column:
    """The value, or an absent member."""
    return F.when(test, value)


def turns(spark: SparkSession, sf_dir: str, agent: int | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    if agent is not None:
        rows = rows.filter(F.col("conv_id") % 4 == agent)
    return rows.select(
        F.col("conv_id").alias("c"),
        F.col("turn").alias("n"),
        "role",
        "text",
        F.length("text").cast("bigint").alias("l"),
        (START + F.col("conv_id") * 3600 + F.col("turn") * 20).alias("t"),
    )


def _lines(rows: DataFrame, agent: str, slots: list[Column]) -> DataFrame:
    """Explode the lines of each turn; a null slot is no line. Every 11th log has a broken line."""
    broken = F.when((F.col("c") % 11 == 0) & (F.col("n") == 0), F.lit('{"type":"assistant","message":{"id":'))
    slots = [*slots, *[F.lit(None).cast("string")] * (LINES_PER_TURN - 1 - len(slots)), broken]
    path = F.concat(F.lit(f"/logs/{agent}/proj"), F.col("c") % 5, F.lit("/chats/conv"), F.col("c"), F.lit(".jsonl"))
    return (
        rows.select(path.alias("path"), F.col("n"), F.posexplode(F.array(*slots)).alias("slot", "line"))
        .filter("line is not null")
        .select("path", F.lit(agent).alias("agent"), (F.col("n") * LINES_PER_TURN + F.col("slot")).alias("ordinal"), "line")
    )


def _cwd() -> Column:
    return F.concat(F.lit("/w/"), F.col("c") % 5)


def pi_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    c, n, l, t = (F.col(x) for x in "cnlt")
    said = F.col("role") == "assistant"
    header = _obj(
        type=F.lit("session"), id=F.concat(F.lit("pi-"), c), cwd=_cwd(), timestamp=_iso(t - 5)
    )
    text = _obj(type=F.lit("text"), text=F.col("text"))
    asked = _obj(
        type=F.lit("message"),
        timestamp=t * 1000,
        message=_obj(role=F.col("role"), content=F.array(text)),
    )
    none = l % 9 == 0
    usage = _obj(
        input=_when(l % 2 == 0, F.when(none, 0).otherwise(l)),
        inputTokens=_when(l % 2 == 1, F.when(none, 0).otherwise(l)),
        output=F.when(none, 0).otherwise(l % 900),
        reasoning=F.when(none, 0).otherwise(l % 300),
        cacheRead=F.when(none, 0).otherwise((l * 3) % 5000),
        cacheReadInputTokens=F.when(none, 0).otherwise(l % 11),
        cacheWrite=F.when(none, 0).otherwise(l % 7),
    )
    call = _obj(type=F.lit("toolCall"), id=F.concat(F.lit("k"), n), name=F.concat(F.lit("tool"), l % 25), text=F.lit(None).cast("string"))
    answer = _obj(
        type=F.lit("message"),
        id=_when(n % 5 != 3, F.concat(c, F.lit("-"), n)),
        timestamp=_iso(t),
        message=_obj(
            role=F.lit("assistant"),
            model=_when(l % 7 != 0, _model(l)),
            content=F.array(
                _obj(type=F.lit("text"), id=F.lit(None).cast("string"), name=F.lit(None).cast("string"), text=F.col("text")),
                call,
            ),
            usage=usage,
        ),
    )
    result = _obj(
        type=F.lit("message"),
        timestamp=_iso(t + 3),
        message=_obj(
            role=F.lit("tool"),
            content=F.array(_obj(
                type=F.lit("toolResult"),
                toolCallId=F.when(l % 5 == 0, "zz").otherwise(F.concat(F.lit("k"), n)),
                startTime=t * 1000,
                endTime=t * 1000 + l % 4000,
                isError=l % 3 == 0,
            )),
        ),
    )
    return _lines(turns(spark, sf_dir, PI if dealt else None), "pi", [
        F.when(n == 0, F.to_json(header)),
        F.when(said, F.to_json(answer)).otherwise(F.to_json(asked)),
        F.when(said, F.to_json(result)),
    ])


def claude_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    c, n, l, t = (F.col(x) for x in "cnlt")
    said = F.col("role") == "assistant"
    asked = _obj(
        type=F.col("role"), timestamp=_iso(t), cwd=_cwd(), uuid=F.concat(F.lit("q"), n),
        message=_obj(content=F.col("text")),
    )
    model = F.when(l % 13 == 0, "<synthetic>").otherwise(_model(l))

    def block(shift: int, generated: Column, empty: Column, content: Column) -> Column:
        def figure(value):
            return F.when(empty, 0).otherwise(value)

        usage = _obj(
            input_tokens=figure(l),
            output_tokens=figure(generated),
            cache_read_input_tokens=figure((l * 31) % 7000),
            cache_creation_input_tokens=figure(l % 97),
            cache_creation=_obj(ephemeral_1h_input_tokens=figure(l % 60)),
            thinking_tokens=_when((l % 4 == 0) & ~empty, l % 40),
        )
        return F.to_json(_obj(
            type=F.lit("assistant"), timestamp=_iso(t + shift), uuid=F.concat(F.lit("a"), n, F.lit(f"-{shift}")),
            message=_obj(
                id=_when(n % 6 != 5, F.concat(F.lit("m"), c, F.lit("-"), n)), model=model, content=content, usage=usage
            ),
        ))

    thinking = F.array(_obj(type=F.lit("thinking"), thinking=F.col("text")))
    use = F.array(_obj(type=F.lit("tool_use"), id=F.concat(F.lit("u"), n), name=F.concat(F.lit("tool"), l % 25)))
    result = _obj(
        type=F.lit("user"), timestamp=_iso(t + 5), uuid=F.concat(F.lit("r"), n),
        message=_obj(content=F.array(_obj(
            type=F.lit("tool_result"),
            tool_use_id=F.when(l % 8 == 0, F.concat(F.lit("old"), n)).otherwise(F.concat(F.lit("u"), n)),
            is_error=l % 3 == 0,
        ))),
    )
    return _lines(turns(spark, sf_dir, CLAUDE if dealt else None), "claude", [
        F.when(said, block(0, l % 50 + 1, l % 9 == 0, thinking)).otherwise(F.to_json(asked)),
        F.when(said, block(2, l % 2000 + 1, F.lit(False), use)),
        F.when(said, F.to_json(result)),
    ])


def codex_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    c, n, l, t = (F.col(x) for x in "cnlt")
    meta = _obj(type=F.lit("session_meta"), timestamp=_iso(t - 5), payload=_obj(id=F.concat(F.lit("cx-"), c), cwd=_cwd()))
    context = _obj(type=F.lit("turn_context"), timestamp=_iso(t - 4), payload=_obj(model=_model(c)))
    # In every fifth log the running totals start over at turn 3.
    k = F.when((c % 5 == 0) & (n >= 3), n - 2).otherwise(n + 1)
    total = _obj(
        input_tokens=k * 700 + l % 600,
        cached_input_tokens=k * 300 + l % 200,
        output_tokens=k * 100 + l % 90,
        reasoning_output_tokens=k * 40 + l % 30,
    )
    last = _obj(
        input_tokens=l % 500,
        cached_input_tokens=l * 0,
        output_tokens=l % 80,
        reasoning_output_tokens=_when(l % 2 == 1, l % 20),
    )
    event = _obj(
        type=F.lit("event_msg"), timestamp=_iso(t),
        payload=_obj(
            type=F.lit("token_count"),
            model=_when(l % 7 == 0, F.lit("gpt-5.5")),
            info=_obj(total_token_usage=total, last_token_usage=_when(l % 3 == 0, last)),
        ),
    )
    return _lines(turns(spark, sf_dir, CODEX if dealt else None), "codex", [
        F.when(n == 0, F.to_json(meta)),
        F.when(n == F.when(c % 3 == 0, 2).otherwise(0), F.to_json(context)),
        F.to_json(event),
    ])


def gemini_lines(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    c, n, l, t = (F.col(x) for x in "cnlt")
    header = _obj(sessionId=F.concat(F.lit("gm-"), c), startTime=_iso(t - 5))
    asked = _obj(type=F.col("role"), id=F.concat(F.lit("q"), n), timestamp=_iso(t), text=F.col("text"))
    answer = _obj(
        type=F.lit("gemini"), id=_when(n % 5 != 3, F.concat(F.lit("g"), n)), timestamp=_iso(t),
        model=_when(l % 7 != 0, _model(l)),
        tokens=_when(l % 10 != 0, _obj(
            input=l, cached=l % 400, output=l % 900, thoughtsTokenCount=l % 1000, cacheWrite=l % 5
        )),
        toolCalls=F.array(_obj(name=F.concat(F.lit("tool"), l % 25)), _obj(name=F.lit(None).cast("string"))),
    )
    return _lines(turns(spark, sf_dir, GEMINI if dealt else None), "gemini", [
        F.when(n == 0, F.to_json(header)),
        F.when(F.col("role") == "assistant", F.to_json(answer)).otherwise(F.to_json(asked)),
    ])


def opencode_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A store in the middle of its migration: a third of the sessions is in both generations."""
    c, n, l, t = (F.col(x) for x in "cnlt")
    rows = turns(spark, sf_dir)
    sid, mid = F.concat(F.lit("s"), c), F.concat(F.lit("m"), c, F.lit("-"), n)
    said = F.col("role") == "assistant"
    heads = rows.filter("n = 0")

    def session(gen: int) -> DataFrame:
        model = F.when(c % 4 == 0, F.to_json(_obj(id=_model(c)))).when(c % 4 == 1, _model(c))
        return heads.select(
            sid.alias("id"), F.concat(_cwd(), F.lit(f"/g{gen}")).alias("directory"),
            F.when(c % 2 == 0, F.concat(F.lit("title "), c)).alias("title"), F.lit("build").alias("agent"),
            model.alias("model"), (t * 1000).alias("time_created"), (t * 1000 + 90000).alias("time_updated"),
        )

    def data(gen: int, own_role: bool) -> Column:
        def tool(i):
            return _obj(
                type=F.lit("tool"), id=F.concat(F.lit("x"), l % 3 + i), name=F.when(l % 4 == 0, "invalid").otherwise(F.concat(F.lit("tool"), l % 25)),
                state=_obj(input=_obj(tool=F.concat(F.lit("wanted"), l % 3)), status=F.when(l % 5 == 0, "error").otherwise("completed")),
                time=_obj(created=t * 1000, completed=t * 1000 + l),
            )

        tokens = _obj(
            input=l + gen, output=l % 700, reasoning=l % 90, cache=_obj(read=(l * 7) % 3000, write=l % 13)
        )
        return F.to_json(_obj(
            role=_when(F.lit(own_role), F.col("role")),
            modelID=_when(l % 3 == 0, _model(l)),
            model=_when(l % 3 == 1, _obj(id=_model(l + 1))),
            tokens=_when(said & (l % 10 != 0), tokens),
            time=_obj(created=t * 1000, completed=_when(l % 4 != 3, t * 1000 + l * 10)),
            content=_when(said, F.array(tool(0), tool(1))),
        ))

    old = rows.filter((c % 3 != 2) & (n % 2 == 0)).select(
        mid.alias("id"), sid.alias("session_id"), (t * 1000).alias("time_created"), (t * 1000).alias("time_updated"),
        data(1, True).alias("data"),
    )
    new = rows.filter((c % 3 == 2) | ((c % 3 == 1) & (n % 4 != 2)) | ((c % 3 == 0) & (n % 2 == 1))).select(
        mid.alias("id"), sid.alias("session_id"), F.col("role").alias("type"), n.alias("seq"),
        (t * 1000).alias("time_created"), (t * 1000).alias("time_updated"), data(2, False).alias("data"),
    )
    part = _obj(
        type=F.when(l % 6 == 0, "text").otherwise("tool"),
        tool=F.when(l % 4 == 0, "").otherwise(F.concat(F.lit("tool"), l % 25)),
        state=_obj(
            status=F.lit("completed"),
            error=_when(l % 3 == 0, F.lit("boom")),
            input=_obj(tool=_when(l % 8 == 0, F.concat(F.lit("wanted"), l % 3))),
            time=_obj(start=t * 1000, end=t * 1000 + l * 2),
        ),
        time=_obj(start=t * 1000 - l),
    )
    # Some parts are newer than their message, some belong to a message that is gone.
    parts = rows.filter(said & (n % 3 == 0)).select(
        F.concat(F.lit("p"), c, F.lit("-"), n).alias("id"),
        F.when(l % 11 == 0, F.concat(F.lit("gone"), n)).otherwise(mid).alias("message_id"),
        sid.alias("session_id"), (t * 1000 + 500).alias("time_updated"), n.alias("rowid"), F.to_json(part).alias("data"),
    )
    return {
        "session_v2": heads_filter(session(2), 0), "session": heads_filter(session(1), 2),
        "session_message": new, "message": old, "part": parts,
    }


def heads_filter(sessions: DataFrame, absent: int) -> DataFrame:
    """Sessions of a generation: conversation ids of one residue modulo 3 are only in the other."""
    number = F.substring("id", 2, 20).cast("bigint")
    return sessions.filter(number % 3 != absent)


# ---------------------------------------------------------------- agy


def _hex_byte(n: Column) -> Column:
    return F.lpad(F.hex(n), 2, "0")


def _varint(n: Column) -> Column:
    """Wire-format bytes, as hex, of a number below 2^35: seven bits a byte, the last unmarked."""
    groups = F.filter(
        F.transform(F.array(*[F.lit(7 * i) for i in range(5)]), lambda s: F.call_function("shiftright", n, s)),
        lambda g: g > 0,
    )
    marked = F.transform(groups, lambda g: _hex_byte(g.bitwiseAND(F.lit(127)) + F.when(g > 127, 128).otherwise(0)))
    return F.when(n == 0, "00").otherwise(F.array_join(marked, ""))


def _key(number: int, shape: int) -> Column:
    """Wire-format bytes, as hex, of a field's key."""
    key, out = (number << 3) | shape, ""
    while True:
        out += f"{(key & 127) | (128 if key > 127 else 0):02X}"
        key >>= 7
        if not key:
            return F.lit(out)


def _number_field(number: int, value: Column) -> Column:
    return F.concat(_key(number, 0), _varint(value.cast("bigint")))


def _bytes_field(number: int, hexed: Column) -> Column:
    """A nested field; every message here is shorter than 128 bytes."""
    return F.concat(_key(number, 2), _hex_byte(fields.whole_div(F.length(hexed).cast("bigint"), 2)), hexed)


def agy_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a step: assistant turns call a model, user turns run a tool.

    Some blobs are cut short, and each turn votes for a working directory.
    """
    c, n, l, t = (F.col(x) for x in "cnlt")
    rows = turns(spark, sf_dir)
    said = F.col("role") == "assistant"
    ids = [342, 1016, 1035, 1266, 1402, 1417, 9999]
    model = F.element_at(F.array(*map(F.lit, ids)), (l % 7 + 1).cast("int"))
    usage = F.concat(
        _number_field(1, model), _number_field(2, l), _number_field(3, l % 900), _number_field(5, (l * 7) % 3000),
        _number_field(9, l % 300),
    )
    home = F.concat(F.lit("/w/"), F.when(l % 3 == 0, c % 5).otherwise(l % 2))
    # Inner messages first, one projection per level of nesting.
    rows = rows.select(
        "*", said.alias("said"), usage.alias("usage"),
        _number_field(1, t).alias("start"),
        _number_field(1, t + F.when(l % 5 == 0, 700).otherwise(l % 40)).alias("end"),
        _bytes_field(2, F.hex(F.concat(F.lit("tool"), l % 25))).alias("tool"),
        _bytes_field(2, F.hex(home)).alias("home"),
    )
    rows = rows.select(
        "*",
        F.concat(
            _bytes_field(1, F.col("start")), _bytes_field(8, F.col("end")),
            F.when(said, _bytes_field(9, F.col("usage"))).otherwise(_bytes_field(4, F.col("tool"))),
        ).alias("meta"),
        F.when(l % 2 == 0, F.col("home")).otherwise(_bytes_field(1, F.col("home"))).alias("inner"),
    )
    cut = F.when((l % 11 == 0) & said, F.substring("meta", 1, 44)).otherwise(F.col("meta"))
    payload = F.when(l % 2 == 0, _bytes_field(28, F.col("inner"))).otherwise(_bytes_field(140, F.col("inner")))
    return rows.select(
        F.concat(F.lit("c"), c).alias("conversation"),
        (n + 1).alias("idx"),
        F.when(said & (l % 2 == 0), 15).when(said, 23).otherwise(132).alias("step_type"),
        F.when(l % 4 == 0, 7).otherwise(3).alias("status"),
        F.unhex(cut).alias("metadata"),
        F.unhex(payload).alias("step_payload"),
    )
