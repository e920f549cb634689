"""claude logs: one line per content block, every line of a response repeating its usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.tokens import estimated_reasoning, stated_reasoning, thinking_bytes
from ..operators.ordered import ROWS_PER_CHUNK, carry
from . import common, resume
from .lines import decode

MEMBERS = """type: STRING, timestamp: VARIANT, uuid: VARIANT, cwd: VARIANT,
             message: STRUCT<id: VARIANT, model: VARIANT, content: VARIANT, usage: VARIANT>"""
AGENT = "claude"
# The model name of a turn that never reached a model.
SYNTHETIC = "<synthetic>"


def _decoded(lines: DataFrame) -> DataFrame:
    r, m = F.col("r"), F.col("r.message")
    rec = decode(resume.flagged(lines), MEMBERS, ("path", "ordinal", "replayed")).filter("r is not null").select(
        "path",
        "ordinal",
        "replayed",
        r.type.alias("type"),
        fields.time_micros(r.timestamp).alias("us"),
        F.nullif(fields.text(r.uuid), F.lit("")).alias("uuid"),
        F.nullif(fields.text(r.cwd), F.lit("")).alias("project_seen"),
        F.nullif(fields.text(m.id), F.lit("")).alias("message_id"),
        fields.text(m.model).alias("model"),
        m.content.alias("content"),
        m.usage.alias("usage"),
    )
    user = F.coalesce(F.col("type") == "user", F.lit(False))
    used = F.coalesce(
        (F.col("type") == "assistant") & ~F.col("model").isin(SYNTHETIC, "") & fields.is_filled_object(F.col("usage")),
        F.lit(False),
    )

    def block(item):
        def member(name):
            return fields.member(item, f"$.{name}")

        kind = fields.text(member("type"))
        return F.struct(
            (kind == "tool_use").alias("use"),
            (kind == "tool_result").alias("result"),
            F.nullif(F.when(kind == "tool_use", fields.text(member("id"))).otherwise(fields.text(member("tool_use_id"))), F.lit("")).alias("id"),
            fields.text(member("name")).alias("name"),
            fields.truth(member("is_error")).alias("is_error"),
        )

    def n(path):
        return fields.count(fields.member(F.col("usage"), f"$.{path}"))

    usage = F.struct(
        n("input_tokens").alias("input"),
        n("output_tokens").alias("generated"),
        n("cache_read_input_tokens").alias("cache_read"),
        n("cache_creation_input_tokens").alias("cache_write"),
        n("cache_creation.ephemeral_1h_input_tokens").alias("cache_write_1h"),
        stated_reasoning(F.col("usage")).alias("stated"),
    )
    blocks = F.transform(fields.items(F.col("content")), block)
    return rec.select(
        "path", "ordinal", "replayed", "us", "project_seen",
        F.lit(None).cast("string").alias("uid_seen"),
        F.lit(None).cast("string").alias("title_seen"),
        user.alias("user"),
        used.alias("used"),
        "uuid", "message_id", "model",
        F.when(used, usage).alias("usage"),
        F.when(used, thinking_bytes(F.col("content"))).alias("thinking"),
        F.when(used, F.filter(blocks, lambda b: b["use"]))
        .when(user, F.filter(blocks, lambda b: b["result"]))
        .alias("tools"),
    )


def events(lines: DataFrame) -> DataFrame:
    """The events of lines, decoded once for all that is made of them; events stay as they are."""
    return resume.events_once(lines, _decoded)


def opened(ev: DataFrame) -> DataFrame:
    """Add ``response``, what groups the lines of one response, and ``opener``, the line that opened it.

    The first line that reports any token opens its response. A line without
    message id is a response of its own; keying it by its place keeps those lines
    spread out.
    """
    u = F.col("usage")
    some = (u.input + u.generated + u.cache_read + u.cache_write) > 0
    ev = ev.withColumn(
        "response", F.coalesce("message_id", common.positional("\u0000", F.col("ordinal")))
    ).withColumn("some", F.coalesce(some, F.lit(False)))
    openers = ev.filter("used and some").groupBy("path", "response").agg(F.min("ordinal").alias("opener"))
    return ev.join(openers, ["path", "response"], "left")


def marked(ev: DataFrame) -> DataFrame:
    """Add ``mark``: lines after the opener belong to a response already answered."""
    answers = F.col("used") & (F.col("opener").isNull() | (F.col("ordinal") <= F.col("opener")))
    asks = F.col("user") & (F.col("us").isNotNull() | (F.size("tools") > 0))
    return ev.withColumn(
        "mark", F.when(answers, common.answered()).when(asks, common.request(F.col("us")))
    )


def _only_replayed(rows: DataFrame) -> Column:
    """Of a group: whether it has no line that is new."""
    return F.min("replayed") if "replayed" in rows.columns else F.lit(False)


def fold(rows: DataFrame) -> DataFrame:
    """One row per response: opening line's time, model and latency, last line's usage, all thinking."""
    head = F.struct(
        "us", "model", "uuid", "message_id", "session_uid", "project", "ordinal",
        common.response_seconds(F.col("asked.us"), F.col("us")).alias("llm_seconds"),
    )
    folded = (
        rows.filter(F.col("used") & (F.col("ordinal") >= F.col("opener")))
        .groupBy("path", "response")
        .agg(
            F.min_by(head, "ordinal").alias("head"),
            F.max_by("usage", "ordinal").alias("usage"),
            F.sum("thinking").alias("thinking"),
            _only_replayed(rows).alias("known"),
        )
        .filter("not known")
    )
    return folded.select(
        "head.*",
        *[f"usage.{p}" for p in common.CALL_PARTS if p != "reasoning"],
        estimated_reasoning(F.col("usage.stated"), F.col("thinking")).alias("reasoning"),
    )


def pair_tools(blocks: DataFrame) -> DataFrame:
    """One row per tool run from ``path, ordinal, pos, us, use, id, name, is_error`` blocks.

    A result completes the row of its use: it gives the time, the duration and the
    error flag. Use and result meet in one aggregate, which also keeps a result
    whose use is not here (its name stays empty) and a use without result. A block
    without id stands alone.
    """
    lone = F.col("id").isNull()
    key = F.when(lone, common.positional("t", F.col("ordinal"), F.col("pos"))).otherwise(
        F.concat(F.lit("tool:"), "id")
    )
    place = F.struct("ordinal", "pos")
    row = F.struct("us", F.when(lone & ~F.col("use"), F.lit("tool")).otherwise(F.col("name")).alias("name"), "is_error")
    paired = (
        blocks.withColumn("call_key", key)
        .groupBy("path", "session_uid", "project", "call_key")
        .agg(
            F.max_by(row, F.when(F.col("use"), place)).alias("use"),
            F.max_by(row, F.when(~F.col("use"), place)).alias("result"),
            _only_replayed(blocks).alias("known"),
        )
        .filter("not known")
    )
    return paired.select(
        "session_uid", "project", "call_key",
        F.coalesce("use.name", F.when(F.startswith("call_key", F.lit("tool:")), F.lit("")), "result.name").alias("tool"),
        F.coalesce("result.us", "use.us").alias("us"),
        F.coalesce(fields.span_seconds(F.col("use.us"), F.col("result.us")), F.lit(0.0)).alias("seconds"),
        F.coalesce("result.is_error", F.lit(False)).alias("is_error"),
    )


def normalise(lines: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> common.Normalised:
    ev = events(lines)
    rows = carry(
        marked(opened(ev)).drop("uid_seen", "title_seen"),
        ["path"],
        ["ordinal"],
        last_before={"asked": F.col("mark")},
        first_of_key={"project": F.col("project_seen")},
        rows_per_chunk=rows_per_chunk,
    ).withColumn("session_uid", common.session_uid(F.lit(None)))
    calls = fold(rows).withColumn(
        "call_key",
        F.concat(F.lit("msg:"), F.coalesce("message_id", "uuid")),
    ).withColumn("call_key", F.coalesce("call_key", common.positional("n", F.col("ordinal"))))
    blocks = rows.select(
        "path", "ordinal", "replayed", "us", "session_uid", F.coalesce("project", F.lit("")).alias("project"),
        F.posexplode("tools").alias("pos", "t"),
    ).select("*", "t.*")
    return common.Normalised(
        common.finish_calls(calls, AGENT),
        common.finish_tools(pair_tools(blocks), AGENT),
        common.identities(ev, AGENT),
    )


def needs(lines: DataFrame) -> resume.Needs:
    """The last request, responses that may go on with the requests they answer, and uses of tools that have no result yet.

    A response may go on while it is the log's last one or its last line is among the newest.
    """
    ev = events(lines)
    lined = ev.filter("used and message_id is not null").select("path", F.concat(F.lit("r:"), "message_id").alias("key"), "ordinal")
    ends = lined.groupBy("path", "key").agg(F.max("ordinal").alias("end"))
    newest = ev.groupBy("path").agg(F.max("ordinal").alias("newest"), F.max(F.when(F.col("used") & F.col("message_id").isNotNull(), F.col("ordinal"))).alias("last"))
    goes_on = (F.col("end") == F.col("last")) | (F.col("end") > F.col("newest") - resume.RECENT_LINES)
    marks = marked(opened(ev))
    # A response that goes on takes its time from the request before its opening line.
    before = carry(marks.select("path", "ordinal", "response", "opener", "message_id", "mark"), ["path"], ["ordinal"],
                   last_before={"asked_at": F.when(F.col("mark").isNotNull(), F.col("ordinal"))})
    asked = before.filter("ordinal = opener and message_id is not null and asked_at is not null").select(
        "path", F.concat(F.lit("r:"), "message_id").alias("key"), F.col("asked_at").alias("ordinal"))
    responses = lined.union(asked).join(ends.join(newest, "path").select("path", "key", goes_on.alias("open")), ["path", "key"])
    blocks = ev.select("path", "ordinal", F.explode("tools").alias("t")).filter("t.id is not null").select(
        "path", F.concat(F.lit("t:"), "t.id").alias("key"), "ordinal", "t.use")
    done = blocks.groupBy("path", "key").agg(F.max(~F.col("use")).alias("done"))
    tools = blocks.join(done, ["path", "key"]).select("path", "key", "ordinal", (~F.col("done")).alias("open"))
    return resume.Needs(resume.points(marks, ("mark",)), responses.select("path", "key", "ordinal", "open").unionByName(tools))
