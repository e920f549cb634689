"""pi logs: a session header record followed by message records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..operators.ordered import ROWS_PER_CHUNK, carry
from . import common, resume
from .lines import decode

MEMBERS = """type: STRING, id: VARIANT, cwd: VARIANT, timestamp: VARIANT,
             message: STRUCT<role: VARIANT, model: VARIANT, content: VARIANT, usage: VARIANT>"""
AGENT = "pi"


def _decoded(lines: DataFrame) -> DataFrame:
    r, m = F.col("r"), F.col("r.message")
    rec = decode(resume.flagged(lines), MEMBERS, ("path", "ordinal", "replayed")).select(
        "path",
        "ordinal",
        "replayed",
        r.type.alias("type"),
        fields.time_micros(r.timestamp).alias("us"),
        F.nullif(fields.text(r.id), F.lit("")).alias("id"),
        F.nullif(fields.text(r.cwd), F.lit("")).alias("cwd"),
        fields.text(m.role).alias("role"),
        fields.text(m.model).alias("model"),
        fields.items(m.content).alias("content"),
        m.usage.alias("usage"),
    )
    rec = rec.filter(F.col("type").isin("session", "message"))
    message, header = F.col("type") == "message", F.col("type") == "session"

    def block(item):
        def member(name):
            return fields.member(item, f"$.{name}")

        kind = fields.text(member("type"))
        result = kind.isin("toolResult", "tool_result")
        own, called = fields.text(member("id")), fields.text(member("toolCallId"))
        return F.struct(
            kind.alias("kind"),
            result.alias("result"),
            kind.isin("toolCall", "tool_call").alias("use"),
            F.when(result, F.coalesce(F.nullif(called, F.lit("")), own))
            .otherwise(F.coalesce(F.nullif(own, F.lit("")), called))
            .alias("id"),
            F.coalesce(F.nullif(fields.text(member("name")), F.lit("")), F.lit("tool")).alias("name"),
            F.coalesce(
                fields.span_seconds(fields.time_micros(member("startTime")), fields.time_micros(member("endTime"))),
                F.lit(0.0),
            ).alias("seconds"),
            ((fields.text(member("isError")) == "true") | fields.truth(member("isError"))).alias("is_error"),
        )

    rec = rec.withColumn("blocks", F.when(message, F.transform("content", block)))
    is_user = F.col("role") == "user"
    marks = F.coalesce(
        F.exists("blocks", lambda b: b["result"] | ((b["kind"] == "text") & is_user)), F.lit(False)
    ) | (is_user & F.col("us").isNotNull())

    def n(name):
        return fields.count(fields.member(F.col("usage"), f"$.{name}"))

    def either(a, b):
        return F.coalesce(F.nullif(n(a), F.lit(0)), n(b))

    call = F.struct(
        F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown")).alias("model"),
        F.coalesce(F.concat(F.lit("msg:"), "id"), common.positional("n", F.col("ordinal"))).alias("key"),
        either("input", "inputTokens").alias("input"),
        either("output", "outputTokens").alias("generated"),
        (n("cacheRead") + n("cacheReadInputTokens")).alias("cache_read"),
        n("cacheWrite").alias("cache_write"),
        common.zero().alias("cache_write_1h"),
        n("reasoning").alias("reasoning"),
        # A record that is its own request took no time.
        marks.alias("self_asked"),
    )
    used = message & fields.is_filled_object(F.col("usage"))
    return rec.select(
        "path",
        "ordinal",
        "replayed",
        "us",
        F.when(header, F.col("id")).alias("uid_seen"),
        F.when(header, F.col("cwd")).alias("project_seen"),
        F.lit(None).cast("string").alias("title_seen"),
        F.when(used, common.answered()).when(message & marks, common.request(F.col("us"))).alias("mark"),
        F.when(used, call).alias("call"),
        F.filter("blocks", lambda b: b["use"] | b["result"]).alias("tools"),
    )


def events(lines: DataFrame) -> DataFrame:
    """The events of lines, decoded once for all that is made of them; events stay as they are."""
    return resume.events_once(lines, _decoded)


def normalise(lines: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> common.Normalised:
    ev = events(lines)
    rows = carry(
        ev.drop("title_seen"),
        ["path"],
        ["ordinal"],
        last_before={"asked": F.col("mark")},
        first_of_key={"uid": F.col("uid_seen"), "project": F.col("project_seen")},
        rows_per_chunk=rows_per_chunk,
    ).withColumn("session_uid", common.session_uid(F.col("uid")))
    asked = F.when(~F.col("call.self_asked"), F.col("asked.us"))
    calls = rows.filter("call is not null and not replayed").select(
        "session_uid", "project", "us", F.col("call.key").alias("call_key"), "call.model",
        *[f"call.{p}" for p in common.CALL_PARTS],
        common.response_seconds(asked, F.col("us")).alias("llm_seconds"),
    )
    blocks = rows.select("path", "ordinal", "replayed", "us", "session_uid", "project", F.posexplode("tools").alias("pos", "t"))
    place = F.struct("ordinal", "pos")
    uses = (
        blocks.filter("t.use")
        .groupBy("path", F.col("t.id").alias("id"))
        .agg(F.min(place).alias("used_at"), F.max_by("t.name", place).alias("name"))
    )
    results = blocks.filter("t.result and not replayed").withColumn("id", F.col("t.id")).join(uses, ["path", "id"], "left")
    tools = results.select(
        "session_uid", "project", "us",
        common.positional("t", F.col("ordinal"), F.col("pos")).alias("call_key"),
        F.coalesce(F.when(F.col("used_at") < place, F.col("name")), F.lit("tool")).alias("tool"),
        "t.seconds", "t.is_error",
    )
    return common.Normalised(
        common.finish_calls(calls, AGENT), common.finish_tools(tools, AGENT), common.identities(ev, AGENT)
    )


def needs(lines: DataFrame) -> resume.Needs:
    """The last request, and the uses of tools that have no result yet."""
    ev = events(lines)
    blocks = ev.select("path", "ordinal", F.explode("tools").alias("t")).select(
        "path", F.concat(F.lit("t:"), "t.id").alias("key"), "ordinal", "t.result").filter("key is not null")
    done = blocks.groupBy("path", "key").agg(F.max("result").alias("done"))
    keyed = blocks.join(done, ["path", "key"]).select("path", "key", "ordinal", (~F.col("done")).alias("open"))
    return resume.Needs(resume.points(ev, ("mark",)), keyed)
