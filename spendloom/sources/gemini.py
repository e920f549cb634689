"""gemini logs: input counts include the cached part, tool names sit on the response."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..operators.ordered import ROWS_PER_CHUNK, carry
from . import common, resume
from .lines import decode

MEMBERS = """type: STRING, id: VARIANT, sessionId: VARIANT, timestamp: VARIANT, startTime: VARIANT,
             model: VARIANT, tokens: VARIANT, toolCalls: VARIANT"""
AGENT = "gemini"
SLOWEST_RESPONSE = 300


def _decoded(lines: DataFrame) -> DataFrame:
    r = F.col("r")
    rec = decode(resume.flagged(lines), MEMBERS, ("path", "ordinal", "replayed")).filter("r is not null").select(
        "path",
        "ordinal",
        "replayed",
        F.coalesce(r.type, F.lit("")).alias("type"),
        F.coalesce(fields.time_micros(r.timestamp), fields.time_micros(r.startTime)).alias("us"),
        F.nullif(fields.text(r.id), F.lit("")).alias("id"),
        F.nullif(fields.text(r.sessionId), F.lit("")).alias("uid_seen"),
        F.nullif(fields.text(r.model), F.lit("")).alias("model"),
        r.tokens.alias("tokens"),
        fields.items(r.toolCalls).alias("tool_calls"),
    )
    used = (F.col("type") == "gemini") & fields.is_filled_object(F.col("tokens"))
    user = F.col("type") == "user"

    def n(name):
        return fields.count(fields.member(F.col("tokens"), f"$.{name}"))

    call = F.struct(
        F.coalesce("model", F.lit("unknown")).alias("model"),
        F.coalesce(F.concat(F.lit("msg:"), "id"), common.positional("n", F.col("ordinal"))).alias("key"),
        F.greatest(n("input") - n("cached"), common.zero()).alias("input"),
        n("output").alias("generated"),
        n("cached").alias("cache_read"),
        n("cacheWrite").alias("cache_write"),
        common.zero().alias("cache_write_1h"),
        n("thoughtsTokenCount").alias("reasoning"),
    )

    def tool_name(item):
        return F.coalesce(F.nullif(fields.text(fields.member(item, "$.name")), F.lit("")), F.lit("tool"))

    return rec.select(
        "path",
        "ordinal",
        "replayed",
        F.when(used | user, F.col("us")).alias("us"),
        "uid_seen",
        F.lit(None).cast("string").alias("project_seen"),
        F.lit(None).cast("string").alias("title_seen"),
        F.when(used, common.answered()).when(user & F.col("us").isNotNull(), common.request(F.col("us"))).alias("mark"),
        F.when(used, call).alias("call"),
        F.when(used, F.transform("tool_calls", tool_name)).alias("tools"),
    )


def events(lines: DataFrame) -> DataFrame:
    """The events of lines, decoded once for all that is made of them; events stay as they are."""
    return resume.events_once(lines, _decoded)


def chat_project(path):
    """<project> of .../<project>/chats/<file>, else ''."""
    return F.regexp_extract(path, r"([^/]+)/chats/[^/]+\z", 1)


def project_roots(files: DataFrame) -> DataFrame:
    """``dir, root`` from the side files <history>/<dir>/.project_root as ``path, content`` rows."""
    root = F.btrim(F.col("content").cast("string"), F.lit(" \t\r\n"))
    return (
        files.select(F.regexp_extract("path", r"([^/]+)/\.project_root\z", 1).alias("dir"), root.alias("root"))
        .filter("dir != '' and root != ''")
        .groupBy("dir")
        .agg(F.min("root").alias("root"))
    )


def name_projects(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Add ``project``: the mirrored side file's directory, else the chat directory's name."""
    rows = rows.withColumn("dir", chat_project(F.col("path")))
    if roots is None:
        return rows.withColumnRenamed("dir", "project")
    return rows.join(roots, "dir", "left").withColumn("project", F.coalesce("root", "dir")).drop("dir", "root")


def normalise(
    lines: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK, roots: DataFrame | None = None
) -> common.Normalised:
    ev = events(lines)
    rows = carry(
        ev.drop("title_seen", "project_seen"),
        ["path"],
        ["ordinal"],
        last_before={"asked": F.col("mark")},
        first_of_key={"uid": F.col("uid_seen")},
        rows_per_chunk=rows_per_chunk,
    ).filter("call is not null and not replayed")
    rows = name_projects(rows.withColumn("session_uid", common.session_uid(F.col("uid"))), roots)
    calls = rows.select(
        "session_uid", "project", "us", F.col("call.key").alias("call_key"), "call.model",
        *[f"call.{p}" for p in common.CALL_PARTS],
        common.response_seconds(F.col("asked.us"), F.col("us"), SLOWEST_RESPONSE).alias("llm_seconds"),
    )
    tools = rows.select("session_uid", "project", "us", "ordinal", F.posexplode("tools").alias("pos", "tool")).select(
        "session_uid", "project", "us",
        common.positional("t", F.col("ordinal"), F.col("pos")).alias("call_key"),
        "tool", F.lit(0.0).alias("seconds"), F.lit(False).alias("is_error"),
    )
    known = name_projects(common.identities(ev, AGENT).drop("project"), roots)
    return common.Normalised(
        common.finish_calls(calls, AGENT), common.finish_tools(tools, AGENT), known
    )


def needs(lines: DataFrame) -> resume.Needs:
    """The last request; tool names stand on the response."""
    return resume.Needs(resume.points(events(lines), ("mark",)))
