"""opencode store: session, message and part tables, in two generations.

The tables arrive as DataFrames with the store's column names. The newer
generation has ``session_v2`` and ``session_message``; a store may hold both
while it migrates. A part table's ``rowid``, where landed, orders equal starts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.names import path_leaf
from ..operators.ordered import newest_per_key
from ..session import cut_lineage
from . import common
from .landed import Landed, past_cursor

AGENT = "opencode"
# Table names, newest generation first.
SESSION_TABLES = ["session_v2", "session"]
MESSAGE_TABLES = ["session_message", "message"]
PART_TABLE = "part"
# Fixed value: the column every table has its update time in.
UPDATED = "time_updated"


def load_tables(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Whichever of the landed tables exist."""
    prefix = f"{database}." if database else ""
    names = SESSION_TABLES + MESSAGE_TABLES + [PART_TABLE]
    found = {n: spark.table(prefix + n) for n in names if spark.catalog.tableExists(prefix + n)}
    if not any(n in found for n in SESSION_TABLES):
        raise ValueError("no session table: need session_v2 or session")
    if not any(n in found for n in MESSAGE_TABLES):
        raise ValueError("no message table: need session_message or message")
    return found


def merge_generations(generations: list[DataFrame], keys: list[str], rank: str = "generation") -> DataFrame:
    """Union of generations, newest first; a key present in several comes from the newest."""
    ranked = [g.withColumn(rank, F.lit(-i)) for i, g in enumerate(generations)]
    rows = ranked[0]
    for more in ranked[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return newest_per_key(rows, keys, [rank])


def session_model(column: Column) -> Column:
    """Model of a session row: a bare name, or an object's id."""
    value = F.try_parse_json(column)
    shape = F.coalesce(fields.kind(value), F.lit(""))
    return (
        F.when(F.coalesce(column, F.lit("")) == "", "")
        .when(F.startswith(shape, F.lit("OBJECT")), fields.text(fields.member(value, "$.id")))
        .otherwise(column)
    )


def message_model(data: Column) -> Column:
    names = [fields.text(fields.member(data, p)) for p in ("$.modelID", "$.model.id", "$.model.modelID")]
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def _objects(df: DataFrame, column: str = "data") -> DataFrame:
    """Parse a JSON column; rows that hold no object are dropped."""
    parsed = df.withColumn(column, F.try_parse_json(F.col(column).cast("string")))
    return parsed.filter(F.startswith(fields.kind(F.col(column)), F.lit("OBJECT")))


def _landed(tables: Mapping[str, DataFrame], names: list[str]) -> list[DataFrame]:
    return [tables[n] for n in names if n in tables]


def sessions(tables: Mapping[str, DataFrame]) -> DataFrame:
    cols = ["id", "directory", "title", "model", "time_created", "time_updated"]
    return merge_generations([t.select(*cols) for t in _landed(tables, SESSION_TABLES)], ["id"]).drop("generation")


def messages(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Merged messages with their role: the row's type, else the data's role, else its type."""
    wanted = []
    for table in _landed(tables, MESSAGE_TABLES):
        role = F.col("type") if "type" in table.columns else F.lit("")
        wanted.append(
            _objects(table).select(
                "id", "session_id", F.col("time_created").alias("created"), F.col("time_updated").alias("updated"),
                F.coalesce(
                    F.nullif(role, F.lit("")),
                    F.nullif(fields.text(fields.member(F.col("data"), "$.role")), F.lit("")),
                    fields.text(fields.member(F.col("data"), "$.type")),
                ).alias("role"),
                "data",
            )
        )
    return merge_generations(wanted, ["session_id", "id"]).drop("generation")


def parts(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    if PART_TABLE not in tables:
        return None
    rowid = F.col("rowid") if "rowid" in tables[PART_TABLE].columns else F.lit(0)
    return _objects(tables[PART_TABLE]).select(
        "id", "message_id", "session_id", F.col("time_updated").alias("updated"), rowid.alias("rowid"), "data"
    )


def part_start(data: Column) -> Column:
    return fields.number(fields.member(data, "$.time.start"))


def sorted_parts(rows: DataFrame) -> DataFrame:
    """Parts in running order: message, start time, row."""
    return rows.orderBy("message_id", part_start(F.col("data")), "rowid")


def _tool_name(given: Column, original: Column) -> Column:
    """The name, or behind a missing or 'invalid' one the tool that was asked for."""
    weak = given.isin("", "invalid")
    name = F.when(weak & (original != ""), original).otherwise(given)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def _failed(state: Column) -> Column:
    return (fields.text(fields.member(state, "$.error")) != "") | (
        fields.text(fields.member(state, "$.status")) == "error"
    )


def attribute_parts(part_rows: DataFrame, message_rows: DataFrame) -> DataFrame:
    """Each part with its message's time.

    The message is looked up by id among all messages, so a part newer than an
    already consumed message still finds it; a part whose message is gone is dropped.
    """
    owners = message_rows.groupBy(F.col("id").alias("message_id")).agg(F.max("created").alias("created"))
    return part_rows.join(owners, "message_id")


def part_tools(attributed: DataFrame) -> DataFrame:
    data = F.col("data")
    state = fields.member(data, "$.state")
    return attributed.filter(fields.text(fields.member(data, "$.type")) == "tool").select(
        F.col("session_id").alias("session_uid"),
        F.concat(F.lit("part:"), "id").alias("call_key"),
        _tool_name(
            fields.text(fields.member(data, "$.tool")), fields.text(fields.member(data, "$.state.input.tool"))
        ).alias("tool"),
        fields.epoch_micros(F.col("created")).alias("us"),
        F.coalesce(
            fields.span_seconds(
                fields.time_micros(fields.member(state, "$.time.start")),
                fields.time_micros(fields.member(state, "$.time.end")),
            ),
            F.lit(0.0),
        ).alias("seconds"),
        _failed(state).alias("is_error"),
    )


def inline_tools(message_rows: DataFrame, part_rows: DataFrame | None) -> DataFrame:
    """Tools written inside a message; used only where the message has no parts at all."""
    rows = message_rows
    if part_rows is not None:
        rows = rows.join(
            part_rows.select(F.col("message_id").alias("id"), "session_id").distinct(), ["id", "session_id"], "left_anti"
        )
    items = rows.select(
        "id", "session_id", "created",
        F.posexplode(fields.items(fields.member(F.col("data"), "$.content"))).alias("pos", "item"),
    ).filter(fields.text(fields.member(F.col("item"), "$.type")) == "tool")
    item = F.col("item")
    state = fields.member(item, "$.state")
    own = F.coalesce(F.nullif(fields.text(fields.member(item, "$.id")), F.lit("")), F.col("pos").cast("string"))
    started = fields.time_micros(fields.member(item, "$.time.created"))
    ended = fields.time_micros(fields.member(item, "$.time.completed"))
    return items.select(
        F.col("session_id").alias("session_uid"),
        F.concat(F.lit("inline:"), "id", F.lit(":"), own).alias("call_key"),
        _tool_name(
            fields.text(fields.member(item, "$.name")), fields.text(fields.member(item, "$.state.input.tool"))
        ).alias("tool"),
        fields.epoch_micros(F.col("created")).alias("us"),
        F.coalesce(fields.span_seconds(started, ended, below=common.SLOWEST_RESPONSE), F.lit(0.0)).alias("seconds"),
        _failed(state).alias("is_error"),
    )


def message_calls(message_rows: DataFrame) -> DataFrame:
    """Calls of assistant messages that carry a filled token block, before the session is known."""
    data = F.col("data")
    tokens = fields.member(data, "$.tokens")

    def n(path):
        return fields.count(fields.member(tokens, f"$.{path}"))

    created = fields.epoch_micros(F.col("created"))
    completed = fields.time_micros(fields.member(data, "$.time.completed"))
    return message_rows.filter((F.col("role") == "assistant") & fields.is_filled_object(tokens)).select(
        F.col("session_id").alias("session_uid"),
        F.concat(F.lit("msg:"), "id").alias("call_key"),
        message_model(data).alias("own_model"),
        F.coalesce(completed, created).alias("us"),
        n("input").alias("input"),
        n("output").alias("output"),
        n("reasoning").alias("reasoning"),
        # Here the output figure leaves reasoning out; both are billed.
        (n("output") + n("reasoning")).alias("generated"),
        n("cache.read").alias("cache_read"),
        n("cache.write").alias("cache_write"),
        common.zero().alias("cache_write_1h"),
        common.response_seconds(created, completed).alias("llm_seconds"),
    )


def normalise(tables: Mapping[str, DataFrame], since: int | None = None) -> common.Normalised:
    """Rows of a store; with ``since`` only what was updated after that cursor.

    The cursor applies to each table on its own and never to the other side of a
    join, so a late part still finds its message.
    """
    session_rows = sessions(tables).withColumnRenamed("id", "session_uid")
    every_message = messages(tables)
    every_part = parts(tables)
    new_messages, new_parts = every_message, every_part
    if since is not None:
        new_messages = every_message.filter(F.col("updated") > since)
        new_parts = None if every_part is None else every_part.filter(F.col("updated") > since)
    owner = session_rows.select("session_uid", F.col("directory").alias("project"), session_model(F.col("model")).alias("model"))
    calls = message_calls(new_messages).join(owner, "session_uid").withColumn(
        "model", F.coalesce("own_model", F.nullif("model", F.lit("")), F.lit("unknown"))
    )
    tools = inline_tools(new_messages, every_part)
    if new_parts is not None:
        tools = tools.unionByName(part_tools(attribute_parts(new_parts, every_message)))
    tools = tools.join(owner.drop("model"), "session_uid")
    known = session_rows.select(
        F.col("session_uid").alias("uid"),
        F.lit(AGENT).alias("agent"),
        F.coalesce("directory", F.lit("")).alias("project"),
        F.lit("").alias("path"),
        F.coalesce(F.nullif("title", F.lit("")), path_leaf(F.col("directory"))).alias("title"),
        fields.epoch_seconds(fields.epoch_micros(F.col("time_created"))).alias("seen_first_ts"),
        fields.epoch_seconds(fields.epoch_micros(F.col("time_updated"))).alias("seen_last_ts"),
        F.lit(False).alias("orphaned"),
    )
    return common.Normalised(common.finish_calls(calls, AGENT), common.finish_tools(tools, AGENT), known)


def touched_sessions(tables: Mapping[str, DataFrame], news: Mapping[str, DataFrame]) -> DataFrame:
    """``uid`` of every session with a new row, or with a part, new or not, whose message is new."""
    found = [news[n].select(F.col("id").alias("uid")) for n in SESSION_TABLES if n in news]
    found += [news[n].select(F.col("session_id").alias("uid")) for n in (*MESSAGE_TABLES, PART_TABLE) if n in news]
    if PART_TABLE in tables:
        for written in _landed(news, MESSAGE_TABLES):
            of_new = tables[PART_TABLE].join(written.select(F.col("id").alias("message_id")), "message_id", "left_semi")
            found.append(of_new.select(F.col("session_id").alias("uid")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.filter("uid IS NOT NULL").distinct()


def narrowed(tables: Mapping[str, DataFrame], touched: DataFrame) -> dict[str, DataFrame]:
    """The rows that some sessions' calls and tool runs come from, in every generation.

    Of other sessions that is the messages their parts name, which only give
    these parts their time.
    """
    out = {}
    for name in tables:
        key = "id" if name in SESSION_TABLES else "session_id"
        out[name] = tables[name].join(touched.select(F.col("uid").alias(key)), key, "left_semi")
    if PART_TABLE in out:
        named = out[PART_TABLE].select(F.col("message_id").alias("id"), "session_id").distinct()
        for name in MESSAGE_TABLES:
            if name in tables:
                elsewhere = tables[name].join(named.select("id").distinct(), "id", "left_semi")
                elsewhere = elsewhere.join(touched.select(F.col("uid").alias("session_id")), "session_id", "left_anti")
                out[name] = out[name].unionByName(elsewhere)
    return out


def read_on(tables: Mapping[str, DataFrame], stored: Callable[[str], DataFrame]) -> Landed | None:
    """The sessions that rows past the tables' cursors touch, worked out whole; None if there are none.

    So a part or a message that comes passes after what it belongs to, a message
    that moves to the newer generation, and a session's own change give what one
    reading of everything gives, also where rows stored before are no longer due.
    Only positions are compared for the other sessions.
    """
    news, cursors = past_cursor(tables, stored("cursors"), AGENT, UPDATED)
    if not news:
        return None
    touched = cut_lineage(touched_sessions(tables, news))
    return Landed(normalise(narrowed(tables, touched)), touched, {"cursors": cursors})
