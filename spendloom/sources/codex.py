"""codex logs: usage as a running total that has to be differenced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields
from ..operators.ordered import ROWS_PER_CHUNK, carry
from ..session import no_rows
from . import common, resume
from .lines import decode

MEMBERS = """type: STRING, timestamp: VARIANT, cwd: VARIANT,
             payload: STRUCT<type: STRING, id: VARIANT, cwd: VARIANT, model: VARIANT,
                             info: STRUCT<total_token_usage: VARIANT, last_token_usage: VARIANT>>"""
AGENT = "codex"
COUNTERS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"]


def _counters(usage: Column) -> Column:
    return F.struct(*[fields.count(fields.member(usage, f"$.{c}")).alias(c) for c in COUNTERS])


def _stated(usage: Column) -> Column:
    """Per-call figures; null where the block does not have the field. A zero is a figure."""
    return F.struct(
        *[
            F.when(fields.member(usage, f"$.{c}").isNotNull(), fields.count(fields.member(usage, f"$.{c}"))).alias(c)
            for c in COUNTERS
        ]
    )


def _decoded(lines: DataFrame) -> DataFrame:
    r, p = F.col("r"), F.col("r.payload")
    rec = decode(resume.flagged(lines), MEMBERS, ("path", "ordinal", "replayed")).select(
        "path",
        "ordinal",
        "replayed",
        r.type.alias("type"),
        fields.time_micros(r.timestamp).alias("us"),
        p.type.alias("event"),
        F.nullif(fields.text(p.id), F.lit("")).alias("id"),
        F.nullif(fields.text(p.cwd), F.lit("")).alias("cwd"),
        F.nullif(fields.text(r.cwd), F.lit("")).alias("header_cwd"),
        F.nullif(fields.text(p.model), F.lit("")).alias("model"),
        p.info.total_token_usage.alias("total"),
        p.info.last_token_usage.alias("last"),
    )
    has_total, has_last = fields.is_filled_object(F.col("total")), fields.is_filled_object(F.col("last"))
    meta = F.col("type") == "session_meta"
    counted = (F.col("type") == "event_msg") & (F.col("event") == "token_count") & (has_total | has_last)
    return rec.filter(F.col("type").isin("session_meta", "session", "turn_context") | counted).select(
        "path",
        "ordinal",
        "replayed",
        # A change of settings is not an observed moment of the session.
        F.when(meta | counted, F.col("us")).alias("us"),
        F.when(meta, F.col("id")).alias("uid_seen"),
        F.when(meta, F.col("cwd")).when(F.col("type") == "session", F.col("header_cwd")).alias("project_seen"),
        F.when(F.col("type") == "turn_context", F.col("model")).alias("title_seen"),
        F.when(counted, F.col("model")).alias("model"),
        F.coalesce(counted, F.lit(False)).alias("counted"),
        F.when(counted & has_total, _counters(F.col("total"))).alias("total"),
        F.when(counted & has_last, _stated(F.col("last"))).alias("last"),
    )


def events(lines: DataFrame) -> DataFrame:
    """The events of lines, decoded once for all that is made of them; events stay as they are."""
    return resume.events_once(lines, _decoded)


def counter_deltas(rows: DataFrame) -> DataFrame:
    """Per-call usage from ``total``, ``last`` and ``before``, the running total so far.

    A per-call figure that is present wins, also when it is zero; otherwise it is
    the increment of the total. The first total without a per-call block is a
    baseline, not a call. A falling counter was reset: the call happened, its size
    is unknown (``sized`` is false).
    """
    rows = rows.filter(F.col("before").isNotNull() | F.col("last").isNotNull())

    def step(c: str) -> Column:
        now = F.coalesce(F.col(f"total.{c}"), common.zero())
        return now - F.coalesce(F.col(f"before.{c}"), common.zero())

    deltas = rows.select(
        "*",
        *[F.coalesce(F.col(f"last.{c}"), step(c)).alias(f"d_{c}") for c in COUNTERS],
    )
    raw, cached, out, thought = (F.greatest(F.col(f"d_{c}"), common.zero()) for c in COUNTERS)
    fell = F.least(*[F.col(f"d_{c}") for c in COUNTERS]) < 0
    return deltas.select(
        "*",
        F.greatest(raw - cached, common.zero()).alias("input"),
        cached.alias("cache_read"),
        out.alias("generated"),
        F.least(thought, out).alias("reasoning"),
        (~fell).alias("sized"),
    ).drop(*[f"d_{c}" for c in COUNTERS])


def normalise(lines: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> common.Normalised:
    ev = events(lines)
    rows = carry(
        ev,
        ["path"],
        ["ordinal"],
        last_before={"before": F.col("total")},
        first_before={"title": F.col("title_seen")},
        first_of_key={"uid": F.col("uid_seen"), "project": F.col("project_seen")},
        rows_per_chunk=rows_per_chunk,
    ).filter("counted and not replayed")
    calls = counter_deltas(rows).select(
        common.session_uid(F.col("uid")).alias("session_uid"),
        "project",
        "us",
        common.positional("n", F.col("ordinal")).alias("call_key"),
        F.coalesce("model", "title", F.lit("unknown")).alias("model"),
        "input",
        "generated",
        # Stored whole beside its reasoning part, and billed once.
        F.col("generated").alias("output"),
        "cache_read",
        common.zero().alias("cache_write"),
        common.zero().alias("cache_write_1h"),
        "reasoning",
        F.lit(0.0).alias("llm_seconds"),
        "sized",
    )
    # The log names no tool runs.
    no_tools = no_rows(
        lines.sparkSession, "session_uid STRING, call_key STRING, project STRING, tool STRING, us BIGINT, seconds DOUBLE, is_error BOOLEAN"
    )
    return common.Normalised(
        common.finish_calls(calls, AGENT), common.finish_tools(no_tools, AGENT), common.identities(ev, AGENT)
    )


def needs(lines: DataFrame) -> resume.Needs:
    """The last running total."""
    return resume.Needs(resume.points(events(lines), ("total",)))
