"""Keyed writes and what is remembered between passes.

Every function maps stored rows and a batch to the new stored rows. Nothing is
patched in place; see ``plans.store`` for how the result is published.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import newest_per_key

KEY = ["session_uid", "call_key"]


def _stack(stored: DataFrame, incoming: DataFrame, seq: str | None) -> DataFrame:
    """Stored rows below the batch; ``_seq`` orders the batch's own copies of a key."""
    new = incoming.withColumn("_batch", F.lit(1)).withColumn(
        "_seq", F.struct(*_order(incoming, seq)) if seq is None else F.struct(F.col(seq))
    )
    # Where a row is its own order, stored rows have theirs as well: it is then the only copy of a row.
    own = F.struct(*_order(incoming, seq)) if seq is None and set(_order(incoming, seq)) <= set(stored.columns) else F.lit(None).cast(new.schema["_seq"].dataType)
    old = stored.withColumn("_batch", F.lit(0)).withColumn("_seq", own)
    return old.unionByName(new)


def _order(df: DataFrame, seq: str | None) -> list[str]:
    """A total order over everything orderable, for batches that name none."""
    return [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str] = KEY,
    seq: str | None = None,
    keep: Sequence[str] = ("agent", "project"),
    keep_if_empty: Sequence[str] = (),
) -> DataFrame:
    """Last write wins per key.

    ``keep`` columns of a row that exists stay as first stored; ``keep_if_empty``
    columns are overwritten only by a non-empty value. One aggregate per key, so
    copies of a key collapse in the map tasks.
    """
    keep = [c for c in keep if c in stored.columns]
    position = F.struct("_batch", "_seq")
    plain = [c for c in stored.columns if c not in [*keys, *keep, *keep_if_empty]]
    rows = _stack(stored, incoming, seq).withColumn("_at", position)
    if seq is None and set(stored.columns) == set(_order(incoming, seq)):
        # The order of the rows is the rows: the greatest and the least are all there is to keep of a key.
        aggs = [F.max("_at").alias("_last")] + ([F.min("_at").alias("_first")] if keep else [])
        aggs += [F.max(F.when(F.col(c) != "", F.struct("_batch", "_seq"))).alias(f"_full_{c}") for c in keep_if_empty]
        merged = rows.groupBy(*keys).agg(*aggs)

        def of(c: str):
            if c in keys:
                return F.col(c)
            if c in keep_if_empty:
                return F.coalesce(f"_full_{c}._seq.{c}", f"_last._seq.{c}").alias(c)
            return F.col(f"_first._seq.{c}" if c in keep else f"_last._seq.{c}").alias(c)

        return merged.select(*map(of, stored.columns))
    aggs = [F.max_by(F.struct(*plain), "_at").alias("_new")] if plain else []
    aggs += [F.min_by(c, "_at").alias(c) for c in keep]
    aggs += [
        F.coalesce(F.max_by(c, F.when(F.col(c) != "", F.col("_at"))), F.max_by(c, "_at")).alias(c)
        for c in keep_if_empty
    ]
    merged = rows.groupBy(*keys).agg(*aggs)
    return merged.select(
        *[F.col(f"_new.{c}").alias(c) if c in plain else F.col(c) for c in stored.columns]
    )


def upsert_calls(stored: DataFrame, incoming: DataFrame, seq: str | None = None) -> DataFrame:
    return upsert(stored, incoming, seq=seq)


def upsert_tools(stored: DataFrame, incoming: DataFrame, seq: str | None = None) -> DataFrame:
    """A result whose use came in an earlier pass has no name; the stored one stays."""
    return upsert(stored, incoming, seq=seq, keep_if_empty=["tool"])


def replace_sessions(stored: DataFrame, incoming: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of the given sessions come from the batch alone."""
    gone = sessions.select(F.col("uid").alias("session_uid")).distinct()
    return stored.join(gone, "session_uid", "left_anti").unionByName(incoming)


def forget_sessions(stored: DataFrame, sessions: DataFrame, key: str = "session_uid") -> DataFrame:
    """Drop every row of the given sessions."""
    return stored.join(sessions.select(F.col("uid").alias(key)).distinct(), key, "left_anti")


def inherit_project(incoming: DataFrame, sessions: DataFrame) -> DataFrame:
    """An appended row without project takes its session's stored one."""
    known = sessions.select(F.col("uid").alias("session_uid"), F.col("project").alias("_known"))
    joined = incoming.join(known, "session_uid", "left")
    own = F.nullif("project", F.lit(""))
    return joined.withColumn("project", F.coalesce(own, "_known", F.lit(""))).select(*incoming.columns)


# ---------------------------------------------------------------- files


def file_digests(lines: DataFrame, file_state: DataFrame) -> DataFrame:
    """``path, consumed, prefix_len, prefix_hash, same_head`` of the complete lines of each file.

    The digest is a sum over all lines of a hash of number and text, so it takes
    in everything consumed, in any order, and adds up in the map tasks.
    ``same_head`` tells whether the lines that were consumed before still give
    the digest recorded then; null for a file not known.
    """
    known = file_state.select("path", F.col("prefix_hash").alias("_hash"), F.col("prefix_len").alias("_len"))
    one = F.xxhash64("ordinal", "line").cast("decimal(20,0)")
    before = F.when(F.col("ordinal") < F.col("_len"), one)
    sums = lines.join(known, "path", "left").groupBy("path", "_hash", "_len").agg(
        F.sum(F.octet_length("line") + 1).cast("bigint").alias("consumed"),
        F.count(F.lit(1)).alias("prefix_len"),
        F.sum(one).cast("string").alias("prefix_hash"),
        F.count(before).alias("_n"),
        F.coalesce(F.sum(before), F.lit(0)).cast("string").alias("_before"),
    )
    same = (F.col("_n") == F.col("_len")) & (F.col("_before") == F.coalesce(F.nullif("_hash", F.lit("")), F.lit("0")))
    return sums.select("path", "consumed", "prefix_len", "prefix_hash", same.alias("same_head"))


def classify_files(listing: DataFrame, file_state: DataFrame) -> DataFrame:
    """What to do with each listed file: complete, unchanged, append or replace.

    ``listing`` is ``agent, path, size, mtime, same_head``. A log that grew and
    still begins with everything consumed is appended to; one that shrank, begins
    differently or has a cursor of another kind is read anew. A log of the
    recorded size and time is unchanged, also when nothing of it was complete yet.
    """
    known = file_state.select(
        "path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), "consumed",
        F.col("cursor").alias("_cursor"), "complete",
    )
    resumable = (
        (F.col("size") >= F.col("consumed"))
        & F.coalesce(F.nullif("_cursor", F.lit("")), F.lit("bytes")).isin("bytes")
        & F.coalesce("same_head", F.lit(False))
    )
    done = F.coalesce("consumed", F.lit(0)) > 0
    action = (
        F.when(F.coalesce("complete", F.lit(False)), "complete")
        .when((F.col("size") == F.col("_size")) & (F.col("mtime") == F.col("_mtime")), "unchanged")
        .when(done & resumable, "append")
        .otherwise("replace")
    )
    return listing.join(known, "path", "left").select(*listing.columns, "consumed", action.alias("action"))


def take_changed(classified: DataFrame, limit: int | None = None) -> DataFrame:
    """Changed files: all of them, or for a bounded look the first ``limit`` per source in path order.

    With a limit, files are first thinned to the smallest paths inside slices of
    a source, so a source with very many changed files is not ranked in one task.
    """
    changed = classified.filter(F.col("action").isin("append", "replace"))
    if limit is None:
        return changed
    slices = Window.partitionBy("agent", "_slice").orderBy("path")
    thin = (
        changed.withColumn("_slice", F.pmod(F.xxhash64("path"), F.lit(1024)))
        .withColumn("_n", F.row_number().over(slices))
        .filter(F.col("_n") <= limit)
    )
    whole = Window.partitionBy("agent").orderBy("path")
    return thin.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= limit).drop("_n", "_slice")


def save_file_state(file_state: DataFrame, incoming: DataFrame) -> DataFrame:
    """Newest state per path."""
    return upsert(file_state, incoming, keys=["path"], keep=())


def reset_cursors(file_state: DataFrame, agent: str) -> DataFrame:
    """Forget one source's cursors, so its logs are rebuilt by the next pass."""
    return file_state.filter(F.col("agent") != agent)


def vanished(file_state: DataFrame, listing: DataFrame) -> DataFrame:
    """State rows whose file is no longer listed. Table-backed sessions have no file."""
    files = file_state.filter(~F.startswith("path", F.lit("opencode:")))
    return files.join(listing.select("path"), "path", "left_anti")


def mark_orphaned(sessions: DataFrame, gone: DataFrame, ingested: DataFrame) -> DataFrame:
    """Flag sessions whose log vanished and clear the flag of those just ingested. Rows stay."""
    lost = gone.filter("session_uid != ''").select(F.col("session_uid").alias("uid")).distinct()
    back = ingested.select("uid").distinct()
    return (
        sessions.join(lost.withColumn("_lost", F.lit(True)), "uid", "left")
        .join(back.withColumn("_back", F.lit(True)), "uid", "left")
        .withColumn(
            "orphaned",
            F.when(F.col("_back"), F.lit(False)).when(F.col("_lost"), F.lit(True)).otherwise(F.col("orphaned")),
        )
        .select(*sessions.columns)
    )


def new_rows(rows: DataFrame, cursors: DataFrame, key: str, position: str) -> DataFrame:
    """Rows past their source's cursor; a source without one is new altogether."""
    seen = cursors.select(key, F.col("cursor").alias("_cursor"))
    return (
        rows.join(seen, key, "left")
        .filter(F.col(position) > F.coalesce("_cursor", F.lit(-(2**63))))
        .select(*rows.columns)
    )


def advance_cursors(rows: DataFrame, cursors: DataFrame, key: str, position: str) -> DataFrame:
    """Highest position consumed per source; a source without new rows keeps its own."""
    newest = rows.groupBy(key).agg(F.max(position).alias("cursor"))
    return cursors.select(key, "cursor").unionByName(newest).groupBy(key).agg(F.max("cursor").alias("cursor"))


# ---------------------------------------------------------------- status


def scan_status(classified: DataFrame, ingested: DataFrame, failures: DataFrame, now) -> DataFrame:
    """One row per source of this pass.

    ``ingested`` is ``agent, calls``; ``failures`` is ``agent, error``, one row per
    file that could not be read, of which the first is told.
    """
    changed = F.col("action").isin("append", "replace")
    files = classified.groupBy("agent").agg(
        F.count(F.lit(1)).alias("files_seen"), F.count_if(changed).alias("files_changed")
    )
    calls = ingested.groupBy("agent").agg(F.sum("calls").alias("calls_ingested"))
    errors = failures.groupBy("agent").agg(F.min("error").alias("error"))
    return (
        files.join(calls, "agent", "full_outer")
        .join(errors, "agent", "full_outer")
        .select(
            "agent",
            now.alias("last_scan_at"),
            F.when(F.col("files_changed") > 0, now).alias("last_full_at"),
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files_seen", "files_changed", "calls_ingested")],
            F.coalesce("error", F.lit("")).alias("error"),
        )
    )


def record_status(stored: DataFrame, this_pass: DataFrame) -> DataFrame:
    """Newest status per source; the last pass that read anything is remembered."""
    new = this_pass.select(*[F.col(c).alias(f"_{c}") if c != "agent" else F.col(c) for c in this_pass.columns])

    def newer(c):
        return F.coalesce(f"_{c}", c).alias(c)

    return stored.join(new, "agent", "full_outer").select(
        "agent",
        F.greatest("last_scan_at", "_last_scan_at").alias("last_scan_at"),
        newer("last_full_at"), newer("files_seen"), newer("files_changed"), newer("calls_ingested"), newer("error"),
    )


def source_states(known: DataFrame, status: DataFrame) -> DataFrame:
    """Each known source as found, empty, error or not-scanned, and whether it needs attention."""
    state = (
        F.when(F.col("files_seen").isNull(), "not-scanned")
        .when(F.coalesce("error", F.lit("")) != "", "error")
        .when(F.col("files_seen") > 0, "found")
        .otherwise("empty")
    )
    return (
        known.select("agent")
        .join(status, "agent", "left")
        .select(
            "agent",
            state.alias("state"),
            F.coalesce("files_seen", F.lit(0)).alias("files_seen"),
            F.coalesce("calls_ingested", F.lit(0)).alias("calls_ingested"),
            F.coalesce("error", F.lit("")).alias("error"),
            state.isin("error", "empty").alias("attention"),
        )
    )


def source_summary(states: DataFrame) -> DataFrame:
    """One line over all sources: how many are found, empty, failing and not scanned."""
    def n(state):
        return F.count_if(F.col("state") == state)

    counts = states.agg(
        F.count(F.lit(1)).alias("known"), n("found").alias("found"), n("empty").alias("empty"),
        n("error").alias("failed"), n("not-scanned").alias("unscanned"),
    )

    def part(column, text):
        return F.when(F.col(column) > 0, F.format_string(text, F.col(column)))

    line = F.concat_ws(
        " · ",
        F.format_string("%d of %d sources found", F.col("found"), F.col("known")),
        part("empty", "%d with no logs"), part("failed", "%d failing"), part("unscanned", "%d not scanned"),
    )
    return counts.select(F.when(F.col("known") == 0, "No sources are configured.").otherwise(line).alias("summary"))
