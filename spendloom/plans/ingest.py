"""One ingest pass: changed logs in, stored tables out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..operators.pricing import PriceList, affected_calls, price_calls, reprice
from ..operators.sessions import session_calls, sessions_rollup
from ..session import cut_lineage, no_rows
from ..sources import resume
from ..sources.common import Normalised
from ..sources.landed import TableSource
from ..sources.lines import read_ranges, unreadable, windows
from ..sources.listing import can_seek
from ..sources.registry import LogSource
from .store import TABLES, OldBaseError, Store


@dataclass(frozen=True)
class PassResult:
    version: int
    changed: int
    vanished: int
    errors: dict[str, str]


@dataclass
class _Read:
    """What one source gave: everything of it or nothing."""

    calls: DataFrame
    tools: DataFrame
    identities: DataFrame
    actions: DataFrame
    tails: DataFrame | None = None
    closed: DataFrame | None = None


def _resume(source: LogSource, grown: DataFrame, known: DataFrame, tails: DataFrame, closed: DataFrame, book: PriceList) -> _Read | None:
    """Rows of logs that grew, from where the last pass stopped reading them; None if there is none to read so.

    ``grown`` are logs that look longer than what was consumed. A log is read on
    if the ends of what was consumed are as they were, its tail is stored, and
    none of its new lines comes back to something closed.
    """
    if source.needs is None:
        return None
    before = known.filter("consumed > 0 AND windows IS NOT NULL").select(
        "path", F.col("consumed").alias("start"), F.col("prefix_len").alias("first"), F.col("prefix_hash").alias("digest"), F.col("windows").alias("seen"))
    grown = cut_lineage(grown.select("agent", "path", "size", "mtime").join(before, "path").filter("size >= start"))
    one = grown.select("path").first()
    if one is None or not can_seek(one.path):
        return None
    now = windows(grown.select("path", F.col("start").alias("upto")))
    kept = cut_lineage(tails.join(grown.select("path"), "path", "left_semi"))
    files = cut_lineage(grown.join(now, "path").filter("windows = seen").join(kept.select("path"), "path", "left_semi").drop("windows", "seen"))
    lines = cut_lineage(read_ranges(files, source.agent))
    late = cut_lineage(resume.late(source.needs(resume.flagged(lines)), closed))
    files, lines = files.join(late, "path", "left_anti"), lines.join(late, "path", "left_anti")
    both = cut_lineage(resume.replaying(lines, kept))
    rows, needs = source.rows(both), resume.settled(source.needs(both))
    one_line = F.xxhash64("ordinal", "line").cast("decimal(20,0)")
    sums = lines.groupBy("path").agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.count(F.lit(1)).alias("n"), F.sum(one_line).alias("sum"))
    digest = F.coalesce(F.nullif("digest", F.lit("")), F.lit("0")).cast("decimal(38,0)") + F.coalesce("sum", F.lit(0))
    actions = files.join(sums, "path", "left").select(
        "agent", "path", "size", "mtime", F.lit("append").alias("action"), (F.col("start") + F.coalesce("bytes", F.lit(0))).cast("bigint").alias("read"),
        digest.cast("string").alias("prefix_hash"), (F.col("first") + F.coalesce("n", F.lit(0))).cast("bigint").alias("prefix_len"))
    return _Read(
        cut_lineage(price_calls(rows.calls, book).drop("sized")), cut_lineage(rows.tools), cut_lineage(rows.identities),
        cut_lineage(actions), cut_lineage(resume.tails(both, needs)), cut_lineage(resume.closed(both, needs)),
    )


def _read(source: LogSource, picked: DataFrame, known: DataFrame, book: PriceList) -> _Read:
    """Rows and new file states of some logs, all of them written out before any is used."""
    lines = cut_lineage(source.lines(picked))
    # Only what was picked is compared with what was consumed of it before.
    digests = cut_lineage(state.file_digests(lines, known))
    chosen = state.classify_files(picked.join(digests.select("path", "same_head"), "path", "left"), known)
    chosen = chosen.join(digests.select("path", F.col("consumed").alias("read"), "prefix_hash", "prefix_len"), "path", "left")
    rows: Normalised = source.rows(lines)
    kept = over = None
    if source.needs is not None:
        needs = resume.settled(source.needs(resume.flagged(lines)))
        kept, over = cut_lineage(resume.tails(lines, needs)), cut_lineage(resume.closed(lines, needs))
    return _Read(
        cut_lineage(price_calls(rows.calls, book).drop("sized")), cut_lineage(rows.tools), cut_lineage(rows.identities),
        cut_lineage(chosen.drop("same_head", "consumed")), kept, over,
    )


def _told(error: Exception) -> str:
    lines = str(error).splitlines()
    return f"{type(error).__name__}: {lines[0] if lines else ''}"


def _read_what_can_be(source: LogSource, picked: DataFrame, known: DataFrame, book: PriceList) -> tuple[list[_Read], DataFrame | None]:
    """Read all picked logs at once; what was read, and ``path, error`` of every log that fails by itself, None if none does.

    Where that fails, one job finds all logs that cannot be opened or read to
    their end, and the others are read at once. If their rows fail, halves are
    read, down to the logs that fail by themselves, however many they are. A
    source that fails without a line gives no log. Logs are halved by a bit of
    the hash of their path, so no list of them is ever on the driver but of
    those that fail by their rows, each of which took some reads.
    """
    spark = picked.sparkSession
    failed: list[tuple[str, str]] = []

    def side(bit: int):
        return F.shiftright(F.xxhash64("path"), bit).bitwiseAND(1)

    def some(part: DataFrame, bit: int = 0, error: Exception | None = None) -> list[_Read]:
        if error is None:
            try:
                return [_read(source, part, known, book)]
            except Exception as raised:  # noqa: BLE001 - one bad log must not stop the rest
                error = raised
        sizes = dict(part.groupBy(side(bit).alias("side")).count().collect()) if bit < 64 else {}
        if bit == 64 or sum(sizes.values()) == 1:
            failed.extend((r.path, _told(error)) for r in part.select("path").collect())
            return []
        if len(sizes) == 1:
            return some(part, bit + 1, error)
        return some(part.filter(side(bit) == 0), bit + 1) + some(part.filter(side(bit) == 1), bit + 1)

    try:
        return [_read(source, picked, known, book)], None
    except Exception as raised:  # noqa: BLE001
        first = raised
    bad = unreadable(picked)
    others = picked.join(bad, "path", "left_anti").select(*picked.columns)
    try:
        _read(source, picked.limit(0), known, book)
    except Exception as raised:  # noqa: BLE001
        return [], bad.unionByName(others.select("path", F.lit(_told(raised)).alias("error")))
    got = [] if others.isEmpty() else some(others, error=first if bad.isEmpty() else None)
    return got, bad.unionByName(spark.createDataFrame(failed, "path STRING, error STRING"))


def _read_on(source: LogSource, grown: DataFrame, known: DataFrame, store: Store, version: int, book: PriceList) -> _Read | None:
    """What :func:`_resume` gives; where it fails, the logs are read from their start, which tells which of them is bad."""
    try:
        return _resume(source, grown, known, store.read("tails", version), store.deltas("closed", version).select("path", "key"), book)
    except Exception:  # noqa: BLE001
        return None


@dataclass
class _Tables:
    """What one table-backed source gave, and how many sessions it touches."""

    calls: DataFrame
    tools: DataFrame
    identities: DataFrame
    again: DataFrame
    state: dict[str, DataFrame]
    sessions: int


def _read_tables(source: TableSource, spark: SparkSession, store: Store, version: int, book: PriceList) -> _Tables | None:
    """New rows of landed tables, written out before any is used; None if nothing landed."""
    got = source.read_on(source.tables(spark), lambda table: store.read(table, version))
    if got is None:
        return None
    calls, tools = price_calls(got.rows.calls, book).drop("sized"), got.rows.tools
    if got.moved:
        calls, tools = calls.unionByName(got.moved["calls"]), tools.unionByName(got.moved["tool_calls"])
    identities = cut_lineage(got.rows.identities)
    state_rows = {table: cut_lineage(rows) for table, rows in got.state.items()}
    return _Tables(cut_lineage(calls), cut_lineage(tools), identities, cut_lineage(got.again), state_rows, identities.count())


def run_pass(
    spark: SparkSession,
    store: Store,
    sources: list[LogSource | TableSource],
    prices: DataFrame,
    now: datetime,
    max_changed: int | None = None,
) -> PassResult:
    """Read what changed, replace or append its sessions, flag vanished logs, record the status.

    All changed logs are read unless ``max_changed`` asks for fewer. A log that
    fails is reported with its path in ``failures`` and leaves the others alone,
    and the next pass tries it again; of a log either everything is stored or
    nothing, and the same holds for a source of landed tables, each of whose
    touched sessions counts as changed. A pass that finds nothing to do writes
    nothing.
    """
    version = store.version()
    known = cut_lineage(store.read("file_state", version))
    book = PriceList(prices)
    stamp = F.lit(now).cast("timestamp")
    errors: dict[str, str] = {}
    parts: list[_Read] = []
    landed: dict[str, _Tables | None] = {}
    files: DataFrame | None = None
    waiting: list[DataFrame] = []
    unread: list[DataFrame] = []

    def stacked(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    for source in sources:
        if isinstance(source, TableSource):
            try:
                landed[source.agent] = _read_tables(source, spark, store, version, book)
            except Exception as error:  # noqa: BLE001 - one bad source must not stop the rest
                errors[source.agent] = _told(error)
            continue
        try:
            # The listing is used several times below and must not move in between.
            listing = cut_lineage(source.files(spark).select(F.lit(source.agent).alias("agent"), "path", "size", "mtime"))
            guess = state.classify_files(listing.withColumn("same_head", F.lit(True)), known)
            picked = cut_lineage(state.take_changed(guess, max_changed).select(*listing.columns))
            grown = picked.join(guess.filter("action = 'append'").select("path"), "path", "left_semi")
            on = _read_on(source, grown, known, store, version, book)
            rest = picked if on is None else picked.join(on.actions.select("path"), "path", "left_anti")
            rest = rest if on is None else cut_lineage(rest)
            got, failed = ([], None) if rest.isEmpty() else _read_what_can_be(source, rest, known, book)
            if on is not None:
                got.append(on)
        except Exception as error:  # noqa: BLE001 - one bad source must not stop the rest
            errors[source.agent] = _told(error)
            continue
        files = guess if files is None else files.unionByName(guess)
        parts += got
        waiting.append(guess.filter(F.col("action").isin("append", "replace")).select("path").join(picked, "path", "left_anti"))
        if failed is not None:
            n, first = failed.agg(F.count(F.lit(1)), F.min(F.struct("path", "error"))).first()
            if n:
                unread.append(failed.select("path", F.lit(source.agent).alias("agent"), "error"))
                errors[source.agent] = f"{n} of {picked.count()} failed; first: {first.path}: {first.error}"

    listing = files if files is not None else no_rows(spark, "path STRING")
    whole = [s.agent for s in sources if files is not None and (s.agent not in errors or " failed; first: " in errors[s.agent])]
    gone = cut_lineage(state.vanished(known.filter(F.col("agent").isin(whole)), listing))
    n_gone = gone.count()
    rows_of = [t for t in landed.values() if t is not None]
    n_changed = sum(p.actions.count() for p in parts) + sum(t.sessions for t in rows_of)
    # A recorded failure stays only where this pass did not try the log again.
    over = store.read("failures", version).filter(F.col("agent").isin(whole)).select("path")
    if waiting:
        over = over.join(stacked(waiting), "path", "left_anti")
    over = cut_lineage(over)
    if n_changed == 0 and not rows_of and n_gone == 0 and not errors and over.isEmpty():
        return PassResult(version, 0, 0, errors)

    changes: dict[str, DataFrame] = {}
    resets: dict[str, DataFrame] = {}
    lost = gone.select(F.col("session_uid").alias("uid"))
    old = store.read("identities", version)
    back = no_rows(spark, "uid STRING")
    seen = lost
    facts = [*parts, *rows_of]
    if facts:
        identities = stacked([p.identities for p in facts])
        replaced = [t.again for t in rows_of]
        if parts:
            actions, of_logs = stacked([p.actions for p in parts]), stacked([p.identities for p in parts])
            anew = actions.filter("action = 'replace'").select("path")
            replaced.append(of_logs.join(anew, "path", "left_semi").select("uid"))
            changes["file_state"] = _file_rows(actions, of_logs, stamp)
            resets["closed"] = anew
        for table, rows in (("calls", stacked([p.calls for p in facts])), ("tool_calls", stacked([p.tools for p in facts]))):
            columns = no_rows(spark, TABLES[table][1]).columns
            changes[table] = state.inherit_project(rows.select(*columns), identities)
            resets[table] = stacked(replaced)
        back = identities.select("uid")
        seen = lost.unionByName(back)
        # A title is set when a session is first stored and stays.
        old = state.upsert(old, identities.select(*old.columns), keys=["uid"], keep=["title"], keep_if_empty=["project"])
        kept = [("tails", [p.tails for p in parts if p.tails is not None]), ("closed", [p.closed for p in parts if p.closed is not None])]
        for table, frames in [*kept, *((t, [x.state[t] for x in rows_of if t in x.state]) for t in ("cursors", "votes"))]:
            if frames:
                changes[table] = stacked(frames)
    changes["identities"] = state.mark_orphaned(old.join(seen.distinct(), "uid", "left_semi"), gone, back)
    resets["file_state"] = gone.select("path")
    resets["failures"] = over
    if unread:
        changes["failures"] = stacked(unread).withColumn("failed_at", stamp)

    counted = no_rows(spark, "agent STRING, calls BIGINT")
    if facts:
        counted = stacked([p.calls.select("agent") for p in facts]).groupBy("agent").agg(F.count(F.lit(1)).alias("calls"))
    failed = spark.createDataFrame(list(errors.items()), "agent STRING, error STRING") if errors else no_rows(spark, "agent STRING, error STRING")
    # A source of landed tables counts as one file.
    classified = spark.createDataFrame([(a, "unchanged" if t is None else "append") for a, t in landed.items()], "agent STRING, action STRING")
    if files is not None:
        classified = classified.unionByName(files.select("agent", "action"))
    changes["scan_status"] = state.record_status(
        store.read("scan_status", version), state.scan_status(classified, counted, failed, stamp))
    return PassResult(publish(store, changes, resets), n_changed, n_gone, errors)


def _file_rows(actions: DataFrame, identities: DataFrame, stamp) -> DataFrame:
    """New state of the files just read. What is consumed ends at the last newline."""
    owner = identities.groupBy("path").agg(F.min("uid").alias("session_uid"))
    # Where tasks cannot open a path at an offset there is no digest, and a log that grew is read from its start.
    some = actions.select("path").first()
    ends = windows(actions.select("path", F.coalesce("read", F.lit(0)).alias("upto"))) if some is not None and can_seek(some.path) else (
        actions.select("path", F.lit(None).cast("string").alias("windows")))
    return actions.join(owner, "path", "left").join(ends, "path", "left").select(
        "path", "agent", "size", "mtime",
        F.coalesce("read", F.lit(0)).alias("consumed"),
        F.coalesce("prefix_hash", F.lit("")).alias("prefix_hash"),
        F.coalesce("prefix_len", F.lit(0)).alias("prefix_len"),
        F.lit("bytes").alias("cursor"), F.coalesce("session_uid", F.lit("")).alias("session_uid"),
        F.lit(False).alias("complete"), stamp.alias("scanned_at"), "windows",
    )


def reprice_store(store: Store, prices: DataFrame, before: DataFrame | None = None) -> int:
    """Bring stored calls to a price list, and their sessions with them; only calls whose price changes are written.

    With ``before``, the list they were priced from, only calls that the two
    lists may price differently are worked out at all. Prices that change
    nothing write nothing. If another pass comes in between, it starts over.
    """
    while True:
        version = store.version()
        rows = store.read("calls", version)
        # Names of models are looked up in the rows as written, so that these are merged only once.
        models = cut_lineage(store.deltas("calls", version).select("model").distinct())
        if before is not None:
            rows = affected_calls(rows, PriceList(before), PriceList(prices), models)
        new = reprice(rows.withColumn("_cost", F.col("cost_usd")).withColumn("_was", F.col("priced")), PriceList(prices), models)
        changed = cut_lineage(new.filter("NOT (cost_usd <=> _cost AND priced <=> _was)").select(*rows.columns))
        if changed.isEmpty():
            return version
        try:
            return publish(store, {"calls": changed}, after=version)
        except OldBaseError:
            continue


def reread(store: Store, agent: str) -> int:
    """Have the next pass read everything of one agent anew, as after a change of what turns its logs into rows.

    Nothing disappears meanwhile: the rows of a log or landed session stay until
    the pass that reads it again stores the new ones in their place, and a log
    that fails then keeps its old rows. Other agents' logs stay as they are.
    """
    version = store.version()
    known = store.read("file_state", version).filter(F.col("agent") == agent)
    # A size no log has and a cursor of no kind: the log has changed and cannot be read on.
    changes = {"file_state": cut_lineage(known.withColumns({"size": F.lit(-1).cast("bigint"), "cursor": F.lit("none")}))}
    cursors = store.read("cursors", version).filter(F.col("agent") == agent).select("source")
    resets = {"cursors": cut_lineage(cursors)}
    resets["votes"] = cut_lineage(cursors.select(F.expr("substring(source, position('/', source) + 1)").alias("conversation")))
    return store.append(changes, resets)


def forget(store: Store, uid: str) -> int:
    """Delete one session with all its rows."""
    one = store.spark.createDataFrame([(uid,)], "uid STRING")
    return publish(store, {}, dict.fromkeys(("calls", "tool_calls", "identities"), one))


FACTS = ("calls", "tool_calls", "identities")
#: So many touched sessions are named in the scan's filter; more are a join.
NAMED_SESSIONS = 500


def publish(store: Store, changes: dict[str, DataFrame], resets: dict[str, DataFrame] | None = None, after: int | None = None) -> int:
    """Append a pass, and with it the rows of the sessions whose calls, tool calls or identity it touches.

    Only these sessions are rolled up again, from their own rows; all others keep the row they have.
    Which they are is read from what the pass has written, so the work behind its rows is done once.
    """
    resets = dict(resets or {})
    if not any(t in changes or t in resets for t in FACTS):
        return store.append(changes, resets, after)
    known: list = []

    def rolled(read, written) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        first = not known
        if first:
            touched = written("resets").filter(F.col("target").isin(*FACTS)).select(F.col("key").alias("uid"))
            for table in FACTS:
                if table in changes:
                    touched = touched.union(written(table).select(F.col(TABLES[table][0][0]).alias("uid")))
            touched = cut_lineage(touched.distinct())
            known.extend([touched, [r.uid for r in touched.limit(NAMED_SESSIONS + 1).collect()]])
        touched, named = known

        def own(table: str) -> DataFrame:
            key = TABLES[table][0][0]
            rows = read(table)
            if len(named) <= NAMED_SESSIONS:
                return rows.filter(F.col(key).isin(named))
            return rows.join(touched.select(F.col("uid").alias(key)), key, "left_semi")

        columns = no_rows(store.spark, TABLES["sessions"][1]).columns
        return {"sessions": sessions_rollup(*map(own, FACTS)).select(*columns)}, {"sessions": touched} if first else {}

    return store.append(changes, resets, after, rolled)


def sessions(store: Store, version: int | None = None) -> DataFrame:
    """Sessions of one version of the store, as its passes left them."""
    version = store.version() if version is None else version
    if store.has("sessions"):
        return store.read("sessions", version)
    return sessions_rollup(store.read("calls", version), store.read("tool_calls", version), store.read("identities", version))


def one_session(store: Store, uid: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A session's row, none if there is no such session, and its calls in time order.

    The test on the session is made in the scan, before rows are merged.
    """
    version = store.version() if version is None else version

    def own(table: str) -> DataFrame:
        return store.read(table, version).filter(F.col(TABLES[table][0][0]) == uid)

    return sessions_rollup(own("calls"), own("tool_calls"), own("identities")), session_calls(own("calls"), uid)
