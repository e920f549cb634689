"""Reading on in a log without reading it again.

What a log's later lines need of its earlier ones is few lines: the first that
state the session's id, project, title and time, the last request and running
total, and the lines of responses and tool runs that are still open. These
lines are kept as they are. A later pass puts them before the new lines, under
their old numbers and marked as ``replayed``, so the same code that reads a
whole log gives exactly the rows of the new lines.

A response or tool run that is over leaves its key in ``closed``. Should a new
line come back to one, the log is read from its start, so nothing depends on
how long things stay open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, no_rows

#: A response stays open for so many lines after its last one, and the log's last response as long as it is that.
RECENT_LINES = 64
TAIL = "path STRING, lines ARRAY<STRUCT<ordinal: BIGINT, line: STRING>>"
CLOSED = "path STRING, key STRING"


@dataclass(frozen=True)
class Needs:
    """Lines of a log that later ones need: ``points`` (path, ordinal) always, ``keyed`` (path, key, ordinal, open) while open."""

    points: DataFrame
    keyed: DataFrame | None = None


#: What a source module offers as ``needs``: lines with a ``replayed`` column to Needs.
NeedsOf = Callable[[DataFrame], Needs]


def flagged(lines: DataFrame) -> DataFrame:
    """Lines with ``replayed``: false where no one says otherwise."""
    return lines if "replayed" in lines.columns else lines.withColumn("replayed", F.lit(False))


def events_once(lines: DataFrame, decode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Events of lines, written out so that no JSON is decoded twice; what has no ``line`` is events already."""
    return cut_lineage(decode(lines)) if "line" in lines.columns else lines


def settled(needs: Needs) -> Needs:
    """The same needs, worked out once for the tails and for what is closed."""
    return Needs(needs.points, None if needs.keyed is None else cut_lineage(needs.keyed))


def points(ev: DataFrame, last: tuple[str, ...] = ()) -> DataFrame:
    """(path, ordinal) of the first line that has each of a session's marks, of its last time, and of the last that has each of ``last``."""
    firsts = [c for c in ("uid_seen", "project_seen", "title_seen", "us") if c in ev.columns]
    has = lambda c: F.when(F.col(c).isNotNull(), F.col("ordinal"))
    at = F.array(*(F.min(has(c)) for c in firsts), *(F.max(has(c)) for c in dict.fromkeys(["us", *last])))
    return ev.groupBy("path").agg(at.alias("at")).select("path", F.explode(F.array_distinct(F.array_compact("at"))).alias("ordinal"))


def tails(lines: DataFrame, needs: Needs) -> DataFrame:
    """(path, lines): the lines to keep of every log, one row each."""
    wanted = needs.points
    if needs.keyed is not None:
        wanted = wanted.union(needs.keyed.filter("open").select("path", "ordinal"))
    kept = lines.join(wanted.distinct(), ["path", "ordinal"], "left_semi")
    rows = kept.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ordinal", "line"))).alias("lines"))
    # A log without such a line has an empty tail, so that it is known to have been read.
    every = lines.select("path").distinct()
    return every.join(rows, "path", "left").select("path", F.coalesce("lines", F.array().cast("array<struct<ordinal:bigint,line:string>>")).alias("lines"))


def closed(lines: DataFrame, needs: Needs) -> DataFrame:
    """(path, key) of all that is over."""
    if needs.keyed is None:
        return no_rows(lines.sparkSession, CLOSED)
    return needs.keyed.filter("NOT open").select("path", "key").distinct()


def late(needs_of_new: Needs, known_closed: DataFrame) -> DataFrame:
    """(path) of logs whose new lines come back to something that is over."""
    if needs_of_new.keyed is None:
        return known_closed.select("path").limit(0)
    return needs_of_new.keyed.join(known_closed, ["path", "key"], "left_semi").select("path").distinct()


def replaying(new_lines: DataFrame, kept: DataFrame) -> DataFrame:
    """New lines and, before them, the tails of their logs."""
    return new_lines.select("path", "agent", "ordinal", "line", F.lit(False).alias("replayed")).unionByName(_replayed(new_lines, kept))


def _replayed(new_lines: DataFrame, kept: DataFrame) -> DataFrame:
    old = kept.join(new_lines.select("path", "agent").distinct(), "path").select("path", "agent", F.explode("lines").alias("l"))
    return old.select("path", "agent", "l.ordinal", "l.line", F.lit(True).alias("replayed"))


def read_on(normalise, needs: NeedsOf, first: DataFrame, second: DataFrame, events=None):
    """Rows of the lines ``second`` that follow ``first`` in their logs, from the tails of ``first`` alone.

    Returns the rows of all logs but those that come back to something closed, and the paths of these.
    With ``events``, which turns lines into events one by one, the new lines are decoded once for their
    needs and their rows, and ``first`` may be a pair of lines and their events.
    """
    first, begun = first if isinstance(first, tuple) else (first, flagged(first))
    before = settled(needs(begun))
    kept, over = cut_lineage(tails(first, before)), cut_lineage(closed(first, before))
    if events is not None:
        new = events(flagged(second))
        again = cut_lineage(late(needs(new), over))
        replayed = events(_replayed(second.join(again, "path", "left_anti"), kept))
        return normalise(cut_lineage(new.join(again, "path", "left_anti").unionByName(replayed))), again
    again = cut_lineage(late(needs(flagged(second)), over))
    return normalise(cut_lineage(replaying(second.join(again, "path", "left_anti"), kept))), again
