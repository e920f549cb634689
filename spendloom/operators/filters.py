"""The filter every report takes, applied to calls, tool calls and sessions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """Empty axes do not filter. Bounds are epoch seconds, both inclusive."""

    models: Sequence[str] = field(default_factory=tuple)
    agents: Sequence[str] = field(default_factory=tuple)
    projects: Sequence[str] = field(default_factory=tuple)
    from_ts: int | None = None
    to_ts: int | None = None

    def within(self, column: str) -> list[Column]:
        """Date tests on an epoch column. An undated row is in no window."""
        out = []
        if self.from_ts is not None:
            out.append((F.col(column) >= self.from_ts) & (F.col(column) > 0))
        if self.to_ts is not None:
            out.append((F.col(column) <= self.to_ts) & (F.col(column) > 0))
        return out

    def owners(self) -> list[Column]:
        out = []
        if self.agents:
            out.append(F.col("agent").isin(list(self.agents)))
        if self.projects:
            out.append(F.col("project").isin(list(self.projects)))
        return out


NO_FILTER = Filter()


def parse_filter(args: Mapping[str, str | Iterable[str]], zone: str = "UTC") -> Filter:
    """Filter from request-style arguments.

    ``model``, ``agent`` and ``project`` may repeat or hold comma lists.
    ``date_from`` and ``date_to`` are calendar days in ``zone``; the last covers
    its whole day, also one that is 23 or 25 hours long.
    """

    def many(name: str) -> tuple[str, ...]:
        given = args.get(name, ())
        given = [given] if isinstance(given, str) else given
        parts = (part.strip() for value in given for part in value.split(","))
        return tuple(part for part in parts if part)

    def midnight(name: str, days: int = 0) -> int | None:
        value = args.get(name) or ""
        if not value:
            return None
        try:
            day = datetime.strptime(value, "%Y-%m-%d")
        except ValueError:
            raise ValueError(f"{name} {value!r} is not a date") from None
        return int((day + timedelta(days=days)).replace(tzinfo=ZoneInfo(zone)).timestamp())

    end = midnight("date_to", days=1)
    return Filter(
        models=many("model"),
        agents=many("agent"),
        projects=many("project"),
        from_ts=midnight("date_from"),
        to_ts=None if end is None else end - 1,
    )


def _apply(df: DataFrame, tests: list[Column]) -> DataFrame:
    for test in tests:
        df = df.filter(test)
    return df


def filter_calls(calls: DataFrame, f: Filter = NO_FILTER) -> DataFrame:
    tests = f.owners() + f.within("ts")
    if f.models:
        tests.append(F.col("model").isin(list(f.models)))
    return _apply(calls, tests)


def _with_model(df: DataFrame, calls: DataFrame, f: Filter, key: str) -> DataFrame:
    """Rows whose session made a call to one of the filter's models."""
    if not f.models:
        return df
    users = calls.filter(F.col("model").isin(list(f.models))).select(F.col("session_uid").alias(key)).distinct()
    return df.join(users, key, "left_semi")


def filter_tools(tools: DataFrame, calls: DataFrame, f: Filter = NO_FILTER) -> DataFrame:
    return _with_model(_apply(tools, f.owners() + f.within("ts")), calls, f, "session_uid")


def filter_sessions(sessions: DataFrame, calls: DataFrame, f: Filter = NO_FILTER) -> DataFrame:
    """A session's date is that of its last call."""
    return _with_model(_apply(sessions, f.owners() + f.within("last_ts")), calls, f, "uid")


def search_sessions(sessions: DataFrame, query: str) -> DataFrame:
    """Case-insensitive text search over project, path, agent and title."""
    needle = query.strip().lower()
    if not needle:
        return sessions
    hit = F.lit(False)
    for column in ["project", "path", "agent", "title"]:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(needle))
    return sessions.filter(hit)


def sort_rows(df: DataFrame, by: str, ascending: bool, tie: Sequence[str]) -> DataFrame:
    """Numbers by value, then text without case; equal values keep the order of ``tie``."""
    return df.orderBy(*sort_keys(by, ascending), *tie)


def sort_keys(by: str, ascending: bool) -> list[Column]:
    text = F.lower(F.coalesce(F.col(by).cast("string"), F.lit("")))
    value = F.btrim(F.col(by).cast("string")).try_cast("double")
    keys = [F.when(value.isNotNull(), 0).otherwise(1), value, F.when(value.isNull(), text)]
    return [k.asc() if ascending else k.desc() for k in keys]


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of an ordered DataFrame."""
    return df.offset(number * size).limit(size)


def page_after(df: DataFrame, by: str, ascending: bool, tie: Sequence[str], size: int, last: Mapping | None = None) -> DataFrame:
    """The ``size`` rows that follow row ``last`` in the order of :func:`sort_rows`; without it the first page.

    ``last`` has the values of ``by`` and ``tie`` of the last row seen. Where a page
    begins is a filter, so however deep it lies, every task keeps ``size`` rows
    and no earlier row is passed on. ``tie`` ends in something unique.
    """
    if last is not None:
        def keys(value: Column) -> Column:
            number = F.btrim(value.cast("string")).try_cast("double")
            text = F.when(number.isNull(), F.lower(F.coalesce(value.cast("string"), F.lit(""))))
            # A number comes before any text; of each only one of the two counts.
            return F.struct(F.when(number.isNotNull(), 0).otherwise(1), number, text)

        def seen(column: str) -> Column:
            return F.lit(last[column]).cast(df.schema[column].dataType)

        here, there = keys(F.col(by)), keys(seen(by))
        rest = F.struct(*tie) > F.struct(*map(seen, tie))
        df = df.filter((here > there if ascending else here < there) | ((here == there) & rest))
    return sort_rows(df, by, ascending, tie).limit(size)
