"""Agents whose sessions are rows of landed tables, read on from where the last pass stopped.

A position is stored per table or conversation, with a digest of the rows that
stand exactly there: rows that land later with the same position are told by it.
A row that is taken out of a landed table is not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CURSORS
from .common import Normalised

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Landed:
    """What one pass reads of landed tables.

    ``again`` is ``uid`` of sessions whose stored calls and tool calls the rows
    take the place of. ``moved`` are stored rows, already priced, that are
    written again with another project. ``state`` holds rows of further stored
    tables by name, the new positions among them.
    """

    rows: Normalised
    again: DataFrame
    state: dict[str, DataFrame]
    moved: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class TableSource:
    """An agent with landed tables and what reads on in them; ``stored`` gives a stored table by name."""

    agent: str
    tables: Callable[[SparkSession], Tables]
    read_on: Callable[[Tables, Callable[[str], DataFrame]], Landed | None]


def _digest(rows: DataFrame) -> str:
    one = F.xxhash64(*[F.col(c).cast("string") for c in sorted(rows.columns)]).cast("decimal(20,0)")
    return str(rows.agg(F.coalesce(F.sum(one), F.lit(0).cast("decimal(38,0)"))).first()[0])


def past_cursor(tables: Tables, cursors: DataFrame, agent: str, position: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Rows of each table that are new by its ``position`` column, and the cursors behind them.

    Rows at the very position of the cursor, and rows without one, count as new
    when they are not the ones that were there before.
    """
    spark = cursors.sparkSession
    before = {r.source: r for r in cursors.filter(F.col("agent") == agent).collect()}
    at, news, ends = F.col(position), {}, []
    for name, rows in tables.items():
        source, known = f"{agent}/{name}", before.get(f"{agent}/{name}")
        # Positions and digests first: what lands while this runs is then new to the next pass too.
        end = rows.agg(F.max(at)).first()[0]

        def standing(where: int | None, rows: DataFrame = rows) -> DataFrame:
            return rows.filter(at.isNull() if where is None else at.isNull() | (at == where))

        now = _digest(standing(end))
        if known is None:
            news[name] = rows
        elif known.position == end and known.ties == now:
            continue
        elif known.ties == (now if known.position == end else _digest(standing(known.position))):
            news[name] = rows.filter(at > known.position) if known.position is not None else rows.filter(at.isNotNull())
        else:
            news[name] = rows.filter(at.isNull() | (at >= known.position)) if known.position is not None else rows
        ends.append((source, agent, end, now))
    return news, spark.createDataFrame(ends, CURSORS)
