"""Ordered state along a key, without ever putting a whole key into one task.

A plain window partitioned by session would hand a session of any size to one
task. Here a key's rows are cut into chunks of bounded size. Each chunk runs its
own window, a small table with one row per (key, chunk) says what the chunks
around it hold, and the two are joined on the chunk. The rows are shuffled once;
only the chunk table, a tiny fraction of them, is ever grouped by the bare key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import whole_div

# Rows per chunk where rows are numbered 0, 1, 2, ... within their key.
ROWS_PER_CHUNK = 65_536


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None = None,
    *,
    last_before: Mapping[str, Column] | None = None,
    first_before: Mapping[str, Column] | None = None,
    first_from: Mapping[str, Column] | None = None,
    first_of_key: Mapping[str, Column] | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    summary_of: DataFrame | None = None,
) -> DataFrame:
    """Add columns that look along each key's rows in ``order``, skipping nulls.

    * ``last_before``: newest value strictly before the row
    * ``first_before``: oldest value strictly before the row
    * ``first_from``: first value at or after the row
    * ``first_of_key``: oldest value of the whole key

    ``order`` must be total within a key. ``chunk`` must not decrease along it and
    must bound the rows per chunk; by default the single order column is taken as
    a row number and cut every ``rows_per_chunk``.

    The chunk table is a second look at the rows. Where ``df`` is the result of
    dear work, pass cheaper rows with the same keys, order and values as
    ``summary_of``, or cut the lineage of ``df`` before.
    """
    if chunk is None:
        (number,) = order
        chunk = whole_div(F.col(number), rows_per_chunk)
    wanted = {
        "last_before": dict(last_before or {}),
        "first_before": dict(first_before or {}),
        "first_from": dict(first_from or {}),
        "first_of_key": dict(first_of_key or {}),
    }
    names = [name for group in wanted.values() for name in group]
    plain = df.columns
    parts = [
        chunk.alias("_chunk"),
        *[value.alias(f"_v_{name}") for group in wanted.values() for name, value in group.items()],
    ]
    base = df.select("*", *parts)
    summary = base if summary_of is None else summary_of.select("*", *parts)
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])

    # What each chunk offers to the others.
    offers = []
    for group, values in wanted.items():
        for name in values:
            value = F.col(f"_v_{name}")
            where = F.when(value.isNotNull(), position)
            pick = F.max_by if group == "last_before" else F.min_by
            offers.append(pick(value, where).alias(f"_o_{name}"))
    along = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    # Looking ahead is looking back in reverse: a frame that starts at the row and
    # ends at the last one would be summed up anew for every row.
    later = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reach = {
        "last_before": (F.last, earlier),
        "first_before": (F.first, earlier),
        "first_from": (F.last, later),
        "first_of_key": (F.first, everywhere),
    }
    around = (
        summary.groupBy(*keys, "_chunk")
        .agg(*offers)
        .select(
            *keys,
            "_chunk",
            *[
                reach[group][0](f"_o_{name}", True).over(reach[group][1]).alias(f"_c_{name}")
                for group, values in wanted.items()
                for name in values
            ],
        )
    )

    # What the row's own chunk says.
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(c) for c in order])
    onward = backward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {
        "last_before": lambda v: F.last(v, True).over(before),
        "first_before": lambda v: F.first(v, True).over(before),
        "first_from": lambda v: F.last(v, True).over(onward),
    }
    rows = base.select(
        *plain,
        "_chunk",
        *[
            local[group](F.col(f"_v_{name}")).alias(f"_l_{name}")
            for group, values in wanted.items()
            if group in local
            for name in values
        ],
    )
    joined = rows.join(around, [*keys, "_chunk"], "left")
    out = []
    for name in wanted["last_before"]:
        out.append(F.coalesce(f"_l_{name}", f"_c_{name}").alias(name))
    for name in wanted["first_before"]:
        out.append(F.coalesce(f"_c_{name}", f"_l_{name}").alias(name))
    for name in wanted["first_from"]:
        out.append(F.coalesce(f"_l_{name}", f"_c_{name}").alias(name))
    for name in wanted["first_of_key"]:
        out.append(F.col(f"_c_{name}").alias(name))
    assert len(out) == len(names)
    return joined.select(*[c for c in plain if c not in names], *out)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the greatest in ``order``.

    An aggregate rather than a ranking window: copies of a key meet in the map
    tasks already, so a key with very many copies costs no task more than others.
    """
    rest = [c for c in df.columns if c not in keys]
    position = F.struct(*order)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )
