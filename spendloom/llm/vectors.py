"""Near duplicates among embeddings by collision counting over sorted one-dimensional projections.

Vectors are projected on many random directions. Around the projection of each
vector lies a window; how many of another's projections fall into these windows
is a count with a known distribution at the threshold, and pairs that reach the
count which a given recall asks for are verified by their cosine.

Vectors of a label are dealt to blocks along their first projection. A task
owns a pair of blocks: it sorts the projections of one, finds the windows of
the other by binary search and adds up the collisions as bit planes, so no
table of pairs arises there or between tasks: what leaves a task is, per
vector, its number of links and whom it hangs together with.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, ranked, store

THRESHOLD = 0.93
#: Directions, and half a window in standard deviations of a projected difference at the threshold.
PROJECTIONS, HALF_WINDOW = 63, 1.5
#: Share of the pairs just at the threshold whose count suffices.
RECALL = 0.9999999
BLOCK = 1024


def reach(threshold: float) -> float:
    """The largest distance of two unit vectors that are as alike as ``threshold``."""
    return math.sqrt(max(0.0, 2 - 2 * threshold))


def least_count(recall: float, projections: int = PROJECTIONS, half_window: float = HALF_WINDOW) -> int:
    """The largest count that pairs at the threshold reach with probability ``recall``.

    Their projected difference is normal, so it falls into the window with the
    same probability in each direction and the count is binomial.
    """
    p = math.erf(half_window / math.sqrt(2))
    below = 0.0
    for count in range(projections + 1):
        below += math.comb(projections, count) * p ** count * (1 - p) ** (projections - count)
        if below > 1 - recall:
            return count
    return projections


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    """Random directions (dim x projections), the same everywhere."""
    return np.random.default_rng([20, dim]).standard_normal((dim, projections))


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values sorted, and for each rank the set of the members before it, as bits."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    own = np.zeros((n + 1, -(-n // 64) * 8), np.uint8)
    own[np.arange(1, n + 1), order >> 3] = np.uint8(1) << (order & 7).astype(np.uint8)
    return values[order], np.bitwise_or.accumulate(own.view(np.uint64), 0)


def candidates(centres: np.ndarray, others: np.ndarray, half: float, least: int) -> np.ndarray:
    """Which of ``others`` lie in at least ``least`` windows around each of ``centres``, as a boolean matrix.

    Both are (vectors x directions). A window is a run of the sorted
    projections, so the set of its members is the difference of two prefixes; a
    counter of all members at once is kept in bit planes and starts so that its
    last plane shows who has reached the count.
    """
    planes = max(1, math.ceil(math.log2(max(centres.shape[1], least) + 1)))
    start = (1 << planes) - least
    width = -(-len(others) // 64)
    ones = ~np.uint64(0)
    counter = [np.full((len(centres), width), ones if start >> i & 1 else 0, np.uint64) for i in range(planes + 1)]
    for k in range(centres.shape[1]):
        values, before = _prefixes(others[:, k])
        low = np.searchsorted(values, centres[:, k] - half, "left")
        high = np.searchsorted(values, centres[:, k] + half, "right")
        carry = before[high] ^ before[low]
        for plane in counter:
            both = plane & carry
            plane ^= carry
            carry = both
    return np.unpackbits(counter[planes].view(np.uint8), axis=1, count=len(others), bitorder="little").astype(bool)


def linked(x: np.ndarray, y: np.ndarray, threshold: float, least: int, half_window: float = HALF_WINDOW, projections: int = PROJECTIONS) -> np.ndarray:
    """Which rows of ``y`` are as alike as ``threshold`` to each row of ``x``; unit vectors in double precision."""
    basis = directions(x.shape[1], projections)
    half = reach(threshold) * half_window
    found = candidates(x @ basis, y @ basis, half, least)
    rows = np.flatnonzero(found.any(1))
    if len(rows):
        found[rows] &= x[rows] @ y.T >= threshold
    return found


def _hanging(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least row it hangs together with."""
    n = len(links)
    least = np.full(n, -1)
    for start in range(n):
        if least[start] >= 0:
            continue
        member = np.zeros(n, bool)
        member[start] = True
        edge = member.copy()
        while edge.any():
            edge = links[edge].any(0) & ~member
            member |= edge
        least[member] = start
    return least


def _cell_of(threshold: float, least: int):
    def cell(table: pa.Table) -> pa.Table:
        left = table["block"].to_numpy()
        apart = bool((table["mate"].to_numpy() != left).any())
        order = np.lexsort((table["node"].to_numpy(), left))
        table, left = table.take(pa.array(order)), left[order]
        flat = table["unit"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        unit, node, times = flat.reshape(len(left), -1), table["node"].to_numpy(), table["times"].to_numpy()
        if apart:
            cut = int(np.searchsorted(left, left[0], "right"))
            across = linked(unit[:cut], unit[cut:], threshold, least)
            links = np.concatenate([across @ times[cut:], times[:cut] @ across])
            rows = np.flatnonzero(links)
            few = np.zeros((len(rows), len(rows)), bool)
            at = np.searchsorted(rows, cut)
            few[:at, at:] = across[np.ix_(rows[:at], rows[at:] - cut)]
            few |= few.T
        else:
            own = linked(unit, unit, threshold, least)
            own |= own.T
            np.fill_diagonal(own, False)
            links = own @ times
            rows = np.flatnonzero(links)
            few = own[np.ix_(rows, rows)]
        root = rows[_hanging(few)] if len(rows) else rows
        return pa.table({"node": node[rows], "links": links[rows].astype(np.int64), "root": node[root]})

    return cell


def _first_projection(batches):
    """Unit vectors of finite non-zero vectors, with their place along the first direction."""
    for batch in batches:
        kept, units, places = [], [], []
        for i, vector in enumerate(batch["vector"]):
            v = vector.values.to_numpy(zero_copy_only=False)
            # Scaled first, so that neither tiny nor huge components leave the range of squares.
            v = v / np.abs(v).max()
            v = v / np.sqrt(v @ v)
            kept.append(i)
            units.append(v)
            along = directions(len(v))[:, 0]
            places.append(float(v @ along / np.sqrt(along @ along)))
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows["kind"], rows["vector"], pa.array(units, pa.list_(pa.float64())), pa.array(places, pa.float64())],
                                         ["kind", "vector", "unit", "place"])


def near_groups(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
                id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links and components among vectors of one label whose cosine reaches ``threshold``.

    Columns: vec_id, n_links (other vectors linked directly), component_id (the
    smallest vec_id reachable by links, itself included), kept (whether it is
    that one). One row per row of ``vectors``. Rows with a null label, and
    vectors that are null, empty, zero or hold null or non-finite components,
    link with nothing; neither do vectors of different lengths. Equal vectors
    of a label are one node with a weight, so copies of any number cost one
    row. Rows with one id are rows of their own. Without an id a row counts as
    a link of others; a component of such rows only has no id. Other columns
    are ignored; an empty table gives an empty result.

    A link is missed with probability of at most ``1 - recall``, and only just
    at the threshold so often; what is given as linked is verified.
    """
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    usable = F.col("label").isNotNull() & F.coalesce(
        F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0), F.lit(False))
    kind = F.concat_ws(":", F.size("vector").cast("string"), "label")
    # Negative zero equals zero.
    vector = F.transform("vector", lambda v: v + F.lit(0.0))
    rows = store(base.select("vec_id", F.when(usable, kind).alias("kind"), F.when(usable, vector).alias("vector")))
    unlinked = rows.where("kind IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))

    distinct = rows.where("kind IS NOT NULL").groupBy("kind", "vector").agg(F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least"))
    nodes = store(distinct.withColumn("node", F.monotonically_increasing_id()))
    places = nodes.select("kind", "vector").mapInArrow(_first_projection, "kind string, vector array<double>, unit array<double>, place double")
    placed = store(places.join(nodes.select("kind", "vector", "node", "times"), ["kind", "vector"]).select("kind", "node", "times", "unit", "place"))
    dealt = ranked(placed, ["kind"], ["place", "node"])
    dealt = store(dealt.select("kind", "node", "times", "unit", "place", ((F.col("pos") - F.col("pos") % block) / block).cast("long").alias("block")))

    # Two blocks meet unless they are further apart along the first direction than linked vectors can be.
    ends = store(dealt.groupBy("kind", "block").agg(F.min("place").alias("low"), F.max("place").alias("high")))
    span = reach(threshold) + 1e-9
    mates = ends.select("kind", "block", "low", "high").join(
        ends.select("kind", F.col("block").alias("mate"), F.col("low").alias("mate_low"), F.col("high").alias("mate_high")), "kind")
    mates = mates.where((F.col("mate_low") - F.col("high") <= span) & (F.col("low") - F.col("mate_high") <= span)).select("kind", "block", "mate")
    cells = dealt.join(mates, ["kind", "block"]).select(
        "kind", F.least("block", "mate").alias("one"), F.greatest("block", "mate").alias("two"), "block", "mate", "node", "times", "unit")
    least = least_count(recall)
    found = store(cells.groupBy("kind", "one", "two").applyInArrow(_cell_of(threshold, least), "node long, links long, root long"))

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.join(links, "node", "left").join(roots, "node", "left").select(
        "kind", "vector", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    known = store(known)
    named = known.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = rows.where("kind IS NOT NULL").join(known.join(named, "component").select("kind", "vector", "n_links", "component_id"), ["kind", "vector"])
    out = unlinked.unionByName(whole.select("vec_id", "n_links", "component_id"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
