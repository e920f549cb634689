"""Near duplicates by one-permutation hashing, with every link confirmed on the full shingle sets.

1. Each text becomes a sketch of one permutation cut into bins; an empty bin
   copies the first non-empty bin of a fixed order of its own (optimal
   densification). Bins are read in bands, and a band's values are a bucket.
2. Texts with equal shingle sets are one class, of which one representative goes on.
3. Every bucket is a star: its smallest member against each other one. Pairs
   grow with the members, not with their square.
4. Where a star left several components in a bucket, its documents are paired
   again by their rarest shingles (prefix filter), which two that link must
   share, and compared across components until none is left out. So no link of a
   bucket is lost, and a passage that many documents share pairs none of them.
   Documents of few shingles are always among these, as their buckets are less sure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import components, keep_documents, store, working
from .shingles import U, WIDTH, mix, shared, shingle_set, stream

BANDS, ROWS = 30, 4
#: Links need 100 * intersection >= THRESHOLD * union. At 75 a link misses all 30 buckets of 4 bins once in 90,000 times,
#: more often where the union is smaller than the bins, whose copies are not independent.
THRESHOLD = 75
#: Sets of fewer shingles are always paired by their rarest shingles, whatever buckets they share.
SMALL = 100
#: Members of one star that a task verifies against its centre.
STAR_SHARE = 250
#: Documents and shingles of a block that the rest of its family is looked up in, and documents of a share of the family.
BLOCK_DOCS, BLOCK_SHINGLES, SHARE_DOCS = 4096, 1 << 20, 2000
_ORDERS: dict[int, np.ndarray] = {}


def _orders(bins: int) -> np.ndarray:
    """For every bin the rank it gives each other bin as a source of its value."""
    if bins not in _ORDERS:
        draws = stream(bins * bins, 7).reshape(bins, bins)
        _ORDERS[bins] = np.argsort(np.argsort(draws, axis=1), axis=1).astype(np.int32)
    return _ORDERS[bins]


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation sketch of a non-empty set with optimal densification."""
    with np.errstate(over="ignore"):
        spread = mix(hashes + U(0x632BE59BD9B4E019))
    bin_of = ((spread >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    low = np.full(bins, np.iinfo(np.uint64).max, U)
    np.minimum.at(low, bin_of, mix(spread))
    full = np.zeros(bins, bool)
    full[bin_of] = True
    empty, there = np.flatnonzero(~full), np.flatnonzero(full)
    if len(empty):
        order = _orders(bins)
        low[empty] = low[there[np.argmin(order[empty][:, there], axis=1)]]
    return low


def band_keys(low: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One bucket key per band."""
    with np.errstate(over="ignore"):
        cells = low.reshape(bands, rows)
        key = stream(bands, 11)
        for r in range(rows):
            key = mix(key * U(0x9E3779B97F4A7C15) + cells[:, r])
    return key.view(np.int64)


def _pieces(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def sketches(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, the bucket keys (none for an empty set), and ``mark`` if there is one."""
    marked = "mark" in docs.columns
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()),
                        ("keys", pa.list_(pa.int64())), *([("mark", pa.int64())] if marked else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("near dedup")
        for batch in batches:
            for part in _pieces(batch):
                size, one, two, keys = [], [], [], []
                for text in part.column("text"):
                    s = shingle_set(text.as_py(), width)
                    with np.errstate(over="ignore"):
                        one.append(int(mix(np.add.reduce(mix(s), keepdims=True)).view(np.int64)[0]) if len(s) else 0)
                        two.append(int(mix(np.bitwise_xor.reduce(mix(s + U(99)), keepdims=True)).view(np.int64)[0]) if len(s) else 0)
                    size.append(len(s))
                    keys.append(band_keys(sketch(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64())), *([part.column("mark")] if marked else [])], schema=schema)

    return docs.mapInArrow(run, "doc_id BIGINT, n_shingles BIGINT, h1 BIGINT, h2 BIGINT, keys ARRAY<BIGINT>" + ", mark BIGINT" * marked)


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, hashes) of the documents in ``ids(id)``; a set is its sorted hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch):
                sets = [shingle_set(t.as_py(), width).tobytes() for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    wanted = docs.join(ids.hint("merge"), docs.doc_id == ids.id).select("id", "text").dropDuplicates(["id"])  # where the join put them
    return store(wanted.mapInArrow(run, "id BIGINT, hashes BINARY"))


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact sizes for ``pairs(a, b)``: rows (a, b, both, na, nb). ``a`` is the centre of its star.

    A star with many members is cut into shares that each get the centre's set,
    so none is one task's work; a task holds one centre at a time.
    """
    sized = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_SHARE).alias("shares")), "a")
    placed = store(sized.select("a", "b", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share")))
    seats = placed.select(F.col("b").alias("id"), "a", "share", F.lit(1).alias("role")).union(
        placed.select(F.col("a").alias("id"), "a", "share", F.lit(0).alias("role")).distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, centre = None, None
        for batch in batches:
            a, share_no, role, ident = (batch.column(c).to_pylist() for c in ("a", "share", "role", "id"))
            data = batch.column("hashes")
            rows = []
            for i in range(batch.num_rows):
                values = np.frombuffer(data[i].as_buffer(), U)
                if role[i] == 0:
                    star, centre = (a[i], share_no[i]), values.copy()
                elif star == (a[i], share_no[i]):
                    rows.append((a[i], ident[i], shared(centre, values), len(centre), len(values)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "both", "na", "nb"])

    ordered = sets.join(seats.hint("merge"), "id").repartition("a", "share").sortWithinPartitions("a", "share", "role")
    return store(ordered.mapInArrow(compare, "a BIGINT, b BIGINT, both BIGINT, na BIGINT, nb BIGINT"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found(node, component)`` after ``links(a, b)`` join components; nodes without a row are their own."""
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    every = store(found.join(ends, "node", "full").select("node", F.coalesce("component", "node").alias("component")))
    x, y = every.select(F.col("node").alias("a"), F.col("component").alias("ca")), every.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    over = components(links.join(x, "a").join(y, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    new = over.select(F.col("node").alias("component"), F.col("component").alias("to"))
    return store(every.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def _prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(key, rep, n_shingles): of the rarest shingles of every set, enough that two sets that link share one, those in more sets.

    Sets that link share at least the threshold's part of each, so in any one
    order of all shingles the first n - ceil(part * n) + 1 of both have one in
    common. The order is by the number of sets that hold a shingle, then by
    hash: what many documents share comes last and is no key, at any size of the
    table. Shingles of one set alone come first and take their places, but pair
    nothing and are left out before the rows are sorted.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _pieces(batch, 50):
                n = [len(data) // 8 for data in part.column("hashes").to_pylist()]
                keys = np.concatenate([np.frombuffer(data.as_buffer(), np.int64) for data in part.column("hashes")])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (keys, np.repeat(part.column("id").to_numpy(), n), np.repeat(n, n))], names=["key", "rep", "n_shingles"])

    every = sets.mapInArrow(spread, "key BIGINT, rep BIGINT, n_shingles BIGINT")
    common = store(every.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"))
    own = Window.partitionBy("rep")
    return (
        every.join(common.hint("merge"), "key")
        .withColumn("place", F.row_number().over(own.orderBy("sets", "key")) + F.col("n_shingles") - F.count(F.lit(1)).over(own))
        .where(F.expr(f"place <= n_shingles - (({int(threshold)} * n_shingles + 99) DIV 100) + 1")).select("key", "rep", "n_shingles")
    )


def _more_links(members: DataFrame, seen: DataFrame, found: DataFrame, sets: DataFrame, small: DataFrame,
                threshold: int) -> tuple[DataFrame, DataFrame]:
    """All links, and components, after looking into buckets that the first stars left in several components.

    The documents of such buckets, and those in ``small(id)``, are brought together anew by their rarest
    shingles, which two that link must share, and looked up in blocks. Left out
    are only pairs of one component already.
    """
    is_link = F.expr(f"100 * both >= {int(threshold)} * (na + nb - both)")
    links = seen.where(is_link).select("a", "b")

    def labelled(rows: DataFrame) -> DataFrame:
        label = found.select(F.col("node").alias("rep"), F.col("component"))
        return rows.join(label, "rep", "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("comp"))

    def mixed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")

    apart = labelled(members)
    unsure = store(apart.join(mixed(apart), "key", "left_semi").select(F.col("rep").alias("id")).union(small).distinct())
    if unsure.isEmpty():
        return links, found
    sets = store(sets.join(unsure, "id", "left_semi"))
    rows = labelled(store(_prefixes(sets, threshold)))
    more = _block_links(sets, store(rows.join(mixed(rows), "key", "left_semi")), threshold)
    if more.isEmpty():
        return links, found
    return links.union(more), _merged(found, more)


def _block_links(sets: DataFrame, now: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) across components among the documents of ``now(key, rep, n_shingles, comp)``.

    Documents that keys connect are a family. Those outside its largest component
    are looked up against all of it: in blocks of bounded size, each with an
    index of its shingles, past which shares of the family stream. Only links
    become rows, never the pairs looked at.
    """
    least = now.groupBy("key").agg(F.min("rep").alias("b"))
    family = components(now.join(least, "key").select(F.col("rep").alias("a"), "b").distinct())
    each = store(now.select("rep", "n_shingles", "comp").distinct().join(family.withColumnRenamed("node", "rep").withColumnRenamed("component", "family"), "rep", "left")
                 .withColumn("family", F.coalesce("family", "rep")))
    main = each.groupBy("family", "comp").count().groupBy("family").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    sided = store(each.join(main, "family").withColumn("minor", F.col("comp") != F.col("main")))
    size = sided.groupBy("family").agg(
        F.ceil(F.greatest(F.sum(F.col("minor").cast("long")) / BLOCK_DOCS, F.sum(F.when(F.col("minor"), F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        F.ceil(F.count(F.lit(1)) / SHARE_DOCS).cast("int").alias("shares"))
    dealt = sided.join(size.where("blocks > 0"), "family")
    own = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    seats = dealt.select("family", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own("shares").alias("share"), F.lit(1).alias("role"), F.col("rep").alias("id"), "comp").union(
        dealt.where("minor").select("family", own("blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0), "rep", "comp"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, index, held = None, None, []
        for batch in batches:
            names = ("family", "block", "share", "role", "id", "comp")
            data = batch.column("hashes")
            a, b = [], []
            for i, (fam, block, share, role, ident, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                values = np.frombuffer(data[i].as_buffer(), U)
                if unit != (fam, block, share):
                    unit, index, held = (fam, block, share), None, []
                if role == 0:
                    held.append((ident, comp, values.copy()))
                    continue
                if not held:
                    continue
                if index is None:
                    every = np.concatenate([v for _, _, v in held])
                    order = np.argsort(every, kind="stable")
                    owner = np.repeat(np.arange(len(held)), [len(v) for _, _, v in held])[order]
                    index = (every[order], owner, np.array([len(v) for _, _, v in held]), [h[1] for h in held])
                every, owner, sizes, comps = index
                low, high = np.searchsorted(every, values, "left"), np.searchsorted(every, values, "right")
                n = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sizes))
                for j in np.flatnonzero(100 * both >= threshold * (sizes + len(values) - both)).tolist():
                    if comps[j] != comp:
                        a.append(held[j][0])
                        b.append(ident)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    unit = ["family", "block", "share"]
    ordered = sets.join(seats, "id").repartition(*unit).sortWithinPartitions(*unit, "role")
    got = ordered.mapInArrow(look, "a BIGINT, b BIGINT")
    return store(got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS,
                threshold: int = THRESHOLD, width: int = WIDTH, mark: Column | None = None) -> DataFrame:
    """Every document's class of near duplicates: doc_id, n_shingles, component_id, kept, n_links.

    Documents link when 100 * |intersection| >= threshold * |union| of their sets
    of distinct ``width``-word shingles. component_id is the smallest id that
    links lead to; n_links counts confirmed links of the document's class, copies
    aside. Null, empty and wordless texts link with nothing. Rows that repeat an
    id and text are one document (one row); a null id stays alone with itself as
    a null component. An empty table gives an empty result, and other columns of
    ``docs`` are ignored. With ``mark``, a long that tells texts apart, each row
    has the smallest one of its texts as well.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([] if mark is None else [mark.alias("mark")]))
    every = store(sketches(base, bands, rows, width))
    known = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = store(
        known.groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.min_by("keys", "doc_id").alias("keys"), F.count(F.lit(1)).alias("copies"))
    )
    placed = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    least = F.min(F.struct("rep", "n_shingles")).alias("least")
    stars = placed.groupBy("key").agg(least, F.count(F.lit(1)).alias("members")).where("members > 1")
    stars = stars.select("key", F.col("least.rep").alias("centre"), F.col("least.n_shingles").alias("centre_n"))
    members = store(placed.join(store(stars), "key").select("key", "centre", "centre_n", "rep", "n_shingles"))
    small = classes.where(F.col("n_shingles") < SMALL).select(F.col("rep").alias("id"))
    sets = shingle_sets(base, members.select(F.col("rep").alias("id")).union(small).distinct(), width)
    # Sets of which one is too small a part of the other cannot link.
    fits = F.expr(f"100 * LEAST(n_shingles, centre_n) >= {int(threshold)} * GREATEST(n_shingles, centre_n)")
    first = store(members.where("centre <> rep").where(fits).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    seen = verified(sets, first)
    found = store(components(seen.where(F.expr(f"100 * both >= {int(threshold)} * (na + nb - both)")).select("a", "b")))
    links, found = _more_links(members, seen, found, sets, small, threshold)
    links = store(links)
    degree = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("rep")).agg(F.count(F.lit(1)).alias("n_links"))
    named = store(
        classes.select("h1", "h2", "n_shingles", "rep", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .join(degree, "rep", "left").where("copies > 1 OR component IS NOT NULL")
        .select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    own = ["doc_id", "n_shingles", "h1", "h2"]
    one_each = every.select(*own).distinct() if mark is None else every.groupBy(*own).agg(F.min("mark").alias("mark"))
    lone = F.col("n_shingles") == 0
    component = F.when(lone | F.col("component").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return one_each.join(named, ["h1", "h2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *([] if mark is None else ["mark"]))


def drop_near(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    Texts that share an id, or have none, are documents of their own: all but one
    of them are judged under new ids above all others.
    """
    mark = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"))
    shared_ids = store(
        texts.groupBy("doc_id").agg(F.min("mark").alias("first"), F.max("mark").alias("last"))
        .where("doc_id IS NULL OR first < last").select("doc_id", "first"))
    if shared_ids.isEmpty():
        return keep_documents(docs, near_groups(docs, mark=mark, **options).where("kept").select("doc_id", "mark"), mark, [F.col("text")])
    top = texts.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0] + 1
    odd = texts.join(shared_ids.withColumnRenamed("doc_id", "of"), F.expr("doc_id <=> of")).where("doc_id IS NULL OR mark <> first")
    fresh = store(odd.select(F.col("doc_id").alias("of"), F.col("mark").alias("text_mark")).distinct().withColumn("new", F.monotonically_increasing_id() + top))
    named = docs.select("doc_id", "text", mark.alias("mark")).join(fresh, F.expr("doc_id <=> of AND mark = text_mark"), "left")
    groups = near_groups(named.select(F.coalesce("new", "doc_id").alias("doc_id"), "text", "mark"), mark=F.col("mark"), **options)
    kept = groups.where("kept").join(fresh, F.col("doc_id") == F.col("new"), "left").select(
        F.when(F.col("new").isNotNull(), F.col("of")).otherwise(F.col("doc_id")).alias("doc_id"), "mark")
    return keep_documents(docs, kept, mark, [F.col("text")])
