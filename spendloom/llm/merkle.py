"""Document fingerprints: a Merkle tree over sections and paragraphs, in DataFrame operations only.

Leaves are paragraphs, sections hash their leaves, and the root hashes the
sections: equal roots are equal texts, and where roots differ, the sections and
then the leaves that differ tell where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# A section ends at a blank line or behind a line that ends in one of a few
# letters, so an edit moves the bounds of its own section only; at last after 2000 code points.
SECTION = r"(?s).{1,2000}?(?:\n[ \t]*\n|[aenort][.!?]?\n)|.{1,2000}"
# A paragraph is a line; a longer one counts as several, cut behind clauses and at last after 48 code points.
PARAGRAPH = r"[^\n]{0,47}?(?:[.,;:!?]+ |\n)|[^\n]{1,48}"
#: Text characters of one run of neighbouring documents: small runs, up to a number of them, then larger ones.
RUN_CHARS, MANY_RUNS, LARGE_RUN_CHARS = 2_000_000, 20_000, 256_000_000


def tree(text: Column) -> Column:
    """struct(root, sections: array of struct(hash, leaves)); a leaf is 32 bits of its paragraph's hash."""
    def section(s: Column) -> Column:
        full = F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))
        return F.struct(F.xxhash64(full).alias("hash"), F.transform(full, lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("array<int>").alias("leaves"))

    sections = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SECTION), F.lit(0)), section)
    return F.struct(root(sections).alias("root"), sections.alias("sections"))


def root(sections: Column) -> Column:
    return F.sha2(F.array_join(F.transform(sections, lambda s: F.hex(s["hash"])), "-"), 256)


def fingerprint(node: Column) -> Column:
    """A tree as text: root, then for every section its hash and its leaves."""
    eight = lambda x: F.lpad(F.hex(x.cast("long") + F.lit(1 << 31)), 8, "0")
    part = lambda s: F.concat(F.hex(s["hash"]), F.lit("="), F.array_join(F.transform(s["leaves"], eight), ""))
    return F.lower(F.concat(node["root"], F.lit(":"), F.array_join(F.transform(node["sections"], part), ";")))


def leaves(node: Column) -> Column:
    return F.flatten(F.transform(node["sections"], lambda s: s["leaves"]))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal roots, else twice the leaves in both over the leaves of each, repeated ones once."""
    x, y = F.array_distinct(leaves(a)), F.array_distinct(leaves(b))
    total = F.size(x) + F.size(y)
    return F.when(a["root"] == b["root"], 1.0).when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def differing(a: Column, b: Column) -> Column:
    """Where ``a`` has what ``b`` has not: (section, paragraph), counted from 0, of each leaf in a section
    whose hash ``b`` lacks that is itself lacking there. Empty for equal roots."""
    theirs, single = F.transform(b["sections"], lambda s: s["hash"]), leaves(b)

    def within(s: Column, i: Column) -> Column:
        at = F.transform(s["leaves"], lambda leaf, j: F.struct(i.alias("section"), j.alias("paragraph"), leaf.alias("leaf")))
        own = F.filter(at, lambda x: ~F.array_contains(single, x["leaf"]))
        return F.when(F.array_contains(theirs, s["hash"]), F.array().cast("array<struct<section:int,paragraph:int,leaf:int>>")).otherwise(own)

    found = F.flatten(F.transform(a["sections"], within))
    places = F.transform(found, lambda x: F.struct(x["section"].alias("section"), x["paragraph"].alias("paragraph")))
    return F.when(a["root"] == b["root"], F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(places)


def _run_of(ident: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are less than the id, found in two short scans."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = bounds[step - 1::step]
    count = lambda array: F.size(F.filter(array, lambda b: b < ident))
    literal = lambda xs: F.lit([int(x) for x in xs]).cast("array<bigint>")
    full = count(literal(coarse)) * step
    return F.when(ident.isNull(), 0).otherwise(full + count(F.slice(literal(bounds), full + 1, F.lit(step))))


def with_next(docs: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """``docs(doc_id, ...)`` with ``next``: all columns of the document that follows by descending id.

    The first follows the last; rows without an id come behind all others. Ids
    are cut into runs whose upper bounds are ids themselves, so the one document
    that a run's last needs from the run below is known, and visits it as a
    guest. Rows are shuffled once, by run; no window spans the table.
    """
    columns = docs.columns
    size = (sized if sized is not None else docs).agg(F.sum(F.length("text")).alias("chars"), F.max("doc_id").alias("last")).first()
    chars, last = size["chars"] or 0, size["last"]
    runs = max(1, min(chars // RUN_CHARS, MANY_RUNS), chars // LARGE_RUN_CHARS)
    bounds: list[int] = []
    if last is not None:
        shares = [i / runs for i in range(1, runs)]
        some = docs.agg(F.percentile_approx("doc_id", shares, F.lit(max(10_000, 4 * runs)))).first()[0] if shares else []
        bounds = sorted({*some, last})
    run = _run_of(F.col("doc_id"), bounds)
    # A bound is the first of its run in descending order: it also visits the run above, the last one's the run at the very end.
    is_bound = F.coalesce((F.col("doc_id") == F.element_at(F.lit([int(b) for b in bounds]).cast("array<bigint>"), F.col("__run") + 1)), F.lit(False)) if bounds else F.lit(False)
    seat = lambda r, guest, end: F.struct(r.cast("int").alias("run"), F.lit(guest).alias("guest"), end.alias("end"))
    final = F.col("__run") == len(bounds) - 1
    own = seat(F.col("__run"), False, F.lit(False))
    visit = seat(F.when(final, 0).otherwise(F.col("__run") + 1), True, final)
    seated = docs.withColumn("__run", run).withColumn("__seat", F.explode(F.when(is_bound, F.array(own, visit)).otherwise(F.array(own))))
    order = Window.partitionBy("__seat.run").orderBy("__seat.end", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return (
        seated.withColumn("next", F.lead(F.struct(*columns)).over(order)).where(~F.col("__seat.guest"))
        .select(*columns, F.coalesce("next", F.struct(*columns)).alias("next"))
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are.

    The edited text is the document with its last floor(n_chars / 2) code points
    replaced by as many from the start of the next document by descending id, or
    by all of a shorter one. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, edits (places of
    the edited text's leaves that the document lacks). A null text is empty; an
    empty one has a root of no sections; a lone document follows itself. Of rows
    that share an id the one with the smaller text hash comes first. Other
    columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(base.withColumn("tree", tree(F.col("text"))), base)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next.text", F.lit(1), half))
    done = rows.select("doc_id", n.cast("long").alias("n_chars"), "tree", F.col("next.tree").alias("next_tree"), edited.alias("edited"))
    done = done.withColumn("edited_tree", tree(F.col("edited")))
    return done.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"), likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        likeness(F.col("tree"), F.col("next_tree")).alias("near_next"), differing(F.col("edited_tree"), F.col("tree")).alias("edits"),
    )
