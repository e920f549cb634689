"""How far the sources of a language differ in their words: three-dimensional cube partitioning.

A task owns one cell (block of groups, block of groups, block of terms): it
gets the two slices of the term table, adds up what each pair of groups differs
by over those terms, and the parts are summed along the term axis. A slice
travels once for each block of groups it meets, whatever the number of pairs.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ranked, store

#: A term is kept in a language that has it in so many documents.
LEAST_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
#: Groups and terms along the edges of a cell; a dense slice is GROUPS x TERMS longs.
GROUPS, TERMS = 64, 4096
#: Term counts a task holds before it hands them on, and bytes of text it splits at a time.
HELD, PIECE = 200_000, 1 << 20
LETTERS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
# A group's row without a term keeps groups that have none.
COUNTED = "lang string, source string, term string, n long, docs long"


def words(data: bytes):
    """The terms of a UTF-8 text, each with its count, piece by piece; a piece ends between terms."""
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and LETTERS[data[end]] != 0x20:
            end += 1
        found.update(data[at:end].translate(LETTERS).split())
        at = end
    return found


def _counted(batches):
    held: dict[tuple[bytes, bytes], dict[bytes, list[int]]] = {}
    size = 0

    def rows():
        flat = [(lang, source, term, *v) for (lang, source), terms in held.items() for term, v in terms.items()]
        texts = [pa.array(c, pa.binary()).cast(pa.string()) for c in list(zip(*flat, strict=True))[:3]]
        numbers = [pa.array(c, pa.int64()) for c in list(zip(*flat, strict=True))[3:]]
        return pa.RecordBatch.from_arrays([*texts, *numbers], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.cast(pa.binary()) for c in batch.columns), strict=True):
            terms = held.setdefault((lang.as_py(), source.as_py()), {})
            before = len(terms)
            terms.setdefault(None, [0, 0])
            for term, n in words(text.as_py()).items():
                entry = terms.setdefault(term, [0, 0])
                entry[0] += n
                entry[1] += 1
            size += len(terms) - before
            if size >= HELD:
                yield rows()
                held, size = {}, 0
    if held:
        yield rows()


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a group, and a row with a null term for each group.

    Counts meet in the tasks that read the texts, then by term, so that a hot source is spread over its terms.
    """
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return text.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact for counts of up to 20 digits; 0 without terms."""
    wide = (count + PRIOR).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    part = F.call_function("div", wide, F.nullif((total + PRIOR * terms).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")))
    return F.coalesce(part.cast("long") + 1, F.lit(0).cast("long"))


class Audit:
    """Stored tables of one audit: ``groups`` (lang, source, idx, total, terms), ``entries`` (lang, source, term, id, n, p,
    lang_p) for terms that a group has, and what the two reports are made of."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, group_block: int = GROUPS, term_block: int = TERMS, **cols: str):
        self.group_block, self.term_block = group_block, term_block
        counts = store(term_counts(docs, **cols))
        per_lang = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = store(ranked(store(per_lang.where(F.col("docs") >= least_docs).drop("docs")), ["lang"], ["term"]))
        self.kept = kept.select("lang", "term", "lang_n", F.col("pos").alias("id"))
        rows = store(counts.where("term IS NOT NULL").join(self.kept, ["lang", "term"]).select("lang", "source", "term", "id", "lang_n", "n"))
        langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
        totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = store(counts.where("term IS NULL").select("lang", "source"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        self.groups = store(
            ranked(groups, ["lang"], ["source"]).drop("size").withColumnRenamed("pos", "idx").join(totals, ["lang", "source"], "left")
            .join(langs, "lang", "left").select("lang", "source", "idx", *map(zero, ("total", "terms", "lang_total"))))
        shares = rows.join(self.groups, ["lang", "source"]).select(
            "lang", "source", "idx", "term", "id", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("lang_p"))
        self.entries = store(shares)

    def slices(self) -> DataFrame:
        """(lang, block, part, kept, groups, bare, at, ids, shares): one row for every block of groups and of terms of a language.

        ``groups`` are the block's sources, ``bare`` the share of a term they lack, and the entries are parallel
        arrays: place of the group in the block, term, share. ``kept`` is the number of terms in the part.
        """
        block = lambda c, n: ((c - c % n) / n).cast("int")
        heads = self.groups.groupBy("lang", "terms", block(F.col("idx"), self.group_block).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "source", share(F.lit(0), F.col("total"), F.col("terms")).alias("bare")))).alias("g"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("terms") / self.term_block)).cast("int")
        heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumn(
            "kept", F.least(F.lit(self.term_block), F.col("terms") - F.col("part") * self.term_block).cast("int"))
        filled = self.entries.groupBy("lang", block(F.col("idx"), self.group_block).alias("block"), block(F.col("id"), self.term_block).alias("part")).agg(
            F.collect_list(F.struct((F.col("idx") % self.group_block).cast("int").alias("at"), (F.col("id") % self.term_block).cast("int").alias("id"), "p")).alias("e"))
        none = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>"))
        return heads.join(filled, ["lang", "block", "part"], "left").select(
            "lang", "block", "part", "kept", F.col("g.source").alias("sources"), F.col("g.bare").alias("bare"),
            none(F.col("e.at"), "int").alias("at"), none(F.col("e.id"), "int").alias("ids"), none(F.col("e.p"), "long").alias("shares"))

    def divergences(self) -> DataFrame:
        """(lang, a, b, value) for every pair of sources a < b of a language: their shares' differences summed over all kept terms."""
        blocks = self.groups.groupBy("lang").agg((F.floor(F.max("idx") / self.group_block) + 1).cast("int").alias("blocks"))
        slices = store(self.slices()).join(blocks, "lang")
        meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        cells = slices.select("*", meets).withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
        partial = cells.groupBy("lang", "first", "second", "part").applyInArrow(_cell, "lang string, a string, b string, value long")
        return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): every other source of the language, the most different first."""
        each = store(self.divergences())
        both = each.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(each.select("lang", "b", "a", "value"))
        return _ranked(both)

    def terms(self, most: int = 50) -> DataFrame:
        """(lang, source, item, value, rank): the ``most`` terms a group has above its language's share."""
        above = self.entries.where("p > lang_p").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("lang_p")).alias("value"))
        return _ranked(above).where(F.col("rank") <= most)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def _dense(table: pa.Table, row: int) -> np.ndarray:
    """The slice of one row as groups x terms, missing terms at the group's bare share."""
    array = lambda name: table[name][row].values.to_numpy(zero_copy_only=False)
    dense = np.repeat(array("bare")[:, None], table["kept"][row].as_py(), 1)
    dense[array("at"), array("ids")] = array("shares")
    return dense


def _cell(table: pa.Table) -> pa.Table:
    """The partial divergences of one cell, from its two slices, or the one of a block with itself."""
    order = np.argsort(table["block"].to_numpy())
    first, second = int(order[0]), int(order[-1])
    x = _dense(table, first)
    y = x if first == second else _dense(table, second)
    names = table["sources"][second].as_py()
    out = []
    for i, a in enumerate(table["sources"][first].as_py()):
        start = i + 1 if first == second else 0
        values = np.abs(y[start:] - x[i]).sum(1)
        out += [(a, b, v) for b, v in zip(names[start:], values.tolist(), strict=True)]
    a, b, value = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(out), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(value, pa.int64())})


def audited(docs: DataFrame) -> DataFrame:
    """Both reports as one table: lang, source, part (``pair`` or ``term``), item, value, rank.

    A null text, language or source counts as the empty one; repeated rows
    count each; a group without terms takes part with every share at its least;
    a language without kept terms gives pairs of value 0 and no terms. Ties
    rank by the item's bytes. An empty table gives an empty result; other
    columns are ignored.
    """
    audit = Audit(docs)
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
             for part, rows in (("pair", audit.pairs()), ("term", audit.terms()))]
    return parts[0].union(parts[1])
