"""Merkle manifest of a dataset: documents as leaves, a subtree for each source, one root over the subroots.

Only every ``stride``-th level is stored. A proof regenerates the levels
between two stored ones of each aligned subtree it passes, takes the siblings
from them and drops them again, so the table on disk stays a few per cent
larger than its leaves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import ranked, store

ARITY = 3
#: Levels between two stored ones: an aligned subtree has ARITY ** STRIDE nodes at most.
STRIDE = 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def h(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one behind another."""
    return F.sha2(F.concat(*parts), 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of a row: each value as its byte count, a colon and itself, or ``-`` where it is null."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return h(*(part(c) for c in columns))


def whole(n: Column, by: int) -> Column:
    """``n`` divided by ``by``, rounded down, exact for any long."""
    return ((n - n % by) / by).cast("long")


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its path of siblings give."""
    for left, right in path:
        digest = _hash(left + digest + right)
    return digest


def siblings(path: list[tuple[str, str]]) -> str:
    """All digests of a path as one text: level by level, left to right."""
    return "".join(left + right for left, right in path)


def regenerated(digests: list[str], arity: int, stride: int, last: bool) -> list[list[str]]:
    """The levels of an aligned subtree above its stored nodes, these first.

    A subtree that is not its key's only one goes ``stride`` levels up, whatever
    its size; the only one ends with one node.
    """
    levels = [digests]
    while len(levels) <= stride and not (last and len(levels[-1]) == 1):
        below = levels[-1]
        levels.append([_hash("".join(below[i:i + arity])) for i in range(0, len(below), arity)])
    return levels


def steps(levels: list[list[str]], at: int, arity: int) -> list[tuple[str, str]]:
    """Left and right siblings of the member at position ``at``, level by level up to the subtree's root."""
    out = []
    for nodes in levels[:-1]:
        start = at - at % arity
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1:start + arity])))
        at //= arity
    return out


def _given_path(member: dict, path: list[tuple[str, str]]) -> tuple:
    return ([{"left": left, "right": right} for left, right in path],)


@dataclass
class Tree:
    """Stored levels of a forest: ``levels[k]`` holds the nodes ``stride * k`` above the leaves as (key, pos, size, digest)."""

    levels: list[DataFrame]
    arity: int = ARITY
    stride: int = STRIDE

    @property
    def width(self) -> int:
        return self.arity ** self.stride

    def roots(self) -> DataFrame:
        """(key, digest): what each key's tree ends in."""
        return _all(level.where("size = 1").select("key", "digest") for level in self.levels)

    def blocks(self, level: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """The aligned subtrees of unfinished keys over a stored level, with their ``members`` in order; ``arity ** stride`` at most."""
        return level.where("size > 1").groupBy("key", whole(F.col("pos"), self.width).alias("block"), "size").agg(
            F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("members"))

    def above(self, level: DataFrame) -> DataFrame:
        """The next level to store: the roots of the subtrees over ``level``."""
        arity, stride, width = self.arity, self.stride, self.width

        def reduced(batches):
            for batch in batches:
                rows = zip(batch["size"].to_pylist(), batch["members"].to_pylist(), strict=True)
                roots = [regenerated([m["digest"] for m in members], arity, stride, size <= width)[-1][0] for size, members in rows]
                yield pa.RecordBatch.from_arrays([batch["key"], batch["block"], batch["over"], pa.array(roots, pa.string())], ["key", "pos", "size", "digest"])

        over = F.ceil(F.col("size") / width).cast("long").alias("over")
        types = {f.name: f.dataType.simpleString() for f in level.schema}
        return self.blocks(level).select("*", over).mapInArrow(reduced, f"key {types['key']}, pos long, size long, digest string")

    def paths(self, k: int, above: DataFrame, carried: tuple[str, ...] = (), given=_given_path,
              columns: str = f"path {STEP}") -> DataFrame:
        """(key, pos, digest, *carried, *columns) of the nodes of stored level ``k``.

        ``above(key, path)`` has the paths of each key's root; those of the
        stored level over this one come first, then the levels between are
        regenerated for one subtree at a time. ``given(member, path)`` makes
        the last columns of a node's path.
        """
        level, arity, stride, width = self.levels[k], self.arity, self.stride, self.width
        # A key's only node is a subtree of its own, without steps.
        single = F.array(F.struct("pos", "digest", *carried)).alias("members")
        rows = level.where("size = 1").select("key", "size", single).join(above.select("key", "path"), "key")
        if k + 1 < len(self.levels):
            over = self.paths(k + 1, above).select("key", F.col("pos").alias("block"), "path")
            rows = rows.unionByName(self.blocks(level, carried).join(over, ["key", "block"]).drop("block"))
        fields = {f.name: f.dataType.simpleString() for f in level.schema}
        names = ["pos", "digest", *carried]
        schema = ", ".join([f"key {fields['key']}", *(f"`{c}` {fields[c]}" for c in names), columns])
        types = to_arrow_schema(StructType.fromDDL(schema))

        def emitted(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    members, end = row["members"], [(s["left"], s["right"]) for s in row["path"]]
                    levels = regenerated([m["digest"] for m in members], arity, stride, row["size"] <= width)
                    out = [(row["key"], *(m[c] for c in names), *given(m, steps(levels, at, arity) + end)) for at, m in enumerate(members)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=types)

        return rows.select("key", "size", "members", "path").mapInArrow(emitted, schema)


def _all(parts) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.union(part)
    return first


def grow(leaves: DataFrame, arity: int = ARITY, stride: int = STRIDE) -> Tree:
    """Trees over stored ``leaves(key, pos, size, digest, ...)``; the levels between stored ones are made and dropped."""
    tree = Tree([leaves], arity, stride)
    most = leaves.agg(F.max("size")).first()[0] or 1
    while most > 1:
        tree.levels.append(store(tree.above(tree.levels[-1])))
        most = -(-most // tree.width)
    return tree


@dataclass
class Manifest:
    """A tree for each source and one over their roots. ``carried`` names columns kept beside the leaves."""

    sources: Tree
    top: Tree
    root: str | None
    carried: tuple[str, ...] = field(default=())

    def proofs(self, wanted: DataFrame | None = None, given=_given_path, columns: str = f"path {STEP}") -> DataFrame:
        """(doc_id, key, digest, *carried, subroot, path) of every leaf, or of those whose doc_id is in ``wanted(doc_id)``.

        ``path`` leads from the leaf to the root: one step of left and right
        siblings for each level. Subtrees without a wanted leaf are not
        regenerated. ``given`` and ``columns``: see :meth:`Tree.paths`.
        """
        carried = ("doc_id", *self.carried)
        subroots = self.top.paths(0, self.top.levels[-1].where("size = 1").select("key", F.array().cast(STEP).alias("path")), ("source_key",))
        subroots = store(subroots.select(F.col("source_key").alias("key"), F.col("digest").alias("subroot"), "path"))
        tree = self.sources
        if wanted is not None:
            ids = wanted.select("doc_id").distinct()
            block = whole(F.col("pos"), tree.width).alias("__block")
            touched = tree.levels[0].join(ids, "doc_id", "left_semi").select("key", block).distinct()
            near = tree.levels[0].select("*", block).join(touched, ["key", "__block"], "left_semi").drop("__block")
            tree = Tree([near, *tree.levels[1:]], tree.arity, tree.stride)
        out = tree.paths(0, subroots, carried, given, columns)
        if wanted is not None:
            out = out.join(ids, "doc_id", "left_semi")
        made = [f.name for f in StructType.fromDDL(columns)]
        return out.join(subroots.select("key", "subroot"), "key").select("doc_id", "key", "digest", *self.carried, "subroot", *made)


def build(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source",
          extra: dict[str, Column] | None = None, arity: int = ARITY, stride: int = STRIDE) -> Manifest:
    """The manifest of ``docs``: a leaf for each row, by id within its source; subroots by source, a null one first.

    The digests of ``columns`` make the leaf. ``extra`` are further columns kept
    beside it. Rows that share an id and a source stand in the order of their
    digests, null ids first; repeated rows are a leaf each. An empty table has
    no root. Other columns are ignored, whatever they are called.

    Texts are hashed where they are read; what is sorted and shuffled is digests.
    A source of any size is cut by sorted ranges, never held by one task.
    """
    extra = extra or {}
    # A null source sorts before every other and must not equal the empty one.
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit(""))
    rows = store(docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), leaf([F.col(c) for c in columns]).alias("digest"),
                             *(c.alias(n) for n, c in extra.items()), F.monotonically_increasing_id().alias("__row")))
    leaves = ranked(rows, ["key"], ["doc_id", "digest", "__row"]).drop("__row")
    sources = grow(store(leaves), arity, stride)
    subroots = store(sources.roots().select(F.lit(0).alias("key"), F.col("key").alias("source_key"), "digest"))
    top = grow(store(ranked(subroots, ["key"], ["source_key"])), arity, stride)
    final = top.levels[-1].where("size = 1").select("digest").first()
    return Manifest(sources, top, final[0] if final else None, tuple(extra))


def tampered(columns: tuple[str, ...] = COLUMNS) -> Column:
    """The leaf of a document where 2 divides its id's crc32 and the line ends of its text are gone; null for others."""
    changed = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in columns]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf(changed))


def audited(docs: DataFrame) -> DataFrame:
    """Every document's leaf, subroot, root and digest of its proof, and whether the document, tampered with or not,
    still folds to the root.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. A
    row without an id is not tampered with. See :func:`build` for nulls, ties,
    repeated rows and empty tables.
    """
    def checked(member: dict, path: list[tuple[str, str]]) -> tuple:
        return _hash(siblings(path)), fold(member["given"] or member["digest"], path)

    manifest = build(docs, extra={"given": tampered()})
    proofs = manifest.proofs(given=checked, columns="proof_sha256 string, folded_root string")
    root = F.lit(manifest.root).cast("string")
    return proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root",
                         (F.col("folded_root") == root).alias("verified"))
