"""Best-fit packing of tokenised documents by the sum of squares.

A document goes to the open bin that leaves the sum, over all residual gaps, of
the squared number of open bins with that gap smallest. A shard of bounded size
is one task; bins a shard could not fill give their documents to the next round,
so what shards waste comes together again.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import remembered, store, working

LENGTH = 1024
END = 2
#: Documents of one shard: the unit of work of a task.
SHARD = 100_000
#: Bins filled less than this are packed again, at last in the next round.
FULL_ENOUGH = 0.98
#: Passes over the items of a shard at most.
PASSES = 12
#: Words that the tokenizers library merges in one call.
TOGETHER = 32

_CODERS: dict[str, bpe.Encoder] = remembered("packing", {})


def coder(path: str) -> bpe.Encoder:
    """Encoder whose words the tokenizers library merges; only the repetition of words is used here."""
    if path not in _CODERS:
        from tokenizers import Tokenizer

        vocabulary = bpe.Vocabulary(path, merges=False)
        letters = {b: c for c, b in bpe.byte_letters().items()}
        table = "".join(letters[b] for b in range(256))
        tokenizer = Tokenizer.from_file(path)
        model = tokenizer.model

        def merge(word: bytes) -> list[int]:
            return [t.id for t in model.tokenize(word.decode("latin-1").translate(table))]

        _CODERS[path] = bpe.Encoder(vocabulary, merge, _together(merge, tokenizer.get_vocab(with_added_tokens=False)))
    return _CODERS[path]


def _together(merge: Callable[[bytes], list[int]], vocab: dict[str, int]) -> Callable[[list[str]], list[bytes]]:
    """Ids of many words, each a space and letters, by one call for up to ``TOGETHER`` of them in a row.

    No token reaches over the space between two words unless it holds that
    space behind the byte before it; a word that ends so is the last of its row.
    """
    letters = bpe.byte_letters()
    space = next(c for c, b in letters.items() if b == 0x20)
    leads = np.zeros(max(vocab.values()) + 1, bool)
    leads[[i for token, i in vocab.items() if token[0] == space]] = True
    before = {letters[token[i - 1]] for token in vocab for i in range(1, len(token)) if token[i] == space}

    def merge_all(words: list[str]) -> list[bytes]:
        ids, row = array("I"), []
        for word in words:
            row.append(word)
            if len(row) == TOGETHER or word[-1].encode()[-1] in before:
                ids.extend(merge("".join(row).encode()))
                row.clear()
        if row:
            ids.extend(merge("".join(row).encode()))
        data = ids.tobytes()
        starts = [*(4 * np.flatnonzero(leads[np.frombuffer(data, "<u4")])).tolist(), len(data)]
        return [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]

    return merge_all


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's token pieces.

    Only a document longer than ``length`` is cut, with the short piece in front.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("packing")
        own = coder(path)
        for whole in batches:
            every = own.encode_all(whole.column("text"))
            for at in range(0, whole.num_rows, 1000):
                rows = []
                for ident in whole.column("doc_id").slice(at, 1000).to_pylist():
                    data = b"".join([next(every), last])
                    n = len(data) // 4
                    start, stop, piece = 0, n % length or length, 0
                    while start < n:
                        rows.append((ident, piece, start, stop - start, zlib.crc32(memoryview(data)[4 * start:4 * stop])))
                        start, stop, piece = stop, stop + length, piece + 1
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT")


def sum_of_squares(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, in the order given, and the fill of each bin.

    Among placements of equal sums the smallest gap is taken; a new bin only if
    it is strictly better than every open one.
    """
    count = np.zeros(length + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        there = count[s:length]
        change = 2 * (count[:length - s] - there)
        if s < length:
            change[0] -= 1  # a bin that closes leaves no gap behind
            change[there == 0] = never
            gap = int(change.argmin())
            best = int(change[gap]) + 1 if change[gap] != never else never
            fresh = 2 * int(count[length - s])
        if s < length and best <= fresh:
            gap += s
            b = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, b = length, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += s
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(b)
    return bins, offsets, np.array(fill, np.int64)


def repeated(sizes: np.ndarray, length: int, full_enough: float, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum-of-squares packing over and over: bin, offset, and whether the bin is full enough, of each item.

    Bins that a pass filled stay as they are; the items of all others are packed
    anew, until a pass fills few of them.
    """
    bins, offsets, stays = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.zeros(len(sizes), bool)
    left, first = np.arange(len(sizes)), 0
    for _ in range(passes):
        b, at, fill = sum_of_squares(sizes[left], length)
        bins[left], offsets[left] = first + b, at
        full = fill >= full_enough * length
        stays[left] = full[b]
        first += len(fill)
        left = left[~full[b]]
        if not len(left) or full.sum() < 0.01 * len(full):
            break
    return bins, offsets, stays


def _packer(length: int, full_enough: float, turn: int, last: bool):
    """The task that packs one shard; in the last round every bin stays."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__row"], ascending=[False, True], ignore_index=True)
        bins, offsets, stays = repeated(pdf["length"].to_numpy(), length, full_enough)
        sequence = -1 - ((turn << 58) | (int(key[0]) << 28) | bins)
        return pd.DataFrame({"__row": pdf["__row"], "length": pdf["length"], "sequence_id": sequence, "offset": offsets, "stays": stays | last})

    return pack


def packed(rows: DataFrame, length: int = LENGTH, shard_rows: int = SHARD, full_enough: float = FULL_ENOUGH) -> DataFrame:
    """``rows`` with sequence_id and offset.

    ``rows`` needs a length of 1 to ``length`` per row; other columns pass
    through. Rows of full length are sequences of their own. Shards are dealt by
    a hash of the row's number, so neither a source nor a length gathers in one;
    within a shard large pieces go first.
    """
    numbered = store(rows.withColumn("__row", F.monotonically_increasing_id()))
    columns = rows.columns
    whole = numbered.where(F.col("length") == length).select(*columns, F.col("__row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = numbered.where(F.col("length") < length).select("__row", "length")
    places, left, turn = [], todo.count(), 0
    final = False
    while left:
        shards = -(-left // shard_rows)
        final = final or shards == 1 or turn == 15
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("__row", F.lit(turn)), F.lit(shards)))
        result = store(dealt.groupBy("shard").applyInPandas(_packer(length, full_enough, turn, final), "__row BIGINT, length BIGINT, sequence_id BIGINT, offset BIGINT, stays BOOLEAN"))
        places.append(result.where("stays").select("__row", "sequence_id", "offset"))
        todo = result.where("NOT stays").select("__row", "length")
        before, left = left, todo.count()
        final = 2 * left > before
        turn += 1
    if not places:
        return whole
    every = places[0]
    for more in places[1:]:
        every = every.union(more)
    short = numbered.where(F.col("length") < length).join(every, "__row").select(*columns, "sequence_id", "offset")
    return whole.union(short)


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text",
                   shard_rows: int = SHARD) -> DataFrame:
    """All documents in sequences of at most ``length`` tokens, one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null
    and empty texts are the end token alone. Every row is packed, repeated ones
    too; an empty table gives an empty result; other columns are ignored.
    """
    return packed(pieces(docs, path, length, end, id_col, text_col), length, shard_rows)
