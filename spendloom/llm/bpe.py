"""Byte-level BPE: encoding with contiguous rank arrays, and decoding.

The vocabulary is a public tokenizer file whose path is a parameter; it is read
once per worker process. Words repeat, so each distinct word is encoded once and
kept in a table of bounded size; a text is then the concatenation of its words'
little-endian 32-bit ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, working

#: Entries of each word table, of at most SHORT characters; a full table starts anew. Both tables of a worker process take
#: about 65 MB when full, kept until another operator's task comes.
TABLE = 1 << 18
#: Words of at most this many bytes are merged in the rank array, longer ones through a heap.
SHORT = 128
#: Bytes of text that are encoded at once.
BLOCK = 1 << 22
NONE = 1 << 63
LOW = (1 << 32) - 1

# Fixed values of the format: how byte-level BPE cuts a text into words.
#: Printable ASCII that is neither letter, digit nor the apostrophe of short forms.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The format's letter for each byte: printable ones stand for themselves, the others come from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, ids and bytes of a byte-level BPE tokenizer file. Without ``merges`` it can neither merge nor decode."""

    def __init__(self, path: str, merges: bool = True) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()} if merges else {}
        self.single = [vocab[letter] for letter in sorted(letters, key=letters.__getitem__)]
        #: left id << 32 | right id -> rank << 32 | id of both together.
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"] if merges else []):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merge[vocab[left] << 32 | vocab[right]] = rank << 32 | vocab[left + right]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.bytes_of[i] = bytes(letters[c] for c in content) if all(c in letters for c in content) else content.encode()
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.words = regex.compile(WORDS)

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one word, by repeatedly joining its adjacent pair of least rank, the leftmost of equals."""
        if len(word) == 1:
            return [self.single[word[0]]]
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        """Parts and the ranks of adjacent pairs lie in two arrays; each step scans the ranks for the least one,
        deletes that boundary and refreshes the ranks on both of its sides."""
        get, single = self.merge.get, self.single
        parts = [single[b] for b in word]
        ranks = [get(left << 32 | right, NONE) for left, right in zip(parts, parts[1:], strict=False)]
        least = min(ranks)
        while least != NONE:
            at = ranks.index(least)
            both = parts[at] = least & LOW
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = get(parts[at - 1] << 32 | both, NONE)
            if at < len(ranks):
                ranks[at] = get(both << 32 | parts[at + 1], NONE)
            elif not at:
                break
            least = min(ranks)
        return parts

    def _long(self, word: bytes) -> list[int]:
        """The same merges for words too long to scan again and again: a heap of pairs over a linked list."""
        merge = self.merge
        parts: list[int] = [self.single[b] for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            if after[i] < n and (hit := merge.get(parts[i] << 32 | parts[after[i]])):
                entry = (hit >> 32, i, parts[i], parts[after[i]], hit & LOW)
                heap.append(entry) if building else heapq.heappush(heap, entry)

        building = True
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        building = False
        while heap:
            _, i, left, right, both = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = both, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [p for p in parts if p >= 0]


class _Irregular(Exception):
    """A text whose white space does not fall between single words."""


class _Table(dict):
    """Ids, as bytes, by text: bounded, and without long texts."""

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(self) >= TABLE:
            self.clear()
        if len(text) <= SHORT:
            self[text] = ids
        return ids


class _Words(_Table):
    """Ids, as bytes, of each word as the format cuts it."""

    def __init__(self, merge: Callable[[bytes], list[int]]) -> None:
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        return self.keep(word, array("I", self.merge(word.encode("utf-8", "surrogatepass"))).tobytes())


class _Spans(_Table):
    """Ids, as bytes, of what stands between two single spaces, with the space or line end before it."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder

    def __missing__(self, span: str) -> bytes:
        if not span or span[-1].isspace():
            raise _Irregular
        return self.keep(span, self.encoder.plain(span if span[0] == "\n" else " " + span))


class Encoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers.

    ``merge`` gives the ids of one word; ``merge_all``, where many cost less together, the ids as bytes of many words
    that are a space and letters each.
    """

    def __init__(self, vocabulary: Vocabulary, merge: Callable[[bytes], list[int]] | None = None,
                 merge_all: Callable[[list[str]], list[bytes]] | None = None) -> None:
        self.vocabulary = vocabulary
        self.merge = merge or vocabulary.merge_word
        self.merge_all = merge_all or (lambda words: [array("I", self.merge(word.encode())).tobytes() for word in words])
        self.words = _Words(self.merge)
        self.spans = _Spans(self)
        # Letters with signs behind them need no expression to be cut, unless an added token could stand in them.
        self.direct = not any(all(c.isalpha() for c in mark.rstrip(SIGNS)) for mark in vocabulary.special)

    def plain(self, text: str) -> bytes:
        """The ids of a text by the format's own cut, added tokens first."""
        v, words = self.vocabulary, self.words
        if not any(mark in text for mark in v.special):
            return b"".join([words[w] for w in v.words.findall(text)])
        return b"".join([
            v.special[part].to_bytes(4, "little") if part in v.special else b"".join([words[w] for w in v.words.findall(part)])
            for part in v.marks.split(text) if part
        ])

    def encode(self, text: str) -> bytes:
        """The same ids. A space or line end behind other text always starts a new word, so texts with single
        ones only are split there by ``str.split`` and looked up; any other text takes the format's cut."""
        if not text:
            return b""
        head, *tail = text.replace("\n", " \n").split(" ")
        if not head or head[-1].isspace():
            return self.plain(text)
        spans = self.spans
        try:
            return self.plain(head) + b"".join([spans[s] for s in tail])
        except _Irregular:
            return self.plain(text)

    def encode_all(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """``encode`` of every text of a column in turn; null counts as empty.

        Of a block of texts each distinct span is looked up once, and the ids of all are gathered by its number.
        """
        stops = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < len(texts):
            stop = int(np.searchsorted(stops, done + BLOCK, "right"))
            if stop > at:
                yield from self._block(pc.fill_null(texts.slice(at, stop - at), ""))
            else:
                stop = at + 1
                yield self.encode(texts[at].as_py())
            at, done = stop, int(stops[stop - 1])

    def _block(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        starts = cut.offsets.to_numpy()
        heads = cut.values.take(cut.offsets[:-1]).to_pylist()
        spans = cut.values.dictionary_encode()
        distinct = spans.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = spans.indices.to_numpy().copy()
        number[starts[:-1]] = np.arange(len(distinct), len(distinct) + len(heads), dtype=number.dtype)
        ids = self._looked_up(distinct, np.bincount(number, minlength=len(distinct)).tolist())
        irregular = {i for i, head in enumerate(heads) if not head or head[-1].isspace()}
        odd = [i for i, data in enumerate(ids) if data is None]
        if odd:
            irregular.update((np.searchsorted(starts, np.flatnonzero(np.isin(number, odd)), "right") - 1).tolist())
        ids += [b"" if i in irregular else self.plain(head) for i, head in enumerate(heads)]
        _, ends, data = pa.array(ids, pa.binary()).take(pa.array(number)).buffers()
        ends, data = np.frombuffer(ends, np.int32)[starts].tolist(), memoryview(data or b"")
        for i, (start, stop) in enumerate(zip(ends, ends[1:], strict=False)):
            yield self.plain(texts[i].as_py()) if i in irregular else data[start:stop]

    def _looked_up(self, spans: list[str], times: list[int]) -> list[bytes | None]:
        """The ids of distinct spans, None if irregular, empty if not used; words that no table has are merged together."""
        table, words = self.spans, self.words
        ids = list(map(table.get, spans))
        lacking, cores, new = [], [], {}
        for i, data in enumerate(ids):
            if data is None and times[i]:
                span = spans[i]
                letters = (span if span.isalpha() else span.rstrip(SIGNS)) if self.direct else ""
                lacking.append(i)
                cores.append(letters)
                if letters.isalpha() and letters not in table:
                    new[letters] = b""
            elif data is None:
                ids[i] = b""
        new = dict(zip(new, self.merge_all([" " + letters for letters in new]), strict=True))
        for i, letters in zip(lacking, cores, strict=True):
            span = spans[i]
            if data := new.get(letters) or (table.get(letters) if letters.isalpha() else None):
                if len(letters) < len(span):
                    table.keep(letters, data)
                    data += words[span[len(letters):]]
                ids[i] = table.keep(span, data)
            else:
                try:
                    ids[i] = table[span]
                except _Irregular:
                    pass
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; broken UTF-8 becomes replacement characters."""
        of = self.vocabulary.bytes_of
        return b"".join([of[i] for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = remembered("bpe", {})


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Every whole text encoded and decoded again: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the ids.

    Null counts as empty: no tokens. Each row stands for itself, so repeated
    rows are repeated; columns besides the two are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()),
                        *([("ids", pa.list_(pa.int32()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working("bpe")
        coder = encoder(path)
        for whole in batches:
            every = coder.encode_all(whole.column("text"))
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, one, two, lists = [], [], [], []
                for data in islice(every, batch.num_rows):
                    n.append(len(data) // 4)
                    one.append(hashlib.sha256(data).hexdigest())
                    two.append(hashlib.sha256(coder.decode(data).encode()).hexdigest())
                    if ids:
                        lists.append(np.frombuffer(data, "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one), pa.array(two),
                     *([pa.array(lists, pa.list_(pa.int32()))] if ids else [])], schema=schema)

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING" + ", ids ARRAY<INT>" * ids)
