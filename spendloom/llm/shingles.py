"""Sets of word shingles as sorted 64-bit hashes, in numpy.

A word's hash is a polynomial over a table of random bytes, read off running
sums, so no word becomes a Python object. Everything wraps modulo 2^64.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
#: Bytes hashed at a time; a longer text goes through in pieces that end between words.
BLOCK = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` random-looking values, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix((np.arange(n, dtype=U) + U(seed + 1)) * U(0x9E3779B97F4A7C15))


with np.errstate(over="ignore"):
    BYTES = stream(256, 1)
    BASE = 0xD6E8FEB86659FD93
    INVERSE = pow(BASE, -1, 1 << 64)
    PLACES = stream(WIDTH, 2) | U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        steps = np.full(BLOCK + 1, base, U)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base]


def _blocks(data: bytes):
    """Pieces of at most about ``BLOCK`` bytes that end between words; a longer word is passed over in one piece."""
    at = 0
    while len(data) - at > BLOCK:
        view = SPACE[np.frombuffer(data, np.uint8, BLOCK, at)]
        last = np.flatnonzero(view)
        if not len(last):
            break
        yield data[at:at + int(last[-1]) + 1]
        at += int(last[-1]) + 1
    rest = data[at:]
    if len(rest) <= BLOCK:
        yield rest
    else:  # a word of more than a block: hashed by itself, and the text behind it again in blocks
        view = SPACE[np.frombuffer(rest, np.uint8)]
        end = int(np.argmax(view)) if view.any() else len(rest)
        yield rest[:end]
        if end < len(rest):
            yield from _blocks(rest[end:])


def word_hashes(text: str | None) -> np.ndarray:
    """Hash of every word ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case, in order."""
    out = []
    for part in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        b = np.frombuffer(part, np.uint8)
        if not len(b):
            continue
        space = SPACE[b]
        edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if not len(start):
            continue
        if len(b) > BLOCK:
            out.append(_long_word(b[start[0]:end[0]]))
            continue
        sums = np.zeros(len(b) + 1, U)
        np.cumsum(BYTES[b] * _powers(BASE)[: len(b)], out=sums[1:])
        value = (sums[end] - sums[start]) * _powers(INVERSE)[start]
        out.append(mix(value ^ mix((end - start).astype(U))))
    return np.concatenate(out) if out else np.zeros(0, U)


def _long_word(b: np.ndarray) -> np.ndarray:
    """The hash of one word longer than a block, in the same polynomial."""
    total, factor = 0, 1
    for at in range(0, len(b), BLOCK):
        piece = b[at:at + BLOCK]
        total += factor * int(np.sum(BYTES[piece] * _powers(BASE)[: len(piece)], dtype=U))
        factor = factor * pow(BASE, len(piece), 1 << 64) % (1 << 64)
    return mix(np.array([total % (1 << 64)], U) ^ mix(np.array([len(b)], U)))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct ``width``-word shingles of a text as sorted hashes.

    A text of fewer words has its whole sequence as the one shingle; one without
    words has none.
    """
    w = word_hashes(text)
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        places = PLACES if width == WIDTH else stream(width, 2) | U(1)
        n = max(1, len(w) - width + 1)
        total = np.zeros(n, U)
        for i in range(min(width, len(w))):
            total += w[i:i + n] * places[i]
        return np.unique(mix(total + U(min(len(w), width))))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
