"""Words of many texts in one byte buffer, as arrays: where they lie, their 64-bit hashes, and rolling hashes over runs of them."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes that are looked at together; a longer word is hashed by itself.
BLOCK = 1 << 19
#: Words of more bytes have a hash of another kind, whatever block they lie in.
LONG_WORD = 1 << 16
WORD, BLANK, BREAK = 0, 1, 2


def byte_classes(blank: bytes, breaks: bytes = b"") -> np.ndarray:
    """What each byte is: part of a word, a blank between words, or a break that also ends a run of words."""
    classes = np.zeros(256, dtype=np.uint8)
    classes[np.frombuffer(blank, dtype=np.uint8)] = BLANK
    classes[np.frombuffer(breaks, dtype=np.uint8)] = BREAK
    return classes


SPACE_CLASSES = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d")


@cache
def _constants(lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of an odd base and of its inverse; of one size for good."""
    rng = np.random.default_rng(20260201)
    byte = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
    if lower:
        byte[65:91] = byte[97:123]
    base = int(rng.integers(0, 1 << 62)) * 2 + 1
    powers = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(BLOCK, b, dtype=np.uint64)))) for b in (base, pow(base, -1, 1 << 64))]
    return byte, *powers


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of texts in one buffer, and where each text begins in it, with the end; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = SPACE_CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word; a word never goes over the end of a text."""
    starts, ends, before = [], [], False
    for at in range(0, len(data), BLOCK):
        inside = classes[data[at : at + BLOCK]] == WORD
        change = np.flatnonzero(np.concatenate(([inside[0] != before], inside[1:] != inside[:-1]))) + at
        opens = change[int(before) :: 2] if len(change) else change
        closes = change[1 - int(before) :: 2] if len(change) else change
        starts.append(opens)
        ends.append(closes)
        before = bool(inside[-1])
    if before:
        ends.append(np.array([len(data)]))
    starts = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    ends = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    seams = np.unique(offsets[1:-1])
    seams = seams[(seams > 0) & (seams < len(data))]
    seams = seams[(classes[data[seams]] == WORD) & (classes[data[seams - 1]] == WORD)] if len(seams) else seams
    if len(seams):
        starts, ends = np.sort(np.concatenate((starts, seams))), np.sort(np.concatenate((ends, seams)))
    return starts.astype(np.int64), ends.astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word, which depends on its bytes alone; lower reads A-Z as a-z. Works in blocks of bounded size."""
    byte, power, inverse = _constants(lower)
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        upto = int(np.searchsorted(ends, starts[at] + BLOCK, side="right"))
        if upto > at:
            first = starts[at]
            part = data[first : ends[upto - 1]]
            sums = np.empty(len(part) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(byte[part] * power[: len(part)], out=sums[1:])
            a, b = starts[at:upto] - first, ends[at:upto] - first
            out[at:upto] = (sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64)
        at = max(upto, at + 1)
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        word = data[starts[i] : ends[i]]
        digest = hashlib.blake2b(digest_size=8)
        for j in range(0, len(word), BLOCK):
            digest.update(word[j : j + BLOCK].tobytes().lower() if lower else word[j : j + BLOCK])
        out[i] = int.from_bytes(digest.digest(), "little")
    return mix(out)


def rolling(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of every run of size consecutive hashes, by doubling; runs that overlap make up sizes between powers of two."""
    rng = np.random.default_rng(987_001 + seed)
    odd = [np.uint64(v) * np.uint64(2) + np.uint64(1) for v in rng.integers(0, 1 << 62, 2, dtype=np.uint64)]
    if len(hashes) < size:
        return hashes[:0]
    runs, width = mix(hashes ^ odd[1]), 1
    while 2 * width <= size:
        runs, width = mix(runs[:-width] * odd[0] + runs[width:]), 2 * width
    if width < size:
        last = len(hashes) - size + 1
        runs = mix(runs[:last] * odd[1] + runs[size - width : size - width + last])
    return runs


def is_member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is among known (sorted); a bitmap of low bits sifts most values before the search."""
    if not len(known) or not len(values):
        return np.zeros(len(values), dtype=bool)
    bits = min(22, max(8, (len(known) * 8).bit_length()))
    low = np.uint64((1 << bits) - 1)
    seen = np.zeros(1 << bits, dtype=bool)
    seen[(known & low).astype(np.int64)] = True
    found = seen[(values & low).astype(np.int64)]
    at = np.flatnonzero(found)
    place = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
    found[at] = known[place] == values[at]
    return found


def groups(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1)) if len(values) else np.zeros(0, dtype=np.int64)


def spans(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal values in a sorted array."""
    at = groups(values)
    return at, np.append(at[1:], len(values)) if len(at) else at
