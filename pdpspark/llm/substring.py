"""Exact substring dedup by fixed-block anchors.

Every document's non-overlapping blocks of (window + 1) / 2 words are the index; every run of as many words, at every place of every
document, probes it. A window that recurs holds a whole block, so it is met by a probe wherever it recurs: a hit. Hits are extended: the
windows of the full length around a hit are compared with all others, and neighbours that recur grow into maximal repeats.

Probes and windows travel as sorted sets of hashes per chunk of documents (see chunks), so a passage that a third of the documents share
is one entry a chunk. A probe is known by 28 bits beside its bucket, which lets about one in a hundred hits through in vain; windows are
known by 64 bits beside their bucket, which holds a million: at any size of the corpus some ten millionths of a window a bucket are
mistaken for another. Texts themselves are read three times and move twice, compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pdpspark.llm.chunks import ASK, answered, ask_rows, bits, bucket_count, chunked, decoded, encoded, packed, per_chunk, unbits, unpacked
from pdpspark.llm.common import written
from pdpspark.llm.wordhash import flat, groups, is_member, rolling, spans, word_bounds, word_hashes

WINDOW = 35
#: Bits of a probe beside its bucket.
PROBE_BITS = 28
#: Words of a text that are joined at once.
JOINED_WORDS = 1 << 16


class Words:
    """The words of a chunk: hashes, the first word of each document, and for each word how many the document still has and had before."""

    def __init__(self, texts: pa.ChunkedArray) -> None:
        self.data, self.offsets = flat(texts)
        self.starts, self.ends = word_bounds(self.data, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.first[-1] = len(self.starts)
        self.sizes = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends)

    def after(self) -> np.ndarray:
        return np.repeat(self.first[1:], self.sizes) - np.arange(len(self.starts))

    def before(self) -> np.ndarray:
        return np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.sizes)


def block_words(window: int) -> int:
    """The longest block of which every window holds one, wherever blocks begin."""
    return (window + 1) // 2


def _probe(hashes: np.ndarray, block: int, buckets: int) -> np.ndarray:
    """Bucket and short key of the run of words that begins at each place, in one number."""
    runs = rolling(hashes, block)
    return (runs % np.uint64(buckets)) << np.uint64(PROBE_BITS) | runs >> np.uint64(64 - PROBE_BITS)


def _windows(hashes: np.ndarray, window: int) -> np.ndarray:
    """Key of the window that begins at each place; its bucket comes from a rolling hash of its own."""
    return rolling(hashes, window, seed=1)


def _pack(piece: pa.Table) -> tuple[int, bytes]:
    return len(Words(piece.column("text")).starts), packed(piece)


def _probes(window: int, buckets: int):
    block = block_words(window)

    def work(chunk: int, body: pa.Scalar, _: list) -> Iterator[pa.RecordBatch]:
        w = Words(unpacked(body).column("text"))
        keys = _probe(w.hashes(), block, buckets)
        n = len(keys)
        usable = (w.after()[:n] >= block) & (np.repeat(w.sizes, w.sizes)[:n] >= window)
        marked = np.sort((keys << np.uint64(1) | (w.before()[:n] % block == 0))[usable])
        keys = marked >> np.uint64(1)
        at, upto = spans(keys)
        again, anchor = upto - at > 1, (marked[upto - 1] & np.uint64(1)).astype(bool)
        yield ask_rows(chunk, (keys[at] >> np.uint64(PROBE_BITS)).astype(np.int64), keys[at] & np.uint64((1 << PROBE_BITS) - 1),
                       lambda a, b: bits(np.concatenate((again[a:b], anchor[a:b]))), encoded)

    return work


def _hits(group: pa.Table) -> Iterator[tuple[int, bytes, bytes]]:
    """For each chunk its keys that a block has and that occur twice or more."""
    chunks, parts = group.column("chunk").to_numpy(), []
    for i, (keys, more) in enumerate(zip(group.column("keys"), group.column("more"), strict=True)):
        key = decoded(keys.as_buffer()).astype(np.uint64)
        flags = unbits(more.as_buffer(), 2 * len(key)).astype(np.uint64)
        parts.append(key << np.uint64(36) | np.uint64(i << 2) | flags[: len(key)] << np.uint64(1) | flags[len(key) :])
    rows = np.sort(np.concatenate(parts))
    at = groups(rows >> np.uint64(36))
    sizes = np.diff(np.append(at, len(rows)))
    flags = np.bitwise_or.reduceat(rows & np.uint64(3), at)
    live = (flags & np.uint64(1) == 1) & ((sizes > 1) | (flags & np.uint64(2) == 2))
    rows = rows[np.repeat(live, sizes)]
    yield from _by_chunk(rows >> np.uint64(2) & np.uint64((1 << 34) - 1), rows >> np.uint64(36), chunks, encoded)


def _by_chunk(owner: np.ndarray, keys: np.ndarray, chunks: np.ndarray, encode) -> Iterator[tuple[int, bytes, bytes]]:
    order = np.argsort(owner, kind="stable")
    owner, keys = owner[order], keys[order]
    for a, b in zip(*(x.tolist() for x in spans(owner)), strict=True):
        yield int(chunks[int(owner[a])]), encode(keys[a:b]), b""


def _extensions(window: int, buckets: int):
    block = block_words(window)

    def work(chunk: int, body: pa.Scalar, answers: list) -> Iterator[pa.RecordBatch]:
        if not answers:
            return
        w = Words(unpacked(body).column("text"))
        hashes = w.hashes()
        known = np.sort(np.concatenate([np.uint64(b << PROBE_BITS) | decoded(k).astype(np.uint64) for b, k, _ in answers]))
        hit = is_member(_probe(hashes, block, buckets), known) & (w.after()[: max(0, len(hashes) - block + 1)] >= block)
        keys = _windows(hashes, window)
        met = np.concatenate(([0], np.cumsum(hit)))
        span = window - block + 1
        place = np.flatnonzero((w.after()[: len(keys)] >= window) & (met[span : span + len(keys)] > met[: len(keys)]))
        bucket, key = (rolling(hashes, window, seed=2)[place] % np.uint64(buckets)).astype(np.int64), keys[place]
        order = np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        at = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])) + 1)) if len(key) else np.zeros(0, dtype=np.int64)
        again = np.diff(np.append(at, len(key))) > 1
        yield ask_rows(chunk, bucket[at], key[at], lambda a, b: bits(again[a:b]), np.ndarray.tobytes)

    return work


def _repeats(group: pa.Table) -> Iterator[tuple[int, bytes, bytes]]:
    """For each chunk its windows that occur twice or more."""
    keys = [np.frombuffer(k.as_buffer(), dtype=np.uint64) for k in group.column("keys")]
    again = np.concatenate([unbits(m.as_buffer(), len(k)) for k, m in zip(keys, group.column("more"), strict=True)])
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    keys = np.concatenate(keys)
    order = np.argsort(keys)
    keys, owner, again = keys[order], owner[order], again[order]
    at = groups(keys)
    sizes = np.diff(np.append(at, len(keys)))
    live = np.repeat((sizes > 1) | np.logical_or.reduceat(again, at), sizes)
    yield from _by_chunk(owner[live], keys[live], group.column("chunk").to_numpy(), np.ndarray.tobytes)


def _joined(text: np.ndarray, w: Words, doc: int, keep: np.ndarray | None) -> str:
    """The words of a document that are kept, by one space."""
    parts = []
    for a in range(w.first[doc], w.first[doc + 1], JOINED_WORDS):
        b = min(a + JOINED_WORDS, w.first[doc + 1])
        found = text[w.starts[a] : w.ends[b - 1]].tobytes().split()
        parts.append(b" ".join(found if keep is None else [x for x, k in zip(found, keep[a:b].tolist(), strict=True) if k]))
    return b" ".join(p for p in parts if p).decode("utf-8")


def _cuts(window: int, kind: pa.DataType):
    def work(chunk: int, body: pa.Scalar, answers: list) -> Iterator[pa.RecordBatch]:
        table = unpacked(body)
        w = Words(table.column("text"))
        n = len(w.starts)
        change = np.zeros(n + 1, dtype=np.int32)
        if answers:
            known = np.sort(np.concatenate([np.frombuffer(k, dtype=np.uint64) for _, k, _ in answers]))
            keys = _windows(w.hashes(), window)
            place = np.flatnonzero(is_member(keys, known) & (w.after()[: len(keys)] >= window))
            change[place] += 1
            change[place + window] -= 1
        covered = np.cumsum(change[:-1]) > 0
        edge = covered.copy()
        edge[1:] &= ~covered[:-1]
        heads = w.first[:-1][w.sizes > 0]
        edge[heads] = covered[heads]  # a repeat ends with its document
        begin = np.flatnonzero(edge)
        total = np.concatenate(([0], np.cumsum(covered)))
        stop = np.minimum(np.append(begin[1:], n), np.repeat(w.first[1:], w.sizes)[begin]) if len(begin) else begin
        length = total[stop] - total[begin]
        mine = np.searchsorted(begin, w.first)
        removed = total[w.first[1:]] - total[w.first[:-1]]
        kept = [_joined(w.data, w, i, ~covered if removed[i] else None) for i in range(len(w.sizes))]
        cut = pa.StructArray.from_arrays([pa.array(begin - np.repeat(w.first[:-1], w.sizes)[begin] if len(begin) else [], pa.int64()), pa.array(length, pa.int64())], ["start", "length"])
        yield pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().cast(kind) if table.num_rows else pa.array([], kind), pa.array(kept, pa.string()), pa.array(w.sizes, pa.int64()), pa.array(removed, pa.int64()),
             pa.ListArray.from_arrays(pa.array(mine, pa.int32()), cut)],
            ["doc_id", "text", "n_words", "n_removed", "repeats"])

    return work


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text, n_words, n_removed, repeats: one row per row of docs (doc_id, text), in no order.

    A word goes if a window of so many consecutive words of its document holds it whose words also begin anywhere else, in the same
    document or another; text has the other words, joined by one space, repeats the maximal runs of words that went (start, length: in words).
    Words end at space, tab, line feed, vertical tab, form feed and carriage return, and are compared byte by byte. Null, empty and blank
    texts have no words and become empty; texts shorter than a window stay whole. Rows are told apart by where they lie, so a null id or
    an id that comes twice does no harm: repeated rows are copies of each other, and all their windows go. Other columns are not read.
    An empty table gives no rows. A long text is a chunk of its own and takes some ten times its size.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select("doc_id", "text")
    chunks = written(chunked(rows, _pack), "passage-chunks")
    buckets = bucket_count(chunks)
    hits = answered(per_chunk(chunks, None, _probes(window, buckets), ASK), _hits)
    repeats = answered(per_chunk(chunks, hits, _extensions(window, buckets), ASK), _repeats)
    kind = rows.schema["doc_id"].dataType
    schema = f"doc_id {kind.simpleString()}, text string, n_words long, n_removed long, repeats array<struct<start: long, length: long>>"
    return per_chunk(chunks, repeats, _cuts(window, to_arrow_type(kind)), schema)
