"""Packing into fixed windows by order-preserving dynamic programming with a monotone queue."""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pdpspark.llm.common import bound_batches

WINDOW = 4096
END_ID = 2
END = np.array([END_ID], dtype="<u4")
#: What a cut costs beside padding, in tokens: after a document nothing, after a sentence, elsewhere.
SENTENCE_CUT, WORD_CUT = 4, 48
#: Tokens over which one dynamic programme runs; the last windows of each wait for what follows.
SEGMENT = 64 * WINDOW
#: Bytes of text that are encoded together (one document at least): equal words in them are encoded once.
TOGETHER_BYTES = 8 << 20
#: Chunks of neighbouring texts whose ids are laid out together (one text at least), and texts that the tokenizer holds at once.
AT_ONCE, HELD = 50_000, 5000
#: Pieces in one output batch.
BATCH = 20_000

#: Words that are encoded as one text; what the last token of a word ends in.
TOGETHER, WORD_END = 1000, "</w>"
#: A Latin word, and one mark behind it at most: the tokenizer parts the mark from the word and lower-cases both.
PLAIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+[.,;:!?]?$"
MARKS = ".,;:!?"
SENTENCE_END = r"[.!?]$"


@cache
def _tokenizer(path: str) -> tuple:
    """The tokenizer and which of its ids end a word: all that a worker process keeps from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has dealt the cores out
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    last = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    last[[i for t, i in tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
    return tokenizer, last


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... of sizes[0] items, then those of the next."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _flat(arrays: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each array holds."""
    return np.fromiter(chain.from_iterable(arrays), dtype="<u4"), np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, sizes = zip((np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)), *parts, strict=True)
    return np.concatenate(ids), np.concatenate(sizes)


def _text_ids(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids of texts and how many each has. An encoding takes many times its ids, so that few are held at once."""
    tokenizer = _tokenizer(path)[0]
    batches = (texts[at : at + HELD] for at in range(0, len(texts), HELD))
    return _joined([_flat([e.ids for e in tokenizer.encode_batch_fast(b, add_special_tokens=False)]) for b in batches])


def _word_ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids of words of letters alone and how many each has; blanks part words, so many are encoded as one text."""
    tokenizer, last = _tokenizer(path)
    parts = []
    for at in range(0, len(words), TOGETHER):
        group = words[at : at + TOGETHER]
        some = np.array(tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
        many = np.diff(np.flatnonzero(last[some]), prepend=-1)
        # some word isn't one to the tokenizer if the numbers differ
        parts.append((some, many) if len(many) == len(group) else _text_ids(group, path))
    return _joined(parts)


def _chunk_ids(chunks: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids of different chunks: one store of ids, and each chunk's place and number of ids in it."""
    plain = pc.match_substring_regex(chunks, PLAIN)
    latin, odd = chunks.filter(plain), chunks.filter(pc.invert(plain)).to_pylist()
    stems = pc.utf8_lower(pc.utf8_rtrim(latin, MARKS)).dictionary_encode()
    marked = pc.match_substring_regex(latin, f"[{MARKS}]$").to_numpy(zero_copy_only=False)
    marks = pc.utf8_slice_codeunits(latin.filter(pa.array(marked)), -1).dictionary_encode()
    store, sizes = _joined([_word_ids(stems.dictionary.to_pylist(), path), _text_ids(marks.dictionary.to_pylist(), path), _text_ids(odd, path)])
    starts = np.cumsum(sizes) - sizes
    n_stems, n_marks = len(stems.dictionary), len(marks.dictionary)

    # a chunk is a stem and perhaps a mark, or an odd one
    first, second = np.zeros(len(chunks), dtype=np.int64), np.full(len(chunks), -1)
    plain = plain.to_numpy(zero_copy_only=False)
    first[plain] = stems.indices.to_numpy()
    first[~plain] = n_stems + n_marks + np.arange(len(odd))
    second[np.flatnonzero(plain)[marked]] = n_stems + marks.indices.to_numpy()
    parts = np.column_stack([first, second]).ravel()
    parts = np.where(parts < 0, len(sizes), parts)
    sizes, starts = np.append(sizes, 0), np.append(starts, 0)
    ids = store[_ragged(starts[parts], sizes[parts])]
    sizes = sizes[parts].reshape(-1, 2).sum(axis=1)
    return ids, np.cumsum(sizes) - sizes, sizes


def encode(texts: pa.Array, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids of each whole text with END_ID behind, and its sentence ends: numbers of ids before a cut.

    The tokenizer never joins what ASCII blanks part, so each different chunk between blanks is encoded once. Nothing outlives the call.
    """
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy()
    chunks = split.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds, index = bounds - bounds[0], chunks.indices.to_numpy()
    store, starts, sizes = _chunk_ids(chunks.dictionary, path)
    closes = pc.match_substring_regex(chunks.dictionary, SENTENCE_END).to_numpy(zero_copy_only=False)
    del split, chunks
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, side="right")) - 1)
        some, inner = index[bounds[at] : bounds[upto]], bounds[at : upto + 1] - bounds[at]
        ids = store[_ragged(starts[some], sizes[some])]
        ends = np.append(0, np.cumsum(sizes[some]))
        closing = np.flatnonzero(closes[some])
        stops, edges, first = ends[closing + 1], ends[inner], np.searchsorted(closing, inner)
        for a, b, c, d in zip(edges[:-1], edges[1:], first[:-1], first[1:], strict=True):
            yield np.append(ids[a:b], END), stops[c:d] - a
        at = upto


def grouped(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges (from, size) of neighbouring texts of TOGETHER_BYTES together, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, done + TOGETHER_BYTES, side="right")))
        yield at, upto - at
        at = upto


def cuts(ends: list[int], penalties: list[int], window: int = WINDOW) -> list[int]:
    """The cheapest increasing cuts out of ends (the last one included), so that no two neighbours are more than window apart.

    The cost is the padding of each window (none where its length is a power of two) and the penalties of the cuts. For a cut at e the
    best cut before it minimises cost + position over those within reach: a sliding minimum, kept in a monotone queue. Some cut must lie
    within reach of every other; forced() sees to that.
    """
    best, before, at = [0.0], [-1], {0: 0}
    places = [0]
    queue = deque([0])
    powers = [1 << p for p in range(window.bit_length() - 1)]
    for end, penalty in zip(ends, penalties, strict=True):
        while places[queue[0]] < end - window:
            queue.popleft()
        i = queue[0]
        cost = best[i] + window - end + places[i]
        for power in powers:
            j = at.get(end - power)
            if j is not None and best[j] < cost:
                cost, i = best[j], j
        k = len(places)
        places.append(end)
        best.append(cost + penalty)
        before.append(i)
        at[end] = k
        key = best[k] + end
        while queue and best[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(k)
    found, k = [], len(places) - 1
    while k > 0:
        found.append(places[k])
        k = before[k]
    return found[::-1]


def forced(stops: list[tuple[int, int]], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """Cut places and penalties from (place, penalty) in order, with more where two lie over half a window apart."""
    places, penalties, last = [], [], 0
    for place, penalty in stops:
        if place == last:
            if places:
                penalties[-1] = min(penalties[-1], penalty)
            continue
        while place - last > window // 2:
            last += window // 2
            places.append(last)
            penalties.append(WORD_CUT)
        if place > last:
            places.append(place)
            penalties.append(penalty)
        else:
            penalties[-1] = min(penalties[-1], penalty)
        last = place
    return places, penalties


class Packer:
    """Takes documents in order, gives pieces in order; holds a segment of ids at most, and the document at hand."""

    def __init__(self, first_sequence: int, window: int = WINDOW, segment: int = SEGMENT) -> None:
        self.sequence, self.window, self.segment = first_sequence, window, segment
        self.docs: deque = deque()  # (id, ids, sentence ends, ids that were given out before)
        self.held = 0

    def add(self, doc_id: object, ids: np.ndarray, stops: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, ids, stops, 0))
        self.held += len(ids)
        if self.held >= self.segment:
            yield from self._give(self._cuts()[:-2])

    def finish(self) -> Iterator[tuple]:
        if not self.held:
            return
        found = self._cuts()
        start = found[-2] if len(found) > 1 else 0
        rest = found[-1] - start
        if rest & (rest - 1) and rest.bit_count() * WORD_CUT < self.window - rest:  # powers of two instead of padding
            found.pop()
            for p in range(rest.bit_length() - 1, -1, -1):
                if rest >> p & 1:
                    start += 1 << p
                    found.append(start)
        yield from self._give(found)

    def _cuts(self) -> list[int]:
        stops, base = [], 0
        for _, ids, ends, given in self.docs:
            stops += [(base + int(e) - given, SENTENCE_CUT) for e in ends[np.searchsorted(ends, given, side="right"):] if e < len(ids)]
            base += len(ids) - given
            stops.append((base, 0))
        return cuts(*forced(stops, self.window), self.window)

    def _give(self, found: list[int]) -> Iterator[tuple]:
        done = 0
        for end in found:
            offset = 0
            while done < end:
                doc_id, ids, stops, given = self.docs[0]
                n = min(end - done, len(ids) - given)
                piece = ids[given : given + n]
                yield doc_id, given, n, zlib.crc32(piece.tobytes()), len(ids), self.sequence, offset
                done, offset = done + n, offset + n
                if given + n == len(ids):
                    self.docs.popleft()
                else:
                    self.docs[0] = (doc_id, ids, stops, given + n)
            self.sequence += 1
        self.held -= done


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document in a sequence.

    Each input partition is packed in its own order, without a shuffle, as one stream: a sequence never mixes partitions, and only the
    last one of a partition can be far from full (it is cut into powers of two, which need no padding, where that costs less). A
    sequence's number is the partition's number times 2**32, counted on from there. A lost task makes the same pieces again, since
    they depend on its partition alone. A null or blank text has one id, end_id. Repeated rows and null ids are packed like others;
    other columns don't matter. Without rows there are no pieces. tokenizer: path of a tokenizers file on every executor.
    """
    if end_id != END_ID:
        raise ValueError(f"end_id is {END_ID}")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, rows, form = Packer(TaskContext.get().partitionId() << 32, window), [], None

        def frame() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, form, strict=True)], schema=form)
            rows.clear()
            return out

        for batch in batches:
            form = form or pa.schema([batch.schema.field("doc_id"), *[(c, pa.int64()) for c in COLUMNS[1:]]])
            ids, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "")
            for at, size in grouped(texts):
                for doc_id, encoded in zip(ids[at : at + size], encode(texts.slice(at, size), tokenizer), strict=True):
                    rows += packer.add(doc_id, *encoded)
                    if len(rows) >= BATCH:
                        yield frame()
        rows += packer.finish()
        if rows:
            yield frame()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(stream, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
