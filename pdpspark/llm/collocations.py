"""Collocations: phrases that occur more often than their parts let one expect, from exact counts of all phrases up to a length.

Counting goes by levels. Within a chunk of documents words are numbered by frequency, so pairs of frequent words lie in few tiles of the
plane (number of the first word, number of the second): a tile with many pairs is counted in a dense array by direct address, all others
as sorted coordinates. What is frequent over all chunks is numbered by frequency in the chunk again, and the next level pairs these phrases
with the word that follows; a phrase is counted only if its first and its last words are frequent phrases already, so nothing frequent is
missed. Chunks send their counts to buckets by hash (see chunks), and get a bit a key back: a pair that every document holds is one number
and one bit a chunk.

Words and phrases are known by two 64-bit hashes, one for the bucket and one within its million; the texts of frequent phrases are
told by one chunk each, and the last steps (cuts, scores, containment, ranks) are joins over these texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdpspark.llm.chunks import ASK, answered, ask_rows, bits, bucket_count, chunked, packed, per_chunk, unbits, unpacked
from pdpspark.llm.common import scratch
from pdpspark.llm.wordhash import BLOCK, BREAK, byte_classes, flat, groups, mix, word_bounds, word_hashes

#: Phrases of fewer occurrences are no candidates; longest phrase in words; rows a language.
MIN_COUNT, LONGEST, MOST = 100, 5, 2000
#: A phrase goes where a longer candidate around it has den * f >= num * its own count.
NUM, DEN = 100, 100
CLASSES = byte_classes(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")
CHUNK_BYTES = 6 << 20
#: Numbers on each side of a tile; pairs from which on it is counted by direct address.
TILE_BITS, DENSE = 10, 1 << 16


# -- a chunk's words -------------------------------------------------------------------------------------------------------------

def _listed(**columns) -> pa.Table:
    """One row of list columns."""
    lists = {}
    for name, values in columns.items():
        values = values if isinstance(values, pa.Array) else pa.array(values)
        lists[name] = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values)
    return pa.table(lists)


def _array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name)[0].values.to_numpy(zero_copy_only=False)


def _planes(values: np.ndarray) -> np.ndarray:
    """Numbers as bytes: how many each takes, all lowest bytes, all second ones, ...; frequent words share their high bytes, so these compress."""
    wide = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return np.concatenate((np.array([wide], dtype=np.uint8), values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T.ravel()))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    body = _array(table, name)
    planes = body[1:].reshape(int(body[0]), -1)
    out = np.zeros(planes.shape[1], dtype=np.int64)
    for i, plane in enumerate(planes):
        out |= plane.astype(np.int64) << 8 * i
    return out


def _keys(words: pa.Array, lang: np.ndarray, langs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each word of its language."""
    salt = np.array([int.from_bytes(hashlib.blake2b(v.as_py().encode("utf-8"), digest_size=8).digest(), "little") for v in langs], dtype=np.uint64)
    data, offsets = flat(words)
    own = mix(word_hashes(data, offsets[:-1], offsets[1:]) ^ salt[lang])
    return mix(own ^ np.uint64(0xA5A5)), mix(own ^ np.uint64(0xC3C3C3))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each different value is first, in ascending order; the number of each value's; how often each occurs. np.unique holds twice as much."""
    order = np.argsort(values, kind="stable")
    at = groups(values[order])
    counts = np.diff(np.append(at, len(values)))
    number = np.empty(len(values), dtype=np.int32 if len(at) < 1 << 31 else np.int64)
    number[order] = np.repeat(np.arange(len(at), dtype=number.dtype), counts)
    return order[at], number, counts


def _heads(data: np.ndarray, starts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each word begins a piece; first: the first word of each text. Works in blocks, as an index takes eight bytes for each of the text."""
    heads = np.zeros(len(starts) + 1, dtype=bool)  # one more, for breaks behind the last word
    heads[first[:-1][np.diff(first) > 0]] = True
    for at in range(0, len(data), BLOCK):
        heads[np.searchsorted(starts, np.flatnonzero(CLASSES[data[at : at + BLOCK]] == BREAK) + at)] = True
    heads[:1] = True
    return heads[:-1]


def _encode(piece: pa.Table) -> tuple[int, bytes]:
    """Texts as numbers of the chunk's different words by frequency, 0 before each piece; the words with their languages; words a language."""
    data, offsets = flat(piece.column("text"))
    starts, ends = word_bounds(data, offsets, CLASSES)
    langs = piece.column("lang").combine_chunks().dictionary_encode()
    first = np.searchsorted(starts, offsets)
    first[-1] = len(starts)
    lang = np.repeat(langs.indices.to_numpy(), np.diff(first))
    hashes = word_hashes(data, starts, ends, lower=True)
    hashes ^= mix(np.arange(len(langs.dictionary), dtype=np.uint64))[lang]
    at, number, counts = _distinct(mix(hashes))
    del hashes
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), dtype=number.dtype)
    place[order] = np.arange(len(order))
    number, at = place[number], at[order]
    heads = _heads(data, starts, first)
    ids = np.zeros(len(starts) + int(heads.sum()), dtype=number.dtype)
    ids[np.arange(len(starts)) + np.cumsum(heads)] = number + 1
    words = [data[starts[i] : ends[i]].tobytes().lower().decode("utf-8") for i in at]
    totals = np.bincount(lang, minlength=len(langs.dictionary))
    return len(starts), packed(_listed(ids=_planes(ids), words=pa.array(words, pa.string()), lang=lang[at].astype(np.int32), langs=langs.dictionary.cast(pa.string()), totals=totals))


def _totals(chunk: int, body: pa.Scalar, _: list) -> Iterator[pa.RecordBatch]:
    table = unpacked(body)
    yield pa.RecordBatch.from_arrays([table.column("langs")[0].values, pa.array(_array(table, "totals"), pa.int64())], ["lang", "n"])


# -- counting --------------------------------------------------------------------------------------------------------------------

def pair_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs of (a, b), numbers by frequency, and how often each occurs: by tiles."""
    if not len(a):
        return a, b, a
    side = np.uint64(1 << TILE_BITS)
    shift, wide = np.uint64(TILE_BITS), np.uint64(int(b.max()) + 1)
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    tile = (a >> shift) * ((wide >> shift) + np.uint64(1)) + (b >> shift)
    tiles, sizes = np.unique(tile, return_counts=True)
    found, left = [], np.ones(len(a), dtype=bool)
    for t in tiles[sizes >= DENSE]:
        mine = tile == t
        left &= ~mine
        cells = np.bincount(((a[mine] & (side - np.uint64(1))) << shift | b[mine] & (side - np.uint64(1))).astype(np.int64), minlength=1 << 2 * TILE_BITS)
        at = np.flatnonzero(cells)
        head = np.argmax(mine)
        found.append(((a[head] >> shift << shift) + (at >> TILE_BITS).astype(np.uint64), (b[head] >> shift << shift) + (at & ((1 << TILE_BITS) - 1)).astype(np.uint64), cells[at]))
    codes = np.sort(a[left] * wide + b[left])
    at = groups(codes)
    found.append((codes[at] // wide, codes[at] % wide, np.diff(np.append(at, len(codes)))))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _joined(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    return mix(x * np.uint64(0x9FB21C651E98DF25 + 2 * seed) + y)


def _run_hashes(own: np.ndarray, words: list[np.ndarray], seed: int) -> np.ndarray:
    """The hashes of runs, from those of their first, second, ... words."""
    out = own[words[0]]
    for word in words[1:]:
        out = _joined(out, own[word], seed)
    return out


def _by_bucket(x: np.ndarray, y: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a chunk asks about its keys, and their buckets in that order."""
    bucket = (x % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((y, bucket))
    return order, bucket[order]


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as steps, the bytes of equal weight together: the heaviest ones are zeros, which shuffles compress."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unsteps(body: pa.Buffer) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(body, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _asked(chunk: int, x: np.ndarray, y: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    order, bucket = _by_bucket(x, y, buckets)
    counts = counts[order]

    def numbers(a: int, b: int) -> bytes:
        top = int(counts[a:b].max())
        return counts[a:b].astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()

    return ask_rows(chunk, bucket, y[order], numbers, _steps)


def _positions(table: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where phrases of so many words may begin, the number of their first words and that of their last one."""
    words = _numbers(table, "ids")
    phrases = words if level == 2 else _numbers(table, "phrases")
    at = np.flatnonzero((phrases[:-1] > 0) & (phrases[1:] > 0))
    return at, phrases[at] - 1, words[at + level - 1] - 1


def _asks(level: int, buckets: int):
    def work(chunk: int, body: pa.Scalar, _: list) -> Iterator[pa.RecordBatch]:
        table = unpacked(body)
        x, y = _keys(table.column("words")[0].values, _array(table, "lang"), table.column("langs")[0].values)
        if level == 1:
            counts = np.bincount(_numbers(table, "ids"), minlength=1)[1:]
        else:
            at, first, last = _positions(table, level)
            place = np.zeros(int(first.max()) + 1 if len(first) else 0, dtype=np.int64)
            place[first] = at
            first, last, counts = pair_counts(first, last)
            ids, begin = _numbers(table, "ids"), place[first.astype(np.int64)]
            run = [ids[begin + i] - 1 for i in range(level - 1)] + [last.astype(np.int64)]
            x, y = (_run_hashes(own, run, i) for i, own in enumerate((x, y)))
        if len(counts):
            yield _asked(chunk, x, y, counts, buckets)

    return work


def _frequent(least: int):
    def decide(group: pa.Table) -> Iterator[tuple[int, bytes, bytes]]:
        """For each chunk that holds frequent keys: a bit a key it asked about; a bit a frequent one (it tells the text), the counts of those.
        Of the chunks that hold a key, in order, its own bits choose the one that tells, so that no chunk tells what all others hold too."""
        rows = sorted(zip(group.column("chunk").to_pylist(), group.column("keys"), group.column("more"), strict=True), key=lambda row: row[0])
        chunks, keys, counts = [row[0] for row in rows], [], []
        for _, k, m in rows:
            keys.append(_unsteps(k.as_buffer()))
            counts.append(np.frombuffer(m.as_buffer(), dtype=f"u{len(m.as_buffer()) // len(keys[-1])}").astype(np.int64))
        cuts = np.cumsum([0] + [len(k) for k in keys]).tolist()
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys, kind="stable")
        at = groups(keys[order])
        sums = np.add.reduceat(counts[order], at)
        totals, tells = np.empty(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        runs = np.diff(np.append(at, len(keys)))
        totals[order] = np.repeat(sums, runs)
        tells[order[at + (keys[order[at]] % runs.astype(np.uint64)).astype(np.int64)]] = True
        live = totals >= least
        for chunk, a, b in zip(chunks, cuts[:-1], cuts[1:], strict=True):
            if live[a:b].any():
                told = tells[a:b] & live[a:b]
                yield chunk, bits(live[a:b]), bits(tells[a:b][live[a:b]]) + totals[a:b][told].tobytes()

    return decide


def _numbered(x: np.ndarray, y: np.ndarray, counts: np.ndarray, answers: list, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the keys a chunk asked about, with its own counts: the number by frequency from 1 (0: not frequent over all chunks); places of the
    frequent ones by number; for each of these its count over all chunks where this chunk tells its text, else 0."""
    order, bucket = _by_bucket(x, y, buckets)
    totals, live = np.zeros(len(y), dtype=np.int64), np.zeros(len(y), dtype=bool)
    for b, is_live, more in answers:
        a, z = np.searchsorted(bucket, [b, b + 1])
        held = order[a:z][unbits(is_live, z - a)]
        live[held] = True
        tells = unbits(more, len(held))
        totals[held[tells]] = np.frombuffer(more, dtype=np.int64, offset=-(-len(held) // 8))
    at = np.flatnonzero(live)
    at = at[np.lexsort((y[at], -counts[at]))]
    number = np.zeros(len(y), dtype=np.int64)
    number[at] = np.arange(1, len(at) + 1)
    return number, at, totals[at]


STATE = "chunk long, n long, body binary, told array<struct<lang: string, words: array<string>, f: long>>"


def _told(langs: pa.Array, lang: np.ndarray, words: pa.Array, run: list[np.ndarray], counts: np.ndarray) -> pa.StructArray:
    """Phrases by the places of their first, second, ... words, with their counts; as objects of Python each would take hundreds of bytes."""
    texts = words.take(pa.array(np.stack(run, axis=1).ravel()))
    phrases = pa.ListArray.from_arrays(pa.array(np.arange(0, len(texts) + 1, len(run)), pa.int32()), texts)
    return pa.StructArray.from_arrays([langs.take(pa.array(lang)), phrases, pa.array(counts, pa.int64())], ["lang", "words", "f"])


def _state(chunk: int, table: pa.Table, told: pa.StructArray) -> pa.RecordBatch:
    told = pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), told)
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([0], pa.int64()), pa.array([packed(table)], pa.binary()), told], ["chunk", "n", "body", "told"])


def _kept_runs(phrases: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in two phrases of the given width that follow each other, as a longer one needs, and the places where a gap precedes them."""
    inside = np.zeros(len(phrases) + width + 1, dtype=np.int32)
    begins = np.flatnonzero((phrases[:-1] > 0) & (phrases[1:] > 0))
    inside[begins] += 1
    inside[begins + width + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[: len(phrases)]) > 0)
    return at, np.concatenate(([True], np.diff(at) > 1)) if len(at) else np.zeros(0, dtype=bool)


def _used(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (0: none) without those that don't occur, in the same order, and where the others were."""
    occurs = np.zeros(size + 1, dtype=bool)
    occurs[numbers] = True
    occurs[0] = False
    return np.cumsum(occurs)[numbers] * (numbers > 0), np.flatnonzero(occurs) - 1


def _spread(values: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """values with a 0 where a gap precedes them."""
    out = np.zeros(len(values) + int(gaps.sum()), dtype=np.int64)
    out[np.arange(len(values)) + np.cumsum(gaps)] = values
    return out


def _next(level: int, last: bool, buckets: int):
    """From a state and the answers about its phrases of level words: the next state, and the texts that this chunk tells."""
    def work(chunk: int, body: pa.Scalar, answers: list) -> Iterator[pa.RecordBatch]:
        if not answers:
            return
        table = unpacked(body)
        words, langs, lang = table.column("words")[0].values, table.column("langs")[0].values, _array(table, "lang")
        ids = _numbers(table, "ids")
        x, y = _keys(words, lang, langs)
        if level == 1:
            number, at, totals = _numbered(x, y, np.bincount(ids, minlength=1)[1:], answers, buckets)
            phrases = np.concatenate(([0], number))[ids]
            tells = at[totals > 0]
            told = _told(langs, lang[tells], words, [tells], totals[totals > 0])
            ids, words, lang = phrases, words.take(pa.array(at)), lang[at]
        else:
            begin, head, tail = _positions(table, level)
            wide = int(tail.max()) + 1 if len(tail) else 1
            head *= wide
            head += tail
            del tail
            where, which, counts = _distinct(head)
            del head
            run = [ids[begin[where] + i] - 1 for i in range(level)]
            number, at, totals = _numbered(*(_run_hashes(own, run, i) for i, own in enumerate((x, y))), counts, answers, buckets)
            phrases = np.zeros(len(ids), dtype=np.int64)
            phrases[begin] = number[which]
            del begin, where, which
            tells = at[totals > 0]
            run = [word[tells] for word in run]
            told = _told(langs, lang[run[0]], words, run, totals[totals > 0])
        if last:
            yield _state(chunk, _listed(langs=langs), told)
            return
        kept, gaps = _kept_runs(phrases, level)
        ids, own = _used(_spread(ids[kept], gaps), len(words))
        front = {} if level == 1 else {"phrases": _planes(_used(_spread(phrases[kept], gaps), len(at))[0])}  # at level 1 the words themselves
        yield _state(chunk, _listed(ids=_planes(ids), **front, words=words.take(pa.array(own)), langs=langs, lang=lang[own]), told)

    return work


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """lang, words, f of every phrase of up to so many words that occurs min_count times or more; lang, n: all words of a language."""
    def kept(df: DataFrame, name: str) -> DataFrame:
        path = scratch(df.sparkSession, name)
        df.write.option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    state = kept(chunked(rows, _encode, most=CHUNK_BYTES), "phrase-words")
    buckets = bucket_count(state)
    totals = per_chunk(state, None, _totals, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))
    told = None
    for level in range(1, longest + 1):
        answers = answered(per_chunk(state.drop("told"), None, _asks(level, buckets), ASK), _frequent(min_count))
        state = kept(per_chunk(state.drop("told"), answers, _next(level, level == longest, buckets), STATE), f"phrases-{level}")
        found = state.select(F.explode("told").alias("t")).select("t.*")
        told = found if told is None else told.unionByName(found)
    return told, totals


# -- scores ----------------------------------------------------------------------------------------------------------------------

def _phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, most: int = MOST, num: int = NUM, den: int = DEN) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases by score descending, a descending, phrase ascending.

    docs has lang and text. A-Z count as a-z; pieces end at . , ; : ! ? and at line feed, vertical tab, form feed and carriage return, words
    in a piece at space and tab. A phrase of 2 to longest words in one piece with a >= min_count occurrences (overlaps included) is a
    candidate. Cut after k words, its parts occur l and r times, and floor(1000 * a * n / (l * r)) is the score of the cut, n being all words
    of the language; the lowest counts, the first of equal ones. A candidate goes if one of its words' longer neighbours, any candidate that
    holds it contiguously, has den * f >= num * a. Null languages are und, null and empty texts hold no words; an empty table gives no
    rows; repeated rows count each; other columns are not read. Decimal numbers of 38 digits keep the products exact.
    """
    told, totals = frequent_phrases(docs, min_count, longest)
    grams = told.select("lang", "words", _phrase("words").alias("phrase"), "f")
    candidates = grams.where(F.size("words") > 1)
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _phrase(F.slice("words", 1, F.col("k"))).alias("left"), _phrase(F.slice("words", F.col("k") + 1, F.size("words"))).alias("right"))
    part = lambda of, count: grams.select("lang", F.col("phrase").alias(of), F.col("f").alias(count))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("score", F.expr("(cast(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0)) as decimal(38,0))) div cast(cast(l as decimal(19,0)) * cast(r as decimal(19,0)) as decimal(38,0))"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("words") - m + 1), lambda i: _phrase(F.slice("words", i, m)))))
    longer = candidates.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("f").alias("around")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("around").isNull() | (den * wide("around") < num * wide("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
