"""Near duplicates: MinHash bands find candidates, odd sketches sift them, full shingle sets confirm them, stars connect them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdpspark.llm.common import SHINGLE_WORDS, bound_batches, written
from pdpspark.llm.components import components
from pdpspark.llm.wordhash import flat, mix, word_bounds, word_hashes

#: 48 bands of 6 samples: a pair of similarity 0.75 shares none of them with probability 8e-5, one of 0.33 shares one with 6 %.
BANDS, ROWS = 48, 6
SAMPLES = BANDS * ROWS
#: Odd sketches of SKETCH_LONGS * 64 bits over all samples.
SKETCH_LONGS = 16
SKETCH_BITS = 64 * SKETCH_LONGS
#: Candidates whose estimate lies so many standard errors under the threshold are dropped unconfirmed.
ERRORS = 4.5
#: Pairs that a member outside the main component is confirmed with in one turn, the most similar ones by sketch.
TRIES = 4
#: intersection * DEN >= NUM * union
NUM, DEN = 75, 100
#: Bytes of text that are hashed at once (one document at least), rows of a set that are permuted at once.
TEXT_BYTES, SET_ROWS = 1 << 18, 1 << 10
#: Bytes of sets in a batch.
SETS_BYTES = 8 << 20

#: Two odd sketches a node: s of its MinHash samples, t of its whole set, which tells small sets apart more precisely.
SKETCH = [f"{x}{i}" for x in "st" for i in range(SKETCH_LONGS)]


# -- shingle sets ----------------------------------------------------------------------------------------------------------------

@cache
def _constants() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(20250101)
    odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return {
        "word": odd(SHINGLE_WORDS), "short": odd(1),
        "permute": (odd(SAMPLES) >> np.uint64(31)).astype(np.uint32) | np.uint32(1), "shift": rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32),
        "band": odd(ROWS), "place": odd(SAMPLES),
    }


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted different 64-bit shingle hashes of each whole text; with fewer than five words one hash of them all, without words none.

    Texts are read where they lie in the batch, TEXT_BYTES at a time, or one longer text alone.
    """
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, side="right")))
        yield from _sets(texts.slice(at, upto - at))
        at = upto


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    c = _constants()
    data, offsets = flat(texts)
    starts, ends = word_bounds(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=True)
    first = np.searchsorted(starts, offsets)  # the first word of each text
    first[-1] = len(starts)
    n = len(hashes) - SHINGLE_WORDS + 1
    spans = mix(sum(hashes[i : i + n] * c["word"][i] for i in range(SHINGLE_WORDS))) if n > 0 else hashes[:0]
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE_WORDS:
            yield np.unique(spans[a : b - SHINGLE_WORDS + 1])
        elif b > a:
            yield mix(np.array([(hashes[a:b] * c["word"][: b - a]).sum()], dtype=np.uint64) + c["short"] * np.uint64(b - a))
        else:
            yield hashes[:0]


# -- signatures ------------------------------------------------------------------------------------------------------------------

def samples(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a set that isn't empty."""
    c = _constants()
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(folded), SET_ROWS):
        seen = folded[None, at : at + SET_ROWS] ^ c["shift"][:, None]
        seen *= c["permute"][:, None]
        np.minimum(least, seen.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * _constants()["band"]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parity bitmap: each (sample number, value) flips one bit."""
    return _parity(mix(least.astype(np.uint64) * _constants()["place"] + np.arange(SAMPLES, dtype=np.uint64)))


def _parity(hashes: np.ndarray) -> np.ndarray:
    odd = (np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def most_differing(flips: Column) -> Column:
    """Bits in which two parity bitmaps that so many flips part differ at most, within ERRORS standard errors of collisions."""
    decay = F.exp(-2 * flips / SKETCH_BITS)
    expected = (1 - decay) * (SKETCH_BITS / 2)
    return expected + ERRORS * F.sqrt(F.least(F.lit(SKETCH_BITS / 4), 2 * flips * flips / SKETCH_BITS)) + 2


def sample_flips(num: int = NUM, den: int = DEN) -> float:
    """Flips that part the samples of a pair at the threshold at most, within ERRORS standard errors of sampling."""
    t = num / den
    return 2 * SAMPLES * (1 - t + ERRORS * math.sqrt(t * (1 - t) / SAMPLES))


def possible(left: str, right: str, num: int = NUM, den: int = DEN) -> Column:
    """Whether sizes and sketches leave room for the threshold. left and right name the two sides' columns.

    At the threshold sets of n and m shingles differ in (n + m) * (den - num) / (den + num); their own parity bitmaps differ by that many
    flips, those of their samples by sample_flips().
    """
    n, m = F.col(f"{left}n"), F.col(f"{right}n")
    sizes = den * F.least(n, m) >= num * F.greatest(n, m)
    own = _differing(left, right, "t") <= most_differing((n + m) * ((den - num) / (den + num)))
    return sizes & own & (_differing(left, right, "s") <= most_differing(F.lit(sample_flips(num, den))))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, f0 and f1 (128-bit fingerprint of the set), bands, s0...: one row per document row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, bands, sketches = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                sizes.append(len(s))
                if len(s):
                    least = samples(s)
                    prints.append((mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(0x632BE59BD9B4E019)))))
                    bands.append(band_keys(least).view(np.int64))
                    sketches.append(np.concatenate((odd_sketch(least), _parity(mix(s ^ np.uint64(0xD6E8FEB86659FD93))))))
                else:
                    prints.append((0, 0))
                    bands.append(None)
                    sketches.append(np.zeros(len(SKETCH), dtype=np.uint64))
            f0, f1 = np.array(prints, dtype=np.uint64).reshape(-1, 2).view(np.int64).T
            columns = np.array(sketches, dtype=np.uint64).reshape(-1, len(SKETCH)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(f0), pa.array(f1), pa.array(bands, pa.list_(pa.int64())), *[pa.array(np.ascontiguousarray(columns[:, i])) for i in range(len(SKETCH))]],
                ["doc_id", "n_shingles", "f0", "f1", "bands", *SKETCH])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, n_shingles long, f0 long, f1 long, bands array<long>, {', '.join(f'{s} long' for s in SKETCH)}")


# -- candidates and links --------------------------------------------------------------------------------------------------------

def _differing(left: str, right: str, kind: str = "s") -> Column:
    return sum((F.bit_count(F.col(f"{left}{s}").bitwiseXOR(F.col(f"{right}{s}"))) for s in SKETCH if s[0] == kind), F.lit(0))


def _sifted(pairs: DataFrame, sketches: DataFrame, num: int, den: int, *more: str) -> DataFrame:
    """pairs (a, b) of different nodes that the sketches don't rule out, with differing bits and the columns more."""
    side = lambda p: sketches.select(F.col("node").alias(p), *[F.col(s).alias(p + s) for s in ("n", *SKETCH)])
    return pairs.join(side("a"), "a").join(side("b"), "b").where(possible("a", "b", num, den)).select("a", "b", *more, _differing("a", "b").alias("differing"))


def _mixed(shared: DataFrame, found: DataFrame, sketches: DataFrame) -> DataFrame:
    """The members of buckets that hold several components: band, node, c (its component), main (the bucket's most frequent one), sketch."""
    label = shared.select("band", "node").join(found.withColumnsRenamed({"a": "node", "b": "c"}), "node", "left").withColumn("c", F.coalesce("c", "node"))
    groups = label.groupBy("band", "c").count().groupBy("band").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    return written(label.join(groups, "band").join(sketches, "node"), "mixed")


def _confirmed(pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts are read again for these nodes alone."""
    nodes = written(pairs.select(F.col("a").alias("doc_id")).distinct().unionByName(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct(), "asked")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, room, sets = 0, 0, []
            for i, found in enumerate(shingle_sets(batch.column("text"))):
                sets.append(found.tobytes())
                room += len(sets[-1])
                if room > SETS_BYTES or i + 1 == batch.num_rows:  # a batch of texts makes several of sets
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(sets)), pa.array(sets, pa.binary())], ["doc_id", "shingles"])
                    at, room, sets = i + 1, 0, []

    sets = docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi").mapInArrow(make, f"doc_id {kind}, shingles binary")
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "y"}), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                common = len(np.intersect1d(u, v, assume_unique=True)) if den * min(len(u), len(v)) >= num * max(len(u), len(v)) else 0
                keep.append(common > 0 and den * common >= num * (len(u) + len(v) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id, text).

    Documents are linked where den * |intersection| >= num * |union| of their full sets of 5-word shingles; component_id is the smallest
    doc_id reachable, kept whether it is the row's own. Rows with one id are one node of the graph. A null id takes no part: it has a
    null component_id and is kept. Null and blank texts have no shingle and are linked with nothing, short ones one shingle.

    Equal sets become one node, by fingerprint, before anything is paired. Of every band bucket first each member meets the smallest
    and the largest one alone, which connects groups of copies in linear work; then, in the buckets that still hold several components,
    the members outside the most frequent one meet four of its members a turn, while that halves their number; at last they meet all
    that their own component doesn't hold yet, so no candidate of the bands is lost. The odd sketches sift both kinds before full sets are read.
    """
    bound_batches(docs.sparkSession)
    rows = written(signatures(docs), "signatures")
    full = rows.where("n_shingles > 0")
    classes = full.groupBy("f0", "f1", "n_shingles").agg(F.min("doc_id").alias("node"))
    nodes = written(full.join(classes.select("node", "f0", "f1", "n_shingles"), ["f0", "f1", "n_shingles"]).where("doc_id = node").dropDuplicates(["node", "f0", "f1"]).select("node", "bands", F.col("n_shingles").alias("n"), *SKETCH), "nodes")
    sketches = nodes.select("node", "n", *SKETCH)
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    shared = written(buckets.join(buckets.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high"), "band"), "buckets")

    # copies meet the ends of their buckets
    ends = shared.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    near = _sifted(ends, sketches, num, den)
    tried = written(near.groupBy("a").agg(F.min("b").alias("low"), F.min_by("b", "differing").alias("best")).select("a", F.explode(F.array("low", "best")).alias("b")).distinct(), "tried")
    links = written(_confirmed(tried, docs, num, den), "links")
    found = components(links)

    # the members outside the main component of a bucket meet some of its members, as long as that connects most of them
    mixed, left, turn = _mixed(shared, found, sketches), None, 0
    while (now := mixed.where("c <> main").count()) and (left is None or 2 * now <= left):
        left, turn = now, turn + 1
        order = F.xxhash64("node", "band", F.lit(turn))
        hosts = mixed.where("c = main").groupBy("band").agg(F.array(F.min("node"), F.max("node"), F.min_by("node", order), F.max_by("node", order)).alias("hosts"))
        met = mixed.where("c <> main").select("band", F.col("node").alias("of")).join(hosts, "band").select("of", F.explode("hosts").alias("host")).distinct()
        near = _sifted(met.select(F.greatest("of", "host").alias("a"), F.least("of", "host").alias("b"), "of").join(tried, ["a", "b"], "left_anti"), sketches, num, den, "of")
        best = near.groupBy("of").agg(F.slice(F.array_sort(F.collect_set(F.struct("differing", "a", "b"))), 1, TRIES).alias("best"))
        fresh = written(best.select(F.explode("best").alias("p")).select("p.a", "p.b").distinct(), "fresh")
        tried = written(tried.unionByName(fresh), "tried")
        found = components(found.unionByName(_confirmed(fresh, docs, num, den)))
        mixed = _mixed(shared, found, sketches)

    # what is left: members of different components, all of them; a pair comes out of the first band alone that both lie in
    mixed = mixed.join(nodes.select("node", "bands"), "node")
    x = mixed.where("c <> main").select("band", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("bands").alias("abands"), *[F.col(s).alias("a" + s) for s in ("n", *SKETCH)])
    y = mixed.select("band", F.col("node").alias("b"), F.col("c").alias("cb"), (F.col("c") == F.col("main")).alias("in_main"), F.col("bands").alias("bbands"), *[F.col(s).alias("b" + s) for s in ("n", *SKETCH)])
    once = F.array_min(F.array_intersect("abands", "bbands")) == x.band
    rest = x.join(y, (x.band == y.band) & (F.col("ca") != F.col("cb")) & (F.col("in_main") | (F.col("a") > F.col("b"))) & possible("a", "b", num, den) & once)
    rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = _confirmed(written(rest, "rest"), docs, num, den)
    found = components(found.unionByName(more)).withColumnsRenamed({"a": "node", "b": "component"})

    named = classes.join(found, "node", "left").select("f0", "f1", "n_shingles", F.coalesce("component", "node").alias("component"))
    linked = rows.select("doc_id", "n_shingles", "f0", "f1").join(named, ["f0", "f1", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id is null").select("doc_id", "text").mapInArrow(_sizes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in shingle_sets(batch.column("text"))], pa.int64())], ["doc_id", "n_shingles"])


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component of docs, the one of the smallest id, with all columns; rows with a null id stay all.

    Of several rows with that id one stays.
    """
    keep = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))
