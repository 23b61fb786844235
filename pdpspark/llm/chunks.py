"""Chunks of a table that ask others about hashes, and get answers back.

A chunk is some megabytes of rows in one row of a written table. Each chunk sends the different hashes it holds, with their numbers, to
buckets by hash; a bucket adds up what all chunks hold and answers each chunk about its own hashes. So a hash that a third of all rows hold
reaches its bucket once a chunk, and nothing that grows with the data goes to the driver, to all tasks or into one of them: the number of
buckets grows with the number of words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdpspark.llm.common import bound_batches

#: Bytes of text in a chunk (one row at least), hashes that a bucket should meet.
CHUNK_BYTES, BUCKET_HASHES = 4 << 20, 1 << 20

CHUNK = "chunk long, n long, body binary"
ASK = "bucket int, chunk long, keys binary, more binary"


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(body: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(body.as_buffer()) as stream:
        return stream.read_all()


def _pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """Consecutive rows with so many bytes of text at most; a longer text alone."""
    kept, size = [], 0
    for batch in batches:
        lengths = _lengths(batch.column(text))
        at = 0
        while at < batch.num_rows:
            room = np.cumsum(lengths[at:])
            fit = int(np.searchsorted(room, most - size, side="right"))
            if fit == 0 and not kept:
                fit = 1
            if fit:
                kept.append(batch.slice(at, fit))
                size += int(room[fit - 1])
                at += fit
            if at < batch.num_rows or size >= most:
                yield pa.Table.from_batches(kept)
                kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept)


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def chunked(rows: DataFrame, make: Callable[[pa.Table], tuple[int, bytes]], text: str = "text", most: int = CHUNK_BYTES) -> DataFrame:
    """rows (with a column of texts) as chunks: chunk, n (what make counts in it), body. The ids hold for one run: write the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, piece in enumerate(_pieces(batches, text, most)):
            n, body = make(piece)
            yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int64()), pa.array([n], pa.int64()), pa.array([body], pa.binary())], ["chunk", "n", "body"])

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, CHUNK)


def bucket_count(chunks: DataFrame) -> int:
    """Buckets for all words of the chunks; one number comes to the driver."""
    return max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // BUCKET_HASHES))


def ask_rows(chunk: int, bucket: np.ndarray, keys: np.ndarray, more: Callable[[int, int], bytes], encode: Callable[[np.ndarray], bytes]) -> pa.RecordBatch:
    """Rows of ASK for a chunk's keys, which are sorted by bucket."""
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, dtype=np.int64)
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]].astype(np.int32) if spans else [], pa.int32()), pa.array([chunk] * len(spans), pa.int64()),
         pa.array([encode(keys[a:b]) for a, b in spans], pa.binary()), pa.array([more(a, b) for a, b in spans], pa.binary())],
        ["bucket", "chunk", "keys", "more"])


def answered(asks: DataFrame, decide: Callable[[pa.Table], Iterator[tuple[int, bytes, bytes]]]) -> DataFrame:
    """decide(rows of a bucket) gives (chunk, keys, more) for the chunks it has an answer for; chunk, answers: array of bucket, keys, more."""
    def run(group: pa.Table) -> pa.Table:
        found = list(decide(group))
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(found), pa.int32()), "chunk": pa.array([f[0] for f in found], pa.int64()),
                         "keys": pa.array([f[1] for f in found], pa.binary()), "more": pa.array([f[2] for f in found], pa.binary())})

    told = asks.groupBy("bucket").applyInArrow(run, ASK)
    return told.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "keys", "more")).alias("answers"))  # bounded by the chunk


def per_chunk(chunks: DataFrame, answers: DataFrame | None, work: Callable[[int, pa.Scalar, list[tuple[int, memoryview, memoryview]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(chunk, body, its answers) for every chunk, one at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                told = batch.column("answers")[i].values if "answers" in batch.schema.names and batch.column("answers")[i].is_valid else None
                found = [] if told is None else [(told.field("bucket")[j].as_py(), told.field("keys")[j].as_buffer(), told.field("more")[j].as_buffer()) for j in range(len(told))]
                yield from work(batch.column("chunk")[i].as_py(), batch.column("body")[i], found)

    return (chunks if answers is None else chunks.join(answers, "chunk", "left")).drop("n").mapInArrow(run, schema)


# -- short keys ------------------------------------------------------------------------------------------------------------------

def encoded(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys: as 16-bit steps (65535 stands for a step that goes on) where that is shorter, else as they are."""
    steps = np.diff(keys.astype(np.int64), prepend=0)
    times, rest = np.divmod(steps, 65535)
    size = len(keys) + int(times.sum())
    if 2 * size >= 4 * len(keys):
        return b"\0" + keys.astype(np.uint32).tobytes()
    out = np.full(size, 65535, dtype=np.uint16)
    out[np.cumsum(times + 1) - 1] = rest
    return b"\1" + out.tobytes()


def decoded(body: pa.Buffer) -> np.ndarray:
    if body[0] == 0:
        return np.frombuffer(body, dtype=np.uint32, offset=1)
    steps = np.frombuffer(body, dtype=np.uint16, offset=1)
    return np.cumsum(steps, dtype=np.int64)[steps != 65535].astype(np.uint32)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(body: pa.Buffer, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(body, dtype=np.uint8), count=size).astype(bool)
