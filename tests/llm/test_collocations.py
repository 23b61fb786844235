"""What a chunk of the collocations holds in memory: texts are told by all chunks that hold them, as arrays; pieces are found block by block."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from pdpspark.llm import collocations
from pdpspark.llm.chunks import unbits, unpacked


def peak(work):
    """What work returns, and the most bytes of arrays and objects at once."""
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def answers_to(ask: pa.RecordBatch, least: int) -> list:
    found = []
    for i in range(ask.num_rows):
        for _, live, more in collocations._frequent(least)(pa.Table.from_batches([ask.slice(i, 1)])):
            found.append((ask.column("bucket")[i].as_py(), pa.py_buffer(live), pa.py_buffer(more)))
    return found


def test_chunks_share_the_texts_they_tell():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
    rows = [collocations._asked(chunk, keys * np.uint64(0), keys, np.full(4000, chunk + 1), 1) for chunk in range(8)]
    told = []
    for order in (range(8), reversed(range(8))):
        out = {chunk: more for chunk, _, more in collocations._frequent(30)(pa.Table.from_batches([rows[i] for i in order]))}
        tells = {chunk: unbits(pa.py_buffer(more), 4000) for chunk, more in out.items()}
        assert sum(tells.values()).tolist() == [1] * 4000  # each by one chunk
        assert all(300 < t.sum() < 700 for t in tells.values())
        assert all(np.frombuffer(more, dtype=np.int64, offset=500).tolist() == [36] * int(tells[chunk].sum()) for chunk, more in out.items())
        told.append({chunk: t.tolist() for chunk, t in tells.items()})
    assert told[0] == told[1]  # in whatever order the rows come, as after a lost executor


def test_a_chunk_and_its_told_texts_take_little_memory():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(20000)}" for _ in range(1000)) for _ in range(200)]
    piece = pa.table({"lang": pa.array(["en", "de"] * 100), "text": pa.array(texts)})
    words = 200 * 1000
    collocations._encode(piece)  # which makes constants that stay
    (_, body), most = peak(lambda: collocations._encode(piece))
    assert most < 90 * words
    body = pa.scalar(body, pa.binary())
    for level in (1, 2):
        [ask] = collocations._asks(level, 3)(0, body, [])
        answers = answers_to(ask, 1)
        [state], most = peak(lambda: list(collocations._next(level, False, 3)(0, body, answers)))  # noqa: B023
        told = state.column("told")[0].values
        assert len(told) > (30_000, 190_000)[level - 1]
        assert most < 200 * max(len(told), words // 2)
        body = state.column("body")[0]
    assert {len(w) for w in told.field("words").to_pylist()} == {2}


@pytest.mark.parametrize("block", [1, 7, 1 << 19])
def test_pieces_are_found_in_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block, raising=False)
    rng = random.Random(block)
    texts = ["", None, "...", ". a", "a b. ", "c", *("".join(rng.choice("ab \t.,\n") for _ in range(rng.randrange(30))) for _ in range(40)), "a.", "."]
    _, body = collocations._encode(pa.table({"lang": pa.array(["en"] * len(texts)), "text": pa.array(texts, pa.string())}))
    table = unpacked(pa.scalar(body, pa.binary()))
    names = [None, *table.column("words")[0].values.to_pylist()]
    want = [w for t in texts for piece in re.split(r"[.,\n]", t or "") if re.search("[ab]|c", piece) for w in (None, *piece.split())]
    assert [names[i] for i in collocations._numbers(table, "ids")] == want
