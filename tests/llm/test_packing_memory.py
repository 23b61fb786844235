"""Memory of packing: what is laid out at once is bounded, with the same ids and sentence ends."""

import tracemalloc

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pdpspark.llm import packing
from pdpspark.llm.queries import word_tokenizer


def test_ids_of_many_texts_are_not_laid_out_together():
    words = np.random.default_rng(1).choice([f"{a}{b}" for a in "the cat sat on a mat and was glad to".split() for b in ("", ".", ",", "s")], 600_000)
    texts = pa.array([" ".join(words[at : at + 300]) for at in range(0, len(words), 300)])
    path, size = word_tokenizer(), sum(map(len, texts.to_pylist()))
    packing._tokenizer(path)
    tracemalloc.start()
    n = sum(len(ids) for ids, _ in packing.encode(texts, path))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > len(words) and most < 4 * size, (n, most, size)


def test_encoding_in_small_portions_gives_the_same(monkeypatch):
    texts = ["", "One two. three's", "été naïve “quoted” 中文字 x1y2 " * 9, " ", "a. b! c? d", "zz" * 40, "Ω ω don't... end."] * 3
    path = word_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    whole = list(packing.encode(pa.array(texts), path))
    for at_once, held, together in ((1, 1, 1), (7, 2, 3), (30, 5, 1000)):
        for name, value in (("AT_ONCE", at_once), ("HELD", held), ("TOGETHER", together)):
            monkeypatch.setattr(packing, name, value)
        found = list(packing.encode(pa.array(["x", *texts]).slice(1), path))
        assert len(found) == len(texts)
        for text, (ids, stops), (ids2, stops2) in zip(texts, found, whole, strict=True):
            assert ids.tolist() == ids2.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]
            assert stops.tolist() == stops2.tolist()
