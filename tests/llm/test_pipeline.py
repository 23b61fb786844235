"""The stages of the pipeline against plain Python; the registered queries without SQL on the small tables."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pdpspark.llm.queries import QUERIES, word_tokenizer
from tests.llm.test_operators import shingles

SF = "/root/testdata/sf0.001"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
LINE = "read more on the pages of our site"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(6)
    draw = lambda n: " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in (rng.randrange(400) for _ in range(n)))
    base = [draw(60) for _ in range(40)]
    texts = dict(enumerate(base))
    texts |= {i: f"you are a grumbler and a grumbler {draw(8)}" for i in range(40, 70)}
    texts |= {70 + i: f"{base[i]} {draw(1)}" for i in range(4)} | {74: base[5].upper(), 75: f"{draw(30)} {ITEM} {draw(30)}", 76: f"{draw(30)} {ITEM.rpartition(' ')[0]} {draw(30)}", 77: f"{draw(30)} {ITEM[:30]} {draw(30)}"}
    texts |= {80 + i: f"{draw(30)}\n  {LINE} \n{draw(30)}" for i in range(6)} | {90: f"{draw(20)}\n{LINE}x", 91: None, 92: "", 93: "  \n", 94: f"{LINE}\n{base[7]}"}
    sources = {i: f"s{i % 5}" for i in texts} | {93: None}
    out = [(i, t, "en", sources[i], None if t is None else len(t)) for i, t in texts.items()]
    return [*out, out[3], out[3], out[45], (None, base[0], "en", "s1", len(base[0])), (None, None, "en", "s1", None), (None, f"x {ITEM}", "en", None, 70)]


def toxicity(docs):
    return [r for r in docs if "grumbler" not in (r[1] or "")]


def line_dedup(docs):
    spread, first = {}, {}
    for i, t, _, source, _ in docs:
        for at, line in enumerate((t or "").split("\n")):
            key = line.strip(" ")
            spread.setdefault(key, set()).update([source] if source else [])
            first[key] = min(first.get(key, (9e9, 0)), (9e9 if i is None else i, at))
    out = []
    for i, t, lang, source, n in docs:
        lines = (t or "").split("\n")
        kept = [x for at, x in enumerate(lines) if not x.strip(" ") or len(spread[x.strip(" ")]) < 4 or first[x.strip(" ")] == (i, at)]
        out.append((i, t, lang, source, n) if len(kept) == len(lines) else (i, "\n".join(kept), lang, source, len("\n".join(kept))))
    return out


def near_dedup(docs):
    texts = {r[0]: r for r in docs if r[0] is not None}
    sets = {i: shingles(r[1]) for i, r in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [r for i, r in texts.items() if root(i) == i] + [r for r in docs if r[0] is None]


def decontamination(docs):
    item = shingles(ITEM)
    return [r for r in docs if r[0] is None or len(shingles(r[1]) & item) < 0.75 * len(item)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 0, int(40 <= i < 70)) for i in range(70) if i % 7], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def tokens(docs):
    from tokenizers import Tokenizer

    real, out = Tokenizer.from_file(word_tokenizer()), Counter()
    for i, t in docs:
        out[i] += len(real.encode(t or "", add_special_tokens=False).ids) + 1
    return out


def lengths(pieces):
    out = Counter()
    for r in pieces:
        out[r.doc_id] += r.length
    return out


def test_stages_and_run(spark, folder):
    docs, have = spark.read.parquet(f"{folder}/documents.parquet"), rows()
    plain = {"toxicity": toxicity, "line_dedup": line_dedup, "near_dedup": near_dedup, "decontamination": decontamination}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, have = len(have), plain[name](have)
        found = stage(spark, docs, folder).localCheckpoint()
        assert found.schema == docs.schema and sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, have)), name
        assert len(have) < before or name == "line_dedup"
        docs = found
    want = tokens(r[:2] for r in have)
    assert [n for n, _ in corpus_pipeline.STAGES] == [*plain, "packing"]
    assert lengths(corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()) == want
    assert lengths(QUERIES["pipeline"](spark, folder).collect()) == want


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_registered_queries_keep_every_row(spark):
    docs, pages = read(spark, "documents").select("doc_id", "text").collect(), read(spark, "pages").select("page_id", "html").collect()
    ids = Counter(r.doc_id for r in docs)
    for name in ("op4_toxicity", "op10_language"):
        assert Counter(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()) == ids, name
    assert lengths(QUERIES["op5_packing"](spark, SF).select("doc_id", "length").collect()) == tokens(docs)
    for name in ("op3_html_text", "op9_warc"):
        found = QUERIES[name](spark, SF).collect()
        assert Counter(r.page_id for r in found) == Counter(r.page_id for r in pages), name
        assert all(r.verified if name == "op9_warc" else r.n_chars == len(r.text) > 0 for r in found), name


def test_registered_nearest_is_brute_force(spark):
    found = QUERIES["op2_nearest"](spark, SF).collect()
    x = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in read(spark, "embeddings").collect()}
    asked = [i for i in x if i % 20 == 0]
    assert len(found) == 20 * len(asked)
    for q in asked:
        got = [r.score for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])]
        assert np.allclose(got, sorted((float(x[q] @ x[i]) for i in x if i != q), reverse=True)[:20])
