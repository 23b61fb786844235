"""Repeated passages, conversation repair and collocations against brute force; nulls, repeats, long texts, clashing columns, empty tables."""

import hashlib
import random
import re
import time
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pdpspark.llm import chunks, collocations, conversations, substring, wordhash

WORD = r"[^\x20\x09-\x0D]+"


# -- words -----------------------------------------------------------------------------------------------------------------------

def test_words_of_a_buffer(monkeypatch):
    monkeypatch.setattr(wordhash, "BLOCK", 16)
    monkeypatch.setattr(wordhash, "LONG_WORD", 12)
    wordhash._constants.cache_clear()
    texts = ["one two", "two\tone ", None, "", "three", "four  one", "x" * 50 + " two", "é ü " * 9, "ONE"]
    data, offsets = wordhash.flat(pa.array(texts, pa.string()))
    starts, ends = wordhash.word_bounds(data, offsets)
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for t in texts for w in (t or "").split()]
    hashes = wordhash.word_hashes(data, starts, ends).tolist()
    assert len(set(hashes)) == len(set(words)) and all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(i))
    lowered = wordhash.word_hashes(data, starts, ends, lower=True).tolist()
    assert lowered[words.index("ONE")] == lowered[words.index("one")]
    wordhash._constants.cache_clear()


def test_rolling_hashes_tell_runs_apart():
    values = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4, 1, 2, 3], dtype=np.uint64)
    for size in (1, 2, 3, 5, 11, 12):
        runs = [tuple(values[i : i + size].tolist()) for i in range(len(values) - size + 1)]
        found = wordhash.rolling(values, size).tolist()
        assert len(found) == len(runs) and len(set(found)) == len(set(runs))
    assert len(wordhash.rolling(values, 13)) == 0


@pytest.mark.parametrize("top", [100, 1 << 20, 1 << 32])
def test_short_keys_come_back(top):
    keys = np.unique(np.random.default_rng(3).integers(0, top, 500))
    assert chunks.decoded(pa.py_buffer(chunks.encoded(keys))).tolist() == keys.tolist()


# -- repeated passages -----------------------------------------------------------------------------------------------------------

def passages(texts, window):
    split = [re.findall(WORD, t or "") for t in texts]
    seen = Counter(tuple(w[p : p + window]) for w in split for p in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        runs = [(m.start(), len(m[0])) for m in re.finditer("1+", "".join("01"[g] for g in gone))]
        out.append((" ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone), runs))
    return out


@pytest.mark.parametrize(("window", "chunk"), [(35, 4 << 20), (6, 300), (5, 4 << 20)])
def test_passages_match_brute_force(spark, monkeypatch, window, chunk):
    rng = random.Random(window)
    draw = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    shared = [draw(n) for n in (34, 35, 36, 80)]
    texts = [None, "", " \t\n", "one two", draw(200), shared[3], f"{shared[3]} {shared[3]}", "same " * 90, "same\n" * 35]
    texts += [f"{draw(rng.randrange(40))}\n{rng.choice(shared)}\t{draw(rng.randrange(40))}" for _ in range(30)] + [draw(60)] * 3 + [shared[1].upper()]
    texts += [" ".join(rng.choice("ab") for _ in range(60)) for _ in range(4)]
    rows = [(i if i % 7 else None, t, "x", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk string, n long").repartition(3)
    monkeypatch.setattr(substring, "chunked", lambda df, make: chunks.chunked(df, make, most=chunk))
    got = substring.drop_repeated_passages(docs, window).collect()
    want = Counter((i, *row[:3], tuple(row[3])) for (i, *_), row in zip(rows, passages(texts, window), strict=True))
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed, tuple((x.start, x.length) for x in r.repeats)) for r in got) == want


def test_passages_of_nothing_and_of_string_ids(spark):
    assert substring.drop_repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = substring.drop_repeated_passages(spark.createDataFrame([("a", "x " * 40), ("b", None)], "doc_id string, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_removed) for r in got} == {("a", 40, 40), ("b", 0, 0)}


def test_passages_of_a_very_long_text(spark):
    text = " ".join(f"word{i}" for i in range(600_000)) + " " + "z" * 3_000_000 + " " + " ".join(f"word{i}" for i in range(100))
    began = time.time()
    [row] = substring.drop_repeated_passages(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("n_words", "n_removed", F.length("text").alias("n")).collect()
    assert (row.n_words, row.n_removed) == (600_101, 200) and time.time() - began < 60


# -- conversations ---------------------------------------------------------------------------------------------------------------

def cheapest(turns):
    """Cost, audit, lines of the cheapest repair: all ways tried, with whole audits."""
    follow = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    wanted, name = (2, 2, 3, 2), {2: "user", 3: "assistant"}

    @cache
    def best(i, state, inserts):
        ways = [(0, "", ())] if i == len(turns) and state in (0, 3) else []
        add = lambda cost, edit, line, rest: ways.append((cost + rest[0], edit + rest[1], line + rest[2])) if rest else None
        if i < len(turns):
            fault, role, text = turns[i]
            add(2, "D", (), best(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                extra, to = 5 * (fault == "truncated"), follow.get((role[:1], state))
                if to is not None:
                    add(extra, "K", (f"{role}:{text}",), best(i + 1, to, 0))
                add(1 + extra, "R", (f"{name[wanted[state]]}:{text}",), best(i + 1, wanted[state], 0))
        if inserts < 3:
            add(5, "I", (f"{name[wanted[state]]}:",), best(i, wanted[state], inserts + 1))
        return min(ways, default=None)

    return best(0, 0, 0)


def report(rows):
    """All columns of a conversation whose rows are (turn, role, text)."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        turns.append(("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None, role, text))
        seen.add((role, text))
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = cheapest(tuple(turns))
    faults = Counter(f for f, *_ in turns)
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("block", [4096, 3])
def test_repairs_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(conversations, "BLOCK", block)
    rng = random.Random(11)
    talks = {c: [(rng.choice([None, *range(12)]) if c % 3 else i, rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "cut", "", None, " \n", "Go on?  ", f"T{i}."])) for i in range(rng.randrange(1, 11))] for c in range(120)}
    talks |= {200: [(0, "user", "Hi."), (1, "assistant", "Hi.")], 201: [(0, "system", "Be kind.")], None: [(1, "user", "A."), (1, "user", "A."), (2, "assistant", "B.")], 202: [(None, "user", None)] * 3}
    rows = spark.createDataFrame([(c, *r, "other", 1) for c, turns in talks.items() for r in turns], "conv_id long, turn long, role string, text string, pos string, block int")
    reports, turns = conversations.repaired(rows)
    sums = {r.conv_id: r.sha256 for r in conversations.digests(turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (*r[1:], sums.get(r.conv_id, empty)) for r in reports.collect()}
    assert got == {c: report(t) for c, t in talks.items()}
    kept = {}
    for r in turns.orderBy("conv_id", "pos", "sub").collect():
        kept.setdefault(r.conv_id, []).append(r.role[:1])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r)) for r in kept.values())


def test_repair_of_nothing_and_of_one_long_conversation(spark):
    reports, turns = conversations.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert reports.collect() == [] and conversations.digests(turns).collect() == []
    rows = spark.range(30_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    reports, turns = conversations.repaired(rows.where("turn <> 777"))
    [r] = reports.collect()
    assert (r.gaps, r.illegal, r.cost, r.audit) == (1, 1, 2, "K" * 776 + "D" + "K" * 29_222)
    assert turns.count() == 29_998


def test_queries_damage_by_the_contract(spark):
    from pdpspark.llm.queries import damaged

    rows = spark.range(400).select(F.lit(5).alias("conv_id"), F.when(F.col("id") > 0, F.col("id")).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit("a.b!").alias("text"))
    from zlib import crc32

    want = []
    for turn in [None, *range(1, 400)]:
        k = crc32(f"5:{' ' if turn is None else turn}".encode()) % 20
        want += [] if k == 0 else [(5, turn, "user" if k == 4 else " ", "" if k == 1 else "ab" if k == 2 else "a.b!")] * (2 if k == 3 else 1)
    assert Counter(tuple(r) for r in damaged(rows).collect()) == Counter(want)


# -- collocations ----------------------------------------------------------------------------------------------------------------

def phrases(rows, least, most, longest=5):
    lower = {c: c + 32 for c in range(65, 91)}
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inside = {(lang, w[i : i + m]) for (lang, w), v in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if v >= found[lang, w[i : i + m]]}
    scored = {}
    for (lang, w), a in found.items():
        if (lang, w) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            scored.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, v in scored.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:most], 1)}


@pytest.mark.parametrize(("chunk", "dense"), [(6 << 20, 1 << 16), (400, 1 << 16), (6 << 20, 4)])
def test_collocations_match_brute_force(spark, monkeypatch, chunk, dense):
    monkeypatch.setattr(collocations, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(collocations, "DENSE", dense)
    monkeypatch.setattr(collocations, "TILE_BITS", 3)
    rng = random.Random(8)
    common = ["New York City hall", "new york city", "as far as I know", "x x x x", "é\tü ß"]
    text = lambda: " ".join(rng.choice([*common, *(f"v{int(rng.expovariate(0.2))}{rng.choice(['', '', '.', ',', ' |'])}" for _ in range(6))]) for _ in range(60))
    rows = [(rng.choice(["en", "de", None, "und"]), text()) for _ in range(40)] + [("en", None), (None, ""), ("fr", " .,\n"), ("en", "a b"), ("en", "a b")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, n int, rank int").repartition(3)
    got = collocations.collocations(docs, min_count=4, most=60).collect()
    assert {tuple(r) for r in got} == phrases(rows, 4, 60) and len(got) > 100


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, "a b c")], "lang string, text string")).collect() == []


def test_scores_pass_64_bits(spark):
    a = n = 10**13
    found = spark.sql(f"select (cast(1000 * cast({a} as decimal(19,0)) * cast({n} as decimal(19,0)) as decimal(38,0))) div cast(cast({a} as decimal(19,0)) * cast({a + 1} as decimal(19,0)) as decimal(38,0)) as s").first().s
    assert found == 1000 * a * n // (a * (a + 1))


# -- clashing names --------------------------------------------------------------------------------------------------------------

def test_line_dedup_and_url_filter_keep_columns_of_any_name(spark):
    from pdpspark.llm import line_dedup, url_filter

    rows = [(i, f"line {i}\nshared line", f"s{i}", "r", ["d"], 1, "w") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, drop array<string>, pos int, words string")
    got = line_dedup.drop_spread_lines(docs).orderBy("doc_id").collect()
    assert [(r.row, r["drop"], r.pos, r.words, r.n_removed) for r in got] == [("r", ["d"], 1, "w", int(r.doc_id > 0)) for r in got] and len(got) == 5
    pages = spark.createDataFrame([("https://a.org/x", "b", "d", 1)], "url string, best string, digest string, size int")
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    [r] = url_filter.url_verdicts(pages, rules).collect()
    assert (r.best, r.digest, r["size"], r.rule, r.verdict) == ("b", "d", 1, "org/", "block")
