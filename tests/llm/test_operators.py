"""Nulls, empty tables, repeated rows and clashing columns for every operator; small brute-force comparisons."""

import re

import numpy as np
import pytest
from pyspark.sql import GroupedData
from pyspark.sql import functions as F

from pdpspark.llm import ann, decontaminate, html_text, langid, line_dedup, near_dedup, packing, toxicity, url_filter
from pdpspark.llm.queries import word_tokenizer

DOC = "doc_id long, text string"
EN, FR = "the quick brown fox jumps over the lazy dog and runs ", "le renard brun saute par dessus le chien paresseux et "


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{i}" for i in rng.integers(0, 400, 60)) for _ in range(12)]
    texts = [None, "", "one two", "One  two", "\t\n"]
    for b in base:
        w = b.split()
        texts += [b, b.upper(), " ".join(w[:-1]), " ".join(w[:55] + ["x"] * 5), " ".join(w[:50] + ["y"] * 10)]
    rows = [*enumerate(texts), (7, texts[7]), (None, base[0]), (None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    sets, parent = {i: shingles(t) for i, t in enumerate(texts)}, {i: i for i in range(len(texts))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], DOC)).collect() == []
    assert near_dedup.drop_near_duplicates(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "A b"), (None, "a b")], DOC)).count() == 2


def test_nearest_is_exact_on_small_tables(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 8))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 8), (92, [float("nan")] + [1.0] * 7), (93, [None] + [1.0] * 7), (None, x[0].tolist()), (4, x[4].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), k=5).collect()
    for q in (0, 20, 40):
        score = [(-(x[q] * x[i]).sum(), i) for i in range(60) if i != q]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in sorted(score)[:5]]
    assert {r.query_id for r in got} == {0, 20, 40}
    assert ann.nearest(df.limit(0), df).collect() == []


@pytest.mark.parametrize("clusters", [0, 40])
def test_nearest_recall_where_hashing_is_on(spark, monkeypatch, clusters):
    monkeypatch.setattr(ann, "LEAST", 0)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 32))
    if clusters:
        x = rng.standard_normal((clusters, 32))[rng.integers(0, clusters, len(x))] + 0.3 * x
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 30 = 0"), k=20).collect()
    found = 0
    for q in range(0, 3000, 30):
        score = x @ x[q]
        score[q] = -np.inf
        found += len(set(np.argsort(-score)[:20].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert len(got) == 2000 and found >= 0.9 * 2000


def test_nearest_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 8)))], "vec_id long, embedding array<double>")
    groups = []
    cogroup = GroupedData.cogroup
    monkeypatch.setattr(GroupedData, "cogroup", lambda self, other: groups.append(self.count().agg(F.max("count")).first()[0]) or cogroup(self, other))
    whole = sorted(map(tuple, ann.nearest(df, df, k=5).collect()))
    monkeypatch.setattr(ann, "QUERY_ROWS", 40)
    assert sorted(map(tuple, ann.nearest(df, df, k=5).collect())) == whole and len(whole) == 2000
    assert groups[0] == 400 and groups[1] < 100


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div>"
    "<div class='content'><article><h1>Head &amp; line</h1><p>First <b>bold</b> text,\n long enough to count as a paragraph.<br><p>Second &lt;tag&gt; a < b<script>var x='</p>'</script>"
    "<aside>Aside</aside><form>Form<input></form><div class=ad>Buy</div></article><section id=comments><p>A reader says something here.</p></section></div><footer>Foot</footer>"
)


def test_main_text(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", None), (3, None, ""), (4, "http://b.example", "plain text"), (1, "http://a.example/1", PAGE)]
    got = html_text.main_texts(spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string"))
    want = "Head & line First bold text, long enough to count as a paragraph. Second <tag> a < b"
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain text", 10)]
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def main_text(html):
    page = html_text.parse(html)
    return html_text.extract(page, [p for p, _ in html_text.votes(page)])


def test_main_text_in_wrappers_that_look_bad():
    text = "A first paragraph of the article, long enough to count as one."
    for wrap in ("<div class='layout has-sidebar'>{}</div>", "<div class=with-ads>{}</div>", "<div id=content-menu-open>{}</div>", "<form id=aspnetForm>{}</form>", "<div class='widget'>{}</div>", "<div hidden>{}</div>"):
        for held in (f"<article><p>{text}</p></article>", f"<div><p>{text}</p><p>{text}</p></div>"):
            page = "<body><nav><a href=/>Home</a></nav>" + wrap.format(f"<div class=sidebar>Side</div>{held}<div class=sidebar-left>Left</div><form>Find</form>") + "<footer>Foot</footer>"
            assert main_text(page) == " ".join([text] * held.count(text)), wrap
    comments = f"<div class=post-comments><p>{text * 20}</p></div>"
    assert main_text(f"<body class=fixed-header><article><p>{text}</p>{comments}</article>{comments}<div class='cookie-notice'><p>{text * 9}</p></div>") == text
    assert main_text(f"<body><div class=entry><p>{text}</p></div>{comments}") == text
    assert main_text(f"<body><form><article><p>{text}</p><form>Mail</form></article><p>{text}</p></form>").startswith(text)


def test_main_text_with_a_long_part(spark):
    one, two = "A first paragraph of the article, long enough to count as one.", "A last paragraph of the article, also long enough to count as one."
    for tag, item in (("ul", "li"), ("blockquote", "p"), ("section", "p"), ("div", "p")):
        part = " ".join(f"Part {i} of what is listed, quoted or told in a place of its own." for i in range(9))
        for page in (f"<div class=x><p>{one}</p><{tag}><{item}>{part}</{tag}><p>{two}</p></div>", f"<div class=x><section><p>{one}</p></section><{tag} class=y><{item}>{part}</{tag}><div><p>{two}</p></div></div>",
                     f"<article><div><div><div><{tag}><{item}>{part}</{tag}></div></div></div><section><p>{two}</p></section></article>"):
            html = f"<body><nav><a href=/>Home</a></nav>{page}<div><ul><li><a href=/1>{one}</a><li><a href=/2>{two}</a></ul></div><footer>Foot</footer>"
            want = " ".join([one, part, two] if "class=x" in page else [part, two])
            assert main_text(html) == want, page
    rows = [(i, "http://a.example/", html) for i in range(3)]
    assert [r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == [want] * 3


def test_toxicity_grammar():
    grammar = toxicity.Grammar({"idiot": 2.0})
    plain, not_so, told, at_you = (grammar.features(t)[0] for t in ("an idiot here", "not an idiot here", "they said an idiot here", "you idiot"))
    assert at_you > plain > told > not_so > 0 and grammar.features("a fine day") == grammar.features(None) == (0.0, 0.0, 0.0)
    assert grammar.features("they will kill you")[0] > 0 == grammar.features("they skill you")[0]


def test_toxicity_learns_and_keeps_rows(spark):
    rows = [(i, f"{'you are a grumbler and a grumbler ' if i % 3 == 0 else 'a fine day number '}{chr(97 + i % 26)}{chr(97 + i // 26)} {chr(98 + i % 20)}") for i in range(90)]
    docs = spark.createDataFrame([*rows, (None, None), (900, ""), (0, rows[0][1])], DOC)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(got) == 93 and all(r.predicted == int(r.doc_id is not None and r.doc_id < 90 and r.doc_id % 3 == 0) for r in got)
    assert [r.score < 1e-6 for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.limit(0))).collect()] == [True] * 93


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "Hello, WORLD. It's <|x|> 12 naïve ΣΑΣ Å x...y!", EN * 900, "a " * 9000, FR * 300]
    docs = spark.createDataFrame([*enumerate(texts), (None, "x"), (3, texts[3])], DOC).coalesce(1)
    got, real = packing.pack(docs, word_tokenizer()).collect(), Tokenizer.from_file(word_tokenizer())
    assert sum(r.length for r in got) == sum(len(real.encode(t or "", add_special_tokens=False).ids) + 1 for t in [*texts, "x", texts[3]])
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096 and packing.pack(docs.limit(0), word_tokenizer()).count() == 0


def test_ids_are_those_of_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["", " ", "a\x0bb\x0cc d \u0308e", "\u0130stanbul \u01c5. ÀÉ! \u00b5m ªº", "don't <|endoftext|>x.", "e\u0301 ß ẞ 5.5 中文。 x.!", "\n\n. a", "\u0133\u0149 \u012e, Æ? ſ", "ai%%% a.,"]
    path, real = word_tokenizer(), Tokenizer.from_file(word_tokenizer())
    for encoded in (packing.encode(pa.array(["x", *texts]).slice(1), path), (e for t in texts for e in packing.encode(pa.array([t]), path))):
        for text, (ids, _) in zip(texts, encoded, strict=True):
            assert ids.tolist() == [*real.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_cuts_are_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        ends = np.cumsum(rng.integers(1, 7, 12)).tolist()
        penalties = rng.integers(0, 4, 12).tolist()

        def cost(found):
            pads = [0 if n & (n - 1) == 0 else 16 - n for n in np.diff([0, *found]).tolist()]
            return sum(pads) + sum(penalties[ends.index(e)] for e in found)

        best = {0: 0}
        for e, p in zip(ends, penalties):
            best[e] = min(best[s] + (0 if (e - s) & (e - s - 1) == 0 else 16 - e + s) + p for s in best if e - s <= 16)
        assert cost(packing.cuts(ends, penalties, 16)) == best[ends[-1]]


def test_line_dedup(spark):
    rows = [(i, f"own {i}\n shared line \n\nx", f"s{i % 5}") for i in range(6)] + [(10, None, "s1"), (11, "", None), (None, "shared line", None), (0, "own 0\n shared line \n\nx", "s0")]
    got = line_dedup.drop_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text, r.n_removed) for r in got.collect() if r.doc_id in (1, 2, 10, 11)) == [(1, "own 1\n", 2), (2, "own 2\n", 2), (10, None, 0), (11, "", 0)]
    assert line_dedup.drop_spread_lines(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_url_verdicts(spark):
    rules = spark.createDataFrame([("example.org", "/en/1", "block"), ("org", "/", "allow"), (None, "/", "block"), ("org", "/", "block")], "host string, path string, verdict string")
    rows = [(1, "http://X.Example.ORG/en/12?q"), (2, "https://org/"), (3, "http://badexample.com/"), (4, None), (5, "no scheme"), (6, "http://example.org"), (1, "http://X.Example.ORG/en/12?q")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' as rule"), rules).fillna("-", ["rule"]).collect())
    assert got == [
        (1, "x.example.org", "/en/12", "example.org/en/1", "block"), (1, "x.example.org", "/en/12", "example.org/en/1", "block"), (2, "org", "/", "org/", "block"),
        (3, "badexample.com", "/", "-", "allow"), (4, "", "", "-", "allow"), (5, "", "", "-", "allow"), (6, "example.org", "", "-", "allow"),
    ]
    assert url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), rules.limit(0)).where("verdict = 'allow'").count() == 7


def test_contaminated(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (None, item), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, EN * 50 + item.upper() + " " + FR * 50), (2, item.replace("beta", "other")), (3, item.replace("eta theta", "x y")), (4, "a Short\titem b"), (5, None), (None, item), (1, EN)], DOC)
    got = sorted((r.doc_id, r.item_id, r.n_item, r.n_found) for r in decontaminate.contaminated(docs, items).collect())
    assert got == [(1, 1, 8, 8), (2, 1, 8, 6), (4, 2, 1, 1)]
    assert decontaminate.contaminated(docs, items.limit(0)).collect() == [] == decontaminate.contaminated(docs.limit(0), items).collect()


def test_languages(spark):
    rows = [(i, (EN if i % 2 else FR) * (1 + i % 5) + f" {i}", "en" if i % 2 else "fr") for i in range(40)] + [(50, None, "en"), (51, "12 34", "en"), (None, EN, "fr"), (52, EN, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit_languages(docs)).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") and got[i].score > 0.5 for i in range(40))
    assert got[50].lang_pred == got[51].lang_pred == "und" and got[50].score == 0 and got[None].lang_pred == "en"
    assert {r.lang_pred for r in langid.identify(docs, langid.fit_languages(docs.limit(0))).collect()} == {"und"}
