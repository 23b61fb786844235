"""Findings of round 3: texts and tasks that grew with the input, and rules that took the square of a text's lines."""

import time

import pyarrow as pa
from pyspark.sql import functions as F

from pdpspark.functions import urls
from pdpspark.operators import channels, extract, jobs, markdown, match, media, ordered
from pdpspark.plans import registry
from pdpspark.session import dealt


def test_long_texts_do_not_meet_the_rows(spark, capsys):
    rows = spark.createDataFrame([(1, 1, "ok", "x"), (2, 2, "ok", "y "), (3, 9, "ok", "z"), (4, 1, None, "w")], "row int, slug int, status string, old string")
    content = spark.createDataFrame([(1, "t" * 40000), (2, "new")], "slug int, text string")
    out = jobs.fill_descriptions(rows, content)
    out.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out
    assert {r.row: (r.value, r.prev_len, r.fill_error) for r in out.collect()} == {
        1: ("x", None, "too long for one cell: 40000"), 2: ("new", 1, None), 3: ("z", None, None), 4: ("w", None, None)}


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    df = spark.range(1000).withColumn("k", F.col("id") % 100)
    assert dealt(df, ["k"], 1000, 10).rdd.getNumPartitions() == 100
    assert dealt(df, ["k"], 1000).rdd.getNumPartitions() == df.rdd.getNumPartitions()
    seen = []
    monkeypatch.setattr(ordered, "dealt", lambda d, keys, rows: seen.append((list(keys), rows)) or d)
    assert ordered.renumber(df, ["k"], ["id"], "n").agg(F.max("n")).first()[0] == 10
    assert seen == [(["k"], 1000)]


def test_wide_tables_are_spread_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(registry, "TASK_TEXTS", 10)
    assert registry.spread(spark.range(200, numPartitions=6), "id").rdd.getNumPartitions() == 20


def test_typed_lines_of_a_long_text(spark):
    lines = [f"Line number {i % 3000} of the text" for i in range(4000)] + ["## Line number 7 of the text", "**Bold one**"]
    began = time.time()
    out = channels.typed_lines(spark.createDataFrame([(1, "\n".join(lines))], "id int, text string"), ["id"]).orderBy("line").collect()
    assert time.time() - began < 30
    assert len(out) == 3001 and [r.kind for r in out[:2]] == ["title", "body"] and out[-1].kind == "bold"
    assert [(r.line, r.kind, r.content) for r in out if r.content == "Line number 7 of the text"] == [(4000, "heading", "Line number 7 of the text")]


def test_node_batches_are_bounded_by_text():
    page = "<div><div><div><p>" + "word " * 4000 + "</p></div></div></div>"
    pages = pa.RecordBatch.from_pydict({"page_id": pa.array(range(100)), "html": [page] * 100})
    made = list(extract._node_batches(iter([pages])))
    assert sum(b.num_rows for b in made) == 400 and max(b.num_rows for b in made) < 40
    assert [r for b in made for r in b.column(0).to_pylist()] == [i for i in range(100) for _ in range(4)]


def test_key_rows_equal_key_arrays(spark):
    said = [(1, "AB12.X + cd_34 and EF56GH", ""), (2, None, "Q-12345"), (3, " , ", None), (4, ".ABCD", "xy/zz11 22")]
    df = spark.createDataFrame(said, "row int, a string, b string")
    arrays = {(r.row, r.tier, r.key) for r in match.exploded_keys(df, "row", ["a", "b"]).collect()}
    assert {tuple(r) for r in match.sku_key_rows(df, "row", ["a", "b"]).collect()} == arrays and arrays
    names = {(r.row, r.key) for r in df.select("row", F.explode(urls.name_keys("a")).alias("key")).collect()}
    assert {tuple(r) for r in match.name_key_rows(df, "row", "a").collect()} == names and names


def test_markdown_tokens_are_dealt(spark, monkeypatch):
    md = "# One\ntext\n![a](https://h.com/content/dam/a.jpg)\nafter\n# Two\nmore"
    tokens = extract.md_tokens(spark.createDataFrame([(i, md) for i in range(8)], "page_id int, md string"))
    rows = lambda: sorted(map(repr, markdown.md_sections(tokens).texts.collect()))
    plain = rows()
    monkeypatch.setattr(markdown, "TASK_TOKENS", 4)
    assert rows() == plain


def test_geometry_is_dealt(spark, monkeypatch):
    assets = spark.createDataFrame([(1, i, f"https://x/{i}-m.jpg", []) for i in range(6)], "page int, id int, url string, variants array<string>")
    geo = spark.createDataFrame([(1, f"https://x/{i}-d.jpg?w=1", 5, i, 1) for i in range(4)], "page int, src string, rw int, rt int, rl int")
    seen = []
    monkeypatch.setattr(media, "dealt", lambda d, keys, rows: seen.append((keys, rows)) or dealt(d, keys, rows, 1))
    out = {r.id: r.geo and r.geo.rt for r in media.merge_geometry(assets, geo, ["page"], ["id"]).collect()}
    assert out == {0: 0, 1: 1, 2: 2, 3: 3, 4: None, 5: None}
    assert seen == [(["page", "__k"], 4), (["page", "__k"], 6), (["page", "id"], 6), (["page", "id"], 6)]
