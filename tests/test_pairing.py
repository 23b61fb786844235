"""Markdown sections, title and image pairing, selling points: cases that the given tables hold rarely, and long groups."""

import random

from pyspark.sql import functions as F

from pdpspark.operators import channels, extract, markdown, sections

LONG = "a text that is surely longer than any short label could ever be, so that it counts as body"


def md(spark, text):
    found = markdown.md_sections(extract.md_tokens(spark.createDataFrame([(1, text)], "page_id long, md string")))
    heads = [(r.seg, r.headline, r.eyebrow, r.is_title) for r in found.sections.orderBy("seg").collect()]
    words = [(r.seg, r.kind, r.text) for r in found.texts.orderBy("seg", "i").collect()]
    pics = {(r.seg, r.url.rsplit("/", 1)[-1], r.title, r.matched_by) for r in found.assets.collect()}
    return heads, words, pics


def pic(name, alt="", folder="a"):
    return f"![{alt}](https://h.com/{folder}/{name}.jpg)"


def test_images_before_and_behind_a_heading(spark):
    text = "\n".join([
        "# Product", LONG, pic("p1"), "Fresh air", "## First", LONG, pic("p2", "Drum in motion"), "Drum in motion", LONG, pic("p3"), pic("p4"), pic("p5"), "## Second", "\\* a note",
        "## Recently Viewed", pic("p6"), LONG, "## Third", pic("p7"), LONG, "Learn more", pic("g1", folder="gallery"), "## Warranty", pic("p8")])
    heads, words, pics = md(spark, text)
    assert heads == [(1, "Product", "", True), (2, "First", "Fresh air", False), (3, "Second", "", False), (5, "Third", "", False)]
    assert words == [(1, "body", LONG), (2, "body", LONG), (2, "body", LONG), (3, "disclaimer", "* a note"), (5, "body", LONG)]
    assert pics == {
        (2, "p1.jpg", None, "doc-order"), (2, "p2.jpg", None, "doc-order-trailing"), (None, "p3.jpg", None, "unassigned"), (3, "p4.jpg", None, "doc-order"),
        (3, "p5.jpg", None, "doc-order"), (5, "p7.jpg", None, "doc-order"), (None, "g1.jpg", None, "gallery")}


def test_runs_of_cards_and_what_waits_at_the_end(spark):
    text = "\n".join(["# Product", "## Why", LONG, pic("c1"), "Fast", "more on it", pic("c2"), "See more", "Quiet", pic("c3"), LONG, pic("w1"), "Label", "not a heading " * 5])
    _, words, pics = md(spark, text)
    assert {p for p in pics if p[3] == "card-pair"} == {(2, "c1.jpg", "Fast", "card-pair"), (2, "c2.jpg", "Quiet", "card-pair")}
    assert (2, "body", "more on it") in words and (None, "w1.jpg", None, "unassigned") in pics


def walk(blocks):
    out, title, main, steps, n = [], None, False, 0, 0
    for i, h, im, p in blocks:
        if title is not None:
            steps += 1
            if steps > 10:
                title, steps = None, 0
        if h and not im:
            if title is None or p or not main:
                title, main, steps, n = i, p, 0, 0
        elif im and not h and title is not None:
            out.append((i, title))
            n += 1
            if n == 3:
                title, steps = None, 0
        elif h and im and (title is None or not main or p):
            title, steps = None, 0
    return out


def test_contending_titles_match_the_walk(spark):
    rng = random.Random(5)
    pages = {k: [(i, rng.random() < a, rng.random() < b, rng.random() < c) for i in range(400)] for k, (a, b, c) in enumerate([(0.5, 0.5, 0.5), (0.2, 0.3, 0.1), (0.1, 0.1, 0.9), (0.9, 0.2, 0.3)])}
    df = spark.createDataFrame([(k, *b, "x") for k, bs in pages.items() for b in bs], "page_id long, i long, has_heading boolean, has_image boolean, primary boolean, note string")
    got = sections.pair_generic(df, ["page_id"], "i").collect()
    assert {(r.page_id, r.i, r.title_at) for r in got} == {(k, *x) for k, bs in pages.items() for x in walk(bs)} and len(got) > 100


def test_selling_points_join_in_page_order(spark):
    texts = ["> no title here", "## Smart Inverter\nquiet", "loose words", "## smart  inverter compressor\nlasting", "## Fresh\nair", "## SMART INVERTER\nquiet", "after a repeat", "## ™\nlost", "## Compressor\nfar"]
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "id long, n long, text string")
    got = [(r.place, r.title, r.desc) for r in channels.usp_list(blocks, ["id"], ["n"]).orderBy("place").collect()]
    assert got == [(1, "no title here", ""), (2, "Smart Inverter", "quiet loose words lasting"), (3, "Fresh", "air after a repeat"), (4, "Compressor", "far")]


def test_selling_points_of_a_large_product(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("id"), F.col("id").alias("n"), F.concat(F.lit("## Point "), F.lpad(F.hex("id"), 5, "0"), F.lit("\ntext")).alias("text"))
    more = spark.createDataFrame([(1, 30_000, "## all of Point 00007 here\nmore")], "id int, n long, text string")
    got = channels.usp_list(rows.unionByName(more), ["id"], ["n"])
    assert got.count() == 20_000 and [r.desc for r in got.where("title = 'Point 00007'").collect()] == ["text more"]
