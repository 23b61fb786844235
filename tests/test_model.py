"""Page models, wanted section orders, typed lines and character references."""

import json

import pytest
from pyspark.sql import functions as F

from pdpspark.functions.text import unescape_basic
from pdpspark.operators import channels, model, sections

HOST = "https://x.example"


def models(spark, **trees):
    df = spark.createDataFrame([(k, None if t is None else json.dumps(t)) for k, t in trees.items()], "page_id string, json string")
    return df.select("page_id", F.parse_json("json").alias("model"))


def tree(*parts):
    return {":itemsOrder": [f"k{i}" for i in range(len(parts), 0, -1)], ":items": {f"k{len(parts) - i}": p for i, p in enumerate(parts)}}


D = "/content/dam/"


def deep():
    node = {":type": "x/text", "text": "deep"}
    for _ in range(10):
        node = {":type": "x/container", ":items": {"a": node}}
    return node


@pytest.fixture(scope="module")
def pages(spark):
    """Sections by page of one walk over all models."""
    found = model.model_sections(models(
        spark, none=None, empty={}, bare={":items": {}}, odd={":items": 3},
        deep=tree({":type": "x/faq", "title": "gone"}, deep(), {":type": "x/text", "text": "Lorem Ipsum dolor"}, {":type": "x/text", "text": "see /promotion/ now"}, "no node"),
        files=tree(
            {":type": "x/hero", "imageRef": D + "one-desktop.jpg", "imageRefMobile": D + "one-mobile.jpg", "imageRefTablet": D + "one-t.jpg", "iconImageRef": D + "i.png",
             "offIconImageRef": D + "o.png", "x": {"imageRef": D + "ONE-v2.jpg", "awardList": [{"iconImageRef": D + "badge.png"}]}},
            {":type": "x/side", "a": {"imageRefMobile": D + "two_m.png"}, "b": {"imageRef": D + "two.png"}},
            {":type": "x/sideimage", "animationRef": D + "f.mp4", "b": [[{"animationRef": D + "g.mp4", "thumb": D + "f_on.jpg"}]], "title": "Film"}),
        lists=tree({
            ":type": "x/tabs", "imageRef": D + "own.jpg", "fileReference": D + "a.jpg", ":itemsOrder": ["h"], ":items": {"h": {":type": "x/title", "text": "<p>Top</p>"}},
            "cards": [{"title": "Aa", "imageRef": D + "a.jpg"}, {"title": "Aa", "headline": "Aa"}, {"title": "B"}, {"desc": "Dd"}, {"desc": "Ee"}]})), HOST)
    by_page = {}
    for r in found.collect():
        by_page.setdefault(r.page_id, []).append(r)
    return {page: sorted(rows, key=lambda r: int(r.order)) for page, rows in by_page.items()}


def test_deep_tree_and_furniture(pages):
    assert set(pages) == {"deep", "files", "lists"}
    assert [(r.order, r.component_id, r.dom, r.text, r.media, r.layout_type) for r in pages["deep"]] == [("1", "AEM:text", 0, "deep", [], "text_block")]


def test_pairs_of_files(pages):
    at = HOST + D
    assert [(r.text, [(m.kind, m.pc_url, m.mobile_url) for m in r.media], r.layout_type) for r in pages["files"]] == [
        ("", [("image", at + "one-desktop.jpg", at + "one-mobile.jpg"), ("image", at + "badge.png", "")], "hero_full_width"),
        ("", [("image", at + "two_m.png", at + "two_m.png")], "hero_full_width"),
        ("## Film", [("video", at + "f.mp4", "")], "text_block")]


def test_lists(pages):
    """A text of one character is none, so the third entry goes; it still counts for the grid."""
    assert [(r.order, r.dom, r.item_group, r.group_heading, r.text, [m.pc_url[-7:] for m in r.media], r.layout_type, r.columns) for r in pages["lists"]] == [
        ("1", -1, False, "", "## Top", ["own.jpg"], "hero_full_width", 1), ("2", 0, True, "Top", "## Aa", ["m/a.jpg"], "grid_3_column", 3),
        ("3", 0, True, "Top", "## Aa", [], "grid_3_column", 3), ("4", 0, True, "Top", "Dd", [], "grid_3_column", 3), ("5", 0, True, "Top", "Ee", [], "grid_3_column", 3)]


def test_overview_carousels(spark):
    one = {":type": "x/carousel", ":items": {"s": {":items": {"title": {"text": "Only"}}}, "t": {}}}
    six = {":type": "x/carousel", ":itemsOrder": list("abcdef"), ":items": {k: {"mediaDescriptionModel": {"imageRef": f"{k}.jpg"}} for k in "abcdef"}}
    got = model.overview_sections(models(spark, a=tree(one, six, {":type": "x/heroimage", "mediaDescriptionModel": {"imageRef": "http://y/z.jpg"}}), b=None, c={}), HOST)
    rows = got.orderBy("dom", "slide").collect()
    assert [(r.dom, r.slide, r.text, r.layout_type, r.item_group, r.column_count) for r in rows[:2]] == [
        (5000, 0, "## Only", "image_text_right", False, 1), (5001, 0, "", "grid_4_column", True, 4)]
    assert len(rows) == 8 and rows[-1].overlay is None and rows[-1].media[0].pc_url == "http://y/z.jpg" and rows[1].media[0].pc_url == HOST + "/a.jpg"


@pytest.mark.parametrize("text, plain", [
    ("a &amp;lt; b", "a &lt; b"), ("&#38;lt;", "&lt;"), ("&#x1F600;&#8364;&euro;", "\U0001F600€€"), ("&#0;&#xD800;&#99999999;", "���"),
    ("&nope; & &amp &", "&nope; & &amp &"), ("&#0039;&apos;&#39 x", "''' x"), ("", ""), (None, "")])
def test_character_references(spark, text, plain):
    assert spark.createDataFrame([(text,)], "t string").select(unescape_basic("t")).first()[0] == plain


def test_order_guard(spark):
    rows = [(page, at, at in (1, 3)) for page in "abcdefg" for at in (1, 2, 3, 4, 5)] + [("h", 1, None), ("h", 2, False)]
    found = spark.createDataFrame(rows, "page_id string, sec_ord int, disclaimer boolean")
    asked = {"a": [5, 4, 2], "b": [5, 4], "c": [5, 4, 2, 2], "d": [5, 4, 3, 2], "e": [5, 4, None], "f": [5, 4, 9], "h": [2, 1], "z": [1]}
    wanted = spark.createDataFrame([(p, i, at) for p, order in asked.items() for i, at in enumerate(order)], "page_id string, place int, sec_ord int")
    got = {}
    for r in sections.reorder_sections(found, wanted).orderBy("page_id", "place").collect():
        got.setdefault(r.page_id, []).append(r.sec_ord)
    assert got == {"a": [1, 5, 4, 2, 3], "h": [2, 1]} | {p: [1, 2, 3, 4, 5] for p in "bcdefg"}
    assert sections.reorder_sections(found.limit(0), wanted).count() == 0


@pytest.mark.parametrize("said, kinds", [
    ("**Bold**\nShort title\nbody", ["bold", "title", "body"]), ("* note\n※ note two\nShort\nShort", ["disclaimer", "disclaimer", "title"]),
    ("**Bold**\n# Head\nShort", ["bold", "heading", "body"]), ("x" * 71 + "\nShort", ["body", "body"]), ("", []), (None, [])])
def test_title_waits_for_the_first_plain_line(spark, said, kinds):
    lines = channels.typed_lines(spark.createDataFrame([(1, said)], "id int, text string"), ["id"])
    assert [r.kind for r in lines.orderBy("line").collect()] == kinds
