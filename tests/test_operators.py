from pyspark.sql import functions as F

from pdpspark.operators import channels, media, qa, sections, store


def test_rehome_and_posters(spark):
    md = [(1, 0, "Nice caption text"), (1, 1, "[PC_IMAGE: https://x/a.jpg]"), (1, 2, "![p](https://x/poster.jpg)"), (1, 3, ""), (1, 4, "[PC_VIDEO: https://x/v.mp4]")]
    lines = spark.createDataFrame(md, "page_id long, n int, line string")
    caps = media.captions(lines, ["page_id"], ["n"])
    rows = {r.url: r.caption for r in caps.collect()}
    assert rows["https://x/a.jpg"] == "Nice caption text"
    posters = media.pair_posters(lines, ["page_id"], ["n"]).collect()
    assert [(r.video, r.poster) for r in posters] == [("https://x/v.mp4", "https://x/poster.jpg")]
    secs = spark.createDataFrame([(1, 0, "other", False), (1, 1, "## H\nNice caption text", False)], "page_id long, sec_ord int, text string, is_disclaimer boolean")
    m = spark.createDataFrame([(1, 0, "https://x/a.jpg?w=1"), (1, 1, "https://x/b.jpg")], "page_id long, sec_ord int, url string")
    out = {r.url: (r.moved_to, r.new_section) for r in media.rehome(m, secs, caps, ["page_id"]).collect()}
    assert out == {"https://x/a.jpg?w=1": (1, False), "https://x/b.jpg": (None, False)}


def test_inject_enrich_backfill(spark):
    lines = spark.createDataFrame([(1, 0, "Alpha"), (1, 1, "Beta https://x/known.jpg")], "page_id long, line_no int, line string")
    m = spark.createDataFrame([(1, 0, "[PC_IMAGE: a]", "https://x/a.jpg", "Alpha"), (1, 1, "[k]", "https://x/known.jpg", "Beta"), (1, 2, "[t]", "https://x/t.jpg", "Nowhere")],
                              "page_id long, pos int, tag string, url string, anchor string")
    out = [r.line for r in media.inject_tags(lines, m, ["page_id"]).orderBy("line_no", "sub").collect()]
    assert out == ["Alpha", "[PC_IMAGE: a]", "Beta https://x/known.jpg", "[t]"]
    flow = spark.createDataFrame([(1, 0, "media", None, ["https://y/p/f.jpg?x"]), (1, 1, "text", "## Head\nx", []),
                                  (1, 2, "text", "A woman is shown in a bright room with a phone on the table.", [])],
                                 "page_id long, seq int, content_type string, text_content string, urls array<string>")
    mi = spark.createDataFrame([(1, 3, "https://z/f.jpg"), (1, 7, "https://q/f.jpg")], "page_id long, dom_index int, url string")
    ti = spark.createDataFrame([(1, 4, "Head"), (1, 5, "A woman is shown in a bright room with a phone on the table."[:50])], "page_id long, dom_index int, text string")
    done = media.enrich(flow, mi, ti)
    assert {r.seq: r.dom_index for r in done.collect()} == {0: 7, 1: 4, 2: 5}
    roles = spark.createDataFrame([(1, 5, "Eye", "Real head", None)], "page_id long, dom_index int, eyebrow string, headline string, body string")
    texts = {r.seq: r.text_content for r in media.backfill_text(done, roles).collect()}
    assert texts[2] == "Eye\n## Real head" and texts[1] == "## Head\nx"


def test_match_cards_and_features(spark):
    cards = spark.createDataFrame([(1, 0, "Silent Motor"), (1, 1, "Fast Wash"), (1, 2, "Other")], "sec long, card_ord int, headline string")
    images = spark.createDataFrame([(1, 0, "/x/one.jpg", "fast wash"), (1, 1, "/x/silent.jpg", ""), (1, 2, "/x/three.jpg", "")], "sec long, img_ord int, url string, alt string")
    got = {r.card_ord: r.url for r in channels.match_cards(cards, images, ["sec"]).collect()}
    assert got == {0: "/x/silent.jpg", 1: "/x/one.jpg", 2: None}
    f = spark.createDataFrame([(1, 0, ["a.jpg"], "X"), (1, 1, [], "Perfect Black for all")], "p long, feature_ord int, files array<string>, headline string")
    c = spark.createDataFrame([(1, 0, ["b.jpg"], "perfect black"), (1, 1, ["a.jpg"], "zzz")], "p long, comp_ord int, files array<string>, headline string")
    assert {r.feature_ord: r.comp_ord for r in media.match_features(f, c, ["p"]).collect()} == {0: 1, 1: 0}


def test_card_rows_heading(spark):
    card = [("i1", "## A")], [("i2", "## B")]
    rows = [(1, 0, 5, False, False, 0, "## Group", "", []), (1, 1, 6, True, False, 2, "## A", "", card[0]), (1, 2, 6, True, False, 2, "## B", "", card[1])]
    df = spark.createDataFrame(rows, "page_id long, ord int, dom_index int, card_like boolean, disclaimer boolean, column_count int, text string, group_heading string, cards array<struct<img:string,text:string>>")
    made, others = sections.card_rows(df, ["page_id"], ["ord"], block=False)
    row = made.first()
    assert (row.heading, row.cols, len(row.cards)) == ("## Group", 2, 2) and others.count() == 0


def test_expand_and_summary_rules(spark):
    f = spark.createDataFrame([(1, "single", 1, "Head", "Sub", "Body", [("a", "Head", "x"), ("b", "Head", "x")]), (1, "grid", 3, "Row", "", "", [("a", "t®", ""), ("b", "u", ""), ("c", "v", "")])],
                              "p long, kind string, per_row int, headline string, subheadline string, body string, cards array<struct<image:string,title:string,body:string>>")
    out = channels.expand_features(f, ["p"]).collect()
    assert sorted((r.kind, r.split, r.subheadline, len(r.cards)) for r in out) == [("grid", 0, "", 3), ("single", 0, "Sub", 1), ("single", 1, "", 1)]
    s = spark.createDataFrame([("Name", "i" * 700, ["a", "b"], [("l", "v")], 3)], "product_name string, intro string, highlights array<string>, product_info array<struct<label:string,value:string>>, n_usps int")
    assert channels.summary_rules(s).first().problems == ["highlight_count"]


def test_coverage_report_and_listing_blocks(spark):
    texts = spark.createDataFrame([(1, 0, "aaa", True), (1, 1, "bbb", False)], "page_id long, node int, text string, missing boolean")
    images = spark.createDataFrame([(1, 0, "u?x", True, False, False)], "page_id long, image int, url string, missing boolean, found boolean, dead boolean")
    r = qa.coverage_report(texts, images).first()
    assert (r.texts_total, r.texts_missing, r.images_missing, r.missing_texts, r.missing_images) == (2, 1, 1, ["aaa"], ["u"])
    cur = spark.range(1).select("id", F.expr("map('details','D','promotion',' ','returns','R')").alias("fields"), F.expr("map('returns','Mine')").alias("titles"))
    rows = channels.listing_blocks(cur, ["id"]).orderBy("block_ord").collect()
    assert [(x.place, x.field, x.title) for x in rows] == [("bottom", "details", "Product Details"), ("bottom", "returns", "Mine")]


def test_moves_frames_and_view(spark):
    m = spark.createDataFrame([(1, 0, 0, "https://x/a-1.jpg"), (1, 0, 1, "https://x/b.jpg")], "page_id long, sec_ord int, media_ord int, url string")
    moves = spark.createDataFrame([(1, "a-1", 4, 0)], "page_id long, image string, to_section int, move_ord int")
    assert {r.url: r.sec_ord for r in sections.apply_moves(m, moves).collect()} == {"https://x/a-1.jpg": 4, "https://x/b.jpg": 0}
    kind = "page_id long, media array<struct<pc_url:string,mobile_url:string,unified_url:string,type:string,role:string>>"
    secs = spark.createDataFrame([(1, [("v.mp4", "", "", "video", "content")]), (2, [("v-m.mp4", "", "", "video", ""), ("w.mp4", "", "", "video", ""), ("p.jpg", "", "", "image", "content")])], kind)
    black = spark.createDataFrame([("p.jpg",)], "url string")
    assert {(r.page_id, r.video, r.reason) for r in media.frames_needed(secs, black).collect()} == {(1, "v.mp4", "missing"), (2, "w.mp4", "black")}
    one = lambda v: spark.createDataFrame([("s", v)], f"slug string, v{v} int")
    assert store.product_view(one(1), one(2), one(3), one(4)).first().v4 == 4
