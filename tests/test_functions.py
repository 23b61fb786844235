from pyspark.sql import functions as F

from pdpspark.functions import rules, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_slug_and_keys(spark):
    assert one(spark, urls.slugify(F.lit("https://www.shop.example/th/ü-1/?a=1"))) == "www-shop-example-th-ü-1-a-1"
    assert one(spark, urls.slugify(F.lit("http://shop.example/ü/"), ascii=True)) == "shop-example"
    assert one(spark, urls.sku_keys(F.lit("oled65g6psa.atm + b-12 34|Abc"))) == ["OLED65G6PSA", "OLED65G6PSAATM", "B1234"]
    assert one(spark, urls.country_of(F.lit("https://x.example/sa_en/a/"))) == "sa"
    assert one(spark, urls.model_of(F.lit("https://x.example/th/tv/oled55.html"))) == "OLED55"
    assert one(spark, urls.path_segments(F.lit("not a url"))) is None or one(spark, urls.model_of(F.lit("https://x.example"))) == ""
    assert one(spark, urls.title_case(F.lit("air-care_mk2 x"))) == "Air Care Mk2 X"


def test_srcset_rules(spark):
    s = F.lit("/d/tv-75,65/a b-d.jpg 800w, /d/c.jpg 2x")
    assert one(spark, urls.srcset_first(s)) == "/d/tv-75,65/a%20b-d.jpg"
    assert one(spark, urls.srcset_first(s, srcset_fix=False)) == "/d/tv-75"
    assert one(spark, urls.srcset_best(F.lit("a.jpg 400w, b.jpg 2x, c.jpg"))) == "b.jpg"
    assert one(spark, urls.srcset_best(F.lit("a.jpg, b.jpg"))) == "a.jpg"


def test_media_addresses(spark):
    assert one(spark, urls.css_unescape(F.lit(r"\2f content\2f a\3a b.jpg"))) == "/content/a:b.jpg"
    assert one(spark, urls.effective_width(F.lit("x/thum-350x350.jpeg"))) == 350
    assert one(spark, urls.effective_width(F.lit("x/a.jpg?w=99"))) == 99
    assert one(spark, urls.effective_width(F.lit("x/a.jpg"))) == 100000
    assert one(spark, urls.col_letters(F.lit(703))) == "AAA"
    assert one(spark, rules.is_award(F.lit("/a/award-winning-x.jpg"))) is False
    assert one(spark, rules.is_award(F.lit("/a/awards/x.jpg"))) is True
    assert one(spark, urls.fix_dup_dam(F.lit("/content/dam/channel/wcms/content/dam/channel/wcms/a.jpg"))) == "/content/dam/channel/wcms/a.jpg"


def test_scene_text(spark):
    scene = "A family with children sits together on a sofa in a bright living room, holding a remote."
    assert one(spark, text.is_image_description(F.lit(scene))) is True
    assert one(spark, text.is_image_description(F.lit(f"![{scene}](x.jpg)"))) is True
    assert one(spark, text.is_image_description(F.lit("Perfect Black, Perfect Colour"))) is False
    assert one(spark, text.strip_descriptions(F.lit(f"## Head\n{scene}\n\nBody ![alt](u.jpg) text"))) == "## Head\n\nBody  text"


def test_clean_lines(spark):
    raw = "| --- |\n| cell |\nLearn more\nTime travel**\nSee eyes7) here\n\n\n\nEnd"
    assert one(spark, text.clean_text_lines(F.lit(raw))) == "cell\nTime travel\nSee eyes here\n\nEnd"


def test_only_ui_and_disclaimers(spark):
    assert one(spark, text.only_ui(F.lit("Summary"), F.lit(""))) is True
    assert one(spark, text.only_ui(F.lit("Nice picture previous video paused"), F.lit("anicepictureb"))) is True
    assert one(spark, text.only_ui(F.lit("Other words"), F.lit("x"))) is False
    out = one(spark, text.split_disclaimers(F.lit("*note\n**bold**\n※ x\n1) first\nline"), numbered=True))
    assert (out.disclaimer, out.normal) == ("*note\n※ x\n1) first", "**bold**\nline")


def test_log_line(spark):
    log = "start\nTraceback\nmy.mod.ValueError: bad thing\ndone"
    assert one(spark, text.pipeline_error(F.lit(log))) == "ValueError: bad thing"
    assert one(spark, text.pipeline_error(F.lit("x\njson.decoder.JSONDecodeError: y"))).startswith("The AI analysis")


def test_roles_and_symbols(spark):
    roles = one(spark, text.roles_of(F.lit("Small name\n## Head\nbody\n*note")))
    assert [(r.role, r.text) for r in roles] == [("eyebrow", "Small name"), ("headline", "Head"), ("body", "body")]
    assert one(spark, text.strip_symbols(F.lit("Fast® (™) drive * ."))) == "Fast drive."


def test_classification(spark):
    out = one(spark, rules.classify(F.lit("https://x.example/th/tvs-soundbars/oled/oled65/")))
    assert (out.cat, out.dv, out.grp) == ("TV", "MS", "TV")
    out = one(spark, rules.classify(F.lit("https://x.example/th/laundry/dryers/rc90/")))
    assert (out.cat, out.dv, out.grp) == ("Washer", "HS", "Dryer")
    out = one(spark, rules.classify(F.lit("https://x.example/de/laundry/washer-dryers/f4/")))
    assert out.grp == "Washer"


def test_page_check(spark):
    body = "<link rel=\"canonical\" href=\"https://x.example/th/other/m1/\">" + "x" * 6000
    assert one(spark, rules.page_check(F.lit(body), F.lit("https://x.example/th/tv/m1/"))).ok is True
    assert one(spark, rules.page_check(F.lit(body), F.lit("https://x.example/th/tv/m2/"))).reason == "different page"
    assert one(spark, rules.page_check(F.lit("short"), F.lit("https://x.example/a/"))).reason == "too short: 5"


def test_truncate(spark):
    md = "a" * 50 + "\nReviews here\nrest"
    assert one(spark, rules.truncate_md(F.lit(md), F.lit("Reviews here"))) == "a" * 50
    assert one(spark, rules.truncate_md(F.lit("Reviews here" + md), F.lit("Reviews here"))) == "Reviews here" + md
