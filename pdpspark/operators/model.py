"""Page models (H16): component trees as VARIANT, walked level by level until a level is empty, and the sections they hold.

Nodes are rows; a node's place is an array of positions, so page order is array order. All that follows the walk (texts, desktop and mobile
pairing, list items, slides) groups by component. VARIANT keeps no key order: children without `:itemsOrder` and images of one node come by name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.text import plain_html, trim_ws, unescape_basic
from ..session import cut_lineage

# Component types, keys and limits of page models.
CONTAINERS = r"/(parsys|container|responsivegrid|xfpage|experiencefragment|tabs?|productoverview|carousel)$"
SKIPPED = (
    r"/(faq|joinmembers|socialshare|productcardbuttons|klarnapopup|breadcrumb|reviews?|buyingguide|countdown|cookie|productpage|wheretobuy|"
    r"personalizationbanner)$")
SALES_PATHS = "(?i)/subscribe/|/promotion/|/sample/"
LIST_KEYS = (
    "keyBenefitsSummaryItems", "blockImageList", "featureIconTabsList", "mediaDescriptionList", "mediaContent", "items", "slides", "cards", "tabList",
    "iconList")
TEXT_KEYS = (
    "eyebrow", "keyBenefitsTitleText", "imageText", "jcrTitle", "title", "headline", "subTitle", "subtitle", "keyBenefitsContentDesc", "description",
    "bodyCopy", "bodycopy", "desc")
TITLE_KEYS = ("keyBenefitsTitleText", "imageText", "jcrTitle", "title", "headline")
UNREAD_KEYS = ("dataLayer", "ctaModel", "scheduleUsabilityModel")
IMAGE_FILE, VIDEO_FILE = r"(?i)\.(jpe?g|png|webp|gif)$", r"(?i)\.(mp4|webm|mov)$"
ON_OFF = r"(?i)[_-](on|off)\.[a-z]+$"
TEXT_DEPTH, MEDIA_DEPTH, ALT_CHARS = 8, 10, 250
SIDE_BY_SIDE, FULL_WIDTH = ("sideimage", "imagetext", "textimage"), "hero_full_width"
FOLDING = ("imagetextfoldingfeature", "imagelayeredtext", "imagectaoverlay", "blockimage")

LAST = 1_000_000  # place of a node's children after all its other keys
UNIT = ["page_id", "at", "item"]


def _get(node: Column | str, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, f"$['{key}']", kind)


def _is(node: Column | str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith(kind), F.lit(False))


def _order(node: Column | str) -> Column:
    """Names of a node's children in order; empty where it lists none."""
    return F.coalesce(_get(node, ":itemsOrder", "array<string>"), F.array().cast("array<string>"))


def _places(order: Column, name: Column, fallback: Column) -> Column:
    """Every place of a name in the order; its place among the keys where there is no order."""
    hits = F.filter(F.transform(order, lambda n, i: F.when(n == name, i)), lambda i: i.isNotNull())
    return F.when(F.size(order) > 0, hits).otherwise(F.array(fallback))


def components(models: DataFrame) -> DataFrame:
    """(page_id, at, dom, kind, node): components of a model in page order, containers of any depth opened, page furniture left out.

    A container that holds a list of its own is a component. Null models and nodes that are no objects give no row.
    """
    level = models.select("page_id", F.array().cast("array<int>").alias("at"), F.col("model").alias("node"))
    found = []
    while True:
        kids = level.select("page_id", "at", _order("node").alias("order"), F.posexplode(_get("node", ":items", "map<string,variant>")).alias("pos", "key", "kid"))
        kids = kids.select("page_id", "at", "kid", F.explode(_places(F.col("order"), F.col("key"), F.col("pos"))).alias("pos"))
        rows = kids.where(_is("kid", "OBJECT")).select(
            "page_id", F.array_append("at", F.col("pos")).alias("at"), F.coalesce(_get("kid", ":type"), F.lit("")).alias("kind"), F.col("kid").alias("node"))
        rows = cut_lineage(rows.where(~F.col("kind").rlike(SKIPPED)))
        lists = F.exists(F.array(*[_get("node", k, "array<variant>") for k in LIST_KEYS]), lambda entries: F.coalesce(F.size(entries) > 0, F.lit(False)))
        opened = F.col("kind").rlike(CONTAINERS) & ~lists
        found.append(rows.where(~opened))
        level = rows.where(opened).select("page_id", "at", "node")
        if level.isEmpty():
            break
    dom = F.row_number().over(Window.partitionBy("page_id").orderBy("at")) - 1
    return reduce(DataFrame.unionByName, found).select("page_id", "at", dom.alias("dom"), "kind", "node")


def _units(parts: DataFrame) -> DataFrame:
    """(page_id, at, item, listed, node): a component as a whole (item 0) and, where it holds a list of two objects or more, each entry (item from 1)."""
    lists = F.array(*[F.struct(F.lit(k).alias("key"), _get("node", k, "array<variant>").alias("entries")) for k in LIST_KEYS])
    usable = F.filter(lists, lambda c: (F.size(c["entries"]) >= 2) & F.forall(c["entries"], lambda e: _is(e, "OBJECT")))
    rows = cut_lineage(parts.withColumn("list", F.try_element_at(usable, F.lit(1)))).withColumn("listed", F.col("list.key"))
    whole = rows.select("page_id", "at", F.lit(0).alias("item"), "listed", "node")
    each = rows.where("listed is not null").select("page_id", "at", F.posexplode("list.entries").alias("item", "node"))
    return whole.unionByName(each.select("page_id", "at", (F.col("item") + 1).alias("item"), F.lit(None).cast("string").alias("listed"), "node"))


def _walk(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (unit, place, pos, text) and files (unit, place, pos, key, url, alt, off) below every unit, one level of all trees at a time."""
    none = F.lit(None).cast("array<int>")
    start = F.array().cast("array<int>")
    level = units.select(
        *UNIT, "listed", start.alias("place"), start.alias("said"), F.lit(0).alias("depth"), F.lit(None).cast("array<string>").alias("order"), "node")
    texts, files = [], []
    while True:
        plain = F.col("order").isNull() & _is("node", "OBJECT")
        kind = F.coalesce(_get("node", ":type"), F.lit(""))
        typed = (kind.endswith("/title") | kind.endswith("/text")) & _is(F.try_variant_get("node", "$.text", "variant"), "STRING")
        speaks = plain & F.col("said").isNotNull() & (F.col("depth") <= TEXT_DEPTH) & F.col("listed").isNull()
        texts.append(level.where(speaks).select(*UNIT, "said", F.posexplode(_sayings(kind, typed)).alias("pos", "s")).select(*UNIT, "said", "pos", "s.*"))
        fields = F.try_variant_get("node", "$", "map<string,variant>")
        elements = F.transform(F.try_variant_get("node", "$", "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
        off = F.coalesce(F.exists(F.map_keys(fields), lambda k: F.contains(F.lower(k), F.lit("officon"))), F.lit(False))
        alt = urls.js_or(_get("node", "imageAltText"), _get("node", "keyBenefitsFileRefAlt"), _get("node", "animationThumbnailAltText"))
        rows = level.select(
            *UNIT, "listed", "place", F.when(~typed & (F.col("depth") < TEXT_DEPTH), F.col("said")).alias("said"), "depth", "order", plain.alias("plain"),
            _order("node").alias("names"), alt.alias("alt"), off.alias("off"), F.posexplode(F.coalesce(F.map_entries(fields), elements)).alias("pos", "e"))
        rows = rows.withColumns({"key": F.col("e.key"), "value": F.col("e.value")}).drop("e").where(
            ~F.coalesce(F.col("plain") & (F.col("key").isin(*UNREAD_KEYS) | (F.col("key") == F.col("listed"))), F.lit(False)))
        rows = cut_lineage(rows.where(_is("value", "OBJECT") | _is("value", "ARRAY") | (F.col("plain") & _is("value", "STRING"))))
        files.append(rows.where(_is("value", "STRING")).select(
            *UNIT, "place", "pos", "key", F.try_variant_get("value", "$", "string").alias("url"), "alt", "off"))
        items = F.col("plain") & (F.col("key") == ":items") & _is("value", "OBJECT")
        inner = F.col("order").isNotNull()
        at = F.when(inner, _places(F.col("order"), F.col("key"), F.col("pos"))).otherwise(F.array(F.when(items, F.lit(LAST)).otherwise(F.col("pos"))))
        below = rows.where(~_is("value", "STRING")).withColumns({"items": items, "inner": inner}).withColumn("here", F.explode(at))
        said = F.when(F.col("items"), F.when(F.size("names") > 0, F.array_append("said", F.lit(0)))).when(
            F.col("inner"), F.array_append("said", F.col("here"))).when(
            F.col("plain") & (F.col("key") == "mediaDescriptionModel") & F.col("listed").isNull(), F.array_append("said", F.lit(1))).otherwise(none)
        level = below.select(
            *UNIT, F.when(F.col("items"), F.col("listed")).alias("kept"), F.array_append("place", F.col("here")).alias("place"), said.alias("said"),
            (F.col("depth") + F.when(F.col("items"), 0).otherwise(1)).alias("depth"), F.when(F.col("items"), F.col("names")).alias("order"),
            F.col("value").alias("node")).where(F.col("depth") <= MEDIA_DEPTH)
        level = level.withColumn("listed", F.lit(None).cast("string")).drop("kept")
        if level.isEmpty():
            return _cleaned(reduce(DataFrame.unionByName, texts)), reduce(DataFrame.unionByName, files)


def _sayings(kind: Column, typed: Column) -> Column:
    """Raw texts of one node: its own text if it is a title or text component, else its text keys in their fixed order."""
    def raw(value: Column, head: Column | bool, own: bool) -> Column:
        return F.struct(value.alias("raw"), F.lit(head).alias("head"), F.lit(own).alias("own"))

    keys = [raw(F.when(_is(_get("node", k, "variant"), "STRING"), _get("node", k)), k in TITLE_KEYS, False) for k in TEXT_KEYS]
    return F.filter(F.when(typed, F.array(raw(_get("node", "text"), kind.endswith("/title"), True))).otherwise(F.array(*keys)), lambda x: x["raw"].isNotNull())


def _cleaned(texts: DataFrame) -> DataFrame:
    """Texts as read on the page: markup gone, titles marked `## ` on one line; addresses and single characters under text keys are none."""
    text = F.when(F.col("own") | ~(F.col("raw").startswith("/content/") | F.col("raw").startswith("http")), plain_html("raw", keep_line_breaks=True, bullet="• "))
    rows = texts.withColumn("text", text).where((F.col("text") != "") & (F.col("own") | (F.length("text") > 1)))
    return rows.select(*UNIT, "said", "pos", F.when(F.col("head"), F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit(" ")))).otherwise(F.col("text")).alias("text"))


def picture_key(url: Column) -> Column:
    """File name without its ending, device, size and version marks: one key for all variants of a picture."""
    name = F.lower(F.element_at(F.split(url, "/"), -1))
    name = F.regexp_replace(name, r"\.(jpe?g|png|webp|gif|mp4|webm|mov)$", "")
    name = F.replace(name, F.lit("(thumbnail)"), F.lit(""))
    return F.regexp_replace(name, r"([-_ ](desktop|mobile|tablet|pc|mo|d|m|t|v\d+|\d{3,4}(x\d{3,4})?))+$", "")


def _media(files: DataFrame, origin: str, root: str) -> DataFrame:
    """(unit, picture, first, kind, pc_url, mobile_url, alt): one row per picture or video of a unit, desktop and mobile files paired.

    The first file of a picture makes it; a mobile file joins the desktop file before it or stands alone.
    """
    key = F.lower("key")
    control = F.contains(key, F.lit("icon")) & (key != "iconblockimageref") & ((key != "iconimageref") | F.col("off"))
    rows = files.where(F.col("url").startswith(root) & ~F.col("url").rlike(SALES_PATHS) & ~F.col("url").rlike(ON_OFF)).where(
        ~control & ~F.contains(key, F.lit("tablet")))
    mobile, video, image = F.contains(key, F.lit("mob")), F.col("url").rlike(VIDEO_FILE), F.col("url").rlike(IMAGE_FILE)
    rows = rows.withColumns({"mobile": mobile, "video": video & ~mobile, "image": image, "picture": picture_key(F.col("url"))}).where("mobile or video or image")
    by = F.struct("place", "mobile", "pos")
    made = F.col("image") | F.col("video")
    groups = rows.groupBy(*UNIT, "picture", "video").agg(
        F.min(F.when(made, by)).alias("first"), F.min_by(F.when(made, F.struct("url", "mobile", "alt")), F.when(made, by)).alias("maker"),
        F.sort_array(F.collect_list(F.when(F.col("mobile"), F.struct("place", (-F.col("pos")).alias("pos"), "url")))).alias("phones"))
    phone = F.try_element_at(F.filter("phones", lambda p: p["place"] >= F.col("first.place")), F.lit(1))["url"]
    pc = F.when(F.col("maker.mobile"), phone).otherwise(F.col("maker.url"))
    link = lambda url: F.coalesce(urls.abs_url(url, origin), F.lit(""))
    return groups.where("first is not null").select(
        *UNIT, "picture", "first", F.when(F.col("video"), "video").otherwise("image").alias("kind"), link(pc).alias("pc_url"), link(phone).alias("mobile_url"),
        F.when(F.col("maker.mobile") | F.col("video"), "").otherwise(F.substring(plain_html(F.coalesce("maker.alt", F.lit(""))), 1, ALT_CHARS)).alias("alt"))


def model_sections(models: DataFrame, origin: str, root: str = "/content/dam") -> DataFrame:
    """Sections of page models (page_id, model VARIANT): texts, media and layout of every component that says or shows something.

    (page_id, order, component_id, dom, item_group, group_heading, text, media, layout_type, columns). A list of two entries or more becomes
    one section an entry, after a section for the component's own head; own pictures that an entry repeats are left to the entry. Sections
    under sales paths without media, and placeholder texts, go. Disclaimer blocks are numbered `disclaimer-n`.
    """
    parts = components(models)
    units = _units(parts)
    texts, files = _walk(units)
    said = texts.groupBy(*UNIT).agg(F.sort_array(F.collect_list(F.struct("said", "pos", "text"))).alias("t")).select(*UNIT, F.col("t.text").alias("t"))
    said = said.select(*UNIT, F.filter("t", lambda x, i: (i == 0) | (x != F.col("t")[F.when(i > 0, i - 1).otherwise(0)])).alias("said"))
    media = cut_lineage(_media(files, origin, root))
    inside = media.where("item > 0").select("page_id", "at", "picture", F.lit(0).alias("item")).distinct()
    media = media.join(inside, [*UNIT, "picture"], "left_anti")
    shown = media.groupBy(*UNIT).agg(
        F.sort_array(F.collect_list(F.struct("first", "kind", "pc_url", "mobile_url", "alt"))).alias("m")).select(
        *UNIT, F.transform("m", lambda m: m.dropFields("first")).alias("m"))
    images, videos = F.filter("m", lambda m: m["kind"] == "image"), F.filter("m", lambda m: m["kind"] == "video")
    shown = shown.select(*UNIT, images.alias("images"), F.concat(images, F.slice(videos, 1, 1)).alias("media"))
    rows = units.drop("node").join(said, UNIT, "left").join(shown, UNIT, "left").join(
        parts.select("page_id", "at", "dom", F.element_at(F.split("kind", "/"), -1).alias("name"), (_get("node", "blockType") == "disclaimer").alias("small"),
                     F.to_json("node").rlike(SALES_PATHS).alias("sales")), ["page_id", "at"])
    whole = Window.partitionBy("page_id", "at")
    rows = rows.withColumns({
        "said": F.coalesce("said", F.array().cast("array<string>")), "images": F.coalesce(F.size("images"), F.lit(0)),
        "media": F.coalesce("media", F.from_json(F.lit("[]"), "array<struct<kind:string,pc_url:string,mobile_url:string,alt:string>>"))})
    rows = rows.withColumns({
        "n": F.max("item").over(whole), "shows": F.max(F.size("media")).over(whole), "head": F.max(F.when(F.col("item") == 0, F.try_element_at("said", F.lit(1)))).over(whole)})
    text = F.array_join("said", "\n")
    kept = F.when(F.col("item") > 0, (F.size("media") > 0) | (text != "")).otherwise(
        ((F.col("images") > 0) | (text != "")) & ((F.col("n") > 0) | ~F.contains(F.lower(text), F.lit("lorem ipsum"))))
    rows = rows.where(kept & ~(F.col("sales") & (F.col("shows") == 0)))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("at", "item"))
    single = (F.col("n") == 0) & (F.col("name") == "textblock") & F.coalesce("small", F.lit(False))
    grid = F.when(F.col("n") <= 4, F.col("n")).when(F.col("n") % 3 == 0, 3).when(F.col("n") % 4 == 0, 4).otherwise(3)
    columns = F.when(F.col("item") > 0, grid).otherwise(1)
    layout = F.when(F.col("item") > 0, F.concat(F.lit("grid_"), grid.cast("string"), F.lit("_column"))).when(F.col("images") == 0, "text_block").when(
        F.col("name").isin(*SIDE_BY_SIDE), "image_text_right").otherwise(FULL_WIDTH)
    return rows.select(
        "page_id", F.concat(F.when(single, "disclaimer-").otherwise(""), number.cast("string")).alias("order"),
        F.concat(F.lit("AEM:"), "name").alias("component_id"),
        F.when((F.col("n") > 0) & (F.col("item") == 0) & (F.col("images") > 0), -1 - F.col("dom")).otherwise(F.col("dom")).alias("dom"),
        (F.col("item") > 0).alias("item_group"),
        F.when((F.col("item") > 0) & F.col("head").startswith("## "), F.substr("head", F.lit(4))).otherwise("").alias("group_heading"),
        text.alias("text"), "media", layout.alias("layout_type"), columns.cast("int").alias("columns"))


def _lines(html: Column | str) -> Column:
    """Text of a fragment: breaks, paragraphs and list entries are lines, markup and blank lines go."""
    s = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>|</p>\s*<p[^>]*>", "\n")
    s = F.regexp_replace(F.regexp_replace(s, "(?i)<li[^>]*>", "\n- "), "<[^>]+>", "")
    lines = F.transform(F.split(F.replace(unescape_basic(s), F.lit("\r"), F.lit("")), "\n"), trim_ws)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def _children(node: Column | str) -> Column:
    """Children of a node in its order: array of (key, kind, node)."""
    items, order = _get(node, ":items", "map<string,variant>"), _order(node)
    names = F.when(F.size(order) > 0, order).otherwise(F.map_keys(items))
    kind = lambda v: F.element_at(F.split(F.coalesce(_get(v, ":type"), F.lit("")), "/"), -1)
    return F.transform(names, lambda n: F.struct(n.alias("key"), kind(F.try_element_at(items, n)).alias("kind"), F.try_element_at(items, n).alias("node")))


def _spoken(node: Column | str) -> Column:
    """Eyebrow, title and body lines of a node's own children; disclaimers are left out."""
    said = F.transform(_children(node), lambda c: F.struct(c["key"].alias("key"), c["kind"].alias("kind"), _lines(_get(c["node"], "text")).alias("text")))
    said = F.filter(said, lambda c: (c["text"] != "") & ~F.contains(c["key"], F.lit("disclaimer")))
    title = lambda c: (c["kind"] == "title") | c["key"].isin("headline", "title")
    heads, above = F.filter(said, title), F.filter(said, lambda c: ~title(c) & (c["key"] == "eyebrow"))
    body = F.transform(F.filter(said, lambda c: ~title(c) & (c["key"] != "eyebrow")), lambda c: c["text"])
    top = F.array_compact(F.array(F.try_element_at(above, F.lit(-1))["text"], F.concat(F.lit("## "), F.try_element_at(heads, F.lit(1))["text"])))
    return F.coalesce(F.array_join(F.concat(top, body), "\n"), F.lit(""))


def _described(node: Column | str, origin: str, listed: bool = True) -> Column:
    """Media of a node's description or list of them: a video shows its still, an animation is a film, all else is a picture."""
    one = F.array(_get(node, "mediaDescriptionModel", "variant"))
    many = _get(node, "mediaDescriptionList", "array<variant>") if listed else F.array().cast("array<variant>")
    link = lambda url: F.when(url.startswith("http"), url).when(url.startswith("/"), F.concat(F.lit(origin), url)).when(
        url != "", F.concat(F.lit(f"{origin}/"), url)).otherwise("")

    def shown(md: Column) -> Column:
        kind = F.lower(urls.js_or(_get(md, "mediaTypeItems"), F.lit("image")))
        def ref(name: str) -> Column:
            return F.coalesce(_get(md, name), F.lit(""))

        def file(kind: str, name: str, video: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), link(ref(name)).alias("pc_url"), link(ref(f"{name}Mobile")).alias("mobile_url"), video.alias("video_id"))

        still = (ref("videoThumbnailImageRef") != "") & ~F.contains(ref("videoThumbnailImageRef"), F.lit("/sample/"))
        none = F.lit("")
        return F.when((kind == "video") & still, file("image", "videoThumbnailImageRef", ref("videoID"))).when(
            (kind == "animation") & (ref("animationRef") != ""), file("video", "animationRef", none)).when(
            (kind != "video") & (ref("imageRef") != ""), file("image", "imageRef", none))

    return F.array_compact(F.transform(F.when(F.size(many) > 0, many).otherwise(one), shown))


def overview_sections(models: DataFrame, origin: str) -> DataFrame:
    """Sections of the plain form of page models: heroes with their overlay, one section a carousel slide, folding features.

    (page_id, dom, slide, component_id, text, media, layout_type, item_group, column_count, overlay struct<pc, mobile>). Slides keep one medium;
    slides, heroes and features without text and media go, as do all other components.
    """
    parts = models.select("page_id", F.posexplode(_children("model")).alias("dom", "c")).select("page_id", "dom", "c.kind", "c.node")
    empty = F.lit(0).alias("slide")
    told = parts.where(F.col("kind").isin("heroimage", *FOLDING)).select("page_id", "dom", empty, "kind", "node")
    slides = parts.where("kind = 'carousel'").select("page_id", "dom", F.posexplode(_children("node")).alias("slide", "c")).select(
        "page_id", "dom", "slide", F.lit("carousel").alias("kind"), "c.node")
    media = F.when(F.col("kind") == "heroimage", _described("node", origin, listed=False)).otherwise(_described("node", origin))
    side, below = F.coalesce(_get("node", "textBlockHorizontalAlign"), F.lit("")), F.concat_ws(
        " ", _get("node", "textBlockVerticalMobileAlign"), _get("node", "textBlockVerticalIconBlockMobileAlign"))
    overlay = F.struct(
        F.when(side.endswith("pos-left"), "left").when(side.endswith("pos-right"), "right").otherwise("center").alias("pc"),
        F.when(F.contains(below, F.lit("top")), "top").when(F.contains(below, F.lit("bottom")), "bottom").when(
            F.contains(below, F.lit("middle")), "middle").otherwise("top").alias("mobile"))
    rows = told.unionByName(slides).select("page_id", "dom", "slide", "kind", _spoken("node").alias("text"), media.alias("media"), overlay.alias("over"))
    rows = rows.where((F.col("text") != "") | (F.size("media") > 0))
    n = F.count(F.lit(1)).over(Window.partitionBy("page_id", "dom"))
    hero, slide = F.col("kind") == "heroimage", F.col("kind") == "carousel"
    rows = rows.withColumn("n", F.least(n, F.lit(4)).cast("int"))
    return rows.select(
        "page_id", (F.col("dom") + 5000).alias("dom"), "slide", F.concat(F.lit("AEM_"), F.upper("kind")).alias("component_id"), "text",
        F.when(slide, F.slice("media", 1, 1)).otherwise(F.col("media")).alias("media"),
        F.when(hero, FULL_WIDTH).when(slide & (F.col("n") > 1), F.concat(F.lit("grid_"), F.col("n").cast("string"), F.lit("_column"))).otherwise(
            "image_text_right").alias("layout_type"),
        (slide & (F.col("n") > 1)).alias("item_group"), F.when(slide, F.col("n")).otherwise(1).alias("column_count"),
        F.when(hero & (F.col("text") != ""), F.col("over")).alias("overlay"))
