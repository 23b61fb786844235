"""Sections out of the tokens of a crawled page's markdown: which heading an image belongs to, the one before it or the one behind it.

The rule reads token by token with images waiting for the next heading. It is stated here without a loop:

- What an image needs to know lies within five tokens, so its owner comes from a fixed look-ahead.
- Runs of cards (image, short title, at most two more texts, next image) are chains of neighbours: an image is a card if it is linked to the
  image before or behind it.
- Between two headings, images either stay or wait for the next heading. Only one thing flows from heading to heading: whether any image
  waits. As a function of that bit a segment is constant, or passes the bit on (its only waiting image is the one that would go to an
  empty section). So the bit at each heading is the last constant before it: functions of segments compose as last non-null values.
- Texts that repeat the alt text of an image attached before are captions: an equi-join on the first characters.

Tokens of a page come from one markdown text, so windows by page are bounded by one row of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..session import cut_lineage, dealt

#: Fixed values of the rule: interface texts, notes, video controls, words that no label holds, gallery and tab icon addresses.
UI_NOISE = (
    r"(?i)^(close|Pause carousel|Play carousel|Watch the Full Movie|Video Play|Video Pause|Previous|Next|_\\{0,2}\*_|\\{0,2}\*|{site} utilizes"
    r"|Learn more|View more|See more|Buy Now|Add to cart|Where to Buy)$"
)
NOTE = r"^\\?\*"
VIDEO_CONTROL = r"(?i)play video|pause video"
CONTROL_WORDS = r"(?i)video|slide|carousel|play|pause|next|prev"
GALLERY_URL = r"(?i)/gallery/"
TAB_ICON = r"(?i)[-_]icon[-_]"
DAM_PATH = "/content/dam/"
IMAGE_FILE = r"(?i)\.(jpe?g|png|webp|gif|avif)(\?|$)"
TASK_TOKENS = 50_000  # a token carries its neighbours through several sorts
TITLE_MAX, LABEL_MAX, ALT_PREFIX, LOOK_AHEAD, EXTRA_TEXTS, ATTACHED = 50, 40, 30, 5, 2, 2


@dataclass(frozen=True)
class MarkdownSections:
    """sections: page_id, seg, sec_ord, headline, eyebrow, is_title. texts: page_id, seg, i, kind (body or disclaimer), text.
    assets: page_id, seg (NULL: gallery or unassigned), i, url, alt, title, matched_by. seg numbers the headings of a page."""

    sections: DataFrame
    texts: DataFrame
    assets: DataFrame


def usable_image(url: Column) -> Column:
    """An absolute address of page content in an image format, no chrome or thumbnail."""
    return (
        url.rlike("^https?:") & ~url.rlike(rules.JUNK_MEDIA["crawl"]) & ~url.rlike(rules.RECOMMENDED_THUMB)
        & (F.contains(url, F.lit(DAM_PATH)) | url.rlike(IMAGE_FILE))
    )


def heading_kind(text: Column, vendor: str = "[A-Z]{2,}") -> Column:
    """stop, chrome, short (no three letters or digits) or normal."""
    return (
        F.when(text.rlike(rules.STOP_HEADING), "stop").when(text.rlike(rules.chrome_heading(vendor)), "chrome")
        .when(F.length(F.regexp_replace(text, "[^A-Za-z가-힣0-9]", "")) < 3, "short").otherwise("normal")
    )


def _begins(text: Column, alt: Column) -> Column:
    return (alt != "") & F.startswith(text, F.left(alt, F.lit(ALT_PREFIX)))


def _read(tokens: DataFrame, site: str, vendor: str) -> DataFrame:
    """Tokens with their place i, what they are, their neighbours, and cards with their titles."""
    by = Window.partitionBy("page_id")
    order = Window.partitionBy("page_id").orderBy("line", "sub")
    t = tokens.select("page_id", "kind", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("url", F.lit("")).alias("url"), F.row_number().over(order).alias("i"))
    txt, img = F.col("kind") == "txt", F.col("kind") == "img"
    t = t.withColumns({
        "noise": txt & F.col("value").rlike(UI_NOISE.replace("{site}", site)), "note": txt & F.col("value").rlike(NOTE),
        "hk": F.when(F.col("kind") == "h", heading_kind(F.col("value"), vendor)),
        "ok": img & usable_image(F.col("url")), "video": txt & F.col("value").rlike(VIDEO_CONTROL)})
    t = t.withColumn("gallery", F.col("ok") & F.col("url").rlike(GALLERY_URL))
    up, down = by.orderBy("i"), by.orderBy(F.desc("i"))
    seen = F.struct("kind", "value", "noise", "note", "video", "hk")
    sofar = up.rowsBetween(Window.unboundedPreceding, 0)
    behind = down.rowsBetween(Window.unboundedPreceding, -1)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({
        "ahead": F.array(*[F.lead(seen, n).over(up) for n in range(1, LOOK_AHEAD + 1)]),
        "prev": F.lag(F.struct("kind", "value", "note", "url")).over(up),
        "real": F.last(F.when(~F.col("noise"), F.struct("i", "kind", "value", "note")), ignorenulls=True).over(behind),
        "seg": F.count(F.when(F.col("kind") == "h", 1)).over(sofar), "stops": F.count(F.when(F.col("hk") == "stop", 1)).over(sofar)})
    titled = (F.col("real.kind") == "txt") & (F.length("real.value") <= TITLE_MAX) & ~F.col("real.note")
    t = t.withColumn("titled", F.coalesce(F.col("ok") & ~F.col("gallery") & titled, F.lit(False)))
    t = t.withColumn("follower", F.last(F.when(img, F.struct("i", "titled", "seg")), ignorenulls=True).over(behind))
    linked = F.col("titled") & F.col("follower.titled") & (F.col("follower.seg") == F.col("seg")) & (F.col("follower.i") - F.col("real.i") <= EXTRA_TEXTS + 1)
    t = t.withColumn("linked", F.coalesce(linked, F.lit(False)))
    t = t.withColumn("card", F.col("linked") | (img & F.coalesce(F.last(F.when(img, F.col("linked")), ignorenulls=True).over(before), F.lit(False))))
    owner = F.last(F.when(img, F.struct("card", F.col("real.i").alias("title_at"))), ignorenulls=True).over(before)
    return t.withColumn("taken", F.coalesce(txt & owner["card"] & (owner["title_at"] == F.col("i")), F.lit(False)))


def _placed(t: DataFrame) -> DataFrame:
    """Tokens before the stop heading, by segment; waits0: the image waits for the next heading unless it fills an empty section (fills0)."""
    up = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = t.where("stops = 0").withColumn("scope", F.last(F.when(F.col("kind") == "h", F.struct("hk", "value")), ignorenulls=True).over(up))
    t = t.withColumn("first_head", F.first(F.when(F.col("hk") == "normal", F.col("value")), ignorenulls=True).over(up))
    open_ = F.coalesce(F.col("scope.hk") == "normal", F.lit(False))
    t = t.withColumns({
        "open": open_, "title_seg": open_ & (F.col("scope.value") == F.col("first_head")),
        "live": (F.col("kind") != "h") & F.coalesce(F.col("scope.hk") != "chrome", F.lit(True))})
    first = F.try_element_at(F.filter("ahead", lambda x: x.isNotNull() & (x["kind"] != "img") & ~(x["noise"] & ~x["video"])), F.lit(1))
    short = F.length(first["value"]) <= LABEL_MAX
    stays = F.when(first.isNull() | (first["kind"] == "h"), False).when(first["video"] | first["note"] | _begins(first["value"], F.col("value")), True).otherwise(~short)
    picture = F.col("live") & F.col("ok") & ~F.col("gallery")
    waits = F.when(F.col("card"), ~F.col("open")).otherwise(~(stays & F.col("open") & ~F.col("title_seg")))
    nxt = F.col("ahead")[0]
    prev_label = F.coalesce((F.col("prev.kind") == "txt") & (F.length("prev.value") <= LABEL_MAX) & ~F.col("prev.note"), F.lit(False))
    prev_icon = F.coalesce((F.col("prev.kind") == "img") & F.col("prev.url").rlike(TAB_ICON), F.lit(False))
    label = (
        (F.length("value") <= LABEL_MAX) & F.coalesce((nxt["kind"] == "h") & ~nxt["hk"].isin("stop", "chrome"), F.lit(False))
        & ~F.col("value").rlike(CONTROL_WORDS) & ~prev_label & ~prev_icon
    )
    words = F.col("live") & (F.col("kind") == "txt") & ~F.col("taken") & ~F.col("noise")
    t = t.withColumns({"picture": picture, "waits0": picture & waits, "words": words & ~F.col("note"), "note": words & F.col("note")})
    t = t.withColumn("label", F.col("words") & label)
    inside = Window.partitionBy("page_id", "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    leads = (F.count_if("picture").over(inside) == 1) & (F.count_if(F.col("words") & ~F.col("label")).over(inside) == 0)
    return t.withColumn("fills0", F.col("picture") & ~F.col("card") & F.col("open") & ~F.col("title_seg") & leads)


def md_sections(tokens: DataFrame, site: str = r"[a-z]+\.com", vendor: str = "[A-Z]{2,}") -> MarkdownSections:
    """Sections, texts and images of markdown pages (W23). tokens: page_id, line, sub, kind (img, h, txt), value, url, as md_tokens gives them.

    site and vendor are patterns for the host and the brand in interface texts and chrome headings. Nothing counts from a stop heading on,
    nothing but a heading inside chrome. Lengths count code points.
    """
    tokens = dealt(tokens, ["page_id"], tokens.count(), TASK_TOKENS)
    t = cut_lineage(_placed(cut_lineage(_read(tokens, site, vendor))))  # read six times below
    by_seg = Window.partitionBy("page_id").orderBy("seg")
    segs = t.groupBy("page_id", "seg").agg(
        F.count_if("waits0").alias("n_wait"), F.coalesce(F.bool_or(F.col("fills0") & F.col("waits0")), F.lit(False)).alias("passes"), F.max("scope.hk").alias("hk"))
    none_waits = F.when(F.col("n_wait") == 0, True).when((F.col("n_wait") == 1) & F.col("passes"), None).otherwise(False)
    segs = segs.withColumns({
        "empty": F.coalesce(F.last(none_waits, ignorenulls=True).over(by_seg.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)), "next_hk": F.lead("hk").over(by_seg)})
    pics = t.where("picture or (live and gallery)").join(segs.select("page_id", "seg", "empty", "next_hk"), ["page_id", "seg"])
    pics = pics.withColumn("fills", F.col("fills0") & F.col("empty")).withColumn("waits", F.col("waits0") & ~F.col("fills"))

    from_end = Window.partitionBy("page_id", "seg", "waits").orderBy(F.desc("i"))
    pics = pics.withColumn("rank", F.row_number().over(from_end))
    none = F.lit(None).cast("string")
    case = (
        F.when(F.col("gallery"), "gallery").when(F.col("waits") & F.col("next_hk").isNull(), "unassigned")
        .when(F.col("waits") & (F.col("next_hk") != "normal"), none).when(F.col("waits") & (F.col("rank") > ATTACHED), "unassigned")
        .when(F.col("waits"), "doc-order").when(F.col("card"), "card-pair").when(F.col("fills"), "doc-order").otherwise("doc-order-trailing")
    )
    home = F.when(F.col("case").isin("gallery", "unassigned"), None).otherwise(F.col("seg") + F.when(F.col("waits"), 1).otherwise(0))
    pics = pics.withColumn("case", case).where("case is not null")
    assets = pics.select(
        "page_id", home.alias("seg"), "i", "url", F.col("value").alias("alt"), F.when(F.col("case") == "card-pair", F.col("real.value")).alias("title"),
        F.col("case").alias("matched_by"))

    # captions repeat the beginning of an alt text that was attached to the segment before them
    alts = assets.where("seg is not null and matched_by <> 'card-pair' and alt <> ''").select("page_id", "seg", F.left("alt", F.lit(ALT_PREFIX)).alias("start"), "i")
    alts = alts.groupBy("page_id", "seg", "start").agg(F.min("i").alias("since")).withColumn("size", F.length("start"))
    sizes = alts.groupBy("page_id", "seg").agg(F.collect_set("size").alias("sizes"))
    said = t.where("words").select("page_id", "seg", "i", "value").join(sizes, ["page_id", "seg"]).select("page_id", "seg", "i", "value", F.explode("sizes").alias("size"))
    captions = said.withColumn("start", F.left("value", F.col("size"))).join(alts, ["page_id", "seg", "size", "start"]).where("since < i").select("page_id", "i").distinct()
    words = t.where("words").join(captions, ["page_id", "i"], "left_anti")
    texts = words.where("not label and open").select("page_id", "seg", "i", F.lit("body").alias("kind"), F.col("value").alias("text")).unionByName(
        t.where("note and open").select("page_id", "seg", "i", F.lit("disclaimer").alias("kind"), F.regexp_replace("value", r"^\\", "").alias("text")))

    heads = t.where("hk = 'normal'").select("page_id", "seg", F.col("value").alias("headline"), F.col("title_seg").alias("is_title"))
    labels = words.where("label").select("page_id", (F.col("seg") + 1).alias("seg"), F.col("value").alias("eyebrow"))
    sections = heads.join(labels, ["page_id", "seg"], "left").withColumn("sec_ord", F.row_number().over(by_seg)).select(
        "page_id", "seg", "sec_ord", "headline", F.coalesce("eyebrow", F.lit("")).alias("eyebrow"), "is_title")
    return MarkdownSections(sections, texts, assets)
