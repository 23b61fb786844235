"""Media joins: resolution upgrade, control media, recovery, ownership, captions, posters, geometry, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..session import dealt
from .ordered import Fill, FillNext, drop_repeats, first_rows, per_key, scan

# File-name words that say nothing about the content.
FILE_STOP_WORDS = [
    "jpg", "jpeg", "png", "webp", "mp4", "webm", "gif", "desktop", "mobile", "feature", "features", "key", "2025", "2026",
    "side", "by", "vs6", "energy", "fridge", "freezers",
]
CARD_STOP_WORDS = [
    "the", "and", "for", "with", "from", "your", "more", "that", "this", "have", "will", "been", "into", "each", "also", "very",
]
TAG = r"\[(?:PC|MOBILE)_(?:IMAGE|VIDEO): (\S+?)\]"


def file_tokens(url: Column | str) -> Column:
    return F.array_except(text.tokens(F.element_at(F.split(urls._text(url), "/"), -1)), F.array(*[F.lit(w) for w in FILE_STOP_WORDS]))


def widest_variants(found: DataFrame, keys: list[str], url: str = "url", pos: str = "pos") -> DataFrame:
    """(keys, asset, best, best_width): the widest address per asset, the first one on a tie."""
    rows = found.select(*keys, urls.asset_key(url).alias("asset"), urls.effective_width(url).alias("w"), F.col(url).alias("u"), F.col(pos).alias("p"))
    best = F.max(F.struct("w", (-F.col("p")).alias("np"), "u")).alias("b")
    return rows.groupBy(*keys, "asset").agg(best).select(*keys, "asset", F.col("b.u").alias("best"), F.col("b.w").alias("best_width"))


def upgrade_resolution(media: DataFrame, found: DataFrame, keys: list[str], url: str = "url", pos: str = "pos") -> DataFrame:
    """Replace an address by the widest variant of its asset found in the page, only if strictly wider."""
    best = widest_variants(found, keys, "url", pos)
    joined = media.withColumn("__a", urls.asset_key(url)).join(best.withColumnRenamed("asset", "__a"), [*keys, "__a"], "left")
    wider = F.coalesce(F.col("best_width") > urls.effective_width(url), F.lit(False))
    return joined.withColumns({
        url: F.when(wider, F.col("best")).otherwise(F.col(url)), "upgraded": wider,
    }).drop("__a", "best", "best_width")


def drop_control_media(media: DataFrame, uses: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """Drop media whose asset is only ever used inside controls (J13). uses: keys, url, inside BOOLEAN."""
    only = uses.groupBy(*keys, urls.dam_path_key("url").alias("__k")).agg(F.bool_and("inside").alias("all_in")).where("all_in")
    return media.withColumn("__k", urls.dam_path_key(url)).join(only.drop("all_in"), [*keys, "__k"], "left_anti").drop("__k")


def token_scores(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(keys, left_id, right_id, score): number of shared distinct tokens. Both sides have an array column `tokens`."""
    a = left.select(*keys, left_id, F.explode("tokens").alias("tok"))
    b = right.select(*keys, right_id, F.explode("tokens").alias("tok"))
    return a.join(b, [*keys, "tok"]).groupBy(*keys, left_id, right_id).agg(F.count(F.lit(1)).alias("score"))


def recover_media(missing: DataFrame, sections: DataFrame, keys: list[str], media_id: str = "media_id", sec: str = "sec_ord",
                  minimum: int = 2) -> DataFrame:
    """(keys, media_id, sec or NULL, score): the section that shares most words with a media file name.

    missing: media_id, url; sections: sec, text, urls ARRAY<STRING> of non-disclaimer sections. Three extra points when
    the section already shows the same numbered feature; below `minimum` the media stays unassigned; first section on ties.
    """
    feature = F.regexp_extract(urls._text("url"), r"feature-\d+", 0)
    m = missing.select(*keys, media_id, "url", file_tokens("url").alias("tokens"), feature.alias("feat"))
    s = sections.select(*keys, sec, text.tokens("text").alias("tokens"))
    words = token_scores(m, s, keys, media_id, sec)
    held = sections.select(*keys, sec, F.explode("urls").alias("u")).select(
        *keys, sec, F.regexp_extract("u", r"feature-\d+", 0).alias("feat")
    ).where("feat <> ''").distinct()
    bonus = m.where("feat <> ''").join(held, [*keys, "feat"]).select(*keys, media_id, sec, F.lit(3).cast("bigint").alias("score"))
    best = (
        words.unionByName(bonus).groupBy(*keys, media_id, sec).agg(F.sum("score").alias("score"))
        .groupBy(*keys, media_id).agg(F.max(F.struct("score", (-F.col(sec)).alias("n"))).alias("b"))
        .where(F.col("b.score") >= minimum)
        .select(*keys, media_id, (-F.col("b.n")).alias(sec), F.col("b.score").alias("score"))
    )
    return missing.select(*keys, media_id, "url").join(best, [*keys, media_id], "left")


@per_key
def own_media(blocks: DataFrame, keys, order, block=None) -> DataFrame:
    """Which neighbour a media row belongs to (J15). Adds `owner` (place of a text block) to media rows.

    blocks: is_media, is_disclaimer, has_heading, text, url. A block with a heading wins over one without; otherwise the
    shared words of file name and text decide, the block before having five points more.
    """
    place = F.struct(*order)
    cand = F.when(
        ~F.col("is_media") & ~F.col("is_disclaimer"),
        F.struct(place.alias("at"), F.col("has_heading").alias("h"), text.tokens("text").alias("tok")),
    )
    out = scan(blocks, keys, order, [Fill("__b", cand), FillNext("__a", cand)], block)
    ft = file_tokens("url")
    score = lambda c: F.size(F.array_intersect(ft, c["tok"]))
    b, a = F.col("__b"), F.col("__a")
    after = (
        F.when(b.isNull(), True).when(a.isNull(), False).when(b["h"] & ~a["h"], False).when(a["h"] & ~b["h"], True)
        .otherwise(score(a) > score(b) + 5)
    )
    owner = F.when(after, F.coalesce(a["at"], b["at"])).otherwise(F.coalesce(b["at"], a["at"]))
    return out.withColumn("owner", F.when(F.col("is_media"), owner)).drop("__a", "__b")


@per_key
def captions(md_lines: DataFrame, keys, order, block=None) -> DataFrame:
    """(keys, url, caption): the line before each media tag, tags and blank lines skipped (J16). md_lines: keys, order, line."""
    line = F.trim("line")
    tag = line.rlike("^" + TAG)
    said = F.when((line != "") & ~tag, line)
    out = scan(md_lines, keys, order, [Fill("__c", said, strict=True)], block).where(tag)
    cap = F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.trim("__c"), "^#+", "")), r"^\*+", ""))
    url = urls.bare_url(F.regexp_extract(line, TAG, 1))
    rows = out.select(*keys, *order, url.alias("url"), F.left(cap, F.lit(60)).alias("caption"), F.length(cap).alias("__n"), cap.startswith("![").alias("__img"))
    good = rows.where((F.col("__n") >= 8) & ~F.col("__img"))
    return first_rows(good, [*keys, "url"], [F.desc(o) for o in order]).select(*keys, "url", "caption")


def rehome(media: DataFrame, sections: DataFrame, caps: DataFrame, keys: list[str], sec: str = "sec_ord") -> DataFrame:
    """Move media to the first section that holds its caption; `new_section` marks captions no section holds.

    The caption search is a per-page containment join: equal page keys first, then `contains`.
    """
    joined = media.withColumn("__u", urls.bare_url("url")).join(caps.withColumnRenamed("url", "__u"), [*keys, "__u"], "left").drop("__u")
    here = sections.select(*keys, sec, F.col("text").alias("__here"))
    asked = joined.join(here, [*keys, sec], "left").withColumn(
        "__moves", F.col("caption").isNotNull() & ~F.contains(F.coalesce("__here", F.lit("")), F.col("caption"))
    )
    wanted = asked.where("__moves").select(*keys, "caption").distinct()
    homes = wanted.join(sections.where("not is_disclaimer").select(*keys, F.col(sec).alias("__to"), F.col("text").alias("__t")), keys).where(
        F.contains("__t", F.col("caption"))
    ).groupBy(*keys, "caption").agg(F.min("__to").alias("__to"))
    out = asked.join(homes, [*keys, "caption"], "left")
    return out.withColumns({
        "moved_to": F.when(F.col("__moves"), F.col("__to")), "new_section": F.col("__moves") & F.col("__to").isNull(),
    }).drop("__here", "__moves", "__to")


def pair_posters(md_lines: DataFrame, keys, order, block=None) -> DataFrame:
    """(keys, video, poster): the nearest picture line at -1, -2, -3, +1, +2 of each video line.

    md_lines holds every line with its number; a band join on line numbers, as an equi-join on the five exploded places.
    """
    n = order[0]
    video = F.regexp_extract("line", r"\[(?:PC|MOBILE)_VIDEO: (\S+?)\]", 1)
    image = F.coalesce(urls.js_or(
        F.regexp_extract("line", r"!\[[^\]]*\]\((\S+?)\)", 1), F.regexp_extract("line", r"\[(?:PC|MOBILE)_IMAGE: (\S+?)\]", 1)), F.lit(""))
    vids = md_lines.select(*keys, n, urls.bare_url(video).alias("video")).where("video <> ''")
    imgs = md_lines.select(*keys, F.col(n).alias("__at"), image.alias("__u")).where(
        (F.col("__u") != "") & ~rules.is_junk_media("__u", "recover")
    )
    places = F.array(*[F.struct(F.lit(r).alias("rank"), (F.col(n) + d).alias("__at")) for r, d in enumerate((-1, -2, -3, 1, 2))])
    tried = vids.select(*keys, n, "video", F.explode(places).alias("p")).select(*keys, n, "video", "p.rank", "p.__at")
    hit = tried.join(imgs, [*keys, "__at"]).groupBy(*keys, n, "video").agg(F.min_by("__u", "rank").alias("poster"))
    return first_rows(hit, [*keys, "video"], [F.desc(n)]).select(*keys, "video", urls.bare_url("poster").alias("poster"))


def attach_videos(assets: DataFrame, videos: DataFrame, keys: list[str], sec: str = "sec_ord", pos: str = "pos") -> DataFrame:
    """(videos + sec, matched_by): section by equal file stem, then equal asset folder, else unassigned."""
    one = drop_repeats(
        videos.withColumn("__s", urls.file_stem("url")).withColumn("__k", F.coalesce(F.nullif("__s", F.lit("")), F.col("url"))),
        [*keys, "__k"], [pos],
    ).drop("__k")
    stems = assets.where("type = 'image'").groupBy(*keys, urls.file_stem("url").alias("__s")).agg(F.min(sec).alias("__by_stem"))
    folders = assets.groupBy(*keys, urls.dam_folder("url").alias("__f")).agg(F.min(sec).alias("__by_folder")).where("__f <> ''")
    out = one.withColumn("__f", urls.dam_folder("url")).join(stems.where("__s <> ''"), [*keys, "__s"], "left").join(folders, [*keys, "__f"], "left")
    how = F.when(F.col("__by_stem").isNotNull(), "file-stem").when(F.col("__by_folder").isNotNull(), "dam-folder").otherwise("unassigned")
    return out.withColumns({sec: F.coalesce("__by_stem", "__by_folder"), "matched_by": how}).drop("__s", "__f", "__by_stem", "__by_folder")


def merge_geometry(assets: DataFrame, geometry: DataFrame, keys: list[str], asset_id: list[str]) -> DataFrame:
    """Render geometry of each asset under its own address, its device swaps, then its variants.

    assets: keys, asset_id, url, variants ARRAY<STRING>; geometry: keys, src, rw, rt, rl.
    """
    base = urls.bare_url("url")
    tries = F.concat(
        F.array(base, F.regexp_replace(base, r"(?i)-m(\.\w+)$", "-d$1"), F.regexp_replace(base, r"(?i)-d(\.\w+)$", "-m$1")),
        F.transform(F.coalesce("variants", F.array().cast("array<string>")), urls.bare_url),
    )
    place, whole, n = [*keys, "__k"], [*keys, *asset_id], assets.count()
    named = dealt(geometry.withColumn("__k", urls.bare_url("src")), place, geometry.count())
    geo = drop_repeats(named, place, ["rt", "rl", "rw"]).select(*place, F.struct("rw", "rt", "rl").alias("geo"))
    tried = dealt(assets.select(*whole, F.posexplode(tries).alias("__r", "__k")), place, n)
    hit = dealt(tried.join(geo, place), whole, n).groupBy(*whole).agg(F.min_by("geo", "__r").alias("geo"))
    return dealt(assets, whole, n).join(hit, whole, "left")


def rows_per_section(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, imgs_per_row, layout): most distinct left edges on one row of about 40 px (A9). placed: rw, rt, rl."""
    row = F.floor(F.col("rt") / 40 + 0.5)
    per_row = placed.groupBy(*keys, row.alias("__row")).agg(F.count_distinct("rl").alias("n"), F.min(F.struct("rt", "rl", "rw")).alias("__f"))
    out = per_row.groupBy(*keys).agg(F.max("n").alias("imgs_per_row"), F.min("__f").alias("__f"))
    kind = (
        F.when(F.col("imgs_per_row") >= 4, "grid-4").when(F.col("imgs_per_row") == 3, "grid-3")
        .when(F.col("__f.rw") >= 1000, "full-width")
    )
    return out.select(*keys, "imgs_per_row", kind.alias("layout"))


def merge_variants(assets: DataFrame, keys: list[str], pos: str = "pos", url: str = "url") -> DataFrame:
    """(keys, stem, primary, variants): desktop file first, else the first one; the others in order (A10)."""
    spot = F.struct((~F.col(url).rlike(r"(?i)-d\.\w+(\?|$)")).alias("nd"), F.col(pos).alias("p"))
    rows = assets.groupBy(*keys, urls.variant_stem(url).alias("stem")).agg(
        F.min(F.struct(spot.alias("s"), F.col(url).alias("u"))).alias("first"),
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(url).alias("u")))).alias("all"),
    )
    rest = F.transform(F.filter("all", lambda x: x["p"] != F.col("first.s.p")), lambda x: x["u"])
    return rows.select(*keys, "stem", F.col("first.u").alias("primary"), rest.alias("variants"))


def prefer_pc_in_section(media: DataFrame, keys: list[str], pos: str = "media_ord", url: str = "url") -> DataFrame:
    """One media per stem and section: the first desktop file at the first place of the stem."""
    spot = F.struct(urls.is_mobile_url(url).alias("m"), F.col(pos).alias("p"))
    return media.groupBy(*keys, urls.dedup_stem(url).alias("stem")).agg(
        F.min_by(url, spot).alias(url), F.min(pos).alias(pos), (F.count(F.lit(1)) - 1).alias("removed")
    )


def canonical_home(media: DataFrame, sections: DataFrame, keys: list[str], sec: str = "sec_ord", url: str = "url") -> DataFrame:
    """Keep each picture only in its best section: one with the same-named video, then the longest text."""
    vid = urls.is_video_url(url)
    stem = urls.dedup_stem(url)
    tagged = media.withColumns({"__v": vid, "__stem": stem, "__base": F.regexp_replace(stem, r"\.\w+$", "")})
    vids = tagged.where("__v").select(*keys, sec, "__base").distinct().withColumn("__has", F.lit(1))
    imgs = tagged.where("not __v").join(vids, [*keys, sec, "__base"], "left").join(
        sections.select(*keys, sec, F.length("text").alias("__len")), [*keys, sec], "left"
    )
    rank = F.struct(F.coalesce("__has", F.lit(0)).alias("v"), F.coalesce("__len", F.lit(0)).alias("n"), (-F.col(sec)).alias("s"))
    homes = imgs.groupBy(*keys, "__stem").agg(F.max(rank).alias("__b")).select(*keys, "__stem", (-F.col("__b.s")).alias(sec))
    kept = imgs.join(homes, [*keys, "__stem", sec], "left_semi")
    cols = media.columns
    return kept.select(*cols).unionByName(tagged.where("__v").select(*cols))


def inject_tags(md_lines: DataFrame, media: DataFrame, keys: list[str], line_no: str = "line_no", probe: int = 40) -> DataFrame:
    """Text lines with media tags put after the first line that holds their anchor; the rest at the end.

    md_lines: keys, line_no, line; media: keys, pos, tag, url, anchor. Tags whose address the text already has are left
    out. The result is ordered by (line_no, sub).
    """
    bodies = md_lines.where(F.contains("line", F.lit("://"))).select(*keys, F.col("line").alias("__l"))
    known = media.join(bodies, keys).where(F.contains("__l", F.col("url"))).select(*keys, "pos").distinct()
    new = media.join(known, [*keys, "pos"], "left_anti")
    anchored = new.where(F.coalesce("anchor", F.lit("")) != "").withColumn("__a", F.left("anchor", F.lit(probe)))
    spots = anchored.join(md_lines, keys).where(F.contains("line", F.col("__a"))).groupBy(*keys, "pos").agg(F.min(line_no).alias("__at"))
    ends = md_lines.groupBy(*keys).agg((F.max(line_no) + 1).alias("__end"))
    placed = new.join(spots, [*keys, "pos"], "left").join(ends, keys, "left")
    tags = placed.select(
        *keys, F.coalesce("__at", "__end", F.lit(0)).alias(line_no),
        F.when(F.col("__at").isNotNull(), 1 + F.lit(1_000_000) - F.col("pos")).otherwise(F.col("pos")).cast("bigint").alias("sub"),
        F.col("tag").alias("line"),
    )
    return md_lines.select(*keys, line_no, F.lit(0).cast("bigint").alias("sub"), "line").unionByName(tags)


def enrich(flow: DataFrame, media_index: DataFrame, text_index: DataFrame) -> DataFrame:
    """Flow rows with their component (J10): media by file name, then full address; text by a headline's first 50 characters.

    flow: page_id, seq, content_type, text_content, urls; media_index: page_id, dom_index, url; text_index: page_id,
    dom_index, text. The last component wins among equal keys.
    """
    by_url = media_index.select("page_id", "dom_index", F.explode(F.array(urls.file_name("url"), F.col("url"))).alias("key")).where("key <> ''")
    by_url = by_url.groupBy("page_id", "key").agg(F.max("dom_index").alias("dom"))
    by_text = text_index.select("page_id", "dom_index", F.left("text", F.lit(50)).alias("key")).where("key <> ''")
    by_text = by_text.groupBy("page_id", "key").agg(F.max("dom_index").alias("dom"))
    tries = F.flatten(F.transform("urls", lambda u: F.array(urls.file_name(u), u)))
    m = flow.where("content_type = 'media'").select("page_id", "seq", F.posexplode(tries).alias("r", "key"))
    bare = F.transform(F.split(F.coalesce("text_content", F.lit("")), "\n"), lambda ln: F.left(F.trim(F.regexp_replace(F.trim(ln), "^#+", "")), F.lit(50)))
    t = flow.where("content_type = 'text'").select("page_id", "seq", F.posexplode(bare).alias("r", "key"))
    hits = m.join(by_url, ["page_id", "key"]).unionByName(t.join(by_text, ["page_id", "key"]))
    first = hits.groupBy("page_id", "seq").agg(F.min_by("dom", "r").alias("dom_index"))
    return flow.join(first, ["page_id", "seq"], "left")


def backfill_text(flow: DataFrame, roles: DataFrame) -> DataFrame:
    """Replace a scene description in a matched text row by the component's own words.

    roles: page_id, dom_index, eyebrow, headline, body (first usable text of each role, NULL when absent).
    """
    out = flow.join(roles, ["page_id", "dom_index"], "left")
    own = F.concat_ws("\n", F.nullif("eyebrow", F.lit("")), F.concat(F.lit("## "), F.nullif("headline", F.lit(""))), F.nullif("body", F.lit("")))
    wrong = F.col("dom_index").isNotNull() & (F.trim(F.coalesce("text_content", F.lit(""))) != "") & text.is_image_description("text_content")
    return out.withColumn("text_content", F.when(wrong, own).otherwise(F.col("text_content"))).drop("eyebrow", "headline", "body")


def match_features(features: DataFrame, components: DataFrame, keys: list[str], feature: str = "feature_ord", comp: str = "comp_ord") -> DataFrame:
    """First component that shares an image file name with a feature, else one with the same headline start.

    features: files ARRAY<STRING>, headline; components: files, headline. The headline tier compares the first 18 characters
    both ways, as equi-joins on that prefix plus containment inside one page.
    """
    f = features.select(*keys, feature, F.explode("files").alias("file"))
    c = components.select(*keys, comp, F.explode("files").alias("file"))
    by_file = f.join(c, [*keys, "file"]).groupBy(*keys, feature).agg(F.min(comp).alias("by_file"))
    low = lambda x: F.lower(F.trim(x))
    fh = features.select(*keys, feature, low("headline").alias("h")).where("h <> ''").join(by_file, [*keys, feature], "left_anti")
    ch = components.select(*keys, comp, low("headline").alias("c")).where("c <> ''")
    by_head = fh.join(ch, keys).where(
        F.contains("h", F.left("c", F.lit(18))) | F.contains("c", F.left("h", F.lit(18)))
    ).groupBy(*keys, feature).agg(F.min(comp).alias("by_head"))
    out = features.join(by_file, [*keys, feature], "left").join(by_head, [*keys, feature], "left")
    return out.withColumn(comp, F.coalesce("by_file", "by_head")).drop("by_file", "by_head")


def drop_dead_media(media: DataFrame, status: DataFrame, pc: str = "pc_url", mobile: str = "mobile_url") -> DataFrame:
    """Drop media whose desktop file is gone (404, 410, under 300 bytes), falling back to a live mobile file."""
    dead = status.where(F.col("http_code").isin(404, 410) | (F.col("http_code").isin(200, 206) & (F.col("bytes") < 300))).select("url").distinct()
    one, two = (dead.select(F.col("url").alias(c), F.lit(True).alias(f"__{c}")) for c in (pc, mobile))
    out = media.join(one, pc, "left").join(two, mobile, "left")
    pc_dead, mo_dead = (F.coalesce(f"__{c}", F.lit(False)) for c in (pc, mobile))
    mo = F.coalesce(F.nullif(mobile, F.lit("")), F.lit(""))
    live_mobile = (mo != "") & ~mo_dead & (mo != F.col(pc))
    return (
        out.where(~pc_dead | live_mobile)
        .withColumns({pc: F.when(pc_dead, F.col(mobile)).otherwise(F.col(pc)), mobile: F.when(~pc_dead & mo_dead, "").otherwise(F.col(mobile))})
        .select(*media.columns)
    )


def prefer_pc_variant(media: DataFrame, corpus: DataFrame, keys: list[str], url: str = "url") -> DataFrame:
    """Promote a mobile address to its desktop twin when the source knows that file. corpus: keys, url."""
    known = corpus.select(*keys, urls.file_name("url").alias("__f")).distinct().withColumn("__ok", F.lit(True))
    twin = urls.to_desktop(url)
    out = media.withColumn("__twin", F.when(urls.is_mobile_url(url) & (twin != F.col(url)), twin)).withColumn("__f", urls.file_name("__twin"))
    joined = out.join(known, [*keys, "__f"], "left")
    swap = F.col("__twin").isNotNull() & F.col("__ok").isNotNull()
    return joined.withColumns({
        "mobile_url": F.when(swap, F.col(url)), url: F.when(swap, F.col("__twin")).otherwise(F.col(url)),
    }).drop("__twin", "__f", "__ok")


def section_video(media: Column | str) -> Column:
    """First desktop video address of a section, else the first one."""
    m = F.col(media) if isinstance(media, str) else media
    vids = F.filter(F.transform(m, lambda x: urls.js_or(x["pc_url"], x["unified_url"])), lambda u: urls.is_video_url(u))
    desk = F.filter(vids, lambda u: ~u.rlike(r"(?i)(/mobile/|[-_]m(_v\d+)?\.\w+$|[-_]mobile)"))
    return F.coalesce(F.try_element_at(desk, F.lit(1)), F.try_element_at(vids, F.lit(1)))


def section_poster(media: Column | str) -> Column:
    """First picture of a section that is neither video nor icon."""
    m = F.col(media) if isinstance(media, str) else media
    pics = F.filter(m, lambda x: ~urls.is_video_url(x["pc_url"]) & (F.coalesce(x["type"], F.lit("")) != "video") & (F.coalesce(x["role"], F.lit("")) != "icon"))
    return F.coalesce(urls.js_or(*[F.try_element_at(pics, F.lit(1))[c] for c in ("pc_url", "mobile_url", "unified_url")]), F.lit(""))


def frames_needed(sections: DataFrame, black: DataFrame) -> DataFrame:
    """Sections with a video whose poster is missing or known to be black (F24). black: url."""
    rows = sections.withColumns({"video": section_video("media"), "poster": section_poster("media")}).where("video is not null")
    flagged = black.select(F.col("url").alias("poster")).distinct().withColumn("__b", F.lit(True))
    reason = F.when(F.col("poster") == "", "missing").when(F.col("__b"), "black")
    return rows.join(flagged, "poster", "left").withColumn("reason", reason).where("reason is not null").drop("__b")


def product_image(gallery: DataFrame, media: DataFrame) -> DataFrame:
    """(page_id, url): first gallery picture, else the first section picture that is not an icon."""
    g = gallery.select("page_id", F.lit(0).alias("b"), F.lit(0).alias("s"), F.col("ord").alias("o"), F.col("url"))
    m = media.where(F.coalesce("role", F.lit("")) != "icon").select(
        "page_id", F.lit(1).alias("b"), F.col("sec_ord").alias("s"), F.col("media_ord").alias("o"), F.col("url")
    )
    return g.unionByName(m).where(F.coalesce("url", F.lit("")) != "").groupBy("page_id").agg(
        F.min_by("url", F.struct("b", "s", "o")).alias("url")
    )


def prefer_mobile(media: Column | str, overlay: Column | str) -> Column:
    """Overlay sections with words at one side show the mobile picture, badges aside."""
    m = F.col(media) if isinstance(media, str) else media
    side = (F.col(overlay) if isinstance(overlay, str) else overlay)["pc"]
    swap = F.coalesce(side.isin("left", "right"), F.lit(False))
    return F.transform(
        m,
        lambda x: F.when(
            swap & (F.coalesce(x["mobile_url"], F.lit("")) != "") & ~rules.is_award(x["pc_url"]), x.withField("pc_url", x["mobile_url"])
        ).otherwise(x),
    )


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Window")]
