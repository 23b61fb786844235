"""Section assembly and the order-sensitive repairs that follow it.

Operators take the key and order columns of a section table. With the default `block` they stay parallel inside one
hot key; `block=False` is the plain-window form for the sections of one parsed page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..session import cut_lineage
from .ordered import Fill, FillNext, Next, Prev, Total, drop_repeats, islands, per_key, scan, with_group

MEDIA = "array<struct<pc_url:string,mobile_url:string,unified_url:string,type:string,role:string>>"
STRINGS = "array<string>"
SPECS = "array<struct<label:string,value:string,grp:string,sect:string>>"
PAGE = ["page_id"]
ORDER = ["dom_index", "part"]


def _ordered(value: Column, *place: Column | str) -> Column:
    """Array of values in order; used on groups bounded by one component or one chunk."""
    spot = [F.col(p) if isinstance(p, str) else p for p in place]
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*[s.alias(f"k{i}") for i, s in enumerate(spot)], value.alias("v")))))
    return F.transform(rows, lambda r: r["v"])


# ---------------------------------------------------------------- assembly


def _texts_by_role(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Cleaned texts as eyebrow/headline/body/disclaimer arrays; a lone eyebrow is the headline."""
    clean = text.strip_descriptions("text")
    rows = texts.withColumn("text", F.trim(clean)).where((F.col("text") != "") & ~text.is_image_description("text"))
    kept = drop_repeats(rows.withColumn("__k", F.left(text.squash("text"), F.lit(120))), [*keys, "__k"], ["node"])
    role = (
        F.when(F.col("role") == "eyebrow", "eyebrow").when(F.col("role").isin("headline", "subheadline"), "headline")
        .when(F.col("role") == "disclaimer", "disclaimer").otherwise("body")
    )
    agg = kept.withColumn("__r", role).groupBy(*keys).agg(
        *[_ordered(F.when(F.col("__r") == r, F.col("text")), "node").alias(r) for r in ("eyebrow", "headline", "body", "disclaimer")],
        _ordered(
            F.when(~F.col("text").rlike(text.UI_WORDS), F.struct(
                F.when(F.col("role") == "subcopy", "subcopy").otherwise(F.col("__r")).alias("role"), F.col("text").alias("text"))),
            "node",
        ).alias("text_roles"),
    )
    lone = (F.size("headline") == 0) & (F.size("body") == 0) & (F.size("eyebrow") > 0)
    return agg.withColumns({
        "headline": F.when(lone, F.slice("eyebrow", 1, 1)).otherwise(F.col("headline")),
        "eyebrow": F.when(lone, F.slice("eyebrow", 2, F.size("eyebrow"))).otherwise(F.col("eyebrow")),
    })


def _media_lists(media: DataFrame, keys: list[str], origin: str) -> DataFrame:
    """Media arrays per key, absolute, one per file name."""
    pc, mo = (urls.abs_url(c, origin) for c in ("src_desktop", "src_mobile"))
    url = F.coalesce(urls.js_or(pc, mo), F.lit(""))
    rows = media.withColumns({"__pc": pc, "__mo": mo, "__url": url}).where("__url <> ''")
    key = F.regexp_replace(F.lower(urls.file_name("__url")), urls.SIZE_MARK, "")
    kept = drop_repeats(rows.withColumn("__k", key), [*keys, "__k"], ["ord"])
    item = F.struct(
        urls.js_or("__pc", "__url").alias("pc_url"), F.col("__mo").alias("mobile_url"), F.lit("").alias("unified_url"),
        F.coalesce("type", F.lit("image")).alias("type"), rules.media_role("__url").alias("role"),
    )
    return kept.groupBy(*keys).agg(_ordered(item, "ord").alias("media"))


def _content(media: Column | str) -> Column:
    m = F.col(media) if isinstance(media, str) else media
    return F.filter(F.coalesce(m, F.array().cast(MEDIA)), lambda x: x["role"] == "content")


def infer_columns(declared: Column, layout: Column, n_media: Column, n_head: Column) -> Column:
    """Column count of a component: declared, then its grid layout, then the shape of its content."""
    grid = F.regexp_extract(layout, r"^grid_(\d)_column", 1)
    return (
        F.when(declared >= 2, F.least(declared, F.lit(4)))
        .when(grid != "", grid.try_cast("int"))
        .when(layout == "icon_grid", F.when(n_media >= 2, F.least(F.greatest(n_media, F.lit(2)), F.lit(4))).otherwise(1))
        .when((n_head >= 2) & (n_media >= 2) & (F.abs(n_head - n_media) <= 1), F.least(F.greatest(n_head, n_media), F.lit(4)))
        .otherwise(1)
    )


def assemble_sections(
    components: DataFrame, texts: DataFrame, media: DataFrame, specs: DataFrame, item_texts: DataFrame, item_media: DataFrame,
    item_boxes: DataFrame, compares: DataFrame, origin: str,
) -> tuple[DataFrame, DataFrame]:
    """(sections, gallery) of all pages.

    texts are those outside items; item_texts and item_media carry (page_id, dom_index, item). Repeated items become
    sections of their own when at least two hold words and a picture; otherwise the component stays one section.
    """
    comp = components.withColumn("bucket", rules.component_bucket("component_id"))
    lists = _media_lists(media, ["page_id", "dom_index"], origin)
    gallery = (
        comp.where("bucket = 'gallery'").join(lists, ["page_id", "dom_index"])
        .select("page_id", "dom_index", F.posexplode(_content("media")).alias("ord", "m")).select("page_id", "dom_index", "ord", "m.*")
    )
    spec_key = drop_repeats(
        specs.where("label <> '' and value <> ''").withColumns({"__l": F.lower("label"), "__v": F.lower("value")}),
        ["page_id", "dom_index", "__l", "__v"], ["ord"],
    )
    spec_lists = spec_key.groupBy("page_id", "dom_index").agg(
        _ordered(F.struct("label", "value", "grp", "sect"), "ord").alias("specs")
    )
    base = (
        comp.where("bucket in ('content','anchor')")
        .join(_texts_by_role(texts, ["page_id", "dom_index"]), ["page_id", "dom_index"], "left")
        .join(lists, ["page_id", "dom_index"], "left").join(spec_lists, ["page_id", "dom_index"], "left")
        .join(compares.select("page_id", "dom_index", F.struct("before", "after").alias("compare")), ["page_id", "dom_index"], "left")
    )
    none = F.array().cast(STRINGS)
    base = base.withColumns({
        **{c: F.coalesce(c, none) for c in ("eyebrow", "headline", "body", "disclaimer")},
        "specs": F.coalesce("specs", F.array().cast(SPECS)), "media": _content("media"),
        "text_roles": F.coalesce("text_roles", F.array().cast("array<struct<role:string,text:string>>")),
    })
    base = cut_lineage(base)
    ikeys = ["page_id", "dom_index", "item"]
    items = (
        item_boxes.join(_texts_by_role(item_texts, ikeys), ikeys).join(_media_lists(item_media, ikeys, origin), ikeys)
        .withColumn("media", _content("media"))
        .where(((F.size("headline") > 0) | (F.size("body") > 0)) & (F.size("media") > 0))
    )
    words = F.concat(F.col("headline"), F.col("body"))
    signed = items.withColumn("__sig", F.concat_ws("\u0001", F.transform(F.slice(words, 1, 2), lambda t: F.left(F.lower(t), F.lit(80)))))
    uniq = cut_lineage(drop_repeats(signed, ["page_id", "dom_index", "__sig"], ["item_ord"]))
    many = uniq.groupBy("page_id", "dom_index").agg(
        F.count(F.lit(1)).alias("made"), F.flatten(F.collect_list(F.transform("media", lambda m: m["pc_url"]))).alias("item_urls"),
        F.min("item_ord").alias("first_item"),
    ).where("made >= 2")
    split = base.join(many, ["page_id", "dom_index"])
    lead_media = F.filter("media", lambda m: ~F.array_contains(F.col("item_urls"), m["pc_url"]))
    lead = split.withColumn("media", lead_media).where((F.size("body") > 0) | (F.size("media") > 0))
    lead_shown = lead.where(F.size("media") > 0).select("page_id", "dom_index", F.lit(True).alias("lead_shown"))

    shared = ["page_id", "dom_index", "component_id", "layout_type", "text_alignment", "wrapper_classes"]
    columns = ["eyebrow", "headline", "body", "disclaimer", "text_roles", "media"]
    no_specs = F.array().cast(SPECS).alias("specs")
    one_eyebrow = F.slice("eyebrow", 1, 1).alias("eyebrow")
    lead_rows = lead.select(
        *shared, F.lit(0).alias("part"), F.lit(1).alias("columns"), one_eyebrow, *columns[1:], no_specs, F.lit("content").alias("kind"),
        F.lit(False).alias("item_group"), F.lit("").alias("group_heading"), (F.size("media") > 0).alias("renderable"),
        F.lit(None).cast(base.schema["compare"].dataType).alias("compare"),
        F.lit(None).cast(base.schema["text_overlay"].dataType).alias("text_overlay"),
    )
    item_rows = (
        uniq.join(many.select("page_id", "dom_index", "made", "first_item"), ["page_id", "dom_index"])
        .join(base.select(*shared, "column_count", F.col("headline").alias("outer_head")), ["page_id", "dom_index"])
        .join(lead_shown, ["page_id", "dom_index"], "left")
        .select(
            *shared, F.col("item_ord").alias("part"),
            F.when(F.col("column_count") > 0, F.col("column_count")).otherwise(F.col("made")).cast("int").alias("columns"), one_eyebrow,
            *columns[1:], no_specs, F.lit("content").alias("kind"), F.lit(True).alias("item_group"),
            F.when(
                (F.col("item_ord") == F.col("first_item")) & F.col("lead_shown").isNull(),
                F.coalesce(F.try_element_at("outer_head", F.lit(1)), F.lit("")),
            ).otherwise("").alias("group_heading"),
            F.lit(True).alias("renderable"), F.lit(None).cast(base.schema["compare"].dataType).alias("compare"),
            F.lit(None).cast(base.schema["text_overlay"].dataType).alias("text_overlay"),
        )
    )
    whole = base.join(many.select("page_id", "dom_index"), ["page_id", "dom_index"], "left_anti")
    has_text = (F.size("headline") > 0) | (F.size("body") > 0) | (F.size("specs") > 0)
    has_img = F.size("media") > 0
    whole_rows = whole.where(has_text | has_img).select(
        *shared, F.lit(0).alias("part"),
        infer_columns(F.col("column_count"), F.col("layout_type"), F.size("media"), F.size("headline")).cast("int").alias("columns"),
        one_eyebrow, *columns[1:], "specs", F.when(F.col("component_id").isin(rules.SPEC_IDS), "spec").otherwise("content").alias("kind"),
        F.lit(False).alias("item_group"), F.lit("").alias("group_heading"),
        rules.renderable(has_text, has_img, F.size("specs") > 0).alias("renderable"), "compare", "text_overlay",
    )
    return whole_rows.unionByName(lead_rows).unionByName(item_rows).withColumn("stacked", F.lit(False)), gallery


def has_words() -> Column:
    return (F.size("headline") > 0) | (F.size("body") > 0)


def text_only() -> Column:
    return has_words() & (F.size("media") == 0)


def image_only() -> Column:
    """Pictures without words, a stray fragment of a heading not counting as words."""
    fragment = (F.size("body") == 0) & (F.size("headline") > 0) & F.forall("headline", text.is_fragment_heading)
    return (F.size("media") > 0) & (~has_words() | fragment)


# ---------------------------------------------------------------- stitching


@per_key
def pair_orphans(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], wants: Column, gives: Column, dom: Column, payload: Column,
    reach: int = 2, block=None,
) -> DataFrame:
    """Give every text-only row the image-only row of the next two places.

    Adds `taken` (payload of the absorbed row, or NULL) and drops absorbed rows. A text row takes the first free image
    row within two places whose dom distance is at most `reach`; each image row is taken once. Only the text row
    directly before can have taken the next place first, so the greedy walk has this closed form.
    """
    me = F.struct(
        F.coalesce(wants, F.lit(False)).alias("w"), F.coalesce(gives, F.lit(False)).alias("g"), dom.alias("d"),
        payload.alias("p"), F.struct(*order).alias("at"),
    )
    base = df.withColumn("__me", me)
    one = scan(base, keys, order, [Next("__n1", F.col("__me")), Prev("__p1", F.struct("__me.w", "__me.d"))], block)
    two = scan(one, keys, order, [Next("__n2", F.col("__n1"))], block)

    def fits(a: Column, b: Column) -> Column:
        return F.coalesce(b["g"] & (F.abs(b["d"] - a["d"]) <= reach), F.lit(False))

    near, far = F.col("__n1"), F.col("__n2")
    robbed = F.coalesce(F.col("__p1.w"), F.lit(False)) & fits(F.col("__p1"), near)
    takes1 = F.col("__me.w") & fits(F.col("__me"), near) & ~robbed
    takes2 = F.col("__me.w") & ~takes1 & fits(F.col("__me"), far)
    picked = two.withColumn("__t", F.when(takes1, near).when(takes2, far))
    gone = picked.where("__t is not null").select(*keys, F.col("__t.at").alias("__at"))
    return (
        picked.withColumn("__at", F.struct(*order)).join(gone, [*keys, "__at"], "left_anti")
        .withColumn("taken", F.col("__t.p")).drop("__me", "__n1", "__n2", "__p1", "__t", "__at")
    )


def stitch_orphans(sections: DataFrame, keys=PAGE, order=ORDER, block=False) -> DataFrame:
    """Restore title + picture siblings: the picture moves into the title section."""
    payload = F.struct("media", "layout_type", "columns", "compare", "text_overlay", "stacked")
    out = pair_orphans(
        sections, keys, order, text_only(), image_only(), F.col("dom_index"), payload, block=block,
    )
    t = F.col("taken")
    return out.withColumns({
        "media": F.coalesce(t["media"], F.col("media")),
        "columns": F.when(t.isNotNull(), F.greatest("columns", t["columns"])).otherwise(F.col("columns")),
        "layout_type": F.when(t.isNotNull() & ~t["layout_type"].isin("unknown", "vertical_stack"), t["layout_type"]).otherwise(F.col("layout_type")),
        "compare": F.coalesce(t["compare"], F.col("compare")), "text_overlay": F.coalesce(t["text_overlay"], F.col("text_overlay")),
        "stacked": F.col("stacked") | F.coalesce(t["stacked"], F.lit(False)),
        "renderable": F.col("renderable") | t.isNotNull(),
    }).drop("taken")


# ---------------------------------------------------------------- stacked heroes


@per_key
def stack_islands(df: DataFrame, keys, order, stack_key: Column, dom: Column, bare: Column, block=None) -> DataFrame:
    """Number runs of rows that continue the row before: same stack key, next dom index, picture only."""
    seen = F.struct(stack_key.alias("k"), dom.alias("d"), F.coalesce(bare, F.lit(False)).alias("b"))
    me = df.withColumn("__s", seen)
    out = islands(
        me, keys, order, F.col("__s"),
        lambda prev: F.col("__s.k").isNotNull() & (F.col("__s.k") == prev["k"]) & (F.col("__s.d") == prev["d"] + 1) & F.col("__s.b"),
        "stack", block,
    )
    return out.drop("__s")


def merge_stacked_heroes(sections: DataFrame, keys=PAGE, order=ORDER, block=False) -> DataFrame:
    """One section per run of heroes that the page shows as one picture."""
    marks = F.array_sort(F.filter("wrapper_classes", lambda c: c.rlike("^(bg-|width-)")))
    key = F.when(
        F.col("component_id").isin(rules.STACK_IDS) & F.array_contains("wrapper_classes", "no-spacing"), F.array_join(marks, " ")
    )
    numbered = stack_islands(sections, keys, order, key, F.col("dom_index"), (F.size("media") > 0) & ~has_words(), block)
    rows = numbered.withColumn("__row", F.struct(*order, *[c for c in sections.columns if c not in (*keys, *order)]))
    merged = rows.groupBy(*keys, "stack").agg(
        F.min("dom_index").alias("__first"), F.count(F.lit(1)).alias("__n"),
        F.min_by("__row", F.struct(*order)).alias("__r"),
        F.flatten(_ordered(F.col("media"), *order)).alias("__media"),
    )
    uniq = F.aggregate(
        "__media", F.array().cast(MEDIA),
        lambda acc, m: F.when(F.exists(acc, lambda x: x["pc_url"] == m["pc_url"]), acc).otherwise(F.array_append(acc, m)),
    )
    cols = [c for c in sections.columns if c not in (*keys, "media", "stacked", "renderable")]
    many = F.col("__n") >= 2
    return merged.select(
        *keys, *[F.col(f"__r.{c}").alias(c) for c in cols], F.when(many, uniq).otherwise(F.col("__r.media")).alias("media"),
        (many | F.col("__r.stacked")).alias("stacked"),
        F.when(many, F.size(uniq) > 0).otherwise(F.col("__r.renderable")).alias("renderable"),
    ).select(*sections.columns)


def keep_image_only(sections: DataFrame) -> DataFrame:
    """A content section with pictures and no words shows its pictures."""
    lone = (F.size("media") > 0) & ~has_words() & (F.col("kind") == "content")
    return sections.withColumn("renderable", F.col("renderable") | lone)


# ---------------------------------------------------------------- serialisation


def _last_group(i: Column) -> Column:
    """Group of the nearest earlier spec that names one."""
    before = F.filter(F.slice("specs", F.lit(1), i), lambda x: F.coalesce(x["grp"], F.lit("")) != "")
    return F.try_element_at(before, F.lit(-1))["grp"]


def section_text() -> Column:
    """Markdown text of a section row: eyebrow, headings, body, then spec lines with a group heading at each change."""
    title = F.try_element_at(F.filter("specs", lambda s: F.coalesce(s["sect"], F.lit("")) != ""), F.lit(1))["sect"]
    heads = F.when(title.isNotNull(), F.array(F.concat(F.lit("## "), title))).otherwise(
        F.transform("headline", lambda h: F.concat(F.lit("## "), h))
    )
    spec_lines = F.transform(
        "specs",
        lambda s, i: F.concat(
            F.when(
                (F.coalesce(s["grp"], F.lit("")) != "")
                & ~F.coalesce(s["grp"] == _last_group(i), F.lit(False)),
                F.concat(F.lit("### "), s["grp"], F.lit("\n")),
            ).otherwise(""),
            F.lit("- "), s["label"], F.lit(": "), s["value"],
        ),
    )
    shifted = F.when(F.size("specs") > 0, spec_lines).otherwise(F.array().cast(STRINGS))
    return F.array_join(F.filter(F.concat("eyebrow", heads, "body", shifted), lambda p: p != ""), "\n")


def serialise(sections: DataFrame, gen2: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sections, cards) in product form. Renderable rows are numbered; the rest are card candidates.

    Without gen2 disclaimers become rows of their own right after their section; with gen2 they stay inside it and a
    short text-only opening with a headline is kept as an intro.
    """
    rows = sections.where(~F.col("component_id").isin(rules.ANCHOR_IDS)).withColumn("text", section_text())
    intro = rules.is_intro("text_roles", F.size("media") > 0, F.size("specs") > 0, F.col("component_id"))
    rows = rows.withColumn("intro", (F.lit(gen2) & intro) & ~F.col("renderable"))
    shown = rows.where("renderable or intro")
    w = Window.partitionBy("page_id").orderBy(*ORDER)
    notes = F.filter(F.transform("disclaimer", lambda d: F.trim(F.regexp_replace(d, r"^\*+", ""))), lambda d: d != "")
    numbered = shown.withColumns({
        "order_n": F.row_number().over(w), "disclaimers": F.when(F.lit(gen2), F.array_distinct(notes)).otherwise(F.array().cast(STRINGS)),
        "layout_type": F.when(F.col("intro"), "text_intro").otherwise(F.col("layout_type")), "order_kind": F.lit("content"),
    })
    out = numbered
    if not gen2:
        lines = F.array_join(F.transform(notes, lambda d: F.concat(F.lit("*"), d)), "\n")
        extra = numbered.where(F.size("disclaimer") > 0).withColumns({
            "text": lines, "order_kind": F.lit("disclaimer"), "media": F.array().cast(MEDIA), "specs": F.array().cast(SPECS),
            "component_id": F.lit(None).cast("string"), "layout_type": F.lit(None).cast("string"),
        })
        out = numbered.unionByName(extra)
    keep = ["page_id", "order_n", "order_kind", "dom_index", "part", "text", "component_id", "layout_type", "columns", "text_alignment",
            "item_group", "group_heading", "disclaimers", "text_roles", "media", "specs", "compare", "text_overlay", "stacked", "intro"]
    cards = rows.where("not renderable and not intro").select("page_id", "dom_index", "part", "text", "component_id", "layout_type", "media")
    return out.select(*keep), cards


# ---------------------------------------------------------------- dedupe, disclaimers, cuts


def section_signature(media_urls: Column, txt: Column, specs: Column) -> Column:
    """Same pictures, same words, same specs: NULL when there is nothing to compare."""
    imgs = F.array_sort(F.transform(F.filter(media_urls, lambda u: u != ""), urls.dam_path_key))
    empty = (F.size(imgs) == 0) & (text.squash(txt) == "") & (F.size(specs) == 0)
    return F.when(~empty, F.sha2(F.to_json(F.struct(imgs.alias("i"), text.squash(txt).alias("t"), specs.alias("s"))), 256))


def drop_repeated_sections(df: DataFrame, keys: list[str], order: list[str], signature: Column) -> DataFrame:
    signed = df.withColumn("__sig", signature)
    kept = drop_repeats(signed.where("__sig is not null"), [*keys, "__sig"], order)
    return kept.unionByName(signed.where("__sig is null")).drop("__sig")


@per_key
def attach_disclaimers(df: DataFrame, keys, order, is_note: Column, notes: Column, block=None) -> DataFrame:
    """Note-only rows hand their notes to the section before them, or to the next one when none came yet."""
    place = F.struct(*order)
    marked = df.withColumn("__note", F.coalesce(is_note, F.lit(False))).withColumn("__notes", notes)
    real = F.when(~F.col("__note"), place)
    homes = scan(marked, keys, order, [Fill("__before", real), FillNext("__after", real)], block)
    given = (
        homes.where("__note").select(*keys, F.coalesce("__before", "__after").alias("__at"), place.alias("__from"), "__notes")
        .where("__at is not null").groupBy(*keys, "__at").agg(F.flatten(_ordered(F.col("__notes"), F.col("__from"))).alias("__given"))
    )
    own = homes.where("not __note").withColumn("__at", place).join(given, [*keys, "__at"], "left")
    none = F.array().cast(STRINGS)
    merged = F.array_distinct(F.concat(F.coalesce("__notes", none), F.coalesce("__given", none)))
    return own.withColumn("disclaimers", merged).drop("__note", "__notes", "__before", "__after", "__at", "__given")


def cut_below_fold(df: DataFrame, keys, order, component_id: str = "component_id") -> DataFrame:
    """Drop what follows the last marketing component, then the page furniture."""
    from .ordered import cut_after_last

    kept = cut_after_last(df, keys, order, F.col(component_id).isin(rules.MARKETING_IDS))
    return kept.where(~F.coalesce(F.col(component_id), F.lit("")).isin(rules.BELOW_FOLD_IDS))


# ---------------------------------------------------------------- merging runs


@per_key
def merge_consecutive(df: DataFrame, keys, order, same: Column, aggs: list[Column], block=None, out: str = "island") -> DataFrame:
    """Merge neighbours with an equal, non-NULL `same` value into one row."""
    numbered = islands(df.withColumn("__k", same), keys, order, F.struct(F.col("__k").alias("k")), lambda p: F.col("__k") == p["k"], out, block)
    return numbered.groupBy(*keys, out).agg(*aggs)


def append_unless_contained(texts: Column) -> Column:
    """Join texts in order, leaving out one the text so far already holds."""
    return F.aggregate(
        texts, F.lit(""),
        lambda acc, t: F.when(acc == "", F.trim(t)).when((F.trim(t) == "") | F.contains(acc, F.trim(t)), acc).otherwise(
            F.concat(acc, F.lit("\n"), F.trim(t))
        ),
    )


@per_key
def merge_same_component(df: DataFrame, keys, order, block=None) -> DataFrame:
    """Neighbouring sections of one single-unit component become one.

    df: dom_index, layout_type, kind, text, media_urls. A run is one component, so its texts fit one row.
    """
    ok = (F.col("dom_index") >= 0) & F.coalesce(F.col("layout_type").isin(rules.MERGE_LAYOUTS), F.lit(True)) & (F.col("kind") != "disclaimer")
    return merge_consecutive(
        df.withColumn("__ok", F.when(ok, F.col("dom_index"))), keys, order, F.col("__ok"),
        [
            F.min(F.struct(*order)).alias("at"), F.min_by("dom_index", F.struct(*order)).alias("dom_index"),
            append_unless_contained(_ordered(F.col("text"), *order)).alias("text"),
            F.array_distinct(F.flatten(_ordered(F.col("media_urls"), *order))).alias("media_urls"),
        ],
        block,
    )


@per_key
def pair_title_image(df: DataFrame, keys, order, title_only: Column, weak_image: Column, disclaimer: Column, block=None) -> DataFrame:
    """Hand a title-only section to the next non-disclaimer section when that one is a picture without real words.

    Adds `title_from` (place of the title section) to the picture row and drops the title row. The next
    non-disclaimer row has one predecessor only, so no two titles compete.
    """
    place = F.struct(*order)
    marked = df.withColumns({
        "__d": F.coalesce(disclaimer, F.lit(False)), "__t": F.coalesce(title_only, F.lit(False)) & ~F.coalesce(disclaimer, F.lit(False)),
        "__w": F.coalesce(weak_image, F.lit(False)),
    })
    mine = F.when(~F.col("__d"), F.struct("__t", "__w", place.alias("at")))
    out = scan(marked, keys, order, [Fill("__before", mine, strict=True), FillNext("__after", mine, strict=True)], block)
    receives = ~F.col("__d") & F.col("__w") & F.coalesce(F.col("__before.__t"), F.lit(False))
    gone = F.col("__t") & F.coalesce(F.col("__after.__w"), F.lit(False))
    return (
        out.withColumn("title_from", F.when(receives, F.col("__before.at"))).where(~gone)
        .drop("__d", "__t", "__w", "__before", "__after")
    )


@per_key
def merge_text_runs(df: DataFrame, keys, order, text_only_: Column, takes: Column, block=None) -> DataFrame:
    """Runs of text-only rows join the picture row that follows without a headline, else stay one intro row.

    Adds `run` (number shared by the rows that form one section) and `intro`.
    """
    me = df.withColumns({"__t": F.coalesce(text_only_, F.lit(False)), "__g": F.coalesce(takes, F.lit(False))})
    prev = F.struct("__t", "__g")
    out = islands(me, keys, order, prev, lambda p: p["__t"] & (F.col("__t") | F.col("__g")), "run", block)
    return with_group(out, [*keys, "run"], {"intro": F.bool_and("__t")}, block).drop("__t", "__g")


@per_key
def carry_titles(df: DataFrame, keys, order, is_title: Column, receives: Column, title: Column, block=None) -> DataFrame:
    """Pending titles go on top of the next row that can carry them (W20). Adds `carried`; title rows drop out."""
    me = df.withColumns({"__t": F.coalesce(is_title, F.lit(False)), "__title": title})
    me = me.withColumn("__r", F.coalesce(receives, F.lit(False)) & ~F.col("__t"))
    out = scan(me, keys, order, [Total("__n", F.when(F.col("__r"), 1).otherwise(0))], block)
    due = F.when(F.col("__r"), F.col("__n")).otherwise(F.col("__n") + 1)
    titles = out.where("__t").groupBy(*keys, due.alias("__due")).agg(
        F.array_join(F.filter(_ordered(F.trim("__title"), *order), lambda t: t != ""), "\n").alias("carried")
    )
    rest = out.where("not __t").withColumn("__due", F.when(F.col("__r"), F.col("__n")))
    return rest.join(titles, [*keys, "__due"], "left").drop("__t", "__r", "__n", "__due", "__title")


@per_key
def pair_captions(df: DataFrame, keys, order, block=None) -> DataFrame:
    """Pair a media row of a multi-column row group with the caption that follows it.

    df: content_type, n_columns, row_group, is_note. Adds `paired` to media rows and `caption` to used captions. A media
    row behind an open caption of its group pairs only if that caption was itself used, so pairs form chains that hold
    up to their first break: runs plus a running count of breaks.
    """
    text_row = (F.col("content_type") == "text") & (F.col("n_columns") > 1)
    me = F.struct(
        F.coalesce(text_row, F.lit(False)).alias("cap"), F.coalesce(text_row & ~F.col("is_note"), F.lit(False)).alias("usable"),
        F.col("row_group").alias("rg"), ((F.col("content_type") == "media") & (F.col("n_columns") > 1)).alias("med"),
    )
    one = scan(df.withColumn("__me", me), keys, order, [Prev("__p", F.col("__me")), Next("__n", F.col("__me"))], block)
    two = scan(one, keys, order, [Prev("__pp", F.col("__p"))], block)
    same = lambda a: F.coalesce(a["rg"] == F.col("__me.rg"), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    can = F.col("__me.med") & yes(F.col("__n.usable")) & same(F.col("__n"))
    behind = yes(F.col("__p.cap")) & same(F.col("__p"))
    linked = behind & yes(F.col("__pp.med")) & same(F.col("__pp"))
    flags = two.withColumns({"__can": can, "__fail": F.col("__me.med") & (~can | (behind & ~linked)), "__link": linked})
    marked = flags.withColumn("__root", F.when(F.col("__me.med") & ~F.col("__link"), 1).otherwise(0))
    chained = scan(marked, keys, order, [Total("__chain", F.col("__root"))], block)
    counted = scan(chained, [*keys, "__chain"], order, [Total("__bad", F.when(F.col("__fail"), 1).otherwise(0))], block)
    done = counted.withColumn("paired", F.col("__me.med") & (F.col("__bad") == 0))
    last = scan(done, keys, order, [Prev("__used", F.col("paired"))], block)
    return last.withColumn("caption", yes(F.col("__used")) & F.col("__me.cap")).select(*df.columns, "paired", "caption")


# ---------------------------------------------------------------- order, cards, heroes


@per_key
def order_by_document(df: DataFrame, keys, order, block=None) -> DataFrame:
    """Document order (W13). df: disclaimer, dom_index, orig_pos, text_pos, rec_pos (NULL = not found).

    A section and the disclaimers after it move together. Groups with a dom index go by it; the others follow the
    group that stands before them in the source text. Adds `new_order` (a sortable struct).
    """
    place = F.struct(*order)
    grouped = islands(
        df, keys, order, F.struct(F.lit(1).alias("one")), lambda p: F.col("disclaimer") & p["one"].isNotNull(), "__g", block
    )
    dom = F.when(F.col("dom_index") >= 0, F.col("dom_index"))
    heads = grouped.groupBy(*keys, "__g").agg(
        F.min("orig_pos").alias("__o"), F.min_by("text_pos", place).alias("__t"), F.min("rec_pos").alias("__r"),
        F.min_by(dom, F.when(dom.isNotNull(), place)).alias("__dom"),
    )
    far = F.lit(10**9)
    ranked = heads.withColumn("__a", F.coalesce("__o", "__t", "__r", far + F.col("__g")).cast("bigint"))
    seen = scan(ranked, keys, ["__a", "__g"], [Fill("__last", F.col("__dom"))], block)
    new = F.struct(
        F.coalesce("__dom", "__last", F.lit(-1)).alias("dom"), F.when(F.col("__dom").isNull(), 1).otherwise(0).alias("tail"),
        F.col("__a").alias("anchor"), F.col("__g").alias("grp"),
    )
    return grouped.join(seen.select(*keys, "__g", new.alias("__new")), [*keys, "__g"]).withColumn(
        "new_order", F.struct("__new.dom", "__new.tail", "__new.anchor", "__new.grp", place.alias("place"))
    ).drop("__g", "__new")


CARD_LAYOUT = r"^grid_|^icon_grid$"


def cardish(layout: Column | str, item_group: Column | str) -> Column:
    lay = F.col(layout) if isinstance(layout, str) else layout
    grp = F.col(item_group) if isinstance(item_group, str) else item_group
    return F.coalesce(lay.rlike(CARD_LAYOUT), F.lit(False)) | F.coalesce(grp, F.lit(False))


@per_key
def card_rows(df: DataFrame, keys, order, max_cols: int = 4, use_group_heading: bool = True, block=None) -> tuple[DataFrame, DataFrame]:
    """(card rows, other rows).

    df: dom_index, card_like BOOLEAN, disclaimer BOOLEAN, column_count, text, group_heading, cards ARRAY<STRUCT<img,text>>.
    Neighbouring sections of one card-like component with two or more cards become rows of `cols` cards; a heading line of
    the component, or the text-only section right before it, heads the first row.
    """
    place = F.struct(*order)
    me = df.withColumn("__dom", F.when((F.col("dom_index") >= 0) & ~F.col("disclaimer"), F.col("dom_index")))
    runs = islands(me, keys, order, F.struct(F.col("__dom").alias("d")), lambda p: F.col("__dom") == p["d"], "run", block)
    runs = runs.withColumns({"__at": place, "__n": F.size("cards")})
    group = [*keys, "run"]
    begun = with_group(runs, group, {"__start": F.min(F.when(F.col("card_like") & F.col("__dom").isNotNull(), F.col("__at")))}, block)
    tagged = begun.withColumn("__in", F.coalesce(F.col("__at") >= F.col("__start"), F.lit(False)))
    hashed = F.when((F.col("__n") == 0) & F.trim("text").startswith("##"), F.col("text"))
    named = F.when((F.col("__n") > 0) & (F.coalesce("group_heading", F.lit("")) != ""), F.concat(F.lit("## "), F.col("group_heading")))
    head = F.coalesce(named, hashed) if use_group_heading else hashed
    inside = lambda ok: F.when(F.col("__in") & ok, F.col("__at"))
    counted = with_group(tagged, group, {
        "n_cards": F.sum(F.when(F.col("__in"), F.col("__n"))), "cc": F.min_by("column_count", inside(F.lit(True))),
        "heading": F.min_by(head, inside(head.isNotNull())),
        "first_card": F.min_by(F.try_element_at("cards", F.lit(1)), inside(F.col("__n") > 0)),
    }, block)
    merged = counted.withColumn("__card", F.coalesce(F.col("__in") & (F.col("n_cards") >= 2), F.lit(False)))
    loose = ~F.col("__card") & (F.col("__n") == 0) & ~F.col("disclaimer") & (F.trim("text") != "")
    with_prev = scan(
        merged, keys, order,
        [Prev("__before", F.struct(F.when(loose, F.col("text")).alias("t"))),
         Next("__next", F.struct(F.col("__card").alias("c"), F.col("heading").isNull().alias("open"), (F.col("__at") == F.col("__start")).alias("s")))],
        block,
    )
    bare = lambda t: F.lower(F.trim(F.regexp_replace(F.trim(t), r"^#+\s*", "")))
    popped = loose & F.coalesce(F.col("__next.c") & F.col("__next.s") & F.col("__next.open"), F.lit(False))
    others = with_prev.where(~F.col("__card") & ~popped).select(*df.columns)
    starter = F.when(F.col("__card") & (F.col("__at") == F.col("__start")), F.col("__at"))
    lent = with_group(with_prev, group, {"lent": F.min_by(F.col("__before.t"), starter)}, block)
    flat = lent.where("__card").select(
        *keys, "run", *order, "n_cards", "cc", "heading", "first_card", "lent", F.posexplode("cards").alias("__k", "card"))
    sized = scan(flat, group, [*order, "__k"], [Total("__rn", F.lit(1))], block)
    per = F.when(F.col("cc").between(2, max_cols), F.col("cc")).otherwise(F.least("n_cards", F.lit(max_cols))).cast("int")
    chunked = sized.withColumn("cols", per).withColumn("chunk", F.floor((F.col("__rn") - 1) / F.col("cols")))
    title = F.coalesce("heading", "lent", F.lit(""))
    same = F.lit(use_group_heading) & (bare(title) == bare(F.coalesce(F.try_element_at(
        F.filter(F.split(F.coalesce(F.col("first_card.text"), F.lit("")), "\n"), lambda ln: F.trim(ln) != ""), F.lit(1)), F.lit(""))))
    rows = chunked.withColumn("__h", F.when((F.col("chunk") == 0) & ~same, title).otherwise("")).groupBy(
        *keys, "run", "chunk", "cols").agg(_ordered(F.col("card"), "__rn").alias("cards"), F.max("__h").alias("heading"))
    return rows, others


@per_key
def spread_awards(df: DataFrame, keys, order, one_logo: Column, component_id: Column, award: Column, block=None) -> DataFrame:
    """In a run of two or more one-logo sections of one component, one award makes all of them awards."""
    me = df.withColumns({"__k": F.when(one_logo, F.coalesce(component_id, F.lit(""))), "__a": F.coalesce(award, F.lit(False))})
    runs = islands(me, keys, order, F.struct(F.col("__k").alias("k")), lambda p: F.col("__k") == p["k"], "__run", block)
    counted = with_group(runs, [*keys, "__run"], {"__n": F.count(F.lit(1)), "__any": F.bool_or("__a")}, block)
    return counted.withColumn(
        "award", F.col("__a") | ((F.col("__n") >= 2) & F.col("__any") & F.col("__k").isNotNull())
    ).drop("__k", "__a", "__run", "__n", "__any")


@per_key
def spec_table_rows(specs: DataFrame, keys, order, group: str = "grp", block=None) -> DataFrame:
    """Spec rows with `header`, the group name where the group changes."""
    named = F.nullif(F.col(group), F.lit(""))
    out = scan(specs, keys, order, [Fill("__p", named, strict=True)], block)
    changed = F.col("__p").isNull() | (F.col("__p") != named)
    return out.withColumn("header", F.when(named.isNotNull() & changed, named)).drop("__p")


def list_columns(n: Column) -> Column:
    """Columns of a list of n items."""
    return F.when(n <= 4, n).when(n % 3 == 0, 3).when(n % 4 == 0, 4).otherwise(3)


def choose_sections(component_sections: DataFrame, model_sections: DataFrame, minimum: int = 3) -> DataFrame:
    """Model sections replace the component ones of pages with fewer than three renderable sections."""
    good = component_sections.groupBy("page_id").agg(F.count_if("renderable").alias("n")).where(F.col("n") >= minimum).select("page_id")
    kept = component_sections.join(good, "page_id", "left_semi")
    usable = model_sections.join(good, "page_id", "left_anti")
    covered = usable.select("page_id").distinct()
    poor = component_sections.join(good, "page_id", "left_anti").join(covered, "page_id", "left_anti")
    return kept.unionByName(poor).unionByName(usable, allowMissingColumns=True)


def apply_moves(media: DataFrame, moves: DataFrame) -> DataFrame:
    """Move media whose address contains the move's image to another section of the page."""
    hits = media.join(moves, "page_id").where(F.contains("url", F.col("image"))).groupBy("page_id", "sec_ord", "media_ord").agg(
        F.min_by("to_section", "move_ord").alias("to_section")
    )
    return media.join(hits, ["page_id", "sec_ord", "media_ord"], "left").withColumn(
        "sec_ord", F.coalesce("to_section", "sec_ord")).drop("to_section")


def reorder_sections(sections: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sections + place): sections in the wanted order where it names every section of the page once, else as they are.

    sections: page_id, sec_ord, disclaimer; wanted: page_id, place, sec_ord. Disclaimer sections are no part of the wanted order: they follow the
    section before them, those before any stay first. Pages without a wanted order, and orders with a repeated, missing, unknown or null
    number, keep theirs. `place` numbers the sections of a page from 1.
    """
    page = Window.partitionBy("page_id").orderBy("sec_ord")
    note = F.coalesce("disclaimer", F.lit(False))
    rows = sections.withColumn("__owner", F.last(F.when(~note, F.col("sec_ord")), ignorenulls=True).over(page))
    own = sections.where(~note).select("page_id", "sec_ord", F.lit(1).alias("__own"))
    asked = wanted.groupBy("page_id", "sec_ord").agg(F.count(F.lit(1)).alias("__times"), F.min("place").alias("__at"))
    pairs = asked.join(own, ["page_id", "sec_ord"], "full")
    good = pairs.groupBy("page_id").agg(F.bool_and((F.coalesce("__own", F.lit(0)) == 1) & (F.coalesce("__times", F.lit(0)) == 1)).alias("__good")).where("__good")
    moved = asked.join(good, "page_id", "left_semi").select("page_id", F.col("sec_ord").alias("__owner"), "__at")
    rows = rows.join(moved, ["page_id", "__owner"], "left")
    at = F.when(F.col("__owner").isNotNull(), F.coalesce("__at", "__owner"))
    order = Window.partitionBy("page_id").orderBy(at.asc_nulls_first(), "sec_ord")
    return rows.select(*sections.columns, F.row_number().over(order).alias("place"))


LOOK_AHEAD, MOST_ABSORBED = 10, 3


def pair_generic(blocks: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(blocks + title_at): image-only blocks with the title-only block that takes them (W18). blocks: has_heading, has_image, primary.

    The walk keeps one waiting title: it lasts LOOK_AHEAD blocks and takes MOST_ABSORBED images. A primary one gives way only to another
    primary block with a heading, an ordinary one to any. Without the walk: how long a primary title waits follows from the next primary
    heading, the third image after it (an equi-join on the number of the image) and the look-ahead. Ordinary titles count only outside these
    spans, and end at the next heading at all, so the spans never overlap and each image looks at the last title before it. `at` numbers the
    blocks of a key from any number, without gaps.
    """
    up = Window.partitionBy(*keys).orderBy(at)
    sofar, before = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*keys).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    head, picture = F.coalesce("has_heading", F.lit(False)), F.coalesce("has_image", F.lit(False))
    rows = blocks.withColumns({
        "__title": head & ~picture, "__image": picture & ~head, "__head": head, "__main": head & F.coalesce("primary", F.lit(False))})
    rows = rows.withColumns({
        "__n": F.count_if("__image").over(sofar), "__next": F.last(F.when(F.col("__head"), F.col(at)), ignorenulls=True).over(behind),
        "__next_main": F.last(F.when(F.col("__main"), F.col(at)), ignorenulls=True).over(behind)})
    nth = rows.where("__image").select(*keys, F.col("__n").alias("__last"), F.col(at).alias("__full"))
    rows = rows.withColumn("__last", F.col("__n") + MOST_ABSORBED).join(nth, [*keys, "__last"], "left")

    def span(which: Column, stop: str) -> Column:
        return F.when(which, F.struct(F.col(at).alias("from"), F.least(F.col(at) + LOOK_AHEAD, F.col("__full"), F.col(stop) - 1).alias("to")))

    rows = rows.withColumn("__p", F.last(span(F.col("__title") & F.col("__main"), "__next_main"), ignorenulls=True).over(before))
    held = F.coalesce(F.col("__p.to") >= F.col(at), F.lit(False))
    rows = rows.withColumn("__held", held)
    rows = rows.withColumn("__q", F.last(span(F.col("__title") & ~F.col("__main") & ~F.col("__held"), "__next"), ignorenulls=True).over(before))
    title = F.when(F.col("__held"), F.col("__p.from")).when(F.col("__q.to") >= F.col(at), F.col("__q.from"))
    out = rows.withColumn("title_at", F.when(F.col("__image"), title)).where("title_at is not null")
    return out.select(*blocks.columns, "title_at")


def union_sections(*frames: DataFrame) -> DataFrame:
    """Union of section tables from several sources, by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def minus(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a with no partner in b."""
    return a.join(b.select(*on).distinct(), on, "left_anti")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.intersect(b)


def ordered_union(a: Column, b: Column) -> Column:
    """Ordered distinct union of two arrays."""
    return F.array_union(a, b)
