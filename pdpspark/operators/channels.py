"""Channel outputs: features and modules, listing texts and drafts, fragments, copy sheets, content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..functions import rules, text, urls
from .ordered import Prev, Total, islands, per_key, scan, with_group
from .sections import _ordered

# Module boxes in pixels, module choice per image row, text limits.
MODULE_BOXES = {
    "sidebar": [(500, 460)], "left-img": [(300, 300)], "right-img": [(300, 300)], "highlights": [(300, 300)],
    "lighttext": [(970, 300)], "dark-overlay": [(970, 300)], "image-header-text": [(970, 600)], "three-img": [(300, 300)] * 3,
    "four-text": [(220, 220)] * 4, "four-hl": [(400, 560), (140, 230), (140, 230), (140, 230)], "quadrant": [(160, 200)] * 4,
    "compare": [(260, 200)] * 3, "specs-detail": [(300, 300)],
}
DEFAULT_MODULE = "image-header-text"
PREMIUM = {
    "four-text": "p-four-images", "three-img": "p-simple-carousel", "text": "p-text", "highlights": "p-single-img-text",
    "image-header-text": "p-full-image", "left-img": "p-single-img-text", "right-img": "p-single-img-text", "sidebar": "p-single-img-text",
    "lighttext": "p-bg-text", "dark-overlay": "p-bg-text",
}
TITLE_LIMIT, BODY_LIMIT, ITEM_TITLE_LIMIT, BODY_HEADLINE_LIMIT = 120, 600, 60, 80
LISTING_FIELDS = ["promotion", "details", "delivery", "aftercare", "returns"]
LISTING_TITLES = {
    "promotion": "Promotion Details", "details": "Product Details", "delivery": "Delivery & Installation Notice",
    "aftercare": "After Care Service Information", "returns": "Terms & Conditions for Return Policy",
}


# ---------------------------------------------------------------- features


@per_key
def to_features(sections: DataFrame, keys, order, block=None) -> DataFrame:
    """Group sections into features (W10): one row per feature with its images as cards.

    sections: dom_index, award, card_like, column_count, row_group, row_columns, headline, eyebrow, body, is_head,
    images ARRAY<STRING>. The sections of one component share their layout and column count, as assembly makes them.
    Kinds, by the first section of a stretch: award, grid (card-like component with two or more cards), columns (declared
    columns), row (one row group) and single. Cards go `per_row` to a feature. Features without an image are dropped; a
    short text-only section right before a columns or row feature becomes its heading instead.
    """
    place = F.struct(*order)
    base = sections.withColumns({"__at": place, "__n": F.size("images")})
    comps = islands(
        base, keys, order, F.struct(F.col("dom_index").alias("d")), lambda p: F.col("dom_index") == p["d"], "__run", block
    )
    run = [*keys, "__run"]
    led = with_group(comps, run, {"__first": F.min(F.when(~F.col("award"), F.col("__at")))}, block)
    tagged = led.withColumn("__body", F.coalesce(F.col("__at") >= F.col("__first"), F.lit(False)))
    counts = F.col("__body") & F.col("dom_index").isNotNull()
    at = F.when(counts, F.col("__at"))
    out = with_group(tagged, run, {
        "__cardish": F.min_by("card_like", at), "__cards": F.sum(F.when(counts, F.col("__n"))),
    }, block)
    grid = F.coalesce(F.col("__cardish") & (F.col("__cards") >= 2), F.lit(False)) & F.col("__body")
    kind1 = F.when(grid, "grid").when(F.col("award"), "award").when(F.col("column_count") >= 2, "columns").when(
        F.col("row_group").isNotNull() & (F.col("row_columns") >= 2), "row").otherwise("single")
    marked = out.withColumn("__kind", kind1)
    me = F.struct("__kind", "__run", F.col("row_group").alias("rg"), F.col("column_count").alias("cc"), F.col("dom_index").alias("d"))

    def goes_on(p: Column) -> Column:
        same_run = F.col("__run") == p["__run"]
        return (F.col("__kind") == p["__kind"]) & (
            F.when(F.col("__kind").isin("grid", "award"), same_run)
            .when(F.col("__kind") == "columns", (F.col("column_count") == p["cc"]) & (F.col("__n") > 0) & (p["d"].isNull() | same_run))
            .when(F.col("__kind") == "row", F.col("row_group") == p["rg"])
            .otherwise(False)
        )

    runs = islands(marked, keys, order, me, goes_on, "__f", block)
    sized = with_group(runs, [*keys, "__f"], {
        "__imgs": F.sum("__n"), "__rows": F.count(F.lit(1)),
        "__head": F.min_by("headline", F.when(F.col("is_head") & (F.col("__n") == 0), F.col("__at"))),
        "__eyebrow": F.min_by("eyebrow", "__at"), "__start": F.min("__at"),
    }, block)
    few = ((F.col("__kind") == "columns") & (F.col("__imgs") < 2)) | ((F.col("__kind") == "row") & (F.col("__rows") < 2))
    kind = F.when(few, "single").otherwise(F.col("__kind"))
    group_at = F.when(kind == "single", F.col("__at")).otherwise(F.col("__start"))
    done = sized.withColumns({"kind": kind, "at": group_at})
    short = (F.col("kind") == "single") & (F.col("__n") == 0) & (F.col("headline") != "") & ~F.col("headline").rlike("^[*※]") & (
        F.length("headline") < 60)
    lent = scan(done, keys, order, [Prev("__lent", F.struct(F.when(short, F.col("headline")).alias("h")))], block)
    heading = F.when(
        (F.col("__at") == F.col("at")),
        F.when(F.col("kind") == "grid", F.coalesce("__head", F.lit("")))
        .when(F.col("kind") == "columns", F.coalesce(F.col("__lent.h"), F.when(~F.col("__eyebrow").rlike("^[*※]"), F.col("__eyebrow")), F.lit("")))
        .when(F.col("kind") == "row", F.coalesce(F.col("__lent.h"), urls.js_or("__eyebrow"), F.lit("Key Features"))),
    )
    withheads = with_group(lent.withColumn("__heading", heading), [*keys, "at"], {"group_heading": F.max("__heading")}, block)
    cards = withheads.where(F.col("__n") > 0).select(
        *keys, "at", "kind", "group_heading", *order, "column_count", "row_columns", "__imgs", "headline", "eyebrow", "body", F.posexplode("images").alias("__k", "image")
    )
    single_text = (F.col("kind") != "single") & (F.col("__k") > 0) & (F.col("kind") == "columns")
    flat = cards.withColumns({
        "title": F.when(single_text, "").otherwise(F.col("headline")), "card_body": F.when(single_text, "").otherwise(F.col("body")),
    })
    rn = scan(flat, [*keys, "at"], [*order, "__k"], [Total("__rn", F.lit(1))], block)
    per = (
        F.when(F.col("kind").isin("grid", "columns"), F.when(F.col("column_count") >= 2, F.col("column_count")).otherwise(F.least("__imgs", F.lit(4))))
        .when(F.col("kind") == "award", F.least("__imgs", F.lit(4))).when(F.col("kind") == "row", F.col("row_columns")).otherwise(F.lit(1))
    ).cast("int")
    chunk = F.when(F.col("kind").isin("grid", "columns"), F.floor((F.col("__rn") - 1) / per)).otherwise(F.lit(0))
    chunked = rn.withColumns({"per_row": per, "chunk": chunk.cast("int")})
    made = chunked.groupBy(*keys, "at", "kind", "chunk", "per_row").agg(
        _ordered(F.struct(F.col("image").alias("image"), F.col("title").alias("title"), F.col("card_body").alias("body")), "__rn").alias("cards"),
        F.min_by("headline", "__rn").alias("own_head"), F.min_by("eyebrow", "__rn").alias("own_eyebrow"),
        F.min_by("body", "__rn").alias("own_body"), F.max("group_heading").alias("group_heading"),
    )
    one = F.size("cards") == 1
    title = (
        F.when(F.col("kind") == "single", F.col("own_head"))
        .when(F.col("kind") == "award", F.when(one, F.col("own_head")).otherwise(""))
        .when(F.col("chunk") == 0, F.coalesce("group_heading", F.lit(""))).otherwise("")
    )
    solo = F.col("kind") == "single"
    return made.select(
        *keys, "at", "chunk", "kind", "per_row", title.alias("headline"), F.when(solo, F.col("own_eyebrow")).otherwise("").alias("subheadline"),
        F.when(solo | ((F.col("kind") == "award") & one), F.col("own_body")).otherwise("").alias("body"), "cards",
    )


def expand_features(features: DataFrame, keys) -> DataFrame:
    """One card per feature where images do not form a row (W11): several images of a single feature, or two awards."""
    n = F.size("cards")
    spread = ((F.col("kind") == "award") & (n == 2)) | ((F.col("kind") != "award") & ~((F.col("per_row") == 3) | (F.col("per_row") >= 4)) & (n >= 2))
    kept = features.where(~spread).withColumn("split", F.lit(0))
    flat = features.where(spread).select("*", F.posexplode("cards").alias("split", "card")).drop("cards")
    award = F.col("kind") == "award"
    title = F.when(award, F.col("card.title")).otherwise(
        F.left(urls.js_or(F.when(F.length(F.trim("card.title")) > 2, F.trim("card.title")), F.col("headline"), F.lit("Feature")), F.lit(TITLE_LIMIT))
    )
    body = F.when(award, F.col("card.body")).when(F.col("split") == 0, F.left("body", F.lit(BODY_LIMIT))).otherwise("")
    cut = flat.withColumns({
        "headline": title, "body": body, "subheadline": F.when(F.col("split") == 0, F.col("subheadline")).otherwise(""),
        "per_row": F.when(award, 1).otherwise(0), "cards": F.array("card"),
    }).drop("card")
    out = kept.unionByName(cut)
    return out.withColumns({c: text.strip_symbols(c) for c in ("headline", "subheadline", "body")}).withColumn(
        "cards", F.transform("cards", lambda c: F.struct(
            c["image"].alias("image"), text.strip_symbols(c["title"]).alias("title"), text.strip_symbols(c["body"]).alias("body")))
    )


# ---------------------------------------------------------------- modules


def build_modules(features: DataFrame, selection: DataFrame, keys, mode: str = "standard", start_id: int = 1, block=None) -> DataFrame:
    """Modules in selection order (W12). features: feature_no, headline, subheadline, body, kind, per_row, cards.
    selection: keys, ord, feature_no.

    Three or four images on a row make an image-row module when they differ, otherwise the single-image one. Premium mode
    swaps each type for its premium twin. Ids count from start_id per key.
    """
    chosen = selection.join(features, [*keys, "feature_no"])
    n = F.size("cards")
    wanted = (
        F.when(n == 0, "text")
        .when(F.col("kind") == "award", F.when(n >= 4, "four-text").when(n == 3, "three-img").otherwise("left-img"))
        .when(F.col("per_row") >= 4, "four-text").when(F.col("per_row") == 3, "three-img").otherwise(DEFAULT_MODULE)
    )
    typed = chosen.withColumn("__w", wanted)
    slots = F.when(F.col("__w") == "three-img", 3).when(F.col("__w") == "four-text", 4)
    uniq = F.array_distinct(F.filter(F.transform(F.slice("cards", 1, 4), lambda c: c["image"]), lambda u: F.coalesce(u, F.lit("")) != ""))
    first = F.slice(uniq, F.lit(1), slots)
    full = F.coalesce(F.size(first) == slots, F.lit(False))
    kind = F.when(slots.isNotNull() & ~full, DEFAULT_MODULE).otherwise(F.col("__w"))
    slot_map = F.when(full, F.map_from_arrays(F.transform(F.sequence(F.lit(1), slots), lambda i: F.concat(F.lit("s"), i.cast("string"))), first))
    twin = F.create_map(*[F.lit(x) for pair in PREMIUM.items() for x in pair])
    final = F.coalesce(F.try_element_at(twin, kind), F.lit("p-text")) if mode == "premium" else kind
    out = typed.withColumns({
        "type": final, "slot_images": slot_map, "image_url": F.try_element_at("cards", F.lit(1))["image"],
        "headline": F.when(F.col("kind") == "award", F.col("headline")).otherwise(
            F.coalesce(urls.js_or("headline", "subheadline", F.left("body", F.lit(BODY_HEADLINE_LIMIT))), F.lit("Product Feature"))),
        "items": F.transform(F.slice("cards", 1, 4), lambda c: F.struct(c["image"].alias("image"), F.left(
            c["title"], F.lit(ITEM_TITLE_LIMIT)).alias("title"), c["body"].alias("body"))),
    })
    ranked = scan(out, keys, ["ord"], [Total("__id", F.lit(1))], block)
    return ranked.withColumn("module_id", F.col("__id") + (start_id - 1)).select(
        *keys, "module_id", "ord", "type", "image_url", "slot_images", "headline", "subheadline", "body", "items"
    )


def module_copy(modules: DataFrame, keys) -> DataFrame:
    """(keys, module_id, row, label, value): the words each module shows (K9)."""
    row = lambda label, value: F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), value.alias("value"))
    pictures = F.col("type").isin("three-img", "four-text")
    shown = F.slice("items", F.lit(1), F.when(F.col("type") == "three-img", 3).otherwise(4))
    titles = F.flatten(F.transform(shown, lambda it, i: F.array(
        row(F.concat(F.lit("Image "), (i + 1).cast("string"), F.lit(" title")), it["title"]),
        row(F.concat(F.lit("Image "), (i + 1).cast("string"), F.lit(" body")), it["body"]))))
    rows = F.when(pictures, F.concat(F.array(row("Headline", F.col("headline"))), titles)).otherwise(
        F.array(row("Headline", F.col("headline")), row("Body", F.col("body"))))
    kept = F.filter(rows, lambda r: F.coalesce(r["value"], F.lit("")) != "")
    return modules.select(*keys, "module_id", F.posexplode(kept).alias("row", "r")).select(*keys, "module_id", "row", "r.label", "r.value")


def image_jobs(modules: DataFrame, keys) -> DataFrame:
    """(keys, module_id, slot, name, url, w, h): image per module box: slot image, item image, module image (K9)."""
    boxes = F.create_map(*[
        x for name, sizes in MODULE_BOXES.items()
        for x in (F.lit(name), F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in sizes]))
    ])
    flat = modules.withColumn("__b", F.try_element_at(boxes, F.col("type"))).select(
        "*", F.posexplode("__b").alias("__i", "box")).withColumn("slot", F.col("__i") + 1)
    url = urls.js_or(
        F.try_element_at("slot_images", F.concat(F.lit("s"), F.col("slot").cast("string"))), F.try_element_at("items", F.col("slot"))["image"], "image_url"
    )
    suffix = F.when(F.size("__b") > 1, F.concat(F.lit("-"), F.col("slot").cast("string"))).otherwise("")
    name = F.concat(
        F.lpad(F.col("module_id").cast("string"), 2, "0"), F.lit("-"), F.col("type"), suffix, F.lit("-"), F.col("box.w").cast("string"),
        F.lit("x"), F.col("box.h").cast("string"), F.lit(".jpg"),
    )
    return flat.select(*keys, "module_id", "slot", name.alias("name"), url.alias("url"), F.col("box.w").alias("w"), F.col("box.h").alias("h")).where(
        "url is not null")


# ---------------------------------------------------------------- listing texts (K5, V5), drafts (O3)


def _titled(fields: Column, titles: Column, key: str) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(titles, F.lit(key)), F.lit("")), F.lit(LISTING_TITLES[key]))


def listing_text(fields: Column, titles: Column) -> Column:
    """Plain listing text: fixed field order, default titles, blank fields skipped (K5)."""
    value = lambda k: text.trim_ws(F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit("")))
    parts = F.filter(
        F.array(*[F.when(value(k) != "", F.concat(_titled(fields, titles, k), F.lit(":\n\n"), value(k))) for k in LISTING_FIELDS]),
        lambda p: p.isNotNull(),
    )
    return F.when(F.size(parts) == 0, "").otherwise(F.concat(F.array_join(parts, "\n\n\n\n"), F.lit("\n")))


def listing_blocks(current: DataFrame, keys) -> DataFrame:
    """(keys, place, block_ord, field, title, text): promotion on top, the others at the bottom, blank ones left out (V5)."""
    rows = F.array(*[
        F.struct(
            F.lit("top" if k == "promotion" else "bottom").alias("place"), F.lit(i).alias("block_ord"), F.lit(k).alias("field"),
            _titled(F.col("fields"), F.col("titles"), k).alias("title"),
            F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")).alias("text"),
        )
        for i, k in enumerate(LISTING_FIELDS)
    ])
    return current.select(*keys, F.inline(F.filter(rows, lambda r: text.trim_ws(r["text"]) != "")))


@per_key
def draft_details(items: DataFrame, keys, order, limit: int = 8, block=None) -> DataFrame:
    """(keys, line rows) of a product-details draft (O3, F20): title and body lines of the first `limit` titles.

    items: title, body. Promotion texts, specification summaries and bare questions stay out; a title of more than 80
    characters is a detail of the title before it.
    """
    t, b = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"\s+", " "))
    spec_like = F.regexp_count(F.concat(F.lit(" "), b), F.lit(r" - [A-Z][A-Z .()/]+:")) >= 3
    usable = items.withColumns({"__t": t, "__b": b}).where(
        (F.col("__t") != "") & ~F.col("__t").rlike(text.PROMO) & ~F.col("__b").rlike(text.PROMO) & ~F.col("__t").rlike("^[-–]") & ~spec_like
    ).withColumn("__long", F.length("__t") > 80)
    bare = ~F.col("__long") & (F.col("__b") == "") & F.col("__t").endswith("?")
    good = usable.where(~bare)
    heads = good.where("not __long")
    from .ordered import drop_repeats

    first = drop_repeats(heads, [*keys, "__t"], order)
    both = first.unionByName(good.where("__long"))
    counted = scan(both, keys, order, [Total("__n", F.when(~F.col("__long"), 1).otherwise(0))], block)
    inside = counted.where((F.col("__n") <= limit) & (~F.col("__long") | ((F.col("__n") > 0) & (F.col("__n") < limit))))
    line = F.when(F.col("__long"), F.concat(F.lit("- "), F.left("__t", F.lit(400)))).otherwise(
        F.concat(F.lit("● "), F.col("__t"), F.when(F.col("__b") != "", F.concat(F.lit("\n- "), F.left("__b", F.lit(400)))).otherwise(F.lit("")))
    )
    return inside.select(*keys, *order, F.col("__n").alias("title_no"), line.alias("line"))


def source_text(sections: DataFrame, keys, order, title: str = "title") -> DataFrame:
    """(keys, doc): title, section texts without disclaimers, each followed by a blank line."""
    body = F.trim(F.replace("text", F.lit(" "), F.lit(" ")))
    rows = sections.where("not is_disclaimer").withColumn("__t", body).where("__t <> ''")
    return rows.groupBy(*keys).agg(_ordered(F.col("__t"), *order).alias("__all"), F.first(title).alias("__title")).select(
        *keys, F.concat(F.col("__title"), F.lit("\n\n"), F.array_join("__all", "\n\n")).alias("doc"))


#: Shortest key that counts as contained in another; shortest piece that all keys around it must share.
CONTAINED_MIN = GRAM = 6


def usp_points(blocks: DataFrame, keys, order) -> DataFrame:
    """(keys, at, kind, key, title, desc): what each block of a product adds (A16 input). kind: point, or more for words without a title.

    blocks: text. A block's title is its first line if a heading line is in it; the first block that has a key may lack one and is
    titled by its first line. Blocks before it and blocks with an empty key add nothing.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda ln: F.trim(F.regexp_replace(ln, "[\\x{2028}\\x{A0}]", " "))), lambda ln: (ln != "") & ~ln.startswith("*"))
    clean = lambda ln: F.trim(F.regexp_replace(ln, r"^[#>\-\s•]+", ""))
    base = blocks.select(*keys, F.struct(*order).alias("at"), lines.alias("ls")).where(F.size("ls") > 0)
    base = base.withColumns({"headed": F.exists("ls", lambda ln: ln.startswith("#")), "cl": F.transform("ls", clean)})
    full = lambda c: F.array_join(F.filter(c, lambda x: x != ""), " ")
    title = F.when(F.col("headed"), F.element_at("cl", 1)).otherwise(F.left(F.element_at("cl", 1), F.lit(80)))
    base = base.withColumn("title", title).withColumn("key", text.usp_key("title"))
    first = base.where("key <> ''").groupBy(*keys).agg(F.min("at").alias("__first"))
    rows = base.join(first, list(keys)).where("at >= __first")
    kind = F.when(F.col("headed") | (F.col("at") == F.col("__first")), "point").otherwise("more")
    rows = rows.withColumn("kind", kind).where("kind = 'more' or key <> ''")
    desc = F.when(F.col("kind") == "point", full(F.slice("cl", 2, F.greatest(F.size("cl"), F.lit(1))))).otherwise(F.trim(F.array_join("cl", " ")))
    return rows.select(*keys, "at", "kind", "key", "title", desc.alias("desc"))


def contained_keys(points: DataFrame, keys) -> DataFrame:
    """(keys, key, other, earlier): each key with the keys before it that hold it or that it holds.

    A key that lies in another shares all its pieces of GRAM characters with it. So its rarest piece in the product is looked up among the
    pieces of all keys, an equi-join, and `contains` confirms the hit.
    """
    one = points.where("kind = 'point'").groupBy(*keys, "key").agg(F.min("at").alias("since")).where(F.length("key") >= CONTAINED_MIN)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - (GRAM - 1)), lambda i: F.substring(F.col("key"), i, F.lit(GRAM))))
    pieces = one.select(*keys, "key", "since", F.explode(grams).alias("gram"))
    rare = pieces.groupBy(*keys, "gram").count()
    picked = pieces.join(rare, [*keys, "gram"]).groupBy(*keys, "key", "since").agg(F.min_by("gram", F.struct("count", "gram")).alias("gram"))
    around = pieces.withColumnsRenamed({"key": "big", "since": "big_since"})
    pairs = picked.join(around, [*keys, "gram"]).where((F.col("key") != F.col("big")) & F.contains("big", F.col("key")))
    swap = F.col("since") < F.col("big_since")
    return pairs.select(*keys, F.when(swap, F.col("big")).otherwise(F.col("key")).alias("key"), F.when(swap, F.col("key")).otherwise(F.col("big")).alias("earlier"),
                        F.least("since", "big_since").alias("earlier_since")).distinct()


def usp_list(blocks: DataFrame, keys, order) -> DataFrame:
    """(keys, place, title, desc): selling points of a product, one per title; a title that holds an earlier one or lies in it joins it.

    The first point of a title is listed unless an earlier listed title is equal to, holds or lies in it. That is settled in rounds: a
    title none of whose earlier neighbours is listed or open is listed, one with a listed earlier neighbour is not; the earliest open title
    of a product is settled in every round. Words without a title join the point listed last before them. A joining text that the point's
    text holds already is left out.
    """
    points = cut_lineage(usp_points(blocks, keys, order))
    near = cut_lineage(contained_keys(points, keys))
    every = points.where("kind = 'point'").groupBy(*keys, "key").agg(F.min("at").alias("since"))
    asked = near.select(*keys, "key").distinct()
    listed = every.join(asked, [*keys, "key"], "left_anti").select(*keys, "key")
    open_, out = cut_lineage(asked), None
    while not open_.isEmpty():
        yes = listed.select(*keys, F.col("key").alias("earlier"))
        gone = near.join(yes, [*keys, "earlier"]).select(*keys, "key").distinct()
        waits = near.join(open_.select(*keys, F.col("key").alias("earlier")), [*keys, "earlier"]).select(*keys, "key").distinct()
        left = open_.join(gone, [*keys, "key"], "left_anti")
        fresh = left.join(waits, [*keys, "key"], "left_anti")
        listed = cut_lineage(listed.unionByName(fresh))
        open_ = cut_lineage(left.join(fresh, [*keys, "key"], "left_anti"))
    heads = cut_lineage(every.join(listed, [*keys, "key"]))
    home = near.join(listed.select(*keys, F.col("key").alias("earlier")), [*keys, "earlier"]).join(listed, [*keys, "key"], "left_anti").groupBy(*keys, "key").agg(
        F.min("earlier_since").alias("home")).unionByName(heads.select(*keys, "key", F.col("since").alias("home")))
    named = points.where("kind = 'point'").join(home, [*keys, "key"])
    marks = heads.select(*keys, F.col("since").alias("at"), F.lit(True).alias("__head"))
    both = points.where("kind = 'more'").join(marks.select(*keys).distinct(), list(keys)).select(*keys, "at", F.lit(False).alias("__head"), "desc").unionByName(
        marks.withColumn("desc", F.lit("")))
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    more = both.withColumn("home", F.last(F.when(F.col("__head"), F.col("at")), ignorenulls=True).over(before)).where("not __head")
    parts = named.select(*keys, "home", "at", F.lit(False).alias("always"), "title", "desc").unionByName(more.select(*keys, "home", "at", F.lit(True).alias("always"), F.lit("").alias("title"), "desc"))

    def join(acc: Column, x: Column) -> Column:
        return F.when(x["always"] | ((x["desc"] != "") & ~F.contains(acc, x["desc"])), F.trim(F.concat(acc, F.lit(" "), x["desc"]))).otherwise(acc)

    made = parts.groupBy(*keys, "home").agg(F.array_sort(F.collect_list(F.struct("at", "title", "always", "desc"))).alias("__p"))
    text_of = F.aggregate(F.slice("__p", 2, F.greatest(F.size("__p"), F.lit(1))), F.element_at("__p", 1)["desc"], join)
    ranked = Window.partitionBy(*keys).orderBy("home")
    return made.select(*keys, F.row_number().over(ranked).cast("long").alias("place"), F.element_at("__p", 1)["title"].alias("title"), text_of.alias("desc"))


def summary_rules(summaries: DataFrame) -> DataFrame:
    """Rule check of a product summary (A17). summaries: product_name, intro, highlights, product_info, n_usps."""
    chars = (
        F.length("product_name") + F.length("intro") + F.aggregate("highlights", F.lit(0), lambda a, h: a + F.length(h))
        + F.aggregate("product_info", F.lit(0), lambda a, r: a + F.length(r["label"]) + F.length(r["value"]))
    )
    out = summaries.withColumn("chars", chars)
    problems = F.array_compact(F.array(
        F.when(F.col("chars") <= 600, "too_short"), F.when(F.col("chars") > 2000, "too_long"),
        F.when(F.length("product_name") > 120, "name_too_long"), F.when(F.size("highlights") != F.col("n_usps"), "highlight_count"),
    ))
    return out.withColumn("problems", problems).withColumn("ok", F.size("problems") == 0)


# ---------------------------------------------------------------- fragments, ids


def typed_lines(docs: DataFrame, keys, text_col: str = "text", first_is_title: bool = True) -> DataFrame:
    """(keys, line, kind, level, content): export lines of a section text.

    Kinds: heading, bold, disclaimer, title (the first line of no other kind, if it is short and no heading comes before it), body. A plain line that repeats a heading
    goes, and each line counts once per section.
    """
    raw = F.transform(
        F.transform(F.split(text_col, "\n"), lambda ln: text.trim_ws(ln)),
        lambda s, i: F.struct(i.alias("line"), s.alias("s"), text.clean_line(s).alias("c"), s.rlike("^#{1,6}").alias("h")))
    # lines with the same words side by side, headings first: one walk tells for each what it repeats
    alike = F.array_sort(F.transform(F.filter(raw, lambda r: (r["s"] != "") & (r["c"] != "")), lambda r: F.struct(
        F.lower(r["c"]).alias("k"), (~r["h"]).alias("plain"), r["line"].alias("line"), r["s"].alias("s"), r["c"].alias("c"),
        text.is_image_description(r["c"]).alias("scene"))))

    def step(acc: Column, r: Column) -> Column:
        new = F.coalesce(acc["k"] != r["k"], F.lit(True))
        headed = F.when(new, ~r["plain"]).otherwise(acc["headed"])
        take = (new | ~acc["taken"]) & ~(r["plain"] & headed) & ~r["scene"]
        line = F.struct(r["line"].alias("line"), r["s"].alias("s"), r["c"].alias("c"), (~r["plain"]).alias("h"))
        return F.struct(
            r["k"].alias("k"), headed.alias("headed"), (take | (~new & acc["taken"])).alias("taken"),
            F.when(take, F.array_append(acc["lines"], line)).otherwise(acc["lines"]).alias("lines"))

    start = F.struct(F.lit(None).cast("string").alias("k"), F.lit(False).alias("headed"), F.lit(False).alias("taken"),
                     F.array().cast("array<struct<line:int,s:string,c:string,h:boolean>>").alias("lines"))
    is_bold = lambda s: s.startswith("**") & s.endswith("**")
    is_note = lambda s: s.rlike("^[*※]")
    first = lambda test: F.array_min(F.transform(F.filter("__seen", test), lambda r: r["line"]))
    placed = docs.withColumn("__seen", F.aggregate(alike, start, step, lambda acc: F.array_sort(acc["lines"]))).withColumns({
        "__told": first(lambda r: ~(r["h"] | is_bold(r["s"]) | is_note(r["s"]))), "__headed": first(lambda r: r["h"])})
    # outer: the filter that Spark puts below a plain explode would work out the lines once more
    flat = placed.select(*keys, "__told", "__headed", F.explode_outer("__seen").alias("r")).where("r is not null")
    s, c = F.col("r.s"), F.col("r.c")
    level = F.length(F.regexp_extract(s, "^(#+)", 1))
    title = F.lit(first_is_title) & (F.col("r.line") == F.col("__told")) & F.coalesce(F.col("__told") < F.col("__headed"), F.lit(True))
    plain = F.when(title & (F.length(c) <= text.HEADLINE_MAX), "title").otherwise("body")
    kind = F.when(F.col("r.h"), "heading").when(is_bold(s), "bold").when(is_note(s), "disclaimer").otherwise(plain)
    return flat.select(
        *keys, F.col("r.line").alias("line"), kind.alias("kind"), F.when(F.col("r.h"), level).alias("level"),
        F.when(kind == "disclaimer", s).otherwise(c).alias("content"),
    )


def render_lines(lines: DataFrame, keys) -> DataFrame:
    """(keys, html): typed lines as escaped HTML, in order (K4)."""
    c = urls.xml_escape("content")
    tag = (
        F.when(F.col("kind") == "heading", F.when(F.col("level") >= 3, F.concat(F.lit("<h3>"), c, F.lit("</h3>"))).otherwise(
            F.concat(F.lit("<h2>"), c, F.lit("</h2>"))))
        .when(F.col("kind") == "title", F.concat(F.lit("<h2>"), c, F.lit("</h2>")))
        .when(F.col("kind") == "bold", F.concat(F.lit("<p><b>"), c, F.lit("</b></p>")))
        .when(F.col("kind") == "disclaimer", F.concat(F.lit('<p class="disclaimer">'), c, F.lit("</p>")))
        .otherwise(F.concat(F.lit("<p>"), c, F.lit("</p>")))
    )
    return lines.withColumn("__h", tag).groupBy(*keys).agg(F.array_join(_ordered(F.col("__h"), "line"), "\n").alias("html"))


def render_spec_table(specs: DataFrame, keys, order) -> DataFrame:
    """(keys, html): label/value table with a header row at each group change (K4). specs: label, value, header."""
    row = F.concat(
        F.when(F.col("header").isNotNull(), F.concat(F.lit('<tr><th colspan="2">'), urls.xml_escape("header"), F.lit("</th></tr>"))).otherwise(F.lit("")),
        F.lit("<tr><td>"), urls.xml_escape("label"), F.lit("</td><td>"), urls.xml_escape("value"), F.lit("</td></tr>"),
    )
    return specs.withColumn("__h", row).groupBy(*keys).agg(
        F.concat(F.lit("<table>"), F.array_join(_ordered(F.col("__h"), *order), ""), F.lit("</table>")).alias("html"))


def render_fragment(blocks: DataFrame, keys, order: str = "block_ord") -> DataFrame:
    """(keys, html): blocks joined in order (K4); check with rules.policy_violations before publishing."""
    return blocks.groupBy(*keys).agg(F.array_join(_ordered(F.col("html"), order), "\n").alias("html"))


def content_hash(html: Column | str, medium: Column | str, version: str = "v1", rev: Column | str | None = None) -> Column:
    """Content id (K6): first 20 hex digits of sha1(version|medium|html[|rev]), video marks of the editor left out."""
    clean = F.regexp_replace(urls._c(html), r'(?i)\s+data-video-src="[^"]*"', "")
    parts = [F.lit(version), urls._c(medium), clean] + ([] if rev is None else [urls._c(rev)])
    return F.left(F.sha1(F.concat_ws("|", *parts)), F.lit(20))


def is_valid_rev(rev: Column | str) -> Column:
    return urls._text(rev).rlike(r"^[\w.-]{1,20}$")


def match_cards(cards: DataFrame, images: DataFrame, keys) -> DataFrame:
    """Card to image, one to one inside a section (J26): title words in the file name or alt text, else by place among the
    unused images. A section shows at most four cards, so the fold runs over two short arrays of one row.

    cards: keys, card_ord, headline; images: keys, img_ord, url, alt.
    """
    from .media import CARD_STOP_WORDS

    stop = F.array(*[F.lit(w) for w in CARD_STOP_WORDS])
    words = F.array_except(F.filter(F.transform(F.split(F.lower("headline"), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", "")), lambda w: F.length(w) >= 4), stop)
    name = F.regexp_replace(F.lower(F.concat(F.element_at(F.split("url", "/"), -1), F.lit(" "), F.coalesce("alt", F.lit("")))), r"[^a-z0-9\s]", "")
    c = cards.where("card_ord < 4").groupBy(*keys).agg(_ordered(F.struct(F.col("card_ord").alias("o"), words.alias("w")), "card_ord").alias("__c"))
    i = images.groupBy(*keys).agg(_ordered(F.struct(F.col("url").alias("u"), name.alias("n")), "img_ord").alias("__i"))
    start = F.array().cast("array<struct<o:int,u:string>>")

    def step(acc: Column, card: Column) -> Column:
        used = F.transform(acc, lambda a: a["u"])
        free = F.filter("__i", lambda im: ~F.coalesce(F.array_contains(used, im["u"]), F.lit(False)))
        hit = F.try_element_at(F.filter(free, lambda im: F.exists(card["w"], lambda w: F.contains(im["n"], w))), F.lit(1))["u"]
        spare = F.get(free, card["o"])["u"]
        return F.array_append(acc, F.struct(card["o"].cast("int").alias("o"), F.coalesce(hit, spare).alias("u")))

    joined = c.join(i, keys)
    return joined.select(*keys, F.inline(F.aggregate("__c", start, step))).select(*keys, F.col("o").alias("card_ord"), F.col("u").alias("url"))


def award_flag(media_urls: Column, component_id: Column | str) -> Column:
    """All pictures of the section are awards, or it is the award component (F8)."""
    return (F.size(media_urls) > 0) & (urls._text(component_id).isin(rules.AWARD_IDS) | F.forall(media_urls, rules.is_award))
