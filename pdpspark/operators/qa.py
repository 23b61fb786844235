"""Quality checks: coverage, verbatim fidelity, crawl comparison, page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text, urls

EXAMPLES = 40


def compare_crawls(a: DataFrame, b: DataFrame, url: str = "url") -> DataFrame:
    """(key, side): query-less addresses of both crawls, in `both`, `only_a` or `only_b`."""
    left = a.select(urls.bare_url(url).alias("key")).distinct().withColumn("in_a", F.lit(True))
    right = b.select(urls.bare_url(url).alias("key")).distinct().withColumn("in_b", F.lit(True))
    side = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("both")
    return left.join(right, "key", "full_outer").select("key", side.alias("side"))


def page_blob(sections: DataFrame, parts: list[Column], keys: list[str], order: list[str]) -> DataFrame:
    """One comparison text per page (A14): everything its sections say, in order."""
    said = F.struct(*order, F.concat_ws(" ", *parts).alias("__t"))
    rows = sections.groupBy(*keys).agg(F.array_sort(F.collect_list(said)).alias("__rows"))
    joined = F.array_join(F.transform("__rows", lambda r: r["__t"]), " ")
    return rows.select(*keys, text.norm_compare(joined).alias("blob"))


def text_coverage(inventory: DataFrame, blobs: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Inventory texts a page's sections do not contain (J8). One blob row per page: an equi-join, then `contains`.

    inventory: page_id, component_id, text, key. Adds missing and only_in_cards.
    """
    joined = inventory.join(blobs.select("page_id", "blob"), "page_id", "left")
    blob = F.coalesce("blob", F.lit(""))
    out = joined.withColumn("missing", ~F.contains(blob, F.col("key")) & ~text.only_ui("text", blob)).drop("blob")
    if cards is None:
        return out.withColumn("only_in_cards", F.lit(False))
    card = cards.select("page_id", F.col("blob").alias("card_blob"))
    return out.join(card, "page_id", "left").withColumn(
        "only_in_cards", F.contains(F.coalesce("card_blob", F.lit("")), F.col("key"))
    ).drop("card_blob")


def image_coverage(inventory: DataFrame, have: DataFrame, dead: DataFrame | None = None, cards: DataFrame | None = None) -> DataFrame:
    """Inventory images none of whose keys is in `have` (J7); dead ones are set apart, card-only ones flagged.

    inventory: page_id, image, keys; have, dead, cards: page_id, key.
    """
    keyed = inventory.select("page_id", "image", F.explode("keys").alias("key"))

    def flag(name: str, other: DataFrame | None) -> DataFrame | None:
        if other is None:
            return None
        hit = other.select("page_id", "key").distinct().withColumn(name, F.lit(True))
        return keyed.join(hit, ["page_id", "key"]).groupBy("page_id", "image").agg(F.max(name).alias(name))

    out = inventory
    for name, other in (("found", have), ("dead", dead), ("carded", cards)):
        marks = flag(name, other)
        out = out.withColumn(name, F.lit(False)) if marks is None else out.join(marks, ["page_id", "image"], "left").withColumn(
            name, F.coalesce(name, F.lit(False))
        )
    return out.withColumn("missing", ~F.col("found") & ~F.col("dead")).withColumnRenamed("carded", "only_in_cards")


def dead_keys(dead_urls: DataFrame) -> DataFrame:
    """(page_id, key) of media left out on purpose; addresses with a doubled path count as lost instead."""
    real = dead_urls.where(~F.col("url").rlike(urls.REPEATED_DAM))
    return real.select(
        "page_id", F.explode(F.array(urls.image_key("url"), urls.image_key("url", decode=True))).alias("key")
    ).distinct()


def coverage_report(texts: DataFrame, images: DataFrame) -> DataFrame:
    """Totals per page and the first missing examples (A4). The example list is a top-k report."""
    from .ordered import first_rows

    t = texts.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("texts_total"), F.count_if("missing").alias("texts_missing")
    )
    i = images.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("images_total"), F.count_if("missing").alias("images_missing"),
        F.count_if(~F.col("found") & F.col("dead")).alias("images_dead"),
    )

    def examples(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        top = first_rows(df.where("missing"), ["page_id"], [order], n=EXAMPLES, rank="__r")
        return top.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("__r", value.alias("v")))).alias("__x")).select(
            "page_id", F.transform("__x", lambda x: x["v"]).alias(name)
        )

    out = t.join(i, "page_id", "full_outer")
    out = out.join(examples(texts, "node", F.left("text", F.lit(160)), "missing_texts"), "page_id", "left")
    out = out.join(examples(images, "image", F.right(urls._no_query("url"), F.lit(120)), "missing_images"), "page_id", "left")
    zero = [c for c in out.columns if c.startswith(("texts_", "images_"))]
    return out.fillna(0, zero)


def verify(flow: DataFrame, corpus: DataFrame, limit: int = 80, min_len: int = 12) -> DataFrame:
    """(page_id, seq, kind, value) of addresses and lines a page's source does not contain.

    flow: page_id, seq, text_content, urls ARRAY<STRING>; corpus: page_id, body.
    """
    body = corpus.select("page_id", F.col("body"), F.regexp_replace("body", r"\s+", " ").alias("flat"))
    line = F.trim(F.regexp_replace(F.col("line"), r"\s+", " "))
    lines = flow.select("page_id", "seq", F.explode(F.split(F.coalesce("text_content", F.lit("")), "\n")).alias("line")).select(
        "page_id", "seq", line.alias("value")
    ).where(F.length("value") > min_len)
    addr = flow.select("page_id", "seq", F.explode("urls").alias("value")).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    bad_text = lines.join(body, "page_id", "left").where(
        ~F.contains(F.coalesce("flat", F.lit("")), F.left("value", F.lit(limit)))
    ).select("page_id", "seq", F.lit("text").alias("kind"), "value")
    bad_url = addr.join(body, "page_id", "left").where(
        ~F.contains(F.coalesce("body", F.lit("")), urls.bare_url(F.trim("value")))
    ).select("page_id", "seq", F.lit("url").alias("kind"), "value")
    return bad_text.unionByName(bad_url)


def image_coverage_pct(md_images: DataFrame, assets: DataFrame) -> DataFrame:
    """(page_id, in_markdown, captured, pct): markdown images found among the assets under any device variant."""
    mine = md_images.select("page_id", urls.bare_url("url").alias("u")).distinct()
    have = assets.select("page_id", urls.bare_url("url").alias("v")).distinct()
    tried = mine.withColumn("v", F.explode(urls.variants_of("u")))
    hit = tried.join(have, ["page_id", "v"], "left_semi").select("page_id", "u").distinct().withColumn("hit", F.lit(1))
    per = mine.join(hit, ["page_id", "u"], "left").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("in_markdown"), F.count("hit").alias("captured")
    )
    pct = F.floor(F.col("captured") * 100 / F.col("in_markdown") + 0.5)
    return per.withColumn("pct", F.when(F.col("in_markdown") == 0, 100).otherwise(pct).cast("bigint"))


def section_stats(sections: DataFrame, keys: list[str]) -> DataFrame:
    """Section counts per page (A1): has_text, has_media and renderable are boolean columns."""
    return sections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sections"),
        F.count_if("renderable").alias("renderable"),
        F.count_if(~F.col("has_media")).alias("text_only"),
        F.count_if(F.col("has_media") & ~F.col("has_text")).alias("image_only"),
    )


def histogram(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """MAP<value, count> per page (A1 layouts, A2 components); counted first, then one small map per page."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("k"), F.col("__n").alias("v"))))
    return counts.groupBy(*keys).agg(F.map_from_entries(pairs).alias(out))


def content_checks(sections: DataFrame, media: DataFrame, products: DataFrame) -> DataFrame:
    """Checks and issue codes per product (A3).

    sections: page_id, text, n_media; media: page_id, url; products: page_id, title, gallery_images.
    """
    s = sections.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("sections"),
        F.count_if((F.col("n_media") > 0) & (F.trim("text") != "")).alias("full_sections"),
    )
    m = media.groupBy("page_id").agg(
        F.count_if(F.coalesce("url", F.lit("")) != "").alias("images"),
        F.count_if(F.coalesce("url", F.lit("")) == "").alias("images_missing_url"),
    )
    out = products.join(s, "page_id", "left").join(m, "page_id", "left").fillna(
        0, ["sections", "full_sections", "images", "images_missing_url"]
    )
    issues = F.array_compact(F.array(
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "no_title"),
        F.when(F.col("gallery_images") == 0, "no_gallery"),
        F.when(F.col("full_sections") < 3, "few_full_sections"),
        F.when(F.col("images_missing_url") > 0, "images_without_url"),
    ))
    return out.withColumn("issues", issues)
