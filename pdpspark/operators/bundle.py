"""Bundle pages: detection, component candidates, component addresses, merged products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from . import extract
from .extract import attr, has_class, inside

# Addresses of bundle pages, and links that are not products.
BUNDLE_PATH = r"(?i)/[a-z0-9-]*bundles?/[^/]+/?$"
NON_PRODUCT_LINK = r"(?i)downloadFile|/support/|cedoc|^#|^javascript:|/buy/?$"
SPEC_CODE = r"\(([A-Z0-9][A-Z0-9.\-]{3,})\)"
DOM_STEP = 10000


def overview_links(page_nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, ord, url): product links of the overview part on the page's own site, first of each."""
    box = page_nodes.where(attr("id") == "pdp-overview-section")
    own = pages.select(
        "page_id", F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("origin"), F.coalesce(urls.site_of("url"), F.lit("")).alias("cc"))
    rows = inside(page_nodes.where((F.col("tag") == "a") & (F.trim(attr("href")) != "")), box, []).join(own, "page_id").where(
        ~F.trim(attr("href")).rlike(NON_PRODUCT_LINK))
    full = urls.bare_url(urls.abs_url(attr("href"), F.col("origin"), upgrade=False))
    good = rows.withColumn("url", full).where(
        (F.regexp_extract("url", "^https?://([^/]+)", 1) == F.regexp_extract("origin", "^https?://([^/]+)", 1))
        & F.startswith(urls.path_of("url"), F.concat(F.lit("/"), F.col("cc"), F.lit("/"))) & ~F.contains(urls.path_of("url"), F.lit("bundles"))
    )
    one = good.groupBy("page_id", "url").agg(F.min("node").alias("at"))
    from pyspark.sql import Window

    return one.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("at")).alias("ord"), "url")


def spec_slides(page_nodes: DataFrame) -> DataFrame:
    """(page_id, ord, name, thumb, code): one spec tab per bundle component."""
    box = page_nodes.where(attr("id") == "pdp-specs-section")
    tab = (attr("id").rlike("^pto-tabs") & (attr("role") == "tab")) | (has_class(r"(^|\s)cmp-tabs__tab(\s|$)") & has_class(r"(^|\s)cmp-carousel__item(\s|$)"))
    tabs = inside(page_nodes.where(tab), box, [])
    imgs = inside(page_nodes.where("tag = 'img'"), tabs.withColumn("t", F.col("node")), ["t"]).groupBy("page_id", F.col("t").alias("node")).agg(
        F.min_by(urls.js_or(attr("src"), attr("data-src")), "node").alias("src"))
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy("node")
    res = inside(page_nodes.where(has_class(r"(^|\s)c-specs-resource(\s|$)")), box, []).select(
        "page_id", F.row_number().over(w).alias("ord"), F.try_element_at(F.regexp_extract_all("text", F.lit(SPEC_CODE), 1), F.lit(1)).alias("doc_code"))
    named = tabs.join(imgs, ["page_id", "node"], "left").select(
        "page_id", F.row_number().over(w).alias("ord"), F.col("text").alias("name"),
        F.regexp_replace(F.coalesce("src", F.lit("")), r"(?s)/jcr:content.*$", "").alias("thumb"))
    tail = F.regexp_extract("name", r"(?:\||\bI)\s*([A-Z0-9][A-Z0-9\-]{3,})\s*$", 1)
    tail = F.when(tail.rlike(r"\d") | (F.length(tail) >= 5), tail).otherwise("")
    return named.join(res, ["page_id", "ord"], "left").select("page_id", "ord", "name", "thumb", F.coalesce(urls.js_or("doc_code", tail), F.lit("")).alias("code"))


def is_bundle_page(pages: DataFrame, links: DataFrame, slides: DataFrame) -> DataFrame:
    """(page_id, is_bundle) (H19): bundle address, fewer than three feature components, and spec tabs or overview links."""
    own = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r"\bST\d{4}\b"), 0))) >= 3
    any_part = links.select("page_id").union(slides.select("page_id")).distinct().withColumn("__p", F.lit(True))
    return pages.select("page_id", (F.coalesce(urls.path_of("url"), F.lit("")).rlike(BUNDLE_PATH) & ~own).alias("__c")).join(
        any_part, "page_id", "left").select("page_id", (F.col("__c") & F.coalesce("__p", F.lit(False))).alias("is_bundle"))


def bundle_candidates(pages: DataFrame, page_nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flags, links, slides) of all pages."""
    n = extract.nodes(pages) if page_nodes is None else page_nodes
    links, slides = overview_links(n, pages), spec_slides(n)
    return is_bundle_page(pages, links, slides), links, slides


def bundle_urls(links: DataFrame, slides: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(page_id, index, name, thumb, model, url, found_by) of bundle components.

    Links and tabs pair by place when they are equally many, else by model code; what is left is looked up in the sitemap.
    sitemap: key, url (key = last path segment in lower case).
    """
    n_links = links.groupBy("page_id").agg(F.count(F.lit(1)).alias("nl"))
    n_slides = slides.groupBy("page_id").agg(F.count(F.lit(1)).alias("ns"))
    rows = slides.join(links.withColumnRenamed("url", "by_place"), ["page_id", "ord"], "full_outer").join(n_links, "page_id", "left").join(
        n_slides, "page_id", "left").fillna(0, ["nl", "ns"]).fillna("", ["name", "thumb", "code"])
    even = (F.col("nl") == F.col("ns")) | (F.col("ns") == 0)
    by_model = links.select("page_id", F.lower(urls.last_segment("url")).alias("__m"), F.col("url").alias("by_model")).dropDuplicates(["page_id", "__m"])
    mapped = rows.withColumn("__m", F.lower("code")).join(by_model, ["page_id", "__m"], "left")
    link = F.when(even, F.col("by_place")).when(F.col("code") != "", F.col("by_model"))
    known = sitemap.where(~F.contains("url", F.lit("bundles"))).groupBy(F.col("key").alias("__k")).agg(F.min("url").alias("by_map"))
    looked = mapped.withColumn("__k", F.regexp_replace(F.lower("code"), r"^\.+|\.+$", "")).join(known, "__k", "left")
    url = F.coalesce(link, "by_map")
    found = F.when(link.isNotNull(), "overview_link").when(F.col("by_map").isNotNull(), "spec_code+sitemap").otherwise("none")
    model = F.when((F.col("code") == "") & url.isNotNull(), urls.model_of(url)).otherwise(F.col("code"))
    return looked.select("page_id", F.col("ord").alias("index"), "name", "thumb", model.alias("model"), url.alias("url"), found.alias("found_by"))


def merge_bundle(parts: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of all components in one product (A19): dom indexes shifted per component, spec sections last.

    parts: bundle_id, index, page_id; sections: page_id, dom_index, sec_ord, n_specs, ... Adds bundle_id, bundle_part, new_ord.
    """
    joined = sections.join(parts.select("bundle_id", F.col("index").alias("bundle_part"), "page_id"), "page_id").withColumn(
        "dom_index", F.when(F.col("dom_index") >= 0, F.col("dom_index") + F.col("bundle_part") * DOM_STEP).otherwise(F.col("dom_index")))
    from .ordered import renumber

    tail = F.when(F.col("n_specs") > 0, 1).otherwise(0)
    return renumber(joined.withColumn("tail", tail), ["bundle_id"], ["tail", "bundle_part", "sec_ord"], "new_ord", block=F.col("tail") * 1_000_000 + F.col("bundle_part"))


def bundle_stats(parts: DataFrame, stats: DataFrame) -> DataFrame:
    """Summed section statistics of a bundle's components."""
    joined = parts.select("bundle_id", "page_id").join(stats, "page_id")
    numbers = [c for c in stats.columns if c != "page_id"]
    return joined.groupBy("bundle_id").agg(F.count(F.lit(1)).alias("components"), *[F.sum(c).alias(c) for c in numbers])


def ufn(name: Column | str, model: Column | str) -> Column:
    return text.ufn(name, model)
