"""Matching marketplace rows to products: tiered keys, prefixes, name tokens, sitemap entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..session import FREED, beside, cut_lineage, dealt, settings
from .ordered import first_rows

NO_KEYS = "array<string>"


def model_keys(catalog: DataFrame, slug: str = "slug", model: str = "model", min_len: int = 4) -> DataFrame:
    """(key, slug) pairs of a catalogue: the join index of every matcher."""
    return (
        catalog.select(urls.norm_key(model).alias("key"), F.col(slug).alias("slug"))
        .where(F.length("key") >= min_len)
        .distinct()
    )


def prefixes(key: Column, longest: Column | int, shortest: Column | int) -> Column:
    """Leading parts of a key from `shortest` to `longest` characters."""
    low, high = F.greatest(F.lit(1), F.lit(shortest) if isinstance(shortest, int) else shortest), longest
    lens = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    return F.transform(lens, lambda n: F.left(key, n))


def exploded_keys(rows: DataFrame, row_id: str, sources: list[str]) -> DataFrame:
    """One row per (row, tier, key): tier 0 is the first source."""
    tiers = F.array(*[
        F.struct(F.lit(i).alias("tier"), urls.sku_keys(F.coalesce(F.col(c), F.lit(""))).alias("keys")) for i, c in enumerate(sources)
    ])
    # outer: the filter that Spark puts below a plain explode would work out the keys once more
    flat = rows.select(F.col(row_id), F.explode_outer(tiers).alias("t"))
    return flat.select(row_id, F.col("t.tier").alias("tier"), F.posexplode("t.keys").alias("ord", "key"))


def sku_key_rows(rows: DataFrame, row_id: str, sources: list[str], min_len: int = 4) -> DataFrame:
    """(row, tier, key) as exploded_keys has them, without order: parts and keys are rows of plain columns, which Spark compiles."""
    cells = F.array(*[F.struct(F.lit(i).alias("tier"), F.col(c).alias("cell")) for i, c in enumerate(sources)])
    flat = rows.select(F.col(row_id), F.explode_outer(cells).alias("t")).where("t.cell <> ''")
    parts = flat.select(row_id, "t.tier", F.explode_outer(urls.sku_parts("t.cell")).alias("part")).where("part <> ''")
    keys = parts.select(row_id, "tier", F.explode_outer(F.array_distinct(urls.part_keys(F.upper(F.trim("part"))))).alias("key"))
    return keys.where(F.length("key") >= min_len)


def name_key_rows(rows: DataFrame, row_id: str, name: str, min_len: int = 5) -> DataFrame:
    """(row, key) of the words of a name, as name_keys gives them, the same way."""
    words = rows.select(F.col(row_id), F.explode_outer(urls.name_tokens(name)).alias("word")).where(F.length("word") >= min_len)
    keys = words.select(row_id, F.explode_outer(F.array_distinct(urls.token_keys(F.col("word")))).alias("key"))
    return keys.where(F.length("key") >= min_len)


def prefix_keys(keys: DataFrame, heads: DataFrame, min_len: int = 6, extra: int = 4) -> DataFrame:
    """Longest model key that a key starts with, for keys without an exact hit.

    The prefixes of a key are exploded (at most extra+1 rows), so the match is an equi-join, not a theta join.
    """
    unknown = keys.join(heads, "key", "left_anti")
    size = F.length("key")
    tried = unknown.withColumn(
        "model", F.explode(prefixes(F.col("key"), size - 1, F.greatest(size - extra, F.lit(min_len))))
    )
    models = heads.where(F.length("key") >= min_len).withColumnRenamed("key", "model")
    return tried.join(models, "model").groupBy(*unknown.columns).agg(F.max_by("model", F.length("model")).alias("model"))


def match_keys(
    rows: DataFrame, index: DataFrame, row_id: str = "row", sku: str = "sku", parent_sku: str = "parent_sku", name: str = "name"
) -> DataFrame:
    """(row, key, by): the model keys a row hits (J1-J3): parent SKU first, then SKU, then name tokens.

    Rows meet distinct model keys only; a key shared by many products does not multiply rows here. Each distinct key looks for its model once;
    the hits are dealt out by row once, and the best tier is told there. Keys are cut out of the rows twice, as a table of them is as large as
    the rows, and what each step shuffled goes when its result is written.
    """
    sources = [parent_sku, sku]
    keys = sku_key_rows(rows, row_id, sources)
    with settings(rows.sparkSession, FREED):
        heads = cut_lineage(index.select("key").distinct())
        known = cut_lineage(keys.select("key").distinct())
        models = cut_lineage(
            known.join(heads, "key").select("key", F.col("key").alias("model")).unionByName(prefix_keys(known, heads))
        )
        hits = keys.join(models, "key").where(F.col(row_id).isNotNull()).select(row_id, "tier", F.col("model").alias("key"))
        hits = dealt(hits, [row_id], len(sources) * rows.count()).distinct()
        best = F.min("tier").over(Window.partitionBy(row_id))
        by_sku = cut_lineage(hits.withColumn("__best", best).where("tier = __best").select(row_id, "key"))
        tokens = name_key_rows(rows.join(by_sku.select(row_id), row_id, "left_anti"), row_id, name)
        by_name = cut_lineage(tokens.join(heads, "key").select(row_id, "key").distinct())
    return by_sku.withColumn("by", F.lit("sku")).unionByName(by_name.withColumn("by", F.lit("name")))


def match_rows(
    rows: DataFrame, index: DataFrame, row_id: str = "row", sku: str = "sku", parent_sku: str = "parent_sku", name: str = "name"
) -> DataFrame:
    """Rows with their candidate slugs, `by` and `bundle`. The candidate list of a row is as long as the answer is."""
    hits = match_keys(rows, index, row_id, sku, parent_sku, name)
    found = beside(hits.join(index, "key"), [row_id], rows.count()).groupBy(row_id).agg(
        F.array_sort(F.collect_set("slug")).alias("candidates"), F.first("by").alias("by")
    )
    return rows.join(found, row_id, "left").select(
        *[rows[c] for c in rows.columns],
        F.coalesce("candidates", F.array().cast(NO_KEYS)).alias("candidates"),
        F.coalesce("by", F.lit("")).alias("by"),
        urls.is_bundle(F.col(parent_sku), F.col(sku)).alias("bundle"),
    )


def key_counts(catalog: DataFrame, country: str | None = None) -> DataFrame:
    """(key, n, pick): products per model key, pre-aggregated so that a shared key stays one row."""
    rows = catalog if country is None else catalog.where(F.col("country") == country)
    return (
        rows.select(urls.norm_key("model").alias("key"), "slug").where(F.length("key") >= 4)
        .groupBy("key").agg(F.count_distinct("slug").alias("n"), F.min("slug").alias("pick"))
    )


def unmatched(rows: DataFrame, hits: DataFrame, catalog: DataFrame, country: str, row_id: str = "row", sku: str = "sku",
              parent_sku: str = "parent_sku") -> DataFrame:
    """Rows, bundles aside, with no product in the country."""
    home = key_counts(catalog, country).select("key")
    good = hits.join(home, "key", "left_semi").select(row_id)
    return rows.where(~urls.is_bundle(F.col(parent_sku), F.col(sku))).join(good, row_id, "left_anti")


def sitemap_index(entries: DataFrame, site: str | None = None, host: str | None = None) -> DataFrame:
    """(site, key, url, lastmod) of sitemap addresses that end in something like a model code (S4 rules)."""
    segs = urls.path_segments("url")
    out = entries.select(
        F.try_element_at(segs, F.lit(1)).alias("site"), urls.norm_key(urls.last_segment("url")).alias("key"), "url",
        F.coalesce("lastmod", F.lit("")).alias("lastmod"), F.size(segs).alias("n"), urls.host_of("url").alias("host"),
    ).where((F.col("n") >= 3) & (F.length("key") >= 4) & F.col("key").rlike(r"\d") & F.col("key").rlike("[A-Z]"))
    if site is not None:
        out = out.where(F.col("site") == site)
    if host is not None:
        out = out.where(F.col("host").rlike(host))
    return out.select("site", "key", "url", "lastmod")


def pick_url(hits: DataFrame, row_id: str = "row") -> DataFrame:
    """Newest, then shortest, address per row, and how many others there were (O2)."""
    distinct = hits.groupBy(row_id, "url").agg(F.max("lastmod").alias("lastmod"))
    alts = distinct.groupBy(row_id).agg((F.count(F.lit(1)) - 1).alias("alts"))
    best = first_rows(distinct, [row_id], [F.desc("lastmod"), F.length("url"), F.col("url")]).select(row_id, "url", "lastmod")
    return best.join(alts, row_id)


def sitemap_lookup(keys: DataFrame, index: DataFrame, row_id: str = "row") -> DataFrame:
    """(row, url, alts, fuzzy): exact key first, then prefixes either way; the first key with hits decides.

    The sitemap is reduced to one row per key before it meets the rows; an address belongs to one key only, so
    the counts of several keys add up.
    """
    per_key = cut_lineage(pick_url(index.select("key", "url", "lastmod"), "key").withColumn("n", F.col("alts") + 1).drop("alts"))
    newest = [F.desc("lastmod"), F.length("url"), F.col("url")]
    sure = cut_lineage(first_rows(keys.join(per_key, "key"), [row_id], ["ord"]).select(
        row_id, "url", (F.col("n") - 1).alias("alts"), F.lit(False).alias("fuzzy")
    ))
    rest = keys.where(F.length("key") >= 6).join(sure.select(row_id), row_id, "left_anti")
    size = F.length("key")
    longer = per_key.withColumn("head", F.explode(prefixes(F.col("key"), size, F.greatest(size - 5, F.lit(6)))))
    cols = [row_id, "ord", "full", "url", "lastmod", "n"]
    ours = rest.join(longer.withColumnRenamed("key", "full").withColumnRenamed("head", "key"), "key").select(*cols)
    shorter = rest.withColumn("head", F.explode(prefixes(F.col("key"), size, F.greatest(size - 4, F.lit(6))))).drop("key")
    theirs = shorter.join(
        per_key.where(size >= 6).withColumn("full", F.col("key")).withColumnRenamed("key", "head"), "head"
    ).select(*cols)
    near = cut_lineage(ours.unionByName(theirs).distinct())
    lead = near.groupBy(row_id).agg(F.min("ord").alias("ord"))
    close = near.join(lead, [row_id, "ord"])
    counts = close.groupBy(row_id).agg((F.sum("n") - 1).alias("alts"))
    loose = first_rows(close, [row_id], newest).select(row_id, "url").join(counts, row_id)
    return sure.unionByName(loose.select(row_id, "url", "alts", F.lit(True).alias("fuzzy")))


def home_country(candidates: DataFrame, country: str = "country", position: Column | str = "pos",
                 keys: list[str] | None = None) -> DataFrame:
    """Most frequent country, the first seen on a tie."""
    keys = keys or []
    counts = candidates.where(F.col(country) != "").groupBy(*keys, country).agg(
        F.count(F.lit(1)).alias("n"), F.min(position).alias("first_pos")
    )
    return counts.groupBy(*keys).agg(
        F.max_by(country, F.struct("n", (-F.col("first_pos")).alias("p"))).alias("home"), F.max("n").alias("n")
    )


def triage(rows: DataFrame, hits: DataFrame, catalog: DataFrame, home: str, lookup: DataFrame | None = None,
           row_id: str = "row", sku: str = "sku", parent_sku: str = "parent_sku") -> DataFrame:
    """Outcome per row (F21): ok, rMulti, register, rBundle or rNone, with the slug of an ok row."""
    per_row = hits.join(key_counts(catalog, home), "key").groupBy(row_id).agg(
        F.sum("n").alias("n_home"), F.min("pick").alias("pick")
    )
    out = rows.join(per_row, row_id, "left").withColumn("n_home", F.coalesce("n_home", F.lit(0)))
    out = out.withColumn("bundle", urls.is_bundle(F.col(parent_sku), F.col(sku)))
    has_url = F.lit(False)
    if lookup is not None:
        out = out.join(lookup.select(row_id, F.lit(True).alias("__found")), row_id, "left")
        has_url = F.coalesce("__found", F.lit(False))
    outcome = (
        F.when(F.col("bundle"), "rBundle").when(F.col("n_home") == 1, "ok").when(F.col("n_home") > 1, "rMulti")
        .when(has_url, "register").otherwise("rNone")
    )
    slug = F.when(F.col("outcome") == "ok", F.col("pick"))
    return out.withColumn("outcome", outcome).withColumn("slug", slug).drop("__found", "pick")


def upload_summary(matched: DataFrame, lookup: DataFrame | None = None, row_id: str = "row", keys: list[str] | None = None) -> DataFrame:
    """Rows, matched rows and rows found in a sitemap per upload."""
    keys = keys or []
    rows = matched
    if lookup is not None:
        rows = rows.join(lookup.select(row_id, F.lit(1).alias("__f")), row_id, "left")
    else:
        rows = rows.withColumn("__f", F.lit(None).cast("int"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.size("candidates") > 0).alias("n_matched"),
        F.count("__f").alias("n_found"),
    )


def build_catalog(products: DataFrame) -> DataFrame:
    """Derived catalogue columns of (slug, url, title, crawled_at) rows (D3); unparsable addresses drop out."""
    kinds = rules.classify("url")
    return (
        products.withColumn("__k", kinds)
        .where(urls.path_segments("url").isNotNull())
        .withColumns({
            "country": urls.country_of("url"), "model": urls.model_of("url"), "cat": F.col("__k.cat"), "sub": F.col("__k.sub"),
            "dv": F.col("__k.dv"), "grp": F.col("__k.grp"),
        })
        .drop("__k")
    )


def catalog_counts(catalog: DataFrame, levels: list[str]) -> DataFrame:
    """Facet counts on every prefix of the levels."""
    return catalog.rollup(*levels).agg(F.count(F.lit(1)).alias("n"))


# Header patterns per column role, with what must not match.
HEADERS = {
    "desc": (r"product[_\s-]*description|long[_\s-]*description|^\s*description\s*$|รายละเอียดสินค้า|deskripsi\s*produk"
             r"|mô\s*tả\s*sản\s*phẩm|商品描述", "short|highlight|title|name|video|image|ชื่อ"),
    "parent_sku": (r"parent[_\s-]*sku|sku\s*หลัก|sku\s*induk|sku\s*cha|主商品货号", None),
    "id": (r"product[_\s-]*id|item[_\s-]*id|รหัสสินค้า|\bspu[_\s-]*id", r"categor|cat[_\s-]*id|shop|brand|variation|model[_\s-]*id"),
    "name": (r"product[_\s-]*name|item[_\s-]*name|ชื่อสินค้า|nama\s*produk|tên\s*sản\s*phẩm|商品名称", None),
    "sku": (r"seller[_\s-]*sku|sellersku|variation[_\s-]*sku|\bsku\b", r"parent[_\s-]*sku|sku\s*หลัก|sku\s*induk|sku\s*cha|主商品货号"),
}
HEAD_ROWS = 15


def detect_columns(cells: DataFrame) -> DataFrame:
    """(upload_id, sheet, role, col, row): the first column whose header labels fit a role."""
    heads = cells.where((F.col("row") <= HEAD_ROWS) & (F.length(F.trim("text")) > 0) & (F.length(F.trim("text")) <= 120))
    label = F.trim("text")
    fits = F.array_compact(F.array(*[
        F.when(
            label.rlike("(?i)" + yes)
            & (F.lit(True) if no is None else ~F.regexp_replace(label, "(?i)^et_title_", "").rlike("(?i)" + no)),
            F.lit(role),
        )
        for role, (yes, no) in HEADERS.items()
    ]))
    found = heads.select("upload_id", "sheet", "row", "col", F.explode(fits).alias("role"))
    parents = (
        found.where("role = 'parent_sku'").groupBy("upload_id", "sheet").agg(F.min("col").alias("parent_col"))
    )
    free = found.join(parents, ["upload_id", "sheet"], "left").where(
        (F.col("role") != "sku") | F.col("parent_col").isNull() | (F.col("col") != F.col("parent_col"))
    )
    spot = F.min(F.struct("col", "row")).alias("m")
    return free.groupBy("upload_id", "sheet", "role").agg(spot).select("upload_id", "sheet", "role", "m.col", "m.row")


def head_end(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """Last header row per sheet: the lowest matched label, moved down to the row before the first numeric id."""
    low = columns.groupBy("upload_id", "sheet").agg(
        F.max("row").alias("low"), F.max(F.when(F.col("role") == "id", F.col("col"))).alias("id_col")
    )
    ids = (
        cells.where(F.trim("text").rlike(r"^\d{3,}$")).join(low, ["upload_id", "sheet"])
        .where((F.col("col") == F.col("id_col")) & (F.col("row") > F.col("low")))
        .groupBy("upload_id", "sheet").agg(F.min("row").alias("first_id"))
    )
    return low.join(ids, ["upload_id", "sheet"], "left").select(
        "upload_id", "sheet", F.coalesce(F.col("first_id") - 1, F.col("low")).alias("head_end")
    )


def pick_sheet(cells: DataFrame, columns: DataFrame, ends: DataFrame) -> DataFrame:
    """Sheet with the best score per upload."""
    roles = columns.groupBy("upload_id", "sheet").agg(
        F.max(F.when(F.col("role") == "desc", 1000000).otherwise(0)).alias("d"),
        F.max(F.when(F.col("role").isin("id", "sku", "parent_sku"), 100000).otherwise(0)).alias("k"),
    )
    rows = cells.groupBy("upload_id", "sheet", "hidden", "row").agg(F.lit(1).alias("one"))
    sized = (
        rows.join(ends, ["upload_id", "sheet"], "left").groupBy("upload_id", "sheet", "hidden")
        .agg(F.count_if(F.col("row") > F.coalesce("head_end", F.lit(0))).alias("n"))
        .join(roles, ["upload_id", "sheet"], "left")
    )
    score = (
        F.coalesce("d", F.lit(0)) + F.coalesce("k", F.lit(0)) + F.col("n") - F.when(F.col("hidden"), 50000).otherwise(0)
    )
    return first_rows(sized.withColumn("score", score), ["upload_id"], [F.desc("score"), F.col("sheet")]).select(
        "upload_id", "sheet", "score"
    )


def market_rows(cells: DataFrame, columns: DataFrame, ends: DataFrame) -> DataFrame:
    """Data rows of a sheet in wide form: id, sku, parent_sku, name, desc."""
    joined = cells.join(columns.select("upload_id", "sheet", "col", "role"), ["upload_id", "sheet", "col"]).join(
        ends, ["upload_id", "sheet"]
    ).where(F.col("row") > F.col("head_end"))
    wide = joined.groupBy("upload_id", "sheet", "row").pivot("role", list(HEADERS)).agg(F.first(F.trim("text")))
    has_id = columns.where("role = 'id'").select("upload_id", "sheet", F.lit(True).alias("has_id"))
    data = wide.join(has_id, ["upload_id", "sheet"], "left")
    named = F.coalesce(urls.js_or("sku", "parent_sku", "name"), F.lit("")) != ""
    return data.where(
        F.when(F.coalesce("has_id", F.lit(False)), F.coalesce(F.col("id").rlike(r"^\d{3,}$"), F.lit(False))).otherwise(named)
    ).drop("has_id")
