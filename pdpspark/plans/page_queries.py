"""Queries over raw pages: URL columns, text quality, links, identity checks, media inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import extract, match
from ..operators.ordered import drop_repeats, first_rows
from ..session import shared_path
from ..sources import readers
from .registry import query, table, wide_table

TEXT_RUN = "<(?:p|h1|li|b)>([^<]*)"
# DuckDB spellings shared by several statements.
SQL_SLUG = "regexp_replace(regexp_replace(regexp_replace(trim(url), '^(.*?)https?://', '\\1'), '[^\\p{L}\\p{N}_]+', '-', 'g'), '-+$', '')"
SQL_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
SQL_SEGS = f"list_filter(string_split({SQL_PATH}, '/'), lambda p: p <> '')"


@query("page_quality", f"""
WITH t AS (
  SELECT page_id, url,
         list_filter(list_transform(regexp_extract_all(html, '{TEXT_RUN}', 1),
             lambda x: lower(regexp_replace(regexp_replace(x, '[™®©*​ ]', '', 'g'), '\\s+', '', 'g'))),
             lambda k: length(k) >= 4) AS keys
  FROM pages)
SELECT page_id, {SQL_SLUG} AS slug, coalesce({SQL_SEGS}[1], '') AS site,
       CAST(len(keys) AS BIGINT) AS n_texts, CAST(len(list_distinct(keys)) AS BIGINT) AS n_distinct,
       CAST(len(keys) - len(list_distinct(keys)) AS BIGINT) AS n_repeats,
       CAST(coalesce(list_sum(list_transform(keys, lambda k: length(k))), 0) AS BIGINT) AS n_chars
FROM t
""")
def page_quality(spark, folder):
    """Text runs per page, repeats and address keys. A page is one row, so nothing is shuffled."""
    runs = F.regexp_extract_all("html", F.lit(TEXT_RUN), 1)
    keys = F.filter(F.transform(runs, text.norm_compare), lambda k: F.length(k) >= 4)
    pages = wide_table(spark, folder, "pages", "page_id", "url", "html").select("page_id", "url", keys.alias("keys"))
    n, uniq = F.size("keys").cast("bigint"), F.size(F.array_distinct("keys")).cast("bigint")
    return pages.select(
        "page_id", urls.slugify("url").alias("slug"), F.coalesce(urls.site_of("url"), F.lit("")).alias("site"),
        n.alias("n_texts"), uniq.alias("n_distinct"), (n - uniq).alias("n_repeats"),
        F.aggregate("keys", F.lit(0).cast("bigint"), lambda a, k: a + F.length(k)).alias("n_chars"),
    )


@query("page_urls", f"""
SELECT page_id, {SQL_SLUG} AS slug,
       regexp_replace(regexp_replace(regexp_replace(trim(url), 'https?://', ''), '[^A-Za-z0-9_]+', '-', 'g'), '-+$', '') AS ascii_slug,
       upper(regexp_replace(coalesce({SQL_SEGS}[-1], ''), '(?i)\\.html?$', '')) AS model,
       regexp_replace(upper(regexp_replace(coalesce({SQL_SEGS}[-1], ''), '(?i)\\.html?$', '')), '[^A-Z0-9]', '', 'g') AS model_key,
       lower(regexp_extract(url, '(?i)//[^/\\s]+/([a-z]{{2}})(?:_[a-z]{{2}})?/', 1)) AS country,
       left(sha1(lower(regexp_replace(trim(url), '/+$', ''))), 20) AS url_hash,
       (url LIKE 'https://%' AND len({SQL_SEGS}) >= 2 AND regexp_matches(coalesce({SQL_SEGS}[1], ''), '^[a-z]{{2}}(_[a-z]{{2}})?$')) AS valid2
FROM pages
""")
def page_urls(spark, folder):
    """Address columns of every page (U1-U4, U31, F3 with two segments, as these addresses have)."""
    segs = urls.path_segments("url")
    site = F.coalesce(urls.site_of("url"), F.lit(""))
    return table(spark, folder, "pages").select(
        "page_id", urls.slugify("url").alias("slug"), urls.slugify("url", ascii=True).alias("ascii_slug"),
        urls.model_of("url").alias("model"), urls.norm_key(urls.model_of("url")).alias("model_key"),
        urls.country_of("url").alias("country"), urls.url_hash20("url").alias("url_hash"),
        ((F.try_parse_url("url", F.lit("PROTOCOL")) == "https") & (F.size(segs) >= 2) & rules.site_code_ok(site)).alias("valid2"),
    )


@query("page_slug_collisions", f"""
SELECT slug, count(*) AS n, min(page_id) AS first_page
FROM (SELECT page_id, regexp_replace({SQL_SLUG.replace("url", "regexp_replace(url, '[?#].*$', '')")}, '-html$', '') AS slug FROM pages)
GROUP BY slug HAVING count(*) > 1
""")
def page_slug_collisions(spark, folder):
    """Pages that would share one product directory."""
    slug = F.regexp_replace(urls.slugify(F.regexp_replace("url", "[?#].*$", "")), "-html$", "")
    return (
        table(spark, folder, "pages").select("page_id", slug.alias("slug")).groupBy("slug")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")
    )


@query("page_links", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM l GROUP BY ALL
""")
def page_links(spark, folder):
    """Links of each page through the element table (H9, H10 for anchors)."""
    nodes = extract.nodes(wide_table(spark, folder, "pages", "page_id", "html"))
    return extract.links(nodes).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("page_tag_counts", """
WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages)
SELECT page_id, tag, count(*) AS n FROM t GROUP BY ALL
""")
def page_tag_counts(spark, folder):
    """Elements per tag from the element table."""
    return extract.nodes(wide_table(spark, folder, "pages", "page_id", "html")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query("page_links_compare", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
     a AS (SELECT DISTINCT href FROM l WHERE page_id % 2 = 0),
     b AS (SELECT DISTINCT href FROM l WHERE page_id % 2 = 1)
SELECT coalesce(a.href, b.href) AS key,
       CASE WHEN a.href IS NULL THEN 'only_b' WHEN b.href IS NULL THEN 'only_a' ELSE 'both' END AS side
FROM a FULL OUTER JOIN b ON a.href = b.href
""")
def page_links_compare(spark, folder):
    """Two crawls side by side on the query-less address (J21): even pages against odd ones."""
    from ..operators.qa import compare_crawls

    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    links = table(spark, folder, "pages").select("page_id", F.explode(hrefs).alias("url"))
    even, odd = links.where("page_id % 2 = 0"), links.where("page_id % 2 = 1")
    return compare_crawls(even, odd, url="url")


@query("page_truncated", """
WITH b AS (SELECT page_id, html, regexp_extract(html, '<footer>([^<]*)', 1) AS boundary FROM pages),
p AS (SELECT *, trim(left(string_split(boundary, chr(10))[1], 40)) AS probe FROM b)
SELECT page_id, CAST(length(CASE WHEN length(boundary) >= 6 AND instr(html, probe) - 1 > length(html) * 0.3
       THEN regexp_replace(left(html, instr(html, probe) - 1), '\\s+$', '') ELSE html END) AS BIGINT) AS kept_chars,
       CAST(length(html) AS BIGINT) AS all_chars
FROM p
""")
def page_truncated(spark, folder):
    """Cut at the footer text."""
    cut = rules.truncate_md("html", F.regexp_extract("html", "<footer>([^<]*)", 1))
    return table(spark, folder, "pages").select(
        "page_id", F.length(cut).cast("bigint").alias("kept_chars"), F.length("html").cast("bigint").alias("all_chars")
    )


@query("page_check", f"""
WITH w AS (SELECT page_id, url, html, lower(regexp_replace({SQL_PATH}, '/+$', '')) AS want, {SQL_SEGS} AS segs FROM pages),
s AS (SELECT *, string_split(want, '/')[-1] AS seg, replace(lower(html), '\\/', '/') AS low,
      '/content/' || coalesce(segs[1], '') || '/' || coalesce(segs[1], '') || '/' || lower(array_to_string(segs[2:], '/')) || '/' AS repo FROM w),
r AS (SELECT page_id, CASE
   WHEN length(html) < 1000 THEN 'too short: ' || length(html)
   WHEN regexp_matches(html, '(?i)access denied|you don''t have permission to access|reference\\s*#\\d|request blocked|are you a robot')
        AND instr(html, '__next_f') = 0 THEN 'block page'
   WHEN instr(low, repo) > 0 THEN ''
   WHEN seg <> '' AND (length(low) - length(replace(low, seg, ''))) // greatest(length(seg), 1) >= 3 THEN ''
   ELSE 'not the requested product page' END AS reason FROM s)
SELECT page_id, reason = '' AS ok, reason FROM r
""")
def page_check(spark, folder):
    """Is each page the one that was asked for (H17)? These pages carry no canonical link, so the model code decides."""
    check = rules.page_check("html", "url", min_len=1000)
    return wide_table(spark, folder, "pages", "page_id", "url", "html").select("page_id", check.alias("c")).select("page_id", "c.ok", "c.reason")


@query("page_title", """
WITH t AS (SELECT page_id,
  trim(regexp_replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g')) AS h1,
  trim(regexp_replace(replace(replace(string_split(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '|')[1], '&copy;', '©'), '&amp;', '&'), '\\s+', ' ', 'g')) AS ti
  FROM pages)
SELECT page_id, CASE WHEN length(h1) >= 5 THEN h1 WHEN length(ti) >= 5 THEN ti ELSE '' END AS title FROM t
""")
def page_title(spark, folder):
    """Product title by tiers."""
    return wide_table(spark, folder, "pages", "page_id", "url", "html").select("page_id", rules.product_title("html").alias("title"))


@query("page_policy", """
WITH v AS (SELECT page_id, unnest([
  {'rule': 'tag', 'n': len(regexp_extract_all(html, '(?i)<\\s*(script|iframe|object|embed|form|input|button|link|meta|base)\\b'))},
  {'rule': 'handler', 'n': len(regexp_extract_all(html, '(?i)\\son[a-z]+\\s*='))},
  {'rule': 'javascript', 'n': len(regexp_extract_all(html, '(?i)javascript\\s*:'))},
  {'rule': 'http_equiv', 'n': len(regexp_extract_all(html, '(?i)http-equiv'))}]) AS x FROM pages)
SELECT page_id, x.rule AS rule, CAST(x.n AS BIGINT) AS n FROM v WHERE x.n > 0
""")
def page_policy(spark, folder):
    """Active content that an export must not carry (F22), as a reject table."""
    return (
        wide_table(spark, folder, "pages", "page_id", "url", "html").select("page_id", F.explode(rules.policy_violations("html")).alias("v"))
        .select("page_id", "v.rule", F.col("v.n").cast("bigint").alias("n"))
    )


@query("site_latest", f"""
WITH s AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY length(url), url, page_id) AS rn,
             count(*) OVER (PARTITION BY host) AS n FROM s)
SELECT host, page_id, url, CAST(rn AS INTEGER) AS place, n - 1 AS alts FROM r WHERE rn <= 3
""")
def site_latest(spark, folder):
    """Three shortest addresses per host and how many others there are (O2, O5): limited before the shuffle."""
    pages = table(spark, folder, "pages").select("page_id", "url", urls.host_of("url").alias("host"))
    top = first_rows(pages, ["host"], [F.length("url"), F.col("url"), F.col("page_id")], n=3, rank="place")
    alts = pages.groupBy("host").agg((F.count(F.lit(1)) - 1).alias("alts"))
    return top.join(alts, "host").select("host", "page_id", "url", F.col("place").cast("int").alias("place"), "alts")


@query("sitemap_pick", f"""
WITH e AS (SELECT page_id, url, {SQL_SEGS} AS segs FROM pages),
s AS (SELECT DISTINCT segs[1] AS site, upper(segs[1]) || regexp_replace(upper(regexp_replace(segs[-1], '(?i)\\.html?$', '')), '[^A-Z0-9]', '', 'g') || 'WW' AS key,
      url, lpad(CAST(page_id % 97 AS VARCHAR), 3, '0') AS lastmod FROM e WHERE len(segs) >= 2),
m AS (SELECT key, url, max(lastmod) AS lastmod FROM s GROUP BY ALL),
k AS (SELECT p_partkey AS "row", 'EN' || (p_partkey % 1000) || 'WW' AS k0, 'FR' || (p_partkey % 700) || 'WWB4' AS k1, 'DE' || (p_partkey % 500) || 'W' AS k2 FROM part),
keys AS (SELECT "row", 0 AS ord, k0 AS key FROM k UNION ALL SELECT "row", 1, k1 FROM k UNION ALL SELECT "row", 2, k2 FROM k),
ex AS (SELECT keys."row", keys.ord, m.* FROM keys JOIN m ON m.key = keys.key),
ex1 AS (SELECT * FROM ex QUALIFY ord = min(ord) OVER (PARTITION BY "row")),
fz AS (SELECT keys."row", keys.ord, m.* FROM keys JOIN m ON length(keys.key) >= 6 AND ((starts_with(m.key, keys.key) AND length(m.key) - length(keys.key) <= 5)
       OR (starts_with(keys.key, m.key) AND length(m.key) >= 6 AND length(keys.key) - length(m.key) <= 4))
       WHERE keys."row" NOT IN (SELECT "row" FROM ex1)),
fz1 AS (SELECT * FROM fz QUALIFY ord = min(ord) OVER (PARTITION BY "row")),
al AS (SELECT "row", url, max(lastmod) AS lastmod, false AS fuzzy FROM ex1 GROUP BY "row", url
       UNION ALL SELECT "row", url, max(lastmod), true FROM fz1 GROUP BY "row", url)
SELECT "row", url, count(*) OVER (PARTITION BY "row") - 1 AS alts, fuzzy FROM al
QUALIFY row_number() OVER (PARTITION BY "row" ORDER BY lastmod DESC, length(url), url) = 1
""")
def sitemap_pick(spark, folder):
    """Sitemap address per row: exact key, then prefixes either way; newest, then shortest."""
    segs = urls.path_segments("url")
    index = table(spark, folder, "pages").where(F.size(segs) >= 2).select(
        F.concat(F.upper(F.element_at(segs, 1)), urls.norm_key(urls.last_segment("url")), F.lit("WW")).alias("key"), "url",
        F.lpad((F.col("page_id") % 97).cast("string"), 3, "0").alias("lastmod"),
    )
    p = F.col("p_partkey")
    made = F.array(
        F.concat(F.lit("EN"), (p % 1000).cast("string"), F.lit("WW")), F.concat(F.lit("FR"), (p % 700).cast("string"), F.lit("WWB4")),
        F.concat(F.lit("DE"), (p % 500).cast("string"), F.lit("W")),
    )
    keys = table(spark, folder, "part").select(p.alias("row"), F.posexplode(made).alias("ord", "key"))
    return match.sitemap_lookup(keys, index)


@query("sitemap_tree", f"""
WITH e AS (SELECT page_id, 'https://www.shop.example/' || {SQL_SEGS}[1] || '/' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/rt-' || page_id || '.html'
                  || regexp_extract(url, '[?][^#]*') AS loc, {SQL_SEGS}[1] AS site FROM pages)
SELECT site, 'RT' || page_id AS key, loc AS url, CASE WHEN page_id % 3 = 0 THEN '' ELSE lpad(CAST(page_id AS VARCHAR), 12, '0') END AS lastmod
FROM e WHERE loc IS NOT NULL AND page_id >= 10
""")
def sitemap_tree(spark, folder):
    """All pages as sitemaps: an index names four indexes, these name twelve maps and one of them the first index again; read back."""
    top, i = shared_path(spark, "sitemaps"), F.col("page_id")
    loc = F.concat(
        F.lit("https://www.shop.example/"), F.try_element_at(urls.path_segments("url"), F.lit(1)), F.lit("/"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1),
        F.lit("/rt-"), i.cast("string"), F.lit(".html"), F.regexp_extract("url", "[?][^#]*", 0))
    xml = lambda df, root, row: df.write.format("xml").option("rootTag", root).option("rowTag", row)
    dated = F.when(i % 3 != 0, F.lpad(i.cast("string"), 12, "0"))
    xml(table(spark, folder, "pages").select(loc.alias("loc"), dated.alias("lastmod"), (i % 12).alias("map")).where("loc is not null"), "urlset", "url").partitionBy("map").save(f"{top}/maps")
    named = lambda to: F.concat(F.lit(f"{top}/{to}="), F.col("id").cast("string")).alias("loc")
    maps = spark.range(12).select(named("maps/map"), (F.col("id") % 4).alias("part")).union(spark.range(1).select(named("indexes/part"), F.lit(3).cast("long").alias("part")))
    xml(maps, "sitemapindex", "sitemap").partitionBy("part").save(f"{top}/indexes")
    xml(spark.range(4).select(named("indexes/part")), "sitemapindex", "sitemap").save(f"{top}/index")
    return readers.read_sitemap_tree(spark, f"{top}/index")


@query("url_classify")
def url_classify_placeholder(spark, folder):
    """Category ladder over page addresses made of the part words (F1)."""
    pages = table(spark, folder, "part").select("p_partkey", _part_url().alias("url"))
    return pages.select("p_partkey", rules.classify("url").alias("c")).select("p_partkey", "c.*")


def _part_url():
    """Product address of a part: the segment words come from its own type and name."""
    words = F.element_at(
        F.array(*[F.lit(w) for w in (
            "tvs-soundbars", "washers-dryers", "air-conditioners", "monitors", "refrigerators", "soundbars", "dishwashers",
            "microwave-ovens", "laptops", "vacuum-cleaners", "dehumidifiers", "projectors", "stylers", "accessories",
        )]), (F.col("p_partkey") % 14 + 1).cast("int"),
    )
    return F.concat(
        F.lit("https://www.shop.example/"), F.element_at(F.array(F.lit("th"), F.lit("de"), F.lit("sa_en")), (F.col("p_partkey") % 3 + 1).cast("int")),
        F.lit("/"), words, F.lit("/"), F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("/"),
        F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("x"), F.col("p_partkey").cast("string"), F.lit("/"),
    )


SQL_PART_URL = """'https://www.shop.example/' || ['th','de','sa_en'][CAST(p_partkey % 3 + 1 AS INT)] || '/' ||
 ['tvs-soundbars','washers-dryers','air-conditioners','monitors','refrigerators','soundbars','dishwashers','microwave-ovens','laptops',
  'vacuum-cleaners','dehumidifiers','projectors','stylers','accessories'][CAST(p_partkey % 14 + 1 AS INT)] || '/' || lower(replace(p_name, ' ', '-')) || '/' ||
 lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || 'x' || p_partkey || '/'"""


def sql_title_case(value: str) -> str:
    words = f"regexp_extract_all(regexp_replace({value}, '[-_]+', ' ', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')"
    return f"array_to_string(list_transform({words}, lambda w: upper(left(w, 1)) || substring(w, 2)), '')"


def sql_ladder(value: str, ladder, default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({value}, '(?i){p}') THEN '{label}'" for label, p in ladder)
    return f"CASE {cases} ELSE {default} END"


def sql_classify() -> str:
    es, ms, hs = (rules.GROUP_RULES[d] for d in ("ES", "MS", "HS"))
    ms_cases = " ".join(
        f"WHEN regexp_matches(k, '{p}')" + (f" AND NOT regexp_matches(k, '{rules.TV_WITH_SOUND}')" if label == "Audio" else "") + f" THEN '{label}'"
        for label, p in ms
    )
    hs_cases = " ".join(
        f"WHEN regexp_matches({'own' if label == 'Dryer' else 'k'}, '{p}')"
        + (f" AND NOT regexp_matches(own, '{rules.WASH_AND_DRY}')" if label == "Dryer" else "") + f" THEN '{label}'"
        for label, p in hs
    )
    return f"""
WITH u AS (SELECT p_partkey, {SQL_PART_URL} AS url FROM part),
s AS (SELECT *, list_filter(string_split(regexp_replace(url, '^https?://[^/]+', ''), '/'), lambda p: p <> '') AS segs FROM u),
c AS (SELECT *, {sql_ladder('url', rules.CATEGORY_RULES, sql_title_case('segs[2]'))} AS cat, {sql_title_case('segs[-2]')} AS sub FROM s),
d AS (SELECT *, cat || ' ' || sub || ' ' || regexp_replace(url, '^https?://[^/]+', '') AS raw FROM c),
e AS (SELECT *, CASE WHEN cat = 'Air' THEN 'ES' ELSE {sql_ladder('raw', rules.DIVISION_RULES, "'HS'")} END AS dv, lower(raw) AS k,
      lower(sub || ' ' || regexp_replace(url, '^https?://[^/]+', '')) AS own FROM d)
SELECT p_partkey, cat, sub, dv, CASE
  WHEN dv = 'ES' THEN CASE {" ".join(f"WHEN regexp_matches(k, '{p}') THEN '{label}'" for label, p in es)} ELSE 'AC' END
  WHEN dv = 'MS' THEN CASE {ms_cases} ELSE 'TV' END
  ELSE CASE {hs_cases} ELSE 'Other' END END AS grp
FROM e"""


from .registry import ORACLES  # noqa: E402

ORACLES["url_classify"] = sql_classify()


@query("page_backfill", f"""
WITH p AS (SELECT page_id, {SQL_SLUG} AS slug, html || chr(10) || url || chr(10) || url || '?again' AS body FROM pages),
f AS (SELECT page_id, slug, unnest(regexp_extract_all(body, 'https?://[^\\s"''<>()\\[\\]\\\\]+')) AS url,
             generate_subscripts(regexp_extract_all(body, 'https?://[^\\s"''<>()\\[\\]\\\\]+'), 1) AS pos FROM p)
SELECT slug, first(url ORDER BY page_id, pos) AS url FROM f WHERE {SQL_SLUG} = slug GROUP BY slug
""")
def page_backfill(spark, folder):
    """Source address found again in the page text (S12): here the text is the html and a trailer with addresses."""
    body = F.concat("html", F.lit("\n"), "url", F.lit("\n"), "url", F.lit("?again"))
    pages = wide_table(spark, folder, "pages", "page_id", "url", "html").select(urls.slugify("url").alias("slug"), body.alias("md"))
    return extract.backfill_source(pages, columns=("md",))


@query("page_text_inventory", """
WITH li AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>(?:<a [^>]*>)?([^<]*)', 1)) AS t,
                   generate_subscripts(regexp_extract_all(html, '(?s)<li>(?:<a [^>]*>)?([^<]*)', 1), 1) AS pos FROM pages),
k AS (SELECT page_id, pos, lower(regexp_replace(regexp_replace(t, '[™®©*​ ]', '', 'g'), '\\s+', '', 'g')) AS key FROM li)
SELECT page_id, key, count(*) AS n FROM k WHERE length(key) >= 4 GROUP BY ALL
""")
def page_text_inventory(spark, folder):
    """List texts of each page that a finished product must contain (H11 for pages without component classes)."""
    nodes = extract.nodes(wide_table(spark, folder, "pages", "page_id", "html"))
    leaves = extract.leaf_texts(nodes).where("tag = 'li'").select("page_id", "node", text.norm_compare("text").alias("key"))
    return leaves.where(F.length("key") >= 4).groupBy("page_id", "key").agg(F.count(F.lit(1)).alias("n"))


@query("page_heading_repeats", """
WITH h AS (SELECT page_id, lower(trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>([^<]*)', 1), '\\s+', ' ', 'g'))) AS k FROM pages)
SELECT k AS key, count(*) AS n, min(page_id) AS first_page FROM h WHERE k <> '' GROUP BY k HAVING count(*) > 1
""")
def page_heading_repeats(spark, folder):
    """Headings that several pages share, with the first page of each (W1 across the corpus, pre-aggregated)."""
    heading = text.squash(F.regexp_extract("html", "(?s)<h1[^>]*>([^<]*)", 1))
    return (
        table(spark, folder, "pages").select("page_id", heading.alias("key")).where("key <> ''").groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page")).where("n > 1")
    )


@query("page_first_seen", """
WITH h AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>([^<]*)', 1), '\\s+', ' ', 'g')) AS t FROM pages)
SELECT lower(t) AS key, page_id, t AS heading FROM h
QUALIFY row_number() OVER (PARTITION BY lower(t) ORDER BY page_id) = 1
""")
def page_first_seen(spark, folder):
    """First page per heading."""
    t = F.trim(F.regexp_replace(F.regexp_extract("html", "(?s)<h1[^>]*>([^<]*)", 1), r"\s+", " "))
    pages = table(spark, folder, "pages").select("page_id", t.alias("heading")).withColumn("key", F.lower("heading"))
    return drop_repeats(pages, ["key"], ["page_id"]).select("key", "page_id", "heading")
