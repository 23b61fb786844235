"""Queries over parts, orders and line items: matching, media keys, sheets, modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import channels, jobs, match, media, ranking, sections
from ..operators.ordered import renumber
from ..session import beside, placed
from .registry import query, table, wide_table

def _p():
    return F.col("p_partkey")


def _key():
    """Model code of a part."""
    return F.concat(F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit("X"), _p().cast("string"))


def _url():
    """Media address of a part, with the marks real asset addresses carry."""
    return F.concat(
        F.lit("https://cdn.shop.example/content/dam/"), F.lower("p_type"), F.when(_p() % 3 == 0, "/mobile/").when(_p() % 3 == 1, "/desktop/").otherwise("/"),
        F.replace("p_name", F.lit(" "), F.lit("-")), F.when(_p() % 4 == 0, F.concat(F.lit("_"), (F.col("p_size") * 10 + 100).cast("string"), F.lit("x600"))).otherwise(""),
        F.when(_p() % 5 == 0, "-m").when(_p() % 5 == 1, "-d").when(_p() % 5 == 2, "-gb").otherwise(""), F.when(_p() % 11 == 0, ".mp4").otherwise(".JPG"),
        F.when(_p() % 6 == 0, "?w=800").when(_p() % 6 == 1, "#top").otherwise(""),
    )


def catalog(spark, folder):
    """Products made of parts: slug, model, country, title."""
    countries = F.array(F.lit("th"), F.lit("de"), F.lit("sa"), F.lit("uk"))
    return table(spark, folder, "part").select(
        F.concat(F.lit("s-"), _p().cast("string")).alias("slug"), _key().alias("model"),
        F.element_at(countries, (_p() % 4 + 1).cast("int")).alias("country"), F.col("p_name").alias("title"))


CATALOG = """cat AS (SELECT 's-' || p_partkey AS slug, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || 'X' || p_partkey AS model,
  ['th','de','sa','uk'][CAST(p_partkey % 4 + 1 AS INT)] AS country, p_name AS title FROM part)"""


def market_rows(spark, folder):
    """One upload row per line item, joined to the part it names; suffixes, bundles and unknown codes by rule. num: a number for other rules."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = li.join(table(spark, folder, "part").select(_p().alias("l_partkey"), _key().alias("k"), "p_name"), "l_partkey")
    n, supp = F.col("l_linenumber"), F.col("l_suppkey")
    row, num = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), F.col("l_orderkey") + n  # after the join: wider than numbers
    sku = (
        F.when(n == 1, F.concat("k", F.lit(".ATM"))).when(n == 2, F.concat("k", F.lit("AT"))).when(n == 3, F.concat("k", F.lit(" + ZZ99")))
        .when(n == 4, F.lower("k")).when(n == 5, F.concat(F.lit("Q"), "k")).when(n == 6, F.lit("")).otherwise(F.concat("k", F.lit("ABCDEFG")))
    )
    parent = F.when((supp % 3 == 0) & (n == 4), F.concat("k", F.lit("_P"))).otherwise("")
    name = F.when(n.isin(5, 6), F.concat("p_name", F.lit(" ("), "k", F.lit(")"))).otherwise(F.col("p_name"))
    return placed(rows.select(row.alias("row"), num.alias("num"), sku.alias("sku"), parent.alias("parent_sku"), name.alias("name")), ["row"], li.count())


ROWS = """rw AS (SELECT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS "row", l_orderkey + l_linenumber AS num, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || 'X' || p_partkey AS k,
  l_linenumber AS n, l_suppkey AS supp, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
rws AS (SELECT "row", num, n, CASE n WHEN 1 THEN k || '.ATM' WHEN 2 THEN k || 'AT' WHEN 3 THEN k || ' + ZZ99' WHEN 4 THEN lower(k) WHEN 5 THEN 'Q' || k WHEN 6 THEN '' ELSE k || 'ABCDEFG' END AS sku,
  CASE WHEN supp % 3 = 0 AND n = 4 THEN k || '_P' ELSE '' END AS parent_sku, CASE WHEN n IN (5, 6) THEN p_name || ' (' || k || ')' ELSE p_name END AS name FROM rw)"""
SQL_KEYS = """sk AS (SELECT "row", tier, upper(trim(unnest(string_split(regexp_replace(s, '\\s*[+&,|/]\\s*', '+', 'g'), '+')))) AS p
   FROM (SELECT "row", 0 AS tier, parent_sku AS s FROM rws UNION ALL SELECT "row", 1, sku FROM rws)),
ks AS (SELECT DISTINCT "row", tier, regexp_replace(string_split(regexp_replace(p, '[\\s_]', '.', 'g'), '.')[1], '[^A-Z0-9]', '', 'g') AS key FROM sk WHERE p <> ''
   UNION SELECT DISTINCT "row", tier, regexp_replace(p, '[^A-Z0-9]', '', 'g') FROM sk WHERE p <> ''),
kk AS (SELECT * FROM ks WHERE length(key) >= 4),
hd AS (SELECT DISTINCT model AS key FROM cat WHERE length(model) >= 4),
ex AS (SELECT "row", tier, key FROM kk WHERE key IN (SELECT key FROM hd)),
pf AS (SELECT k."row", k.tier, h.key FROM (SELECT * FROM kk WHERE key NOT IN (SELECT key FROM hd)) k JOIN hd h
   ON length(h.key) >= 6 AND length(k.key) - length(h.key) BETWEEN 1 AND 4 AND left(k.key, length(h.key)) = h.key
   QUALIFY row_number() OVER (PARTITION BY k."row", k.tier, k.key ORDER BY length(h.key) DESC) = 1),
hits AS (SELECT DISTINCT * FROM (SELECT * FROM ex UNION ALL SELECT * FROM pf)),
hs AS (SELECT "row", key, 'sku' AS "by" FROM hits QUALIFY tier = min(tier) OVER (PARTITION BY "row")),
tk AS (SELECT "row", unnest(string_split_regex(upper(name), '[^A-Z0-9.\\-]+')) AS t FROM rws WHERE "row" NOT IN (SELECT "row" FROM hs)),
tn AS (SELECT "row", regexp_replace(string_split(t, '.')[1], '[^A-Z0-9]', '', 'g') AS key FROM tk UNION SELECT "row", regexp_replace(t, '[^A-Z0-9]', '', 'g') FROM tk),
hn AS (SELECT DISTINCT "row", key, 'name' AS "by" FROM tn WHERE length(key) >= 5 AND key IN (SELECT key FROM hd)),
al AS (SELECT * FROM hs UNION ALL SELECT * FROM hn)"""


@query("sku_match", f"""
WITH {CATALOG}, {ROWS}, {SQL_KEYS},
c AS (SELECT "row", string_agg(DISTINCT slug, ',' ORDER BY slug) AS candidates, any_value("by") AS "by" FROM al JOIN cat ON cat.model = al.key GROUP BY "row")
SELECT rws."row", coalesce(candidates, '') AS candidates, coalesce("by", '') AS "by", regexp_matches(parent_sku || ' ' || sku, '[+&]') AS bundle
FROM rws LEFT JOIN c ON c."row" = rws."row"
""")
def sku_match(spark, folder):
    """Candidates per upload row: exact keys, glued suffixes, then model codes in the name."""
    cat = catalog(spark, folder)
    out = match.match_rows(market_rows(spark, folder), match.model_keys(cat))
    return out.select("row", F.array_join("candidates", ",").alias("candidates"), "by", "bundle")


@query("sku_prefix_match", f"""
WITH {CATALOG}, k AS (SELECT DISTINCT l_partkey AS "row", upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || 'X' || p_partkey || left('ABCDE', CAST(1 + l_partkey % 5 AS INT)) AS key
  FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT k."row", k.key, h.model FROM k JOIN (SELECT DISTINCT model FROM cat) h ON length(h.model) >= 6 AND left(k.key, length(h.model)) = h.model AND length(k.key) - length(h.model) BETWEEN 1 AND 4
WHERE k.key NOT IN (SELECT model FROM cat)
QUALIFY row_number() OVER (PARTITION BY k."row", k.key ORDER BY length(h.model) DESC) = 1
""")
def sku_prefix_match(spark, folder):
    """Longest model a glued key starts with (J2): prefixes exploded to an equi-join."""
    keys = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("row")).distinct().join(
        table(spark, folder, "part").select(_p().alias("row"), F.concat(_key(), F.left(F.lit("ABCDE"), (_p() % 5 + 1).cast("int"))).alias("key")), "row")
    heads = match.model_keys(catalog(spark, folder)).select("key").distinct()
    return match.prefix_keys(keys, heads).select("row", "key", "model")


@query("sku_name_fallback", """
WITH t AS (SELECT doc_id, unnest(string_split_regex(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9.\\-]+')) AS t FROM documents),
k AS (SELECT doc_id, regexp_replace(string_split(t, '.')[1], '[^A-Z0-9]', '', 'g') AS key FROM t UNION SELECT doc_id, regexp_replace(t, '[^A-Z0-9]', '', 'g') FROM t),
w AS (SELECT DISTINCT regexp_replace(upper(replace(w, 'ß', 'SS')), '[^A-Z0-9]', '', 'g') AS key FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark))
SELECT doc_id, CAST(count(DISTINCT k.key) AS BIGINT) AS n_keys FROM k JOIN w USING (key) WHERE length(k.key) >= 5 GROUP BY doc_id
""")
def sku_name_fallback(spark, folder):
    """Key-like words of the texts that the word index knows."""
    words = table(spark, folder, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).select(urls.norm_key("w").alias("key")).distinct()
    tokens = match.name_key_rows(wide_table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return tokens.join(words, "key").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_keys"))


@query("unmatched_rows", f"""
WITH {CATALOG}, {ROWS}, {SQL_KEYS},
g AS (SELECT DISTINCT al."row" FROM al JOIN cat ON cat.model = al.key WHERE country = 'th')
SELECT "row", sku FROM rws WHERE NOT regexp_matches(parent_sku || ' ' || sku, '[+&]') AND "row" NOT IN (SELECT "row" FROM g)
""")
def unmatched_rows(spark, folder):
    """Rows without a product in the home country, bundles aside."""
    cat, rows = catalog(spark, folder), market_rows(spark, folder)
    hits = match.match_keys(rows, match.model_keys(cat))
    return match.unmatched(rows, hits, cat, "th").select("row", "sku")


@query("row_triage", f"""
WITH {CATALOG}, {ROWS}, {SQL_KEYS},
h AS (SELECT al."row", count(DISTINCT slug) AS n, min(slug) AS pick FROM al JOIN cat ON cat.model = al.key WHERE country = 'th' GROUP BY ALL),
o AS (SELECT rws."row", CASE WHEN regexp_matches(parent_sku || ' ' || sku, '[+&]') THEN 'rBundle' WHEN h.n = 1 THEN 'ok' WHEN h.n > 1 THEN 'rMulti' WHEN num % 2 = 0 THEN 'register' ELSE 'rNone' END AS outcome, pick
  FROM rws LEFT JOIN h ON h."row" = rws."row")
SELECT "row", outcome, CASE WHEN outcome = 'ok' THEN pick END AS slug FROM o
""")
def row_triage(spark, folder):
    """Outcome per upload row (F21); rows with an even number count as found in a sitemap."""
    cat, rows = catalog(spark, folder), market_rows(spark, folder)
    hits = match.match_keys(rows, match.model_keys(cat))
    return match.triage(rows, hits, cat, "th", rows.where("num % 2 = 0").dropDuplicates(["row"])).select("row", "outcome", "slug")


@query("upload_summary", f"""
WITH {CATALOG}, {ROWS}, {SQL_KEYS}, m AS (SELECT DISTINCT "row" FROM al)
SELECT num % 7 AS upload_id, count(*) AS n_rows, count(m."row") AS n_matched, count(*) FILTER (num % 3 = 0) AS n_found
FROM rws LEFT JOIN m ON m."row" = rws."row" GROUP BY 1
""")
def upload_summary(spark, folder):
    """Row counts per upload."""
    rows = market_rows(spark, folder)
    hits = match.match_keys(rows, match.model_keys(catalog(spark, folder)))
    hits = beside(hits, ["row"], rows.count()).groupBy("row").agg(F.collect_set("key").alias("candidates"))
    full = rows.join(hits, "row", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return match.upload_summary(full.withColumn("upload_id", F.col("num") % 7), rows.where("num % 3 = 0"), keys=["upload_id"])


@query("home_country", """
WITH c AS (SELECT c_mktsegment, n_name AS country, count(*) AS n, min(o_orderkey) AS p FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
SELECT c_mktsegment, first(country ORDER BY n DESC, p) AS home, max(n) AS n FROM c GROUP BY c_mktsegment
""")
def home_country(spark, folder):
    """Most frequent country per segment, first seen on ties."""
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return match.home_country(
        rows.select("c_mktsegment", F.col("n_name").alias("country"), F.col("o_orderkey").alias("pos")), keys=["c_mktsegment"])


@query("catalog_facets", """
WITH p AS (SELECT ['th','de','sa','uk'][CAST(p_partkey % 4 + 1 AS INT)] AS country, p_type AS dv, p_brand AS grp FROM part)
SELECT country, dv, grp, count(*) AS n FROM p GROUP BY ROLLUP(country, dv, grp)
""")
def catalog_facets(spark, folder):
    """Facet counts by country, division and group."""
    rows = table(spark, folder, "part").select(
        F.element_at(F.array(F.lit("th"), F.lit("de"), F.lit("sa"), F.lit("uk")), (_p() % 4 + 1).cast("int")).alias("country"),
        F.col("p_type").alias("dv"), F.col("p_brand").alias("grp"))
    return match.catalog_counts(rows, ["country", "dv", "grp"])


# ---------------------------------------------------------------- media addresses made of parts

SQL_URL = """u AS (SELECT p_partkey, p_brand, p_type, p_size, p_name, p_retailprice, 'https://cdn.shop.example/content/dam/' || lower(p_type) || CASE p_partkey % 3 WHEN 0 THEN '/mobile/' WHEN 1 THEN '/desktop/' ELSE '/' END ||
  replace(p_name, ' ', '-') || CASE WHEN p_partkey % 4 = 0 THEN '_' || (p_size * 10 + 100) || 'x600' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN '-m' WHEN 1 THEN '-d' WHEN 2 THEN '-gb' ELSE '' END ||
  CASE WHEN p_partkey % 11 = 0 THEN '.mp4' ELSE '.JPG' END || CASE p_partkey % 6 WHEN 0 THEN '?w=800' WHEN 1 THEN '#top' ELSE '' END AS url FROM part)"""


def part_urls(spark, folder):
    return table(spark, folder, "part").withColumn("url", _url())


SQL_DEDUP_STEM = """lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '(?i)/(desktop|mobile|pc)/', '/', 'g'), '^.*/', ''),
  '(?i)[-_](m|d|gb-d|gb-m|gb|mobile|desktop|mo|pc)(\\.\\w+)$', '\\2'), '(?i)[-_](desktop|mobile)', '', 'g'), '\\d{2,4}x\\d{2,4}', '', 'g'))"""


@query("media_keys", f"""
WITH {SQL_URL}
SELECT p_partkey,
  regexp_replace(replace(lower(regexp_replace(regexp_replace(string_split(url, '?')[1], '/jcr:content/.*$', ''), '^.*/', '')), '%20', ' '), '[._-]\\d{{2,4}}x\\d{{2,4}}', '', 'g') AS image_key,
  {SQL_DEDUP_STEM} AS dedup_stem,
  CASE WHEN regexp_extract(url, '(?i)/([^/]+\\.(?:jpg|jpeg|png|webp|gif))', 1) = '' THEN url ELSE regexp_replace(lower(regexp_extract(url, '(?i)/([^/]+\\.(?:jpg|jpeg|png|webp|gif))', 1)), '[._-]\\d{{2,4}}x\\d{{2,4}}(\\.[^.]*)$', '\\1') END AS asset_key,
  lower(regexp_replace(regexp_replace(string_split(url, '?')[1], '^https?://[^/]+', ''), '/jcr:content.*$', '')) AS dam_key,
  CASE WHEN regexp_extract(url, '[?&]w=(\\d+)', 1) <> '' THEN CAST(regexp_extract(url, '[?&]w=(\\d+)', 1) AS INT)
       ELSE coalesce(list_max(list_transform(regexp_extract_all(url, '(\\d{{2,4}})x(\\d{{2,4}})', 1), lambda w: CAST(w AS INT))), 100000) END AS width,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '\\.\\w+$', ''), '(?i)-(m|d|gb|gb-d|gb-m)$', ''), '(?i)-(m|d)$', '') AS stem,
  regexp_extract(url, '(/content/dam/[^?#]*/)', 1) AS folder,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '^.*/', '')), '\\.(jpe?g|png|webp|gif|mp4|webm|mov)$', ''), '\\(thumbnail\\)', '', 'g'), '([-_ ](desktop|mobile|tablet|pc|mo|d|m|t|v\\d+|\\d{{3,4}}(x\\d{{3,4}})?))+$', '') AS folded
FROM u
""")
def media_keys(spark, folder):
    """Asset identity columns of media addresses."""
    return part_urls(spark, folder).select(
        "p_partkey", urls.image_key("url").alias("image_key"), urls.dedup_stem("url").alias("dedup_stem"), urls.asset_key("url").alias("asset_key"),
        urls.dam_path_key("url").alias("dam_key"), urls.effective_width("url").alias("width"), urls.file_stem("url").alias("stem"),
        urls.dam_folder("url").alias("folder"), urls.fold_name("url").alias("folded"))


@query("media_variants_flags", f"""
WITH {SQL_URL}
SELECT p_partkey, regexp_replace(regexp_replace(url, '-m(\\.\\w+)$', '-d\\1'), '(?i)/mobile/', '/desktop/', 'g') AS desktop,
  regexp_replace(url, '(?i)-d(\\.\\w+)$', '-m\\1') AS mobile,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '(?i)([-_])M(\\.(?:jpe?g|png|webp|gif)(?:\\?|$))', '\\1D\\2'), '(?i)([-_])mobile([-_./])', '\\1desktop\\2', 'g'), '(?i)/mobile/', '/desktop/', 'g'), '(?i)([-_])sp(\\.(?:jpe?g|png|webp)(?:\\?|$))', '\\1pc\\2') AS guess,
  regexp_matches(url, '(?i)-m(\\.\\w+)$|/mobile/|_mobile|318x300') AS is_mobile,
  regexp_matches(url, '(?i)\\.(mp4|webm|mov)(\\?|$)') AS is_video,
  regexp_matches(url, '(?i)gnb|promotion|promo|deals|banner|membership|favicon|\\.svg|[-_]icon[-_]|logo') AS junk,
  CASE WHEN regexp_matches(url, '(?i)\\.svg($|\\?)|/icon') THEN 'icon' ELSE 'content' END AS role,
  NOT regexp_matches(lower(string_split(url, '?')[1]), '\\.(mp4|webm|mov)$|[_-](on|off)\\.(png|jpe?g)$') AND NOT regexp_matches(lower(url), 'thum-\\d+x\\d+') AS usable
FROM u
""")
def media_variants_flags(spark, folder):
    """Device swaps and media predicates."""
    return part_urls(spark, folder).select(
        "p_partkey", urls.to_desktop("url").alias("desktop"), urls.to_mobile("url").alias("mobile"), urls.guess_desktop("url").alias("guess"),
        urls.is_mobile_url("url").alias("is_mobile"), urls.is_video_url("url").alias("is_video"), rules.is_junk_media("url", "inventory").alias("junk"),
        rules.media_role("url").alias("role"), rules.usable_media("url").alias("usable"))


@query("award_media", """
WITH u AS (SELECT p_partkey, 'https://cdn.shop.example/' || CASE WHEN p_partkey % 10 = 0 THEN 'awards/' ELSE 'dam/' END ||
  ['red-dot','award','award-winning','badge','testsieger','best-of-ces','award_winning','photo','editors-choice','picture'][CAST(p_partkey % 10 + 1 AS INT)] || '-' || p_size || '.jpg' AS url FROM part),
n AS (SELECT *, regexp_replace(string_split(string_split(url, '?')[1], '/')[-1], '(?i)award[-_ ]?winning', '#', 'g') AS name FROM u)
SELECT p_partkey, url, regexp_matches(name, '(?i)(badge|award|reddot|red[-_]dot|testurteil|editors?[-_]?choice|best[-_]?of[-_]?(the[-_]?best|ces|show)|winner)')
  OR regexp_matches(name, '(?i)test[-_ %20]*(siegel|urteil|sieger)|best[-_ %20]*picks?') OR regexp_matches(url, '(?i)/awards?/') AS award FROM n
""")
def award_media(spark, folder):
    """Award pictures by file name and folder; award-winning is a plain feature picture (F8)."""
    names = F.array(*[F.lit(n) for n in (
        "red-dot", "award", "award-winning", "badge", "testsieger", "best-of-ces", "award_winning", "photo", "editors-choice", "picture")])
    url = F.concat(F.lit("https://cdn.shop.example/"), F.when(_p() % 10 == 0, "awards/").otherwise("dam/"), F.element_at(names, (_p() % 10 + 1).cast("int")),
                   F.lit("-"), F.col("p_size").cast("string"), F.lit(".jpg"))
    return table(spark, folder, "part").select("p_partkey", url.alias("url")).withColumn("award", rules.is_award("url"))


@query("srcset_pick", """
WITH s AS (SELECT p_partkey, p_size, '/i/' || p_partkey || '-a.jpg ' || (p_size * 20) || 'w, /i/' || p_partkey || '-b,c.jpg ' || (p_size * 20 + p_partkey % 3) || 'w, /i/' || p_partkey || '-d.jpg ' || CASE WHEN p_partkey % 2 = 0 THEN '1.5x' ELSE '' END AS ss FROM part)
SELECT p_partkey, '/i/' || p_partkey || '-a.jpg' AS first_url,
  CASE WHEN greatest(p_size * 20, CASE WHEN p_partkey % 2 = 0 THEN 1500 ELSE 500 END) = p_size * 20 AND p_size * 20 >= greatest(500, CASE WHEN p_partkey % 2 = 0 THEN 1500 ELSE 500 END) AND p_size * 20 >= p_size * 20 + p_partkey % 3 THEN '/i/' || p_partkey || '-a.jpg'
       WHEN p_size * 20 + p_partkey % 3 > greatest(p_size * 20, 500) AND p_size * 20 + p_partkey % 3 >= CASE WHEN p_partkey % 2 = 0 THEN 1500 ELSE 500 END THEN 'c.jpg'
       WHEN p_partkey % 2 = 0 THEN '/i/' || p_partkey || '-d.jpg'
       ELSE '/i/' || p_partkey || '-b' END AS best_url FROM s
""")
def srcset_pick(spark, folder):
    """First and best srcset candidates (U9, U10); best splits at every comma, so a comma in a name cuts it, as the source does."""
    p, n = _p().cast("string"), F.col("p_size")
    ss = F.concat(
        F.lit("/i/"), p, F.lit("-a.jpg "), (n * 20).cast("string"), F.lit("w, /i/"), p, F.lit("-b,c.jpg "), (n * 20 + _p() % 3).cast("string"),
        F.lit("w, /i/"), p, F.lit("-d.jpg "), F.when(_p() % 2 == 0, "1.5x").otherwise(""))
    return table(spark, folder, "part").select("p_partkey", urls.srcset_first(ss).alias("first_url"), urls.srcset_best(ss).alias("best_url"))


@query("sheet_columns", """
SELECT p_partkey, CASE WHEN p_partkey % 16384 + 1 > 702 THEN chr(CAST(65 + ((p_partkey % 16384 + 1 - 27) // 676 - 1) % 26 AS INT)) ELSE '' END ||
  CASE WHEN p_partkey % 16384 + 1 > 26 THEN chr(CAST(65 + ((p_partkey % 16384) // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + (p_partkey % 16384) % 26 AS INT)) AS letters,
  CAST(p_partkey % 16384 + 1 AS INT) AS back FROM part
""")
def sheet_columns(spark, folder):
    """Spreadsheet column letters and back."""
    letters = urls.col_letters(_p() % 16384 + 1)
    return table(spark, folder, "part").select("p_partkey", letters.alias("letters"), urls.col_number(letters).alias("back"))


@query("name_cells", """
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(regexp_replace(p_name || '-' || lower(p_type) || '_mk' || p_size, '[-_]+', ' ', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: upper(left(w, 1)) || substring(w, 2)), '') AS title,
  CASE WHEN starts_with(p_brand, 'Brand#1') THEN 'https://www.shop.example/a/' || p_partkey WHEN starts_with(p_brand, 'Brand#2') THEN 'https://cdn.example/' || p_partkey ELSE 'https://x.example/' || p_partkey END AS abs,
  regexp_replace(p_type || '/' || p_name || ':' || p_partkey || '?.xlsx', '[\\x00-\\x1f\\\\/:*?"<>|]+', '_', 'g') AS file,
  CASE p_size % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'neutral' END AS device,
  'yt' || p_partkey AS tube
FROM part
""")
def name_cells(spark, folder):
    """Title case, absolute addresses, file names, device of a media query, video ids."""
    p = _p().cast("string")
    raw = F.when(F.col("p_brand").startswith("Brand#1"), F.concat(F.lit("/a/"), p)).when(
        F.col("p_brand").startswith("Brand#2"), F.concat(F.lit("//cdn.example/"), p)).otherwise(F.concat(F.lit("http://x.example/"), p))
    m = F.element_at(F.array(F.lit("(min-width: 769px)"), F.lit("(max-width:768px)"), F.lit(""), F.lit("(min-width: 300px) and (max-width: 500px)")), (F.col("p_size") % 4 + 1).cast("int"))
    tube = F.concat(F.when(_p() % 2 == 0, "https://www.youtube.com/embed/yt").otherwise("https://youtu.be/yt"), p, F.lit("?rel=0"))
    return table(spark, folder, "part").select(
        "p_partkey", urls.title_case(F.concat("p_name", F.lit("-"), F.lower("p_type"), F.lit("_mk"), F.col("p_size").cast("string"))).alias("title"),
        urls.abs_url(raw, "https://www.shop.example").alias("abs"),
        urls.safe_filename(F.concat("p_type", F.lit("/"), "p_name", F.lit(":"), p, F.lit("?.xlsx"))).alias("file"), urls.device_of(m).alias("device"),
        urls.youtube_id(tube).alias("tube"))


@query("variant_merge", f"""
WITH {SQL_URL}, v AS (SELECT p_type, p_partkey AS pos, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(?i)-(m|d)(\\.\\w+)$', '\\2') AS stem FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type, stem ORDER BY CASE WHEN regexp_matches(url, '(?i)-d\\.\\w+(\\?|$)') THEN 0 ELSE 1 END, pos) AS r FROM v)
SELECT p_type, stem, max(url) FILTER (r = 1) AS "primary", CAST(count(*) - 1 AS BIGINT) AS n_variants, md5(coalesce(string_agg(url, '|' ORDER BY pos) FILTER (r > 1), '')) AS variants_md5 FROM r GROUP BY ALL
""")
def variant_merge(spark, folder):
    """Device variants of one asset merged (A10)."""
    rows = part_urls(spark, folder).select("p_type", _p().alias("pos"), "url")
    out = media.merge_variants(rows, ["p_type"])
    return out.select("p_type", "stem", "primary", F.size("variants").cast("bigint").alias("n_variants"), F.md5(F.array_join("variants", "|")).alias("variants_md5"))


SQL_ASSET = "CASE WHEN regexp_extract(url, '(?i)/([^/]+\\.(?:jpg|jpeg|png|webp|gif))', 1) = '' THEN url ELSE regexp_replace(lower(regexp_extract(url, '(?i)/([^/]+\\.(?:jpg|jpeg|png|webp|gif))', 1)), '[._-]\\d{2,4}x\\d{2,4}(\\.[^.]*)$', '\\1') END"
SQL_WIDTH = "CASE WHEN regexp_extract(url, '[?&]w=(\\d+)', 1) <> '' THEN CAST(regexp_extract(url, '[?&]w=(\\d+)', 1) AS INT) ELSE coalesce(list_max(list_transform(regexp_extract_all(url, '(\\d{2,4})x(\\d{2,4})', 1), lambda w: CAST(w AS INT))), 100000) END"


@query("resolution_upgrade", f"""
WITH {SQL_URL}, k AS (SELECT p_type, p_partkey AS pos, url, {SQL_ASSET} AS asset, {SQL_WIDTH} AS w FROM u),
b AS (SELECT p_type, asset, url AS best, w AS bw FROM k QUALIFY row_number() OVER (PARTITION BY p_type, asset ORDER BY w DESC, pos) = 1)
SELECT pos, CASE WHEN bw > w THEN best ELSE url END AS url, bw > w AS upgraded FROM k JOIN b USING (p_type, asset)
""")
def resolution_upgrade(spark, folder):
    """Address replaced by the widest variant of its asset, if strictly wider."""
    rows = part_urls(spark, folder).select("p_type", _p().alias("pos"), "url")
    return media.upgrade_resolution(rows, rows, ["p_type"]).select("pos", "url", "upgraded")


@query("source_pick", """
WITH i AS (SELECT p_brand, p_partkey AS pos, CAST(p_size * 40 + 100 AS DOUBLE) AS w, CAST(p_partkey % 700 + 50 AS DOUBLE) AS h FROM part),
k AS (SELECT *, round(least((w / h) / (970.0::DOUBLE / 600), (970.0::DOUBLE / 600) / (w / h)), 9) AS keep FROM i)
SELECT p_brand, first(pos ORDER BY keep DESC, pos) AS pos, round(max(keep), 6) AS keep FROM k GROUP BY p_brand
""")
def source_pick(spark, folder):
    """Picture that loses least in a module box, per brand."""
    rows = table(spark, folder, "part").select(
        "p_brand", _p().alias("pos"), (F.col("p_size") * 40 + 100).cast("double").alias("width"), (_p() % 700 + 50).cast("double").alias("height"))
    return ranking.pick_source(rows, ["p_brand"], 970, 600).select("p_brand", "pos", F.round("keep", 6).alias("keep"))


@query("closest_image", """
WITH i AS (SELECT p_type, p_partkey AS pos, CASE WHEN p_partkey % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(p_size AS DOUBLE) / 13 END AS ar FROM part)
SELECT p_type, first(pos ORDER BY CASE WHEN ar > 0 THEN round(abs(ar - 1.6166666666666667::DOUBLE), 9) ELSE 1e9 END, pos) AS pos FROM i GROUP BY p_type
""")
def closest_image(spark, folder):
    """Picture with the closest aspect ratio per type."""
    rows = table(spark, folder, "part").select("p_type", _p().alias("pos"), F.when(_p() % 4 == 0, F.lit(0.0)).otherwise(F.col("p_size").cast("double") / 13).alias("ar"))
    return ranking.closest_ratio(rows, ["p_type"], 1.6166666666666667)


@query("section_media_pc", f"""
WITH {SQL_URL}, s AS (SELECT p_type AS sec, p_partkey AS pos, url, {SQL_DEDUP_STEM} AS stem, regexp_matches(url, '(?i)-m(\\.\\w+)$|/mobile/|_mobile|318x300') AS m FROM u)
SELECT sec, stem, first(url ORDER BY m, pos) AS url, min(pos) AS media_ord, count(*) - 1 AS removed FROM s GROUP BY ALL
""")
def section_media_pc(spark, folder):
    """One media per stem and section, desktop preferred, at the first place."""
    rows = part_urls(spark, folder).select(F.col("p_type").alias("sec"), _p().alias("media_ord"), "url")
    return media.prefer_pc_in_section(rows, ["sec"])


@query("canonical_home", f"""
WITH {SQL_URL}, m AS (SELECT p_type AS page, p_size AS sec_ord, p_partkey AS id, url, {SQL_DEDUP_STEM} AS stem, regexp_matches(url, '(?i)\\.(mp4|webm|mov)(\\?|$)') AS v FROM u),
t AS (SELECT p_type AS page, p_size AS sec_ord, count(*) * (p_size % 5) AS len FROM part GROUP BY p_type, p_size),
vb AS (SELECT DISTINCT page, sec_ord, regexp_replace(stem, '\\.\\w+$', '') AS base FROM m WHERE v),
x AS (SELECT m.*, CASE WHEN vb.base IS NULL THEN 0 ELSE 1 END AS hv, len FROM m JOIN t USING (page, sec_ord) LEFT JOIN vb ON vb.page = m.page AND vb.sec_ord = m.sec_ord AND vb.base = regexp_replace(m.stem, '\\.\\w+$', '') WHERE NOT v),
h AS (SELECT page, stem, first(sec_ord ORDER BY hv DESC, len DESC, sec_ord) AS sec_ord FROM x GROUP BY ALL)
SELECT page, sec_ord, id FROM x SEMI JOIN h USING (page, stem, sec_ord) UNION ALL SELECT page, sec_ord, id FROM m WHERE v
""")
def canonical_home(spark, folder):
    """Each picture kept in its best section only."""
    rows = part_urls(spark, folder).select(F.col("p_type").alias("page"), F.col("p_size").alias("sec_ord"), _p().alias("id"), "url")
    lengths = table(spark, folder, "part").groupBy(F.col("p_type").alias("page"), F.col("p_size").alias("sec_ord")).agg(
        (F.count(F.lit(1)) * (F.col("p_size") % 5)).alias("n")).select("page", "sec_ord", F.repeat(F.lit("x"), F.col("n").cast("int")).alias("text"))
    return media.canonical_home(rows, lengths, ["page"]).select("page", "sec_ord", "id")


@query("control_media", f"""
WITH {SQL_URL}, s AS (SELECT p_type, p_partkey, url, lower(regexp_replace(regexp_replace(string_split(url, '?')[1], '^https?://[^/]+', ''), '/jcr:content.*$', '')) AS k, p_size % 3 <> 0 AS inside FROM u),
o AS (SELECT p_type, k FROM s GROUP BY ALL HAVING bool_and(inside))
SELECT p_type, p_partkey FROM s ANTI JOIN o USING (p_type, k)
""")
def control_media(spark, folder):
    """Media not only used inside controls."""
    rows = part_urls(spark, folder).select("p_type", "p_partkey", "url", (F.col("p_size") % 3 != 0).alias("inside"))
    return media.drop_control_media(rows.drop("inside"), rows.select("p_type", "url", "inside"), ["p_type"]).select("p_type", "p_partkey")


@query("dead_media", f"""
WITH {SQL_URL}, m AS (SELECT p_partkey, url AS pc_url, CASE WHEN p_partkey % 3 = 0 THEN replace(url, '.JPG', '-x.JPG') ELSE '' END AS mobile_url FROM u),
d AS (SELECT DISTINCT url FROM u WHERE p_size % 7 = 0 UNION SELECT DISTINCT replace(url, '.JPG', '-x.JPG') FROM u WHERE p_size % 14 = 0),
j AS (SELECT m.*, pc_url IN (SELECT url FROM d) AS pd, mobile_url IN (SELECT url FROM d) AS md FROM m)
SELECT p_partkey, CASE WHEN pd THEN mobile_url ELSE pc_url END AS pc_url, CASE WHEN NOT pd AND md THEN '' ELSE mobile_url END AS mobile_url FROM j
WHERE NOT pd OR (mobile_url <> '' AND NOT md AND mobile_url <> pc_url)
""")
def dead_media(spark, folder):
    """Dead files dropped, falling back to a live mobile file."""
    u = part_urls(spark, folder)
    alt = F.replace("url", F.lit(".JPG"), F.lit("-x.JPG"))
    m = u.select("p_partkey", F.col("url").alias("pc_url"), F.when(_p() % 3 == 0, alt).otherwise("").alias("mobile_url"))
    gone = u.where("p_size % 7 = 0").select("url", F.lit(404).alias("http_code"), F.lit(0).alias("bytes")).unionByName(
        u.where("p_size % 14 = 0").select(alt.alias("url"), F.lit(200).alias("http_code"), F.lit(120).alias("bytes")))
    return media.drop_dead_media(m, gone)


@query("image_coverage", f"""
WITH {SQL_URL}, i AS (SELECT p_type AS page, regexp_replace(url, '[?#].*$', '') AS u FROM u),
a AS (SELECT p_type AS page, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'https://old.shop.example' END || regexp_replace(url, '[?#].*$', '') AS v FROM u),
d AS (SELECT DISTINCT page, u FROM i), da AS (SELECT DISTINCT page, v FROM a),
h AS (SELECT page, u, (page, u) IN (SELECT (page, v) FROM da) OR (page, regexp_replace(u, '(?i)-m(\\.\\w+)$', '-d\\1')) IN (SELECT (page, v) FROM da) OR (page, regexp_replace(u, '(?i)-d(\\.\\w+)$', '-m\\1')) IN (SELECT (page, v) FROM da) AS hit FROM d)
SELECT page AS page_id, count(*) AS in_markdown, count(*) FILTER (hit) AS captured, CAST(floor(count(*) FILTER (hit) * 100 / count(*) + 0.5) AS BIGINT) AS pct FROM h GROUP BY page
""")
def image_coverage(spark, folder):
    """Share of pictures found under any device variant."""
    from ..operators import qa

    u = part_urls(spark, folder).withColumn("page_id", F.col("p_type"))
    moved = F.concat(F.when(_p() % 3 == 0, "").otherwise("https://old.shop.example"), "url")
    return qa.image_coverage_pct(u.select("page_id", "url"), u.select("page_id", moved.alias("url")))


@query("image_inventory_gaps", f"""
WITH {SQL_URL}, k AS (SELECT p_type AS page_id, p_partkey AS image, regexp_replace(replace(lower(regexp_replace(regexp_replace(string_split(url, '?')[1], '/jcr:content/.*$', ''), '^.*/', '')), '%20', ' '), '[._-]\\d{{2,4}}x\\d{{2,4}}', '', 'g') AS key, p_size FROM u),
hv AS (SELECT DISTINCT page_id, key FROM k WHERE p_size % 2 = 0), dd AS (SELECT DISTINCT page_id, key FROM k WHERE p_size % 5 = 0), cc AS (SELECT DISTINCT page_id, key FROM k WHERE p_size % 3 = 0)
SELECT page_id, image, hv.key IS NULL AND dd.key IS NULL AS missing, cc.key IS NOT NULL AS only_in_cards
FROM k LEFT JOIN hv USING (page_id, key) LEFT JOIN dd USING (page_id, key) LEFT JOIN cc USING (page_id, key)
""")
def image_inventory_gaps(spark, folder):
    """Inventory pictures missing from the product, dead ones apart."""
    from ..operators import qa

    u = part_urls(spark, folder).select(F.col("p_type").alias("page_id"), _p().alias("image"), urls.image_key("url").alias("key"), "p_size")
    inv = u.select("page_id", "image", F.array("key").alias("keys"))
    pick = lambda c: u.where(c).select("page_id", "key")
    return qa.image_coverage(inv, pick("p_size % 2 = 0"), pick("p_size % 5 = 0"), pick("p_size % 3 = 0")).select(
        "page_id", "image", "missing", "only_in_cards")


@query("video_sections", f"""
WITH {SQL_URL}, a AS (SELECT p_type || CASE WHEN p_partkey % 11 <> 0 AND p_size <= 40 THEN ' low' ELSE '' END AS page, p_size AS sec_ord, p_partkey AS pos, url,
   regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '\\.\\w+$', ''), '(?i)-(m|d|gb|gb-d|gb-m)$', ''), '(?i)-(m|d)$', '') AS stem,
   regexp_extract(url, '(/content/dam/[^?#]*/)', 1) AS folder, p_partkey % 11 = 0 AS v FROM u),
vd AS (SELECT * FROM a WHERE v QUALIFY row_number() OVER (PARTITION BY page, stem ORDER BY pos) = 1),
st AS (SELECT page, stem, min(sec_ord) AS s FROM a WHERE NOT v GROUP BY ALL), fo AS (SELECT page, folder, min(sec_ord) AS f FROM a WHERE NOT v GROUP BY ALL)
SELECT page, pos, coalesce(s, f) AS sec_ord, CASE WHEN s IS NOT NULL THEN 'file-stem' WHEN f IS NOT NULL THEN 'dam-folder' ELSE 'unassigned' END AS matched_by
FROM vd LEFT JOIN st USING (page, stem) LEFT JOIN fo USING (page, folder)
""")
def video_sections(spark, folder):
    """Section of each video by file stem, then folder."""
    low = F.when((_p() % 11 != 0) & (F.col("p_size") <= 40), " low").otherwise("")  # pictures of pages of their own
    u = part_urls(spark, folder).select(F.concat("p_type", low).alias("page"), F.col("p_size").alias("sec_ord"), _p().alias("pos"), "url")
    vids = u.where("pos % 11 = 0").select("page", "pos", "url")
    assets = u.where("pos % 11 <> 0").withColumn("type", F.lit("image"))
    return media.attach_videos(assets, vids, ["page"]).select("page", "pos", "sec_ord", "matched_by")


@query("geometry_join", f"""
WITH {SQL_URL}, a AS (SELECT p_type AS page, p_partkey AS id, regexp_replace(url, '[?#].*$', '') AS b FROM u),
g AS (SELECT p_type AS page, CASE WHEN p_partkey % 5 IN (0, 1) THEN '' ELSE 'https://old.shop.example' END || regexp_replace(url, '[?#].*$', '') AS k, p_size * 30 AS rw, p_partkey AS rt, p_size AS rl FROM u
      QUALIFY row_number() OVER (PARTITION BY p_type, CASE WHEN p_partkey % 5 IN (0, 1) THEN '' ELSE 'https://old.shop.example' END || regexp_replace(url, '[?#].*$', '') ORDER BY p_partkey, p_size, p_size * 30) = 1)
SELECT a.page, a.id, CAST(coalesce(g0.rt, g1.rt, g2.rt) AS BIGINT) AS rt FROM a LEFT JOIN g g0 ON g0.page = a.page AND g0.k = b
  LEFT JOIN g g1 ON g1.page = a.page AND g1.k = regexp_replace(b, '(?i)-m(\\.\\w+)$', '-d\\1') LEFT JOIN g g2 ON g2.page = a.page AND g2.k = regexp_replace(b, '(?i)-d(\\.\\w+)$', '-m\\1')
""")
def geometry_join(spark, folder):
    """Render geometry under an address or its device swaps."""
    u = part_urls(spark, folder)
    assets = u.select(F.col("p_type").alias("page"), _p().alias("id"), "url", F.array().cast("array<string>").alias("variants"))
    moved = F.concat(F.when((_p() % 5).isin(0, 1), "").otherwise("https://old.shop.example"), "url")
    geo = u.select(
        F.col("p_type").alias("page"), moved.alias("src"), (F.col("p_size") * 30).alias("rw"), _p().alias("rt"), F.col("p_size").alias("rl"))
    return media.merge_geometry(assets, geo, ["page"], ["id"]).select("page", "id", F.col("geo.rt").alias("rt"))


@query("crop_urls", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'https://cdn.shop.example/a.jpg' ELSE '/api/v1/image-crop?url=https%3A%2F%2Fcdn.shop.example%2Fa.jpg&box=' ||
  format('{:.4f},{:.4f},{:.4f},{:.4f}', p_size / 64.0::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, (p_partkey % 8) / 8.0::DOUBLE) END AS url FROM part
""")
def crop_urls(spark, folder):
    """Crop addresses."""
    crop = F.struct(
        (F.col("p_size") / F.lit(64.0)).alias("x"), F.lit(0.25).alias("y"), F.lit(0.5).alias("w"), ((_p() % 8) / F.lit(8.0)).alias("h"),
        F.when(_p() % 5 == 0, "full").otherwise("badge").alias("kind"))
    return table(spark, folder, "part").select("p_partkey", F.lit("https://cdn.shop.example/a.jpg").alias("u"), crop.alias("c")).select(
        "p_partkey", urls.crop_url("u", "c").alias("url"))


# ---------------------------------------------------------------- features and modules


def part_features(spark, folder):
    """Features made of parts: brand is the product, images by size."""
    n = (F.col("p_size") % 5).cast("int")
    img = lambda i: F.concat(F.lit("https://cdn.shop.example/"), _p().cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg"))
    cards = F.when(n == 0, F.array().cast("array<struct<image:string,title:string,body:string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(img(F.when(_p() % 7 == 0, F.lit(1)).otherwise(i)).alias("image"), F.concat(F.lit("Card "), i.cast("string")).alias("title"),
                                                                 F.col("p_type").alias("body"))))
    return table(spark, folder, "part").select(
        "p_brand", _p().alias("feature_no"), F.initcap("p_name").alias("headline"), F.lit("").alias("subheadline"), F.col("p_type").alias("body"),
        F.when(_p() % 9 == 0, "award").otherwise("grid").alias("kind"), n.alias("per_row"), cards.alias("cards"))


def part_modules(spark, folder, mode="standard"):
    f = part_features(spark, folder)
    selection = f.select("p_brand", F.col("feature_no").alias("ord"), "feature_no")
    return channels.build_modules(f, selection, ["p_brand"], mode)


SQL_MODULES = """f AS (SELECT p_brand, p_partkey AS ord, p_size % 5 AS n, p_partkey % 9 = 0 AS award, p_partkey % 7 = 0 AS same, p_name, p_type FROM part),
w AS (SELECT *, CASE WHEN n = 0 THEN 'text' WHEN award THEN CASE WHEN n >= 4 THEN 'four-text' WHEN n = 3 THEN 'three-img' ELSE 'left-img' END WHEN n >= 4 THEN 'four-text' WHEN n = 3 THEN 'three-img' ELSE 'image-header-text' END AS w FROM f),
m AS (SELECT *, CASE WHEN w IN ('three-img', 'four-text') AND same THEN 'image-header-text' ELSE w END AS type, row_number() OVER (PARTITION BY p_brand ORDER BY ord) AS module_id FROM w)"""


@query("part_modules", f"""
WITH {SQL_MODULES}
SELECT p_brand, CAST(module_id AS BIGINT) AS module_id, type, CASE WHEN n > 0 THEN 'https://cdn.shop.example/' || ord || '-1.jpg' END AS image_url,
  CAST(CASE WHEN type = 'three-img' THEN 3 WHEN type = 'four-text' THEN 4 ELSE 0 END AS BIGINT) AS n_slots FROM m
""")
def part_modules_query(spark, folder):
    """Modules in selection order with their slots."""
    m = part_modules(spark, folder)
    return m.select("p_brand", "module_id", "type", "image_url", F.coalesce(F.size("slot_images"), F.lit(0)).cast("bigint").alias("n_slots")).withColumn(
        "n_slots", F.when(F.col("n_slots") < 0, 0).otherwise(F.col("n_slots")))


@query("copy_rows", f"""
WITH {SQL_MODULES},
h AS (SELECT p_brand, module_id, type, n, p_type, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || lower(substring(x, 2))), ' ') AS head FROM m),
r AS (SELECT p_brand, module_id, 0 AS o, 'Headline' AS label, head AS value FROM h
 UNION ALL SELECT p_brand, module_id, 1, 'Body', p_type FROM h WHERE type NOT IN ('three-img', 'four-text')
 UNION ALL SELECT p_brand, module_id, 2 * i, 'Image ' || i || ' title', 'Card ' || i FROM h, range(1, 5) t(i) WHERE type IN ('three-img', 'four-text') AND i <= CASE WHEN type = 'three-img' THEN 3 ELSE 4 END
 UNION ALL SELECT p_brand, module_id, 2 * i + 1, 'Image ' || i || ' body', p_type FROM h, range(1, 5) t(i) WHERE type IN ('three-img', 'four-text') AND i <= CASE WHEN type = 'three-img' THEN 3 ELSE 4 END)
SELECT p_brand, CAST(module_id AS BIGINT) AS module_id, label, value FROM r WHERE value <> ''
""")
def copy_rows(spark, folder):
    """Copy sheet of all modules (K9)."""
    return channels.module_copy(part_modules(spark, folder), ["p_brand"]).select("p_brand", "module_id", "label", "value")


@query("image_jobs", f"""
WITH {SQL_MODULES},
b AS (SELECT * FROM (VALUES ('left-img', 1, 300, 300), ('image-header-text', 1, 970, 600), ('three-img', 1, 300, 300), ('three-img', 2, 300, 300), ('three-img', 3, 300, 300),
  ('four-text', 1, 220, 220), ('four-text', 2, 220, 220), ('four-text', 3, 220, 220), ('four-text', 4, 220, 220)) t(type, slot, w, h))
SELECT p_brand, CAST(module_id AS BIGINT) AS module_id, slot, left(lpad(CAST(module_id AS VARCHAR), 2, '0'), 2) || '-' || type || CASE WHEN type IN ('three-img', 'four-text') THEN '-' || slot ELSE '' END || '-' || b.w || 'x' || b.h || '.jpg' AS name,
  'https://cdn.shop.example/' || ord || '-' || CASE WHEN type IN ('three-img', 'four-text') THEN slot ELSE 1 END || '.jpg' AS url FROM m JOIN b USING (type)
""")
def image_jobs(spark, folder):
    """Image per module box with its file name (K9)."""
    return channels.image_jobs(part_modules(spark, folder), ["p_brand"]).select("p_brand", "module_id", "slot", "name", "url")


@query("spec_rows", """
WITH s AS (SELECT p_type AS page, p_partkey AS ord, p_name AS label, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'G' || (p_partkey // 7 % 5) END AS grp FROM part),
l AS (SELECT *, last_value(grp IGNORE NULLS) OVER (PARTITION BY page ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
SELECT page, ord, label, CASE WHEN grp IS NOT NULL AND (p IS NULL OR p <> grp) THEN grp END AS header FROM l
""")
def spec_rows(spark, folder):
    """Spec rows with a header where the group changes."""
    rows = table(spark, folder, "part").select(
        F.col("p_type").alias("page"), _p().alias("ord"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("G"), (F.floor(_p() / 7) % 5).cast("string"))).alias("grp"))
    return sections.spec_table_rows(rows, ["page"], ["ord"]).select("page", "ord", "label", "header")


@query("list_columns", """
SELECT p_brand, count(*) AS n, CAST(CASE WHEN count(*) <= 4 THEN count(*) WHEN count(*) % 3 = 0 THEN 3 WHEN count(*) % 4 = 0 THEN 4 ELSE 3 END AS BIGINT) AS cols FROM part GROUP BY p_brand
""")
def list_columns(spark, folder):
    """Columns of a list by its length."""
    return table(spark, folder, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "cols", sections.list_columns(F.col("n")).cast("bigint"))


@query("fill_cells", """
WITH c AS (SELECT p_partkey, repeat(p_name || ' ', CASE WHEN p_partkey % 50 = 0 THEN 6000 ELSE 3 END) AS t FROM part),
r AS (SELECT o_orderkey AS "row", o_orderkey % (SELECT count(*) FROM part) AS k, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'failed' ELSE 'queued' END AS status, o_orderpriority AS old FROM orders)
SELECT "row", status, md5(CASE WHEN status = 'ok' AND length(t) <= 32767 THEN t ELSE old END) AS value_md5, CAST(CASE WHEN status = 'ok' AND length(t) <= 32767 THEN length(trim(old)) END AS BIGINT) AS prev_len,
  CASE WHEN status = 'ok' AND length(t) > 32767 THEN 'too long for one cell: ' || length(t) END AS fill_error FROM r JOIN c ON p_partkey = k
""")
def fill_cells(spark, folder):
    """Description cells after a job (K3)."""
    parts = table(spark, folder, "part")
    n = parts.agg(F.count(F.lit(1))).scalar()
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row"), (F.col("o_orderkey") % n).alias("slug"),
        F.when(F.col("o_orderstatus") == "O", "ok").when(F.col("o_orderstatus") == "F", "failed").otherwise("queued").alias("status"),
        F.col("o_orderpriority").alias("old"))
    content = parts.select(_p().alias("slug"), F.expr("repeat(concat(p_name, ' '), CASE WHEN p_partkey % 50 = 0 THEN 6000 ELSE 3 END)").alias("text"))
    out = jobs.fill_descriptions(rows, content)
    return out.select("row", "status", F.md5("value").alias("value_md5"), F.col("prev_len").cast("bigint").alias("prev_len"), "fill_error")


@query("name_tokens_ufn", """
SELECT p_partkey, p_name || ' ' || p_type AS ufn, trim(regexp_replace(lower(p_name || ' – ' || p_type || '™'), '[\\s™®\\-–—:]+', ' ', 'g')) AS usp_key FROM part
""")
def name_tokens_ufn(spark, folder):
    """Product name without its model code, and title keys."""
    name = F.concat("p_name", F.lit(" "), "p_type", F.lit(" | "), _p().cast("string"))
    return table(spark, folder, "part").select(
        "p_partkey", text.ufn(name, _p().cast("string")).alias("ufn"), text.usp_key(F.concat("p_name", F.lit(" – "), "p_type", F.lit("™"))).alias("usp_key"))


@query("channel_guess", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'shopee' WHEN p_partkey % 4 = 1 THEN 'lazada' WHEN p_partkey % 4 = 2 THEN 'shopee' ELSE '' END AS channel FROM part
""")
def channel_guess(spark, folder):
    """Channel from file name and header labels, the first rule winning (F2)."""
    file = F.element_at(F.array(F.lit("Shopee_mass.xlsx"), F.lit("lorikeet.xlsx"), F.lit("x.xlsx"), F.lit("plain.xlsx")), (_p() % 4 + 1).cast("int"))
    labels = F.when(_p() % 4 == 2, "et_title_name SellerSKU").otherwise(F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", rules.channel_guess(file, labels).alias("channel"))


def line_sections(spark, folder):
    """Line items as ordered sections of an order; place numbers made unique."""
    li = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    return renumber(li, ["page_id"], ["line", "l_partkey", "l_suppkey"], "sec_ord")
