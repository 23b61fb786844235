"""Queries over line items as the ordered sections of an order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import channels, extract, model, qa, sections
from ..operators.ordered import cut_after_last, mark_first, renumber
from ..session import IN_PLACE, cut_lineage, settings
from .registry import query, table, wide_table

LINE = ["l_linenumber", "l_partkey", "l_suppkey"]
SQL_LINE = "l_linenumber, l_partkey, l_suppkey"


def lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", *LINE, "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").alias("q"))


@query("section_places", f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linestatus, CAST(row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY {SQL_LINE}) AS BIGINT) AS place FROM lineitem
""")
def section_places(spark, folder):
    """Separate running numbers for both kinds of rows."""
    return renumber(lines(spark, folder), ["l_orderkey", "l_linestatus"], LINE, "place").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linestatus", "place")


@query("section_stats", """
SELECT l_orderkey, count(*) AS sections, count(*) FILTER ((l_returnflag <> 'N' AND l_linestatus = 'O') OR l_quantity > 45) AS renderable,
  count(*) FILTER (l_linestatus <> 'O') AS text_only, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'N') AS image_only FROM lineitem GROUP BY l_orderkey
""")
def section_stats(spark, folder):
    """Section statistics per page."""
    has_text, has_media = F.col("l_returnflag") != "N", F.col("l_linestatus") == "O"
    rows = lines(spark, folder).select(
        "l_orderkey", has_text.alias("has_text"), has_media.alias("has_media"), rules.renderable(has_text, has_media, F.col("q") > 45).alias("renderable"))
    return qa.section_stats(rows, ["l_orderkey"])


@query("layout_histogram", """
WITH h AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag) AS layouts FROM h GROUP BY l_orderkey
""")
def layout_histogram(spark, folder):
    """Histogram per page as a map (A1, A2)."""
    out = qa.histogram(lines(spark, folder), ["l_orderkey"], "l_returnflag", "layouts")
    flat = F.transform(F.map_entries("layouts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.select("l_orderkey", F.array_join(flat, ",").alias("layouts"))


@query("below_fold", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE}) AS rn FROM lineitem),
m AS (SELECT l_orderkey, max(rn) AS last FROM r WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r LEFT JOIN m USING (l_orderkey) WHERE last IS NULL OR rn <= last
""")
def below_fold(spark, folder):
    """Rows up to the last marked one."""
    return cut_after_last(lines(spark, folder), ["l_orderkey"], LINE, F.col("l_returnflag") == "R").select("l_orderkey", *LINE)


@query("hero_first", f"""
WITH r AS (SELECT l_orderkey, {SQL_LINE}, o_orderpriority, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE}) AS rn FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity >= 20)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority FROM r WHERE rn = 1
""")
def hero_first(spark, folder):
    """First row of a page that can be the hero."""
    marked = mark_first(lines(spark, folder), ["l_orderkey"], LINE, F.col("q") >= 20, "kv").where("kv")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return marked.join(orders, "l_orderkey").select("l_orderkey", *LINE, "o_orderpriority")


@query("stack_islands", f"""
WITH d AS (SELECT *, CAST(l_quantity AS INT) AS q, lag(CASE WHEN l_returnflag <> 'A' THEN l_returnflag END) OVER w AS pk, lag(l_linenumber) OVER w AS pd FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {SQL_LINE})),
i AS (SELECT *, sum(CASE WHEN l_returnflag <> 'A' AND l_returnflag = pk AND l_linenumber = pd + 1 AND q % 3 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE} ROWS UNBOUNDED PRECEDING) AS stack FROM d)
SELECT l_orderkey, CAST(stack AS BIGINT) AS stack, count(*) AS n, min(l_linenumber) AS first_line, CAST(sum(q) AS BIGINT) AS q FROM i GROUP BY ALL
""")
def stack_islands(spark, folder):
    """Heroes that continue the one before."""
    key = F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    out = sections.stack_islands(lines(spark, folder), ["l_orderkey"], LINE, key, F.col("l_linenumber"), F.col("q") % 3 != 0)
    return out.groupBy("l_orderkey", "stack").agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("first_line"), F.sum("q").alias("q"))


@query("stitch_orphans", f"""
WITH RECURSIVE r AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE}) AS i, l_linenumber AS d, l_partkey AS p,
    CAST(l_quantity AS INT) % 3 = 0 AS t, CAST(l_quantity AS INT) % 3 = 1 AS g FROM lineitem),
s AS (SELECT *, lead(g) OVER w AS g1, lead(d) OVER w AS d1, lead(p) OVER w AS p1, lead(g, 2) OVER w AS g2, lead(d, 2) OVER w AS d2, lead(p, 2) OVER w AS p2 FROM r WINDOW w AS (PARTITION BY k ORDER BY i)),
walk AS (
  SELECT k, i, p, CASE WHEN t AND g1 AND abs(d1 - d) <= 1 THEN 1 WHEN t AND g2 AND abs(d2 - d) <= 1 THEN 2 ELSE 0 END AS take, false AS u0,
     t AND coalesce(g1 AND abs(d1 - d) <= 1, false) AS u1, t AND NOT coalesce(g1 AND abs(d1 - d) <= 1, false) AND coalesce(g2 AND abs(d2 - d) <= 1, false) AS u2 FROM s WHERE i = 1
  UNION ALL
  SELECT s.k, s.i, s.p, CASE WHEN w.u1 THEN 0 WHEN s.t AND s.g1 AND abs(s.d1 - s.d) <= 1 AND NOT w.u2 THEN 1 WHEN s.t AND s.g2 AND abs(s.d2 - s.d) <= 1 THEN 2 ELSE 0 END,
     w.u1,
     w.u2 OR (s.t AND NOT w.u1 AND coalesce(s.g1 AND abs(s.d1 - s.d) <= 1, false)),
     s.t AND NOT w.u1 AND NOT (coalesce(s.g1 AND abs(s.d1 - s.d) <= 1, false) AND NOT w.u2) AND coalesce(s.g2 AND abs(s.d2 - s.d) <= 1, false)
  FROM walk w JOIN s ON s.k = w.k AND s.i = w.i + 1)
SELECT w.k AS l_orderkey, w.p AS l_partkey, CASE take WHEN 1 THEN s.p1 WHEN 2 THEN s.p2 END AS taken_part FROM walk w JOIN s USING (k, i) WHERE NOT u0
""")
def stitch_orphans(spark, folder):
    """Text-only rows with the picture row they absorb, greedy without contention losses (W7); the SQL walks row by row."""
    q = F.col("q") % 3
    out = sections.pair_orphans(
        lines(spark, folder), ["l_orderkey"], LINE, q == 0, q == 1, F.col("l_linenumber"), F.struct("l_partkey"), reach=1)
    return out.select("l_orderkey", "l_partkey", F.col("taken.l_partkey").alias("taken_part"))


@query("card_rows", f"""
WITH b AS (SELECT l_orderkey AS k, {SQL_LINE}, l_suppkey % 3 AS dom, CAST(l_quantity AS INT) AS q, l_partkey AS p, l_returnflag AS f FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {SQL_LINE}) AS i, q % 5 <> 0 AS ok, q % 4 = 3 AS disc, q % 3 + CASE WHEN q % 7 = 0 THEN 0 ELSE 1 END AS n FROM b),
d AS (SELECT *, CASE WHEN NOT disc THEN dom END AS dm FROM r),
i AS (SELECT *, sum(CASE WHEN dm = pdm THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(dm) OVER (PARTITION BY k ORDER BY i) AS pdm FROM d)),
s AS (SELECT k, run, min(i) AS st FROM i WHERE ok AND dm IS NOT NULL GROUP BY ALL),
g AS (SELECT i.*, st FROM i JOIN s USING (k, run) WHERE i.i >= st),
t AS (SELECT k, run, sum(n) AS nc, first(q % 5 ORDER BY i) AS cc FROM g GROUP BY ALL HAVING sum(n) >= 2),
c AS (SELECT g.k, g.run, nc, cc, p || '-' || j AS card, row_number() OVER (PARTITION BY g.k, g.run ORDER BY g.i, j) AS rn FROM g JOIN t USING (k, run), range(1, 5) x(j) WHERE j <= g.n),
z AS (SELECT *, CASE WHEN cc BETWEEN 2 AND 4 THEN cc ELSE least(nc, 4) END AS cols FROM c)
SELECT k AS l_orderkey, CAST(run AS BIGINT) AS run, CAST((rn - 1) // cols AS BIGINT) AS chunk, CAST(cols AS INT) AS cols, string_agg(card, ',' ORDER BY rn) AS cards FROM z GROUP BY ALL
""")
def card_rows(spark, folder):
    """Neighbouring sections of one component as card rows, chunked by declared columns."""
    q = F.col("q")
    n = (q % 3 + F.when(q % 7 == 0, 0).otherwise(1)).cast("int")
    none = F.array().cast("array<struct<img:string,text:string>>")
    cards = F.when(n == 0, none).otherwise(F.transform(F.sequence(F.lit(1), n), lambda j: F.struct(
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), j.cast("string")).alias("img"), F.lit("x").alias("text"))))
    df = lines(spark, folder).select(
        "l_orderkey", *LINE, (F.col("l_suppkey") % 3).cast("int").alias("dom_index"), (q % 5 != 0).alias("card_like"), (q % 4 == 3).alias("disclaimer"),
        (q % 5).cast("int").alias("column_count"), F.lit("").alias("text"), F.lit("").alias("group_heading"), cards.alias("cards"))
    rows, _ = sections.card_rows(df, ["l_orderkey"], LINE)
    return rows.select("l_orderkey", "run", "chunk", "cols", F.array_join(F.transform("cards", lambda c: c["img"]), ",").alias("cards"))


@query("award_runs", f"""
WITH b AS (SELECT l_orderkey, {SQL_LINE}, CASE WHEN CAST(l_quantity AS INT) % 4 <> 0 THEN l_returnflag END AS k, CAST(l_quantity AS INT) % 9 = 0 AS a FROM lineitem),
i AS (SELECT *, sum(CASE WHEN k = pk THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(k) OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE}) AS pk FROM b)),
w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, run) AS n, bool_or(a) OVER (PARTITION BY l_orderkey, run) AS anya FROM i)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a OR (n >= 2 AND anya AND k IS NOT NULL) AS award FROM w
""")
def award_runs(spark, folder):
    """One award spreads over a run of logo sections."""
    q = F.col("q")
    out = sections.spread_awards(lines(spark, folder), ["l_orderkey"], LINE, q % 4 != 0, F.col("l_returnflag"), q % 9 == 0)
    return out.select("l_orderkey", *LINE, "award")


@query("same_component", f"""
WITH b AS (SELECT l_orderkey, {SQL_LINE}, CASE WHEN CAST(l_quantity AS INT) % 5 <> 0 THEN l_suppkey % 3 END AS dm, l_partkey AS p FROM lineitem),
i AS (SELECT *, sum(CASE WHEN dm = pd THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE} ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(dm) OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE}) AS pd FROM b))
SELECT l_orderkey, CAST(island AS BIGINT) AS island, string_agg('P' || p || '.', chr(10) ORDER BY {SQL_LINE}) FILTER (rn = 1) AS text, CAST(count(DISTINCT p % 50) AS BIGINT) AS n_media
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, island, p ORDER BY {SQL_LINE}) AS rn FROM i) GROUP BY l_orderkey, island
""")
def same_component(spark, folder):
    """Neighbouring rows of one component merged, texts appended unless contained, media united."""
    q = F.col("q")
    df = lines(spark, folder).select(
        "l_orderkey", *LINE, F.when(q % 5 != 0, F.col("l_suppkey") % 3).otherwise(-1).cast("int").alias("dom_index"), F.lit("unknown").alias("layout_type"),
        F.lit("content").alias("kind"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit(".")).alias("text"),
        F.array((F.col("l_partkey") % 50).cast("string")).alias("media_urls"))
    out = sections.merge_same_component(df, ["l_orderkey"], LINE)
    return out.select("l_orderkey", "island", "text", F.size("media_urls").cast("bigint").alias("n_media"))


@query("signature_sections", f"""
WITH s AS (SELECT l_orderkey, {SQL_LINE}, '/x/' || (l_partkey % 4) || '.jpg' AS img, lower(trim(l_returnflag || ' ' || l_linestatus)) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, img, t ORDER BY {SQL_LINE}) = 1
""")
def signature_sections(spark, folder):
    """Sections with the same pictures and words kept once per page."""
    imgs = F.array(F.concat(F.lit("https://cdn.example/x/"), (F.col("l_partkey") % 4).cast("string"), F.lit(".jpg?w=1")))
    sig = sections.section_signature(imgs, F.concat("l_returnflag", F.lit("  "), "l_linestatus"), F.array().cast("array<string>"))
    return sections.drop_repeated_sections(lines(spark, folder), ["l_orderkey"], LINE, sig).select("l_orderkey", *LINE)


@query("feature_groups", f"""
WITH b AS (SELECT l_orderkey AS k, {SQL_LINE}, l_suppkey % 3 AS dom, CAST(l_quantity AS INT) AS q, l_partkey AS p FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {SQL_LINE}) AS i, dom = 1 AS ish, CASE WHEN dom = 2 THEN 2 ELSE 0 END AS cc, CASE WHEN q % 4 = 0 THEN 0 ELSE 1 + q % 2 END AS n, q % 11 = 5 AND q % 4 <> 0 AS aw FROM b),
i AS (SELECT *, sum(CASE WHEN dom = pd THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(dom) OVER (PARTITION BY k ORDER BY i) AS pd FROM r)),
f AS (SELECT k, run, min(i) AS st FROM i WHERE NOT aw GROUP BY ALL),
t AS (SELECT i.*, st, coalesce(i.i >= st, false) AS body FROM i LEFT JOIN f USING (k, run)),
g AS (SELECT k, run, sum(n) AS cards FROM t WHERE body GROUP BY ALL),
m AS (SELECT t.*, CASE WHEN body AND ish AND cards >= 2 THEN 'grid' WHEN aw THEN 'award' WHEN cc >= 2 THEN 'columns' ELSE 'single' END AS kind FROM t LEFT JOIN g USING (k, run)),
e AS (SELECT *, lag(kind) OVER (PARTITION BY k ORDER BY i) AS pk, lag(run) OVER (PARTITION BY k ORDER BY i) AS pr FROM m),
x AS (SELECT *, sum(CASE WHEN kind = pk AND run = pr AND (kind IN ('grid', 'award') OR (kind = 'columns' AND n > 0)) THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) AS ft FROM e),
y AS (SELECT *, sum(n) OVER (PARTITION BY k, ft) AS im, min(i) OVER (PARTITION BY k, ft) AS st2 FROM x),
z AS (SELECT *, CASE WHEN kind = 'columns' AND im < 2 THEN 'single' ELSE kind END AS kd FROM y),
c AS (SELECT k, kd, CASE WHEN kd = 'single' THEN i ELSE st2 END AS pt, im, cc, p || '-' || j AS card, i, j FROM z, range(1, 3) v(j) WHERE j <= n),
n AS (SELECT *, row_number() OVER (PARTITION BY k, pt ORDER BY i, j) AS rn, CASE WHEN kd IN ('grid', 'columns') THEN CASE WHEN cc >= 2 THEN cc ELSE least(im, 4) END WHEN kd = 'award' THEN least(im, 4) ELSE 1 END AS per FROM c)
SELECT k AS l_orderkey, CAST(pt AS BIGINT) AS "at", kd AS kind, CAST(CASE WHEN kd IN ('grid', 'columns') THEN (rn - 1) // per ELSE 0 END AS INT) AS chunk, CAST(per AS INT) AS per_row, string_agg(card, ',' ORDER BY rn) AS cards FROM n GROUP BY ALL
""")
def feature_groups(spark, folder):
    """Features: award runs, card grids, column groups, single sections."""
    q, dom = F.col("q"), F.col("l_suppkey") % 3
    n = F.when(q % 4 == 0, 0).otherwise(q % 2 + 1).cast("int")
    imgs = F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), n), lambda j: F.concat(F.col("l_partkey").cast("string"), F.lit("-"), j.cast("string"))))
    base = renumber(lines(spark, folder), ["l_orderkey"], LINE, "i")
    df = base.select(
        "l_orderkey", "i", dom.cast("int").alias("dom_index"), ((q % 11 == 5) & (q % 4 != 0)).alias("award"), (dom == 1).alias("card_like"),
        F.when(dom == 2, 2).otherwise(0).alias("column_count"), F.lit(None).cast("string").alias("row_group"), F.lit(0).alias("row_columns"),
        F.lit("*note").alias("headline"), F.lit("").alias("eyebrow"), F.lit("").alias("body"), F.lit(False).alias("is_head"), imgs.alias("images"))
    out = channels.to_features(df, ["l_orderkey"], ["i"])
    return out.select("l_orderkey", F.col("at.i").alias("at"), "kind", "chunk", "per_row", F.array_join(
        F.transform("cards", lambda c: c["image"]), ",").alias("cards"))


@query("content_checks", """
WITH s AS (SELECT l_orderkey, count(*) AS sections, count(*) FILTER (l_quantity > 10 AND l_returnflag <> 'N') AS full_sections FROM lineitem GROUP BY ALL),
m AS (SELECT l_orderkey, count(*) FILTER (l_linenumber <> 3) AS images, count(*) FILTER (l_linenumber = 3) AS miss FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS page_id, coalesce(sections, 0) AS sections, coalesce(full_sections, 0) AS full_sections, coalesce(images, 0) AS images, coalesce(miss, 0) AS images_missing_url,
 array_to_string(list_filter([CASE WHEN o_orderpriority = '5-LOW' THEN 'no_title' END, CASE WHEN o_orderkey % 9 = 0 THEN 'no_gallery' END, CASE WHEN coalesce(full_sections, 0) < 3 THEN 'few_full_sections' END, CASE WHEN coalesce(miss, 0) > 0 THEN 'images_without_url' END], lambda x: x IS NOT NULL), ',') AS issues
FROM orders LEFT JOIN s ON s.l_orderkey = o_orderkey LEFT JOIN m ON m.l_orderkey = o_orderkey
""")
def content_checks(spark, folder):
    """Checks and issues per product (A3)."""
    li = lines(spark, folder)
    sec = li.select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_returnflag") != "N", "x").otherwise("").alias("text"), (F.col("l_quantity") > 10).cast("int").alias("n_media"))
    med = li.select(F.col("l_orderkey").alias("page_id"), F.when(F.col("l_linenumber") == 3, "").otherwise("u").alias("url"))
    products = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("t").alias("title"),
        (F.col("o_orderkey") % 9).alias("gallery_images"))
    return qa.content_checks(sec, med, products).select(
        "page_id", "sections", "full_sections", "images", "images_missing_url", F.array_join("issues", ",").alias("issues"))


@query("component_choice", """
WITH c AS (SELECT l_orderkey AS page_id, l_partkey AS p, l_returnflag <> 'N' AS r FROM lineitem), m AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey ELSE -o_orderkey END AS page_id, o_custkey AS p FROM orders),
g AS (SELECT page_id FROM c GROUP BY ALL HAVING count(*) FILTER (r) >= 3)
SELECT page_id, p, 'component' AS src FROM c WHERE page_id IN (SELECT page_id FROM g) OR page_id NOT IN (SELECT page_id FROM m)
UNION ALL SELECT page_id, p, 'model' FROM m WHERE page_id NOT IN (SELECT page_id FROM g)
""")
def component_choice(spark, folder):
    """Model sections for pages with too few renderable ones."""
    c = lines(spark, folder).select(
        F.col("l_orderkey").alias("page_id"), F.col("l_partkey").alias("p"), (F.col("l_returnflag") != "N").alias("renderable"), F.lit("component").alias("src"))
    m = table(spark, folder, "orders").select(  # models of other pages have numbers of their own
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("page_id"), F.col("o_custkey").alias("p"), F.lit(True).alias("renderable"), F.lit("model").alias("src"))
    return sections.choose_sections(c, m).select("page_id", "p", "src")


@query("rebuild_report", """
WITH o AS (SELECT l_orderkey AS page_id, count(*) AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL),
n AS (SELECT l_orderkey AS page_id, count(*) AS a, count(*) FILTER (l_returnflag <> 'N') AS r FROM lineitem GROUP BY ALL)
SELECT page_id, coalesce(b, 0) AS before, CASE WHEN coalesce(r, 0) >= 3 THEN a ELSE coalesce(b, 0) END AS after, CASE WHEN coalesce(r, 0) >= 3 THEN 'rebuild' ELSE 'filter' END AS mode
FROM o FULL OUTER JOIN n USING (page_id) WHERE coalesce(r, 0) >= 3 OR b IS NOT NULL
""")
def rebuild_report(spark, folder):
    """Corpus re-derivation with its quality gate and before/after counts."""
    from ..operators import store

    li = lines(spark, folder).select(F.col("l_orderkey").alias("page_id"), "l_partkey", "l_linestatus", (F.col("l_returnflag") != "N").alias("renderable"))
    _, report = store.rebuild(li, li.where("l_linestatus = 'O'"))
    return report.select("page_id", "before", "after", "mode")


@query("page_sections")
def page_sections(spark, folder):
    """Sections assembled from the raw pages (H1-H9, W4-W8, F4, F9): block elements take the part of components.

    These pages carry no component classes, so their block tags are given some, as a crawl of a component site has them.
    """
    nodes = tag_components(extract.nodes(wide_table(spark, folder, "pages", "page_id", "html")))
    secs, _cards = assemble(nodes)
    return secs.select(
        "page_id", "order_n", "dom_index", "component_id", "layout_type", "columns", F.size("media").alias("n_media"), F.length("text").alias("n_chars"))


def tag_components(nodes):
    """Component classes for plain pages: the article is a title block, list items are cards, the footer is legal text."""
    cls = (
        F.when(F.col("tag") == "article", "c-wrapper ST0003").when(F.col("tag") == "ul", "c-wrapper ST0014 column-4")
        .when(F.col("tag") == "footer", "c-wrapper ST0044").when(F.col("tag") == "h1", "c-text-contents__headline")
        .when(F.col("tag").isin("p", "li"), "c-text-contents__bodycopy")
    )
    return nodes.withColumn("attrs", F.when(cls.isNotNull(), F.map_concat(
        F.map_filter("attrs", lambda k, v: k != "class"), F.create_map(F.lit("class"), cls))).otherwise(F.col("attrs")))


#: Every step of a page stays in the page's task: what is dealt out by page meets by page and more without another shuffle.
BY_PAGE = IN_PLACE | {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def assemble(nodes, origin="https://www.shop.example", gen2=False):
    """Element table to product sections: the whole chain, each table materialised once and read many times.

    The elements are dealt out by page once. Plans then have no shuffle, so adaptive execution, which would plan them again after each, is off.
    """
    spark = nodes.sparkSession
    n = max(nodes.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    with settings(spark, BY_PAGE):
        done = _chain(cut_lineage(extract.component_nodes(nodes).repartition(n, "page_id")), origin, gen2)
    shown = done.withColumn("renderable", F.col("renderable") | sections.has_words())
    return sections.serialise(shown, gen2)


def _chain(nodes, origin, gen2):
    comps = cut_lineage(extract.wrappers(nodes))
    parts = extract.component_table(nodes, comps)
    specs = cut_lineage(extract.specs(nodes, comps))
    boxes = cut_lineage(extract.item_boxes(nodes, comps))
    compares = cut_lineage(extract.compares(nodes, comps))
    as_items = nodes.join(boxes.select("page_id", F.col("item").alias("node"), F.col("dom_index").alias("owner")), ["page_id", "node"])
    scope = as_items.withColumn("component_id", F.lit("")).withColumn("dom_index", F.col("node"))
    used = specs.select("page_id", F.explode(F.array("label_node", "value_node")).alias("node"))
    owner = boxes.select("page_id", "item", F.col("dom_index").alias("owner"))
    rename = lambda df: df.withColumnRenamed("dom_index", "item").join(owner, ["page_id", "item"]).withColumnRenamed("owner", "dom_index")
    item_texts = rename(extract.component_texts(nodes, scope, gen2, consumed=used))
    item_media = rename(extract.component_media(nodes, scope))
    in_items = extract.inside(nodes, as_items, []).select("page_id", "node").distinct()
    texts = extract.component_texts(nodes, comps, gen2, consumed=used.unionByName(in_items))
    media = extract.component_media(nodes, comps)
    made, _gallery = sections.assemble_sections(
        cut_lineage(parts), cut_lineage(texts), cut_lineage(media), specs, cut_lineage(item_texts), cut_lineage(item_media), boxes, compares, origin)
    merged = cut_lineage(sections.merge_stacked_heroes(made))
    return cut_lineage(sections.keep_image_only(sections.stitch_orphans(merged)))


SQL_CLEAN = r"""trim(regexp_replace(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)),
    lambda x: trim(regexp_replace(x, '[ \t\r]+', ' ', 'g'))), chr(10)), '\n{2,}', chr(10), 'g'), chr(10))"""
SQL_MODEL_PAGE = "conv_id || '-' || CAST(coalesce(turn, -1) // 16 AS BIGINT)"


def _model_turns(spark, folder):
    """Turns of a conversation, sixteen turn numbers a page, numbered in order."""
    page = F.concat_ws("-", F.col("conv_id").cast("string"), F.floor(F.coalesce("turn", F.lit(-1)) / 16).cast("string"))
    turns = table(spark, folder, "conversations").select(page.alias("page_id"), "turn", "role", "text")
    return turns.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("turn", "role", "text")))


def _model_trees(rows, part):
    """One model per page; the names of its components sort against their order."""
    name = F.concat(F.lit("c"), F.lpad((F.lit(999_999_999) - F.col("rn")).cast("string"), 9, "0"))
    trees = rows.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("rn", name.alias("name"), part.alias("json")))).alias("c"))
    root = F.concat(
        F.lit('{":itemsOrder":["'), F.array_join("c.name", '","'), F.lit('"],":items":{'),
        F.array_join(F.transform("c", lambda c: F.concat(F.lit('"'), c["name"], F.lit('":'), c["json"])), ","), F.lit("}}"))
    return trees.select("page_id", F.parse_json(root).alias("model"))


def _quoted(text):
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t"))), r'^\{"t":(.*)\}$', 1)


@query("model_sections", f"""
WITH r AS (SELECT {SQL_MODEL_PAGE} AS page_id, {SQL_CLEAN} AS t,
                  row_number() OVER (PARTITION BY {SQL_MODEL_PAGE} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rn FROM conversations),
c AS (SELECT *, 'https://www.shop.example/content/dam/p' || page_id || '-' || rn AS file,
             row_number() OVER (PARTITION BY page_id ORDER BY rn) - 1 AS dom FROM r WHERE rn % 5 <> 4),
s AS (
  SELECT page_id, rn, dom, 0 AS item, 'AEM:heroimage' AS component_id, rtrim('## Turn ' || rn || chr(10) || t, chr(10)) AS text,
         'image ' || file || '-desktop.jpg ' || file || '-mobile.jpg' AS media, 'hero_full_width' AS layout_type, 1 AS columns, '' AS group_heading
  FROM c WHERE rn % 5 = 0
  UNION ALL SELECT page_id, rn, dom, 0, 'AEM:keybenefits', '## Points ' || rn, '', 'text_block', 1, '' FROM c WHERE rn % 5 = 1
  UNION ALL SELECT page_id, rn, dom, 1, 'AEM:keybenefits', '## First' || CASE WHEN length(t) > 1 THEN chr(10) || t ELSE '' END,
                   'image ' || file || '-a.png ', 'grid_3_column', 3, 'Points ' || rn FROM c WHERE rn % 5 = 1
  UNION ALL SELECT page_id, rn, dom, 2, 'AEM:keybenefits', t, '', 'grid_3_column', 3, 'Points ' || rn FROM c WHERE rn % 5 = 1 AND length(t) > 1
  UNION ALL SELECT page_id, rn, dom, 0, 'AEM:textblock', t, '', 'text_block', 1, '' FROM c WHERE rn % 5 = 2 AND t <> ''
  UNION ALL SELECT page_id, rn, dom, 0, 'AEM:sideimage', 'Above' || CASE WHEN length(t) > 1 THEN chr(10) || t ELSE '' END,
                   'image ' || file || '-m.webp ' || file || '-m.webp|video ' || file || '.mp4 ', 'image_text_right', 1, '' FROM c WHERE rn % 5 = 3)
SELECT page_id, CASE WHEN component_id = 'AEM:textblock' THEN 'disclaimer-' ELSE '' END || row_number() OVER (PARTITION BY page_id ORDER BY rn, item) AS "order",
       component_id, dom, item > 0 AS item_group, group_heading, text, media, layout_type, columns FROM s
""")
def model_sections(spark, folder):
    """Sections of page models that hold the turns of a conversation, each below 2 to 9 containers: heroes, lists, notes, pictures, and questions that go."""
    rows = _model_turns(spark, folder)
    no, said = F.col("rn").cast("string"), _quoted("text")
    file = F.concat(F.lit("/content/dam/p"), "page_id", F.lit("-"), no)
    part = F.element_at(F.array(
        F.concat(F.lit('{":type":"x/heroimage",":itemsOrder":["t","b"],":items":{"b":{":type":"x/text","text":'), said, F.lit('},"t":{":type":"x/title","text":"Turn '), no,
                 F.lit('"}},"mediaDescriptionModel":{"imageRef":"'), file, F.lit('-desktop.jpg","imageRefMobile":"'), file, F.lit('-mobile.jpg","iconImageRef":"'), file,
                 F.lit('-x.png","offIconImageRef":"/content/dam/y.png"}}')),
        F.concat(F.lit('{":type":"x/keybenefits",":itemsOrder":["h"],":items":{"h":{":type":"x/title","text":"Points '), no,
                 F.lit('"}},"title":"not read","keyBenefitsSummaryItems":[{"title":"First","description":'), said, F.lit(',"imageRef":"'), file,
                 F.lit('-a.png"},{"bodyCopy":'), said, F.lit('},{"text":"not a text key"}]}')),
        F.concat(F.lit('{":type":"x/textblock","blockType":"disclaimer",":itemsOrder":["t"],":items":{"t":{":type":"x/text","text":'), said, F.lit("}}}")),
        F.concat(F.lit('{":type":"x/sideimage","eyebrow":"Above","subTitle":'), said, F.lit(',"mobileImageAddr":"'), file, F.lit('-m.webp","animationRef":"'), file,
                 F.lit('.mp4","dataLayer":{"imageRef":"/content/dam/z.png"}}')),
        F.concat(F.lit('{":type":"x/faq","title":'), said, F.lit("}")),
    ), (F.col("rn") % 5 + 1).cast("int"))
    depth = (F.col("rn") % 8 + 1).cast("int")
    nested = F.concat(F.repeat(F.lit('{":type":"x/container",":itemsOrder":["a"],":items":{"a":'), depth), part, F.repeat(F.lit("}}"), depth))
    sections = model.model_sections(_model_trees(rows, nested), "https://www.shop.example")
    return sections.withColumn("media", F.array_join(F.transform("media", lambda m: F.concat_ws(" ", m["kind"], m["pc_url"], m["mobile_url"])), "|"))


@query("overview_sections", f"""
WITH r AS (SELECT {SQL_MODEL_PAGE} AS page_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS t,
                  row_number() OVER (PARTITION BY {SQL_MODEL_PAGE} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rn FROM conversations),
f AS (SELECT *, 'https://www.shop.example/p' || page_id || '-' || rn AS file, 4999 + rn AS dom FROM r)
SELECT page_id, dom, 0 AS slide, 'AEM_HEROIMAGE' AS component_id, rtrim('Above' || chr(10) || '## “Ünit” ' || rn || chr(10) || t, chr(10)) AS text,
       'image ' || file || '.jpg ' || file || '-m.jpg ' AS media, 'hero_full_width' AS layout_type, false AS item_group, 1 AS column_count, 'right bottom' AS overlay
FROM f WHERE rn % 4 = 0
UNION ALL SELECT page_id, dom, 0, 'AEM_CAROUSEL', t, 'image ' || file || '-v.jpg  v' || rn, 'grid_2_column', true, 2, '' FROM f WHERE rn % 4 = 1
UNION ALL SELECT page_id, dom, 2, 'AEM_CAROUSEL', 'Last', '', 'grid_2_column', true, 2, '' FROM f WHERE rn % 4 = 1
UNION ALL SELECT page_id, dom, 0, 'AEM_IMAGETEXTFOLDINGFEATURE', t, 'image ' || file || '-1.jpg  |video ' || file || '.mp4  ', 'image_text_right', false, 1, '' FROM f WHERE rn % 4 = 2
""")
def overview_sections(spark, folder):
    """Sections of plain page models that hold the turns of a conversation: heroes with overlays, slides, folding features; fragments go."""
    rows = _model_turns(spark, folder)
    no, said, file = F.col("rn").cast("string"), _quoted("text"), F.concat(F.lit("/p"), "page_id", F.lit("-"), F.col("rn").cast("string"))
    part = F.element_at(F.array(
        F.concat(F.lit('{":type":"x/heroimage","textBlockHorizontalAlign":"main-pos-right","textBlockVerticalMobileAlign":"bottom",":itemsOrder":["a","headline","eyebrow","disclaimer1"],'
                       '":items":{"a":{"text":'), said, F.lit('},"headline":{"text":"<b>&ldquo;&#220;nit&#x201d;</b> '), no,
                 F.lit('"},"eyebrow":{"text":"Above"},"disclaimer1":{"text":"no"}},"mediaDescriptionModel":{"imageRef":"'), file, F.lit('.jpg","imageRefMobile":"'), file,
                 F.lit('-m.jpg"},"mediaDescriptionList":[{"imageRef":"/not-read.jpg"}]}')),
        F.concat(F.lit('{":type":"x/carousel",":itemsOrder":["s","e","l"],":items":{"l":{":items":{"t":{"text":"Last"}}},"e":{},"s":{":items":{"t":{"text":'), said,
                 F.lit('}},"mediaDescriptionList":[{"mediaTypeItems":"Video","videoThumbnailImageRef":"'), file, F.lit('-v.jpg","videoID":"v'), no,
                 F.lit('"},{"imageRef":"/second.jpg"}]}}}')),
        F.concat(F.lit('{":type":"x/imagetextfoldingfeature",":items":{"t":{"text":'), said, F.lit('}},"mediaDescriptionList":[{"imageRef":"'), file,
                 F.lit('-1.jpg"},{"mediaTypeItems":"video","videoThumbnailImageRef":"/sample/x.jpg"},{"mediaTypeItems":"animation","animationRef":"'), file, F.lit('.mp4"}]}')),
        F.concat(F.lit('{":type":"x/experiencefragment",":items":{"t":{"text":'), said, F.lit("}}}")),
    ), (F.col("rn") % 4 + 1).cast("int"))
    sections = model.overview_sections(_model_trees(rows, part), "https://www.shop.example")
    return sections.withColumns({
        "media": F.array_join(F.transform("media", lambda m: F.concat_ws(" ", m["kind"], m["pc_url"], m["mobile_url"], m["video_id"])), "|"),
        "overlay": F.coalesce(F.concat_ws(" ", "overlay.pc", "overlay.mobile"), F.lit(""))})


@query("section_moves", f"""
WITH s AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_LINE}) AS sec_ord, l_returnflag = 'R' AS disclaimer FROM lineitem),
w AS (SELECT page_id, list(CASE WHEN page_id % 3 = 0 AND sec_ord = 2 THEN 1 WHEN page_id % 7 = 0 AND sec_ord = 3 THEN 999 ELSE sec_ord END ORDER BY sec_ord DESC) AS asked,
             list(sec_ord ORDER BY sec_ord) AS own FROM s WHERE NOT disclaimer AND NOT (page_id % 5 = 0 AND sec_ord = 4) GROUP BY page_id),
p AS (SELECT page_id, list(sec_ord ORDER BY sec_ord) AS own FROM s WHERE NOT disclaimer GROUP BY page_id),
o AS (SELECT s.*, max(CASE WHEN NOT disclaimer THEN sec_ord END) OVER (PARTITION BY page_id ORDER BY sec_ord) AS owner FROM s)
SELECT o.page_id, sec_ord, disclaimer, CAST(row_number() OVER (PARTITION BY o.page_id ORDER BY
         CASE WHEN owner IS NULL THEN 0 WHEN list_sort(asked) = p.own THEN list_position(asked, owner) ELSE owner END, sec_ord) AS INT) AS place
FROM o LEFT JOIN w USING (page_id) LEFT JOIN p USING (page_id)
""")
def section_moves(spark, folder):
    """Line items as sections, asked for in reverse; some orders name a section twice, one that is none, or leave one out."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE))
    rows = lines(spark, folder).select(F.col("l_orderkey").alias("page_id"), number.alias("sec_ord"), (F.col("l_returnflag") == "R").alias("disclaimer"))
    page, at = F.col("page_id"), F.col("sec_ord")
    asked = F.when((page % 3 == 0) & (at == 2), 1).when((page % 7 == 0) & (at == 3), 999).otherwise(at)
    wanted = rows.where(~F.col("disclaimer") & ~((page % 5 == 0) & (at == 4))).select("page_id", (-at).alias("place"), asked.alias("sec_ord"))
    return sections.reorder_sections(rows, wanted)
