"""Queries over documents, benchmark texts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import channels, extract, markdown, media, qa, sections
from ..operators.ordered import Total, drop_repeats, scan
from .registry import query, table, wide_table


def q(pattern: str) -> str:
    """Regex as a SQL string literal body."""
    return pattern.replace("'", "''")


NO_MARKS = "[™®©*​ ]"
SQL_NORM = "lower(regexp_replace(regexp_replace({0}, '" + NO_MARKS + "', '', 'g'), '\\s+', '', 'g'))"


def marked_lines(folder_df):
    """Documents as markdown-like product texts: each line gets a mark by its place, as crawled pages mix them."""
    lines = F.transform(F.split("text", "\n"), lambda ln, i: F.when(i % 9 == 0, F.concat(F.lit("## "), ln))
                        .when(i % 9 == 1, F.concat(F.lit("* "), ln)).when(i % 9 == 2, F.concat(F.lit("**"), ln))
                        .when(i % 9 == 3, F.concat(F.lit("| "), ln, F.lit(" |")))
                        .when(i % 9 == 4, F.concat(F.lit("The image shows a person on a sofa, "), ln)).when(i % 9 == 5, F.lit("Learn more"))
                        .when(i % 9 == 6, F.concat(ln, F.lit("a7)"))).when(i % 9 == 7, F.concat(F.lit("1) "), ln)).otherwise(ln))
    return folder_df.withColumn("md", F.array_join(lines, "\n"))


SQL_MARKED = """m AS (SELECT doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda ln, i: CASE (i - 1) % 9
  WHEN 0 THEN '## ' || ln WHEN 1 THEN '* ' || ln WHEN 2 THEN '**' || ln WHEN 3 THEN '| ' || ln || ' |'
  WHEN 4 THEN 'The image shows a person on a sofa, ' || ln WHEN 5 THEN 'Learn more' WHEN 6 THEN ln || 'a7)' WHEN 7 THEN '1) ' || ln ELSE ln END), chr(10)) AS md
  FROM documents)"""
SQL_TRIM_WS = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


@query("doc_lines_clean", f"""
WITH {SQL_MARKED},
l AS (SELECT doc_id, list_transform(string_split(md, chr(10)), lambda ln: {{'ln': ln, 's': {SQL_TRIM_WS.format('ln')}}}) AS ls FROM m),
c AS (SELECT doc_id, list_transform(ls, lambda x: CASE
  WHEN x.s = '' THEN ''
  WHEN regexp_matches(x.s, '^\\|?[\\s:|-]*\\|?$') THEN NULL
  WHEN regexp_matches(x.s, '^\\|(.+)\\|$') THEN CASE WHEN regexp_matches(trim(replace(regexp_extract(x.s, '^\\|(.+)\\|$', 1), '|', ' ')), '^[\\s:-]*$') THEN NULL
       ELSE trim(replace(regexp_extract(x.s, '^\\|(.+)\\|$', 1), '|', ' ')) END
  WHEN length(x.s) >= 40 AND regexp_matches(x.s, '{q(text.READER_START)}') AND regexp_matches(x.s, '{q(text.READER_VERB)}') THEN NULL
  WHEN regexp_matches(x.s, '{q(text.CTA_LINE)}') THEN NULL
  ELSE nullif(regexp_replace(regexp_replace(CASE WHEN len(regexp_extract_all(x.ln, '\\*\\*')) % 2 = 1 THEN replace(x.ln, '**', '') ELSE x.ln END,
       '([A-Za-z가-힣.,])\\d{{1,2}}\\)', '\\1', 'g'), '\\s+$', ''), '') END) AS cs FROM l)
SELECT doc_id, md5({SQL_TRIM_WS.format("regexp_replace(array_to_string(list_filter(cs, lambda x: x IS NOT NULL), chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g')")}) AS clean_md5,
       CAST(len(list_filter(cs, lambda x: x IS NULL)) AS BIGINT) AS dropped
FROM c
""")
def doc_lines_clean(spark, folder):
    """Section text clean-up per line (T4)."""
    docs = marked_lines(wide_table(spark, folder, "documents", "doc_id", "text"))
    kept = F.transform(text.lines_of("md"), text.clean_one_line)
    return docs.select(
        "doc_id", F.md5(text.clean_text_lines("md")).alias("clean_md5"),
        F.size(F.filter(kept, lambda c: c.isNull())).cast("bigint").alias("dropped"),
    )


@query("doc_clean_lines", f"""
WITH {SQL_MARKED},
l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS ln, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS pos FROM m),
c AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(trim(ln), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '^#{{1,6}}\\s*', ''), '^[-*+]\\s+', '') AS t FROM l),
d AS (SELECT doc_id, pos, trim(CASE WHEN starts_with(t, '**') AND ends_with(t, '**') AND length(t) > 4 THEN substring(t, 3, length(t) - 4) ELSE t END) AS clean FROM c)
SELECT doc_id, CAST(count(*) FILTER (clean <> '') AS BIGINT) AS n_lines, CAST(sum(length(clean)) AS BIGINT) AS n_chars,
       CAST(count(DISTINCT clean) FILTER (clean <> '') AS BIGINT) AS n_distinct FROM d GROUP BY doc_id
""")
def doc_clean_lines(spark, folder):
    """Markdown residue stripped per line."""
    docs = marked_lines(wide_table(spark, folder, "documents", "doc_id", "text"))
    clean = docs.select("doc_id", F.transform(text.lines_of("md"), text.clean_line).alias("c"))
    full = F.filter("c", lambda x: x != "")
    return clean.select(
        "doc_id", F.size(full).cast("bigint").alias("n_lines"),
        F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_chars"),
        F.size(F.array_distinct(full)).cast("bigint").alias("n_distinct"),
    )


SQL_DESCRIBES = (
    "(length({t}) >= 40 AND (regexp_matches({t}, '" + q(text.SCENE_STRONG) + "') OR regexp_matches({t}, '" + q(text.SCENE_NARRATIVE)
    + "') OR (regexp_matches({t}, '" + q(text.SCENE_START) + "') AND len(regexp_extract_all({t}, '" + q(text.SCENE_WORDS) + "')) >= 2)))"
)


@query("doc_descriptions", f"""
WITH {SQL_MARKED},
l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS ln FROM m),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(ln), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '^#{{1,6}}\\s*', ''), '^[-*+]\\s+', '') AS t FROM l),
d AS (SELECT doc_id, trim(regexp_replace(trim(CASE WHEN starts_with(t, '**') AND ends_with(t, '**') AND length(t) > 4 THEN substring(t, 3, length(t) - 4) ELSE t END), '\\.+$', '')) AS t FROM c)
SELECT doc_id, CAST(count(*) FILTER ({SQL_DESCRIBES.format(t='t')}) AS BIGINT) AS n_descriptions, count(*) AS n_lines FROM d GROUP BY doc_id
""")
def doc_descriptions(spark, folder):
    """Scene descriptions among the lines of each text."""
    docs = marked_lines(wide_table(spark, folder, "documents", "doc_id", "text"))
    lines = docs.select("doc_id", F.explode(text.lines_of("md")).alias("ln"))
    return lines.groupBy("doc_id").agg(
        F.count_if(text.is_image_description("ln")).alias("n_descriptions"), F.count(F.lit(1)).alias("n_lines"))


@query("doc_line_dedupe", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT doc_id, pos, {SQL_NORM.format('ln')} AS key FROM l),
g AS (SELECT key, count(*) AS n, min({{'d': doc_id, 'p': pos}}) AS f FROM k WHERE length(key) >= 4 GROUP BY key)
SELECT key, n, f.d AS first_doc, CAST(f.p AS INTEGER) AS first_line FROM g WHERE n > 1
""")
def doc_line_dedupe(spark, folder):
    """Lines that repeat across the corpus, with their first place (W1, T5), pre-aggregated per key."""
    lines = wide_table(spark, folder, "documents").select("doc_id", F.posexplode(text.lines_of("text")).alias("pos", "ln"))
    keyed = lines.select("doc_id", "pos", text.norm_compare("ln").alias("key")).where(F.length("key") >= 4)
    return keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "pos")).alias("f")).where("n > 1").select(
        "key", "n", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_line"))


@query("doc_signature_dupes", """
WITH s AS (SELECT doc_id, source, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM documents)
SELECT doc_id, source FROM s QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1
""")
def doc_signature_dupes(spark, folder):
    """First document per signature (W2): equal words, whatever the white space and case."""
    docs = wide_table(spark, folder, "documents").select("doc_id", "source", "text")
    none = F.array().cast("array<string>")
    signed = docs.select("doc_id", "source", sections.section_signature(none, F.col("text"), none).alias("sig"))
    kept = drop_repeats(signed.where("sig is not null"), ["sig"], ["doc_id"])
    return kept.unionByName(signed.where("sig is null")).select("doc_id", "source")


@query("doc_coverage", f"""
WITH n AS (SELECT count(*) AS n FROM benchmark),
b AS (SELECT item_id, {SQL_NORM.format('text')} AS blob FROM benchmark),
l AS (SELECT doc_id, doc_id % (SELECT n FROM n) AS item_id, unnest(string_split(text, '. ')) AS s FROM documents),
k AS (SELECT doc_id, item_id, {SQL_NORM.format('s')} AS key FROM l)
SELECT doc_id, count(*) AS texts_total, CAST(count(*) FILTER (instr(blob, key) = 0) AS BIGINT) AS texts_missing
FROM k JOIN b USING (item_id) WHERE length(key) >= 4 GROUP BY doc_id
""")
def doc_coverage(spark, folder):
    """Sentences a paired source text does not contain (J8): one equi-join, then containment."""
    bench = table(spark, folder, "benchmark")
    n = bench.agg(F.count(F.lit(1))).scalar()
    blobs = bench.select(F.col("item_id").alias("page_id"), text.norm_compare("text").alias("blob"))
    docs = wide_table(spark, folder, "documents").select(
        "doc_id", (F.col("doc_id") % n).alias("page_id"), F.explode(F.split("text", r"\. ")).alias("text"))
    inventory = docs.select("doc_id", "page_id", "text", text.norm_compare("text").alias("key")).where(F.length("key") >= 4)
    out = qa.text_coverage(inventory, blobs)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts_total"), F.count_if("missing").alias("texts_missing"))


@query("doc_verify", """
WITH n AS (SELECT count(*) AS n FROM pages),
c AS (SELECT page_id, regexp_replace(html, '\\s+', ' ', 'g') AS flat FROM pages),
l AS (SELECT doc_id, doc_id % (SELECT n FROM n) AS page_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS v FROM documents)
SELECT doc_id, count(*) AS n_bad FROM l LEFT JOIN c USING (page_id) WHERE length(v) > 12 AND instr(coalesce(flat, ''), left(v, 80)) = 0 GROUP BY doc_id
""")
def doc_verify(spark, folder):
    """Lines whose first 80 characters the paired page does not hold."""
    pages = table(spark, folder, "pages")
    n = pages.agg(F.count(F.lit(1))).scalar()
    flow = wide_table(spark, folder, "documents").select(
        (F.col("doc_id") % n).alias("page_id"), F.col("doc_id").alias("seq"), F.col("text").alias("text_content"),
        F.array().cast("array<string>").alias("urls"))
    bad = qa.verify(flow, pages.select("page_id", F.col("html").alias("body")))
    return bad.groupBy(F.col("seq").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_bad"))


@query("doc_disclaimers", f"""
WITH {SQL_MARKED},
l AS (SELECT doc_id, list_filter(string_split(md, chr(10)), lambda ln: {SQL_TRIM_WS.format('ln')} <> '') AS ls FROM m),
s AS (SELECT doc_id, array_to_string(list_filter(ls, lambda ln: (starts_with({SQL_TRIM_WS.format('ln')}, '*') AND NOT starts_with({SQL_TRIM_WS.format('ln')}, '**')) OR starts_with({SQL_TRIM_WS.format('ln')}, '※') OR regexp_matches({SQL_TRIM_WS.format('ln')}, '^\\d+\\s*[).]\\s*')), chr(10)) AS d,
             array_to_string(list_filter(ls, lambda ln: NOT ((starts_with({SQL_TRIM_WS.format('ln')}, '*') AND NOT starts_with({SQL_TRIM_WS.format('ln')}, '**')) OR starts_with({SQL_TRIM_WS.format('ln')}, '※') OR regexp_matches({SQL_TRIM_WS.format('ln')}, '^\\d+\\s*[).]\\s*'))), chr(10)) AS n FROM l),
r AS (SELECT doc_id, 0 AS part, 'disclaimer' AS kind, d AS t FROM s WHERE d <> '' UNION ALL SELECT doc_id, 1, 'content', n FROM s WHERE n <> '')
SELECT doc_id, kind, md5(t) AS text_md5, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) AS BIGINT) AS seq FROM r
""")
def doc_disclaimers(spark, folder):
    """Texts split into a disclaimer and a content row, renumbered (T8, W14). Two rows come from one document row."""
    docs = marked_lines(wide_table(spark, folder, "documents", "doc_id", "text")).select(
        "doc_id", text.split_disclaimers("md", numbered=True).alias("s"))
    parts = F.filter(F.array(
        F.struct(F.lit("disclaimer").alias("kind"), F.col("s.disclaimer").alias("t")),
        F.struct(F.lit("content").alias("kind"), F.col("s.normal").alias("t"))), lambda p: p["t"] != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "p")).select(
        "doc_id", "p.kind", F.md5("p.t").alias("text_md5"), (F.col("pos") + 1).cast("bigint").alias("seq"))


@query("doc_token_recover", """
WITH k AS (SELECT count(*) AS n FROM benchmark),
m AS (SELECT doc_id AS media_id, doc_id % 20 AS page_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS tok FROM documents),
s AS (SELECT item_id AS sec_ord, item_id % 20 AS page_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS tok FROM benchmark),
a AS (SELECT media_id, page_id, unnest(tok) AS t FROM m), b AS (SELECT sec_ord, page_id, unnest(tok) AS t FROM s),
c AS (SELECT media_id, sec_ord, count(*) AS score FROM a JOIN b USING (page_id, t) GROUP BY ALL),
r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY score DESC, sec_ord) = 1)
SELECT m.media_id, r.sec_ord, r.score FROM m LEFT JOIN r ON r.media_id = m.media_id AND r.score >= 2
""")
def doc_token_recover(spark, folder):
    """Section that shares most words with each item, at least two (J14), first section on ties."""
    m = wide_table(spark, folder, "documents").select(
        (F.col("doc_id") % 20).alias("page_id"), F.col("doc_id").alias("media_id"), text.tokens("text").alias("tokens"))
    s = table(spark, folder, "benchmark").select(
        (F.col("item_id") % 20).alias("page_id"), F.col("item_id").alias("sec_ord"), text.tokens("text").alias("tokens"))
    best = media.token_scores(m, s, ["page_id"], "media_id", "sec_ord").groupBy("media_id").agg(
        F.max(F.struct("score", (-F.col("sec_ord")).alias("n"))).alias("b")).where(F.col("b.score") >= 2)
    return m.select("media_id").join(best, "media_id", "left").select("media_id", (-F.col("b.n")).alias("sec_ord"), F.col("b.score").alias("score"))


@query("doc_roles", f"""
WITH {SQL_MARKED},
l AS (SELECT doc_id, list_filter(list_transform(string_split(md, chr(10)), lambda x: {SQL_TRIM_WS.format('x')}), lambda x: x <> '') AS ls FROM m),
f AS (SELECT doc_id, coalesce(ls[2], '') AS second, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM l),
t AS (SELECT doc_id, i, s, {SQL_TRIM_WS.format("regexp_replace(s, '^#{1,6}' || '\\s*', '')")} AS c, second FROM f),
u AS (SELECT doc_id, CASE WHEN regexp_matches(s, '^#{{1,6}}\\s*') THEN 'headline' WHEN i = 1 AND regexp_matches(second, '^#{{1,6}}\\s*') AND length(c) <= 40 THEN 'eyebrow' ELSE 'body' END AS role, c,
  trim(regexp_replace(trim(CASE WHEN starts_with(w, '**') AND ends_with(w, '**') AND length(w) > 4 THEN substring(w, 3, length(w) - 4) ELSE w END), '\\.+$', '')) AS d, s
  FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(c), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '^#{{1,6}}\\s*', ''), '^[-*+]\\s+', '') AS w FROM t))
SELECT doc_id, role, count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM u
WHERE c <> '' AND NOT regexp_matches(s, '^[*※]') AND NOT {SQL_DESCRIBES.format(t='d')} GROUP BY ALL
""")
def doc_roles(spark, folder):
    """Lines by role."""
    docs = marked_lines(wide_table(spark, folder, "documents", "doc_id", "text"))
    flat = docs.select("doc_id", F.explode(text.roles_of("md")).alias("r"))
    return flat.groupBy("doc_id", F.col("r.role").alias("role")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("r.text")).alias("n_chars"))


@query("doc_headline", f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {SQL_TRIM_WS.format("regexp_replace(" + SQL_TRIM_WS.format('x') + ", '^#+' || '\\s*', '')")}), lambda x: x <> '') AS ls FROM documents),
e AS (SELECT *, len(ls) >= 2 AND length(ls[1]) <= 40 AND length(ls[2]) > length(ls[1]) AS lead FROM l)
SELECT doc_id, CASE WHEN lead THEN ls[1] ELSE '' END AS eyebrow, coalesce(CASE WHEN lead THEN ls[2] ELSE ls[1] END, '') AS headline,
       md5(array_to_string(CASE WHEN lead THEN ls[3:] ELSE ls[2:] END, chr(10))) AS body_md5 FROM e
""")
def doc_headline(spark, folder):
    """Eyebrow, headline and body of each text."""
    return wide_table(spark, folder, "documents").select("doc_id", text.split_headline("text").alias("h")).select(
        "doc_id", "h.eyebrow", "h.headline", F.md5("h.body").alias("body_md5"))


@query("doc_symbols", """
WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, '. ', ' ®(™) * . '), '[®™℠©℗]|[*＊∗✱⁎]|[†‡§¶※⁂]|[¹²³⁰ⁱ⁴-ⁿ]|[•‣■-◿★☆]', '', 'g'), '\\(\\s*\\)', '', 'g') AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \\t ]{2,}', ' ', 'g'), '[ \\t]+([,.;:!?%)\\]])', '\\1', 'g') AS t FROM s)
SELECT doc_id, md5(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), chr(10)), '^\\s+|\\s+$', '', 'g')) AS clean_md5 FROM u
""")
def doc_symbols(spark, folder):
    """Marks a retail text policy refuses taken out."""
    noisy = F.replace("text", F.lit(". "), F.lit(" ®(™) * . "))
    return wide_table(spark, folder, "documents").select("doc_id", F.md5(text.strip_symbols(noisy)).alias("clean_md5"))


@query("doc_md_tokens", f"""
WITH {SQL_MARKED},
l AS (SELECT doc_id, trim(unnest(string_split(md, chr(10)))) AS r, generate_subscripts(string_split(md, chr(10)), 1) - 1 AS line FROM m)
SELECT doc_id AS page_id, CASE WHEN regexp_matches(r, '^(#{{1,4}})\\s+(.+)$') THEN 'h' ELSE 'txt' END AS kind, count(*) AS n,
       CAST(sum(length(CASE WHEN regexp_matches(r, '^(#{{1,4}})\\s+(.+)$') THEN trim(regexp_extract(r, '^(#{{1,4}})\\s+(.+)$', 2)) ELSE r END)) AS BIGINT) AS n_chars
FROM l WHERE r <> '' GROUP BY ALL
""")
def doc_md_tokens(spark, folder):
    """Markdown tokens of each text."""
    docs = marked_lines(wide_table(spark, folder, "documents", "doc_id", "text")).withColumnRenamed("doc_id", "page_id")
    return extract.md_tokens(docs).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("n_chars"))


def page_markdown(docs):
    """Documents as crawled markdown: by its place and length a line becomes an image, a heading, a label, a note, a control or stays a text."""
    url = lambda stem, i: F.concat(F.lit(stem), F.col("doc_id").cast("string"), F.lit("-"), i.cast("string"))
    image = lambda alt, stem, i, end: F.concat(F.lit("!["), alt, F.lit("]("), url(stem, i), F.lit(end), F.lit(")"))

    def one(ln, i):
        k = (i * 7 + F.length(ln) + F.col("doc_id")) % 29
        word = F.left(ln, F.lit(22))
        return (
            F.when(k.isin(0, 1, 2, 3), F.concat(F.lit("## "), ln)).when(k.isin(4, 5, 6), image(word, "https://h.com/content/dam/", i, ".jpg"))
            .when(k == 7, F.concat(image(word, "https://h.com/a/", i, ".png"), F.lit("\n"), word, F.lit(" caption")))
            .when(k == 8, F.concat(image(F.lit(""), "https://h.com/a/", i, ".webp?x=1"), F.lit("\n"), word, F.lit("\n"), image(word, "https://h.com/b/", i, ".png"), F.lit("\nSee more\n"), word))
            .when(k == 9, F.concat(image(word, "https://h.com/gallery/", i, ".jpg"), F.lit("\n"), image(word, "https://h.com/x-icon-", i, ".png")))
            .when(k == 10, F.concat(F.lit("\\*"), ln)).when(k == 11, F.lit("Learn more")).when(k == 12, F.lit("Play video"))
            .when(k == 13, F.lit("# Recently Viewed")).when(k == 14, F.lit("### --")).when((k == 15) & (i > 8), F.lit("## Warranty"))
            .when(k.isin(16, 17, 18), word).when(k == 19, F.concat(word, F.lit(" "), image(word, "https://h.com/a/", i, ".gif"), F.lit(" end of line")))
            .when(k == 20, F.concat(F.lit("* "), ln)).when(k == 21, F.concat(F.lit("## "), word)).when(k == 22, F.lit("# Same title"))
            .when(k == 23, image(word, "data:", i, ".png")).otherwise(ln))

    return docs.select(F.col("doc_id").alias("page_id"), F.array_join(F.transform(F.split("text", "\n"), one), "\n").alias("md"))


SQL_MARKDOWN = r"""md AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda ln, j: [ln, left(ln, 22), doc_id || '-' || (j - 1), CAST(((j - 1) * 7 + length(ln) + doc_id) % 29 AS VARCHAR), CAST(j - 1 AS VARCHAR)]) AS ls FROM
    (SELECT doc_id, text FROM documents)),
  ln AS (SELECT doc_id, unnest(list_transform(ls, lambda x: CASE CAST(x[4] AS BIGINT)
    WHEN 0 THEN '## ' || x[1] WHEN 1 THEN '## ' || x[1] WHEN 2 THEN '## ' || x[1] WHEN 3 THEN '## ' || x[1]
    WHEN 4 THEN '![' || x[2] || '](https://h.com/content/dam/' || x[3] || '.jpg)' WHEN 5 THEN '![' || x[2] || '](https://h.com/content/dam/' || x[3] || '.jpg)' WHEN 6 THEN '![' || x[2] || '](https://h.com/content/dam/' || x[3] || '.jpg)'
    WHEN 7 THEN '![' || x[2] || '](https://h.com/a/' || x[3] || '.png)' || chr(10) || x[2] || ' caption'
    WHEN 8 THEN '![](https://h.com/a/' || x[3] || '.webp?x=1)' || chr(10) || x[2] || chr(10) || '![' || x[2] || '](https://h.com/b/' || x[3] || '.png)' || chr(10) || 'See more' || chr(10) || x[2]
    WHEN 9 THEN '![' || x[2] || '](https://h.com/gallery/' || x[3] || '.jpg)' || chr(10) || '![' || x[2] || '](https://h.com/x-icon-' || x[3] || '.png)'
    WHEN 10 THEN '\*' || x[1] WHEN 11 THEN 'Learn more' WHEN 12 THEN 'Play video' WHEN 13 THEN '# Recently Viewed' WHEN 14 THEN '### --'
    WHEN 15 THEN CASE WHEN CAST(x[5] AS BIGINT) > 8 THEN '## Warranty' ELSE x[1] END WHEN 16 THEN x[2] WHEN 17 THEN x[2] WHEN 18 THEN x[2]
    WHEN 19 THEN x[2] || ' ![' || x[2] || '](https://h.com/a/' || x[3] || '.gif) end of line' WHEN 20 THEN '* ' || x[1] WHEN 21 THEN '## ' || x[2] WHEN 22 THEN '# Same title'
    WHEN 23 THEN '![' || x[2] || '](data:' || x[3] || '.png)' ELSE x[1] END)) AS l, generate_subscripts(ls, 1) AS j FROM md),
  raw AS (SELECT doc_id, j, trim(unnest(string_split(l, chr(10)))) AS r, generate_subscripts(string_split(l, chr(10)), 1) AS jj FROM ln),
  made AS (SELECT doc_id, j, jj, CASE WHEN regexp_matches(r, '^(#{1,4})\s+(.+)$') THEN [{'k': 'h', 'v': trim(regexp_extract(r, '^(#{1,4})\s+(.+)$', 2)), 'u': ''}]
    ELSE list_transform(regexp_extract_all(r, '!\[[^\]]*\]\([^)]+\)'), lambda m: {'k': 'img', 'v': trim(regexp_extract(m, '!\[([^\]]*)\]', 1)), 'u': trim(regexp_extract(m, '\]\(([^)]+)\)', 1))})
      || CASE WHEN trim(regexp_replace(r, '!\[[^\]]*\]\([^)]+\)', '', 'g')) <> '' THEN [{'k': 'txt', 'v': trim(regexp_replace(r, '!\[[^\]]*\]\([^)]+\)', '', 'g')), 'u': ''}] ELSE [] END END AS a FROM raw WHERE r <> ''),
  flat AS (SELECT doc_id, j, jj, unnest(a) AS t, generate_subscripts(a, 1) AS jjj FROM made),
  tok AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, jj, jjj) AS i, t.k AS k, t.v AS v, t.u AS u FROM flat)"""


@query("doc_md_sections", "WITH RECURSIVE " + SQL_MARKDOWN + r""",
  a AS (SELECT *, k = 'txt' AND regexp_matches(v, '(?i)^(close|Pause carousel|Play carousel|Watch the Full Movie|Video Play|Video Pause|Previous|Next|_\\{0,2}\*_|\\{0,2}\*|[a-z]+\.com utilizes|Learn more|View more|See more|Buy Now|Add to cart|Where to Buy)$') AS ns,
    k = 'txt' AND regexp_matches(v, '^\\?\*') AS nt,
    CASE WHEN k = 'h' THEN CASE WHEN regexp_matches(v, '(?i)^(Summary|Dimensions|All Specs?\b|Specs?$|Key Spec|PRODUCT (FEATURES|SPECIFICATIONS)|Rating|Overall Rating|Review|Average Customer|Customer Images|Filter Reviews|Pros$|Cons$|Our picks|Need help|Contact|Find locally|Support|Warranty|FAQ|Product Support)') THEN 'stop'
      WHEN regexp_matches(v, '(?i)^(AI recommend|Quick Links|(?-i:[A-Z]{2,})s Pick|Popularity ranking|Recommended|Recently Viewed|You may also like|What people are saying|Compare|Where to buy|Find a store|Related)') THEN 'chrome'
      WHEN length(regexp_replace(v, '[^A-Za-z가-힣0-9]', '', 'g')) < 3 THEN 'short' ELSE 'normal' END END AS hk,
    k = 'img' AND regexp_matches(u, '^https?:') AND NOT regexp_matches(u, '(?i)gnb|promotion|promo|deals|installment|home-page|/banner|membership|superbrand|microsite|/logo|favicon|\.svg|[-_]icon[-_]')
      AND (contains(u, '/content/dam/') OR regexp_matches(u, '(?i)\.(jpe?g|png|webp|gif|avif)(\?|$)')) AS ok FROM tok),
  arr AS (SELECT doc_id, list({'k': k, 'v': v, 'u': u, 'ns': ns, 'nt': nt, 'hk': hk, 'ok': ok, 'g': ok AND contains(u, '/gallery/')} ORDER BY i) AS t, count(*) AS n FROM a GROUP BY doc_id),
  -- the run that would begin at each image, by itself: image, title behind noise, at most two more texts, next image
  m AS (SELECT a.doc_id, a.i, ok AND NOT contains(u, '/gallery/') AS pic, (SELECT min(b.i) FROM a b WHERE b.doc_id = a.doc_id AND b.i > a.i AND NOT b.ns) AS m FROM a WHERE k = 'img'),
  vv AS (SELECT m.doc_id, m.i, m.m, pic AND t[m.m].k = 'txt' AND length(t[m.m].v) <= 50 AND NOT t[m.m].nt AS valid, m.m + 1 + CASE WHEN t[m.m + 1].k = 'txt' THEN CASE WHEN t[m.m + 2].k = 'txt' THEN 2 ELSE 1 END ELSE 0 END AS nx FROM m JOIN arr USING (doc_id)),
  go AS (SELECT doc_id, 1::BIGINT AS ci, 1::BIGINT AS p, [0::BIGINT] AS run, [0::BIGINT] AS done, n FROM arr
    UNION ALL
    SELECT go.doc_id, CASE WHEN coalesce(vv.valid, false) THEN ci WHEN len(run) > 2 THEN p ELSE ci + 1 END, CASE WHEN coalesce(vv.valid, false) THEN vv.nx WHEN len(run) > 2 THEN p ELSE ci + 1 END,
      CASE WHEN coalesce(vv.valid, false) THEN list_append(run, go.p) ELSE [0::BIGINT] END, CASE WHEN NOT coalesce(vv.valid, false) AND len(run) > 2 THEN list_concat(done, run) ELSE done END, n
    FROM go LEFT JOIN vv ON vv.doc_id = go.doc_id AND vv.i = go.p WHERE ci <= n),
  cards AS (SELECT DISTINCT doc_id, unnest(done) AS i FROM go WHERE ci > n),
  titles AS (SELECT c.doc_id, c.i, v.m FROM cards c JOIN vv v USING (doc_id, i)),
  own AS (SELECT a.doc_id, a.i, list_filter(arr.t[a.i + 1:least(a.i + 5, n)], lambda x: x.k <> 'img' AND NOT (x.ns AND NOT regexp_matches(x.v, '(?i)play video|pause video')))[1] AS x FROM a JOIN arr USING (doc_id) WHERE a.k = 'img'),
  step AS (SELECT a.*, a.ok AND contains(a.u, '/gallery/') AS gal, c.i IS NOT NULL AS card, t2.v AS ctitle, s.m IS NOT NULL AS taken,
      CASE WHEN a.k = 'img' THEN CASE WHEN x IS NULL OR x.k = 'h' THEN 'next' WHEN regexp_matches(x.v, '(?i)play video|pause video') OR x.nt OR (a.v <> '' AND starts_with(x.v, left(a.v, 30))) THEN 'current' WHEN length(x.v) <= 40 THEN 'next' ELSE 'current' END END AS who,
      lag(a.k) OVER w AS pk, lag(a.v) OVER w AS pv, lag(a.nt) OVER w AS pnt, lag(a.u) OVER w AS pu, lead(a.k) OVER w AS nk, lead(a.hk) OVER w AS nhk
    FROM a LEFT JOIN cards c USING (doc_id, i) LEFT JOIN vv USING (doc_id, i) LEFT JOIN tok t2 ON t2.doc_id = vv.doc_id AND t2.i = vv.m LEFT JOIN titles s ON s.doc_id = a.doc_id AND s.m = a.i LEFT JOIN own ON own.doc_id = a.doc_id AND own.i = a.i
    WINDOW w AS (PARTITION BY a.doc_id ORDER BY a.i)),
  -- the walk: c the open section (0: none), b and s its texts and images so far, p images that wait, e the waiting label, al alt texts, o what this token puts out
  walk AS (SELECT doc_id, 0::BIGINT AS i, false AS stop, false AS chrome, 0::BIGINT AS c, 0::BIGINT AS nsec, false AS ti, 0::BIGINT AS b, 0::BIGINT AS s, ['']::VARCHAR[] AS p, '' AS e, ['']::VARCHAR[] AS al, ''::VARCHAR AS h0, ['']::VARCHAR[] AS o FROM arr
    UNION ALL
    SELECT y.doc_id, y.i, y.hk IS NOT DISTINCT FROM 'stop',
      CASE WHEN y.k = 'h' THEN y.hk = 'chrome' ELSE w.chrome END,
      CASE WHEN y.hk = 'normal' THEN nsec + 1 WHEN y.k = 'h' THEN 0 ELSE c END, CASE WHEN y.hk = 'normal' THEN nsec + 1 ELSE nsec END,
      CASE WHEN y.k = 'h' THEN y.hk = 'normal' AND (nsec = 0 OR h0 = y.v) ELSE ti END,
      CASE WHEN y.k = 'h' THEN 0 WHEN y.act = 'body' THEN b + 1 ELSE b END,
      CASE WHEN y.k = 'h' THEN least(2, len(p) - 1) WHEN y.act IN ('card-pair', 'doc-order', 'doc-order-trailing') THEN s + 1 ELSE s END,
      CASE WHEN y.k = 'h' AND y.hk <> 'stop' THEN [''] WHEN y.act = 'wait' THEN list_append(p, y.u || '|' || y.v) ELSE p END,
      CASE WHEN y.k = 'h' THEN '' WHEN y.act = 'label' THEN y.v WHEN y.act = 'wait' AND NOT y.card THEN '' ELSE e END,
      CASE WHEN y.hk = 'normal' THEN list_concat([''], list_filter(list_transform(p[greatest(2, len(p) - 1):], lambda q: left(regexp_extract(q, '\|(.*)$', 1), 30)), lambda q: q <> '')) WHEN y.k = 'h' THEN ['']
           WHEN y.act IN ('doc-order', 'doc-order-trailing') AND y.v <> '' THEN list_append(al, left(y.v, 30)) ELSE al END,
      CASE WHEN y.hk = 'normal' AND nsec = 0 THEN y.v ELSE h0 END,
      CASE WHEN y.hk = 'normal' THEN list_concat(['0section:' || (nsec + 1) || ':' || y.v || ':' || e], list_transform(p[greatest(2, len(p) - 1):], lambda q: '1asset:' || (nsec + 1) || ':doc-order:' || q), list_transform(p[2:greatest(1, len(p) - 2)], lambda q: '2unassigned:' || q))
           WHEN y.act IN ('body', 'note') AND c > 0 THEN ['0' || y.act || ':' || c || ':' || CASE WHEN y.act = 'note' THEN regexp_replace(y.v, '^\\', '') ELSE y.v END]
           WHEN y.act = 'card-pair' THEN ['1asset:' || c || ':card-pair:' || y.u || '|' || y.v || '|' || y.ctitle] WHEN y.act IN ('doc-order', 'doc-order-trailing') THEN ['1asset:' || c || ':' || y.act || ':' || y.u || '|' || y.v]
           WHEN y.act = 'gallery' THEN ['2gallery:' || y.u || '|' || y.v] ELSE ['']::VARCHAR[] END
    FROM walk w JOIN LATERAL (SELECT z.*, CASE WHEN z.k = 'h' THEN NULL WHEN w.chrome THEN 'skip'
        WHEN z.k = 'img' THEN CASE WHEN NOT z.ok THEN 'skip' WHEN z.gal THEN 'gallery' WHEN z.card THEN CASE WHEN w.c > 0 THEN 'card-pair' ELSE 'wait' END
          WHEN w.c > 0 AND NOT w.ti AND w.b = 0 AND w.s = 0 THEN 'doc-order' WHEN z.who = 'current' AND w.c > 0 AND NOT w.ti THEN 'doc-order-trailing' ELSE 'wait' END
        WHEN z.taken OR z.ns THEN 'skip' WHEN z.nt THEN 'note' WHEN len(list_filter(w.al, lambda q: q <> '' AND starts_with(z.v, q))) > 0 THEN 'skip'
        WHEN length(z.v) <= 40 AND z.nk = 'h' AND z.nhk NOT IN ('stop', 'chrome') AND NOT regexp_matches(z.v, '(?i)video|slide|carousel|play|pause|next|prev')
          AND NOT coalesce((z.pk = 'txt' AND length(z.pv) <= 40 AND NOT z.pnt) OR (z.pk = 'img' AND regexp_matches(z.pu, '(?i)[-_]icon[-_]')), false) THEN 'label' ELSE 'body' END AS act
      FROM step z) y ON y.doc_id = w.doc_id AND y.i = w.i + 1 WHERE NOT w.stop),
  last AS (SELECT doc_id, p FROM walk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
  outs AS (SELECT doc_id, unnest(o) AS x FROM walk UNION ALL SELECT doc_id, '2unassigned:' || q FROM (SELECT doc_id, unnest(p[2:]) AS q FROM last))
SELECT doc_id AS page_id, count(*) FILTER (starts_with(x, '0section')) AS n_sections, count(*) FILTER (starts_with(x, '0body')) AS n_body, count(*) FILTER (starts_with(x, '1asset')) AS n_assets,
  count(*) FILTER (starts_with(x, '2unassigned')) AS n_unassigned, count(*) FILTER (contains(x, ':card-pair:')) AS n_cards, md5(string_agg(x, chr(10) ORDER BY encode(x))) AS all_md5 FROM outs WHERE x <> '' GROUP BY doc_id
""")
def doc_md_sections(spark, folder):
    """Sections, texts and images of crawled markdown (W23); the SQL walks the tokens one by one."""
    pages = page_markdown(wide_table(spark, folder, "documents", "doc_id", "text"))
    found = markdown.md_sections(extract.md_tokens(pages))
    nth = found.sections.select("page_id", "seg", F.col("sec_ord").cast("string").alias("n"))
    label = lambda *parts: F.concat_ws(":", *parts)
    heads = found.sections.select("page_id", label(F.lit("0section"), F.col("sec_ord").cast("string"), "headline", "eyebrow").alias("x"))
    words = found.texts.join(nth, ["page_id", "seg"]).select("page_id", label(F.concat(F.lit("0"), F.when(F.col("kind") == "body", "body").otherwise("note")), "n", "text").alias("x"))
    pics = found.assets.join(nth, ["page_id", "seg"], "left").select("page_id", F.when(F.col("n").isNull(), label(F.concat(F.lit("2"), "matched_by"), F.concat_ws("|", "url", "alt"))).otherwise(
        label(F.lit("1asset"), "n", "matched_by", F.concat_ws("|", "url", "alt", "title"))).alias("x"))
    count = lambda c: F.count_if(c)
    x = F.col("x")
    return heads.unionByName(words).unionByName(pics).groupBy("page_id").agg(
        count(x.startswith("0section")).alias("n_sections"), count(x.startswith("0body")).alias("n_body"), count(x.startswith("1asset")).alias("n_assets"),
        count(x.startswith("2unassigned")).alias("n_unassigned"), count(F.contains(x, F.lit(":card-pair:"))).alias("n_cards"),
        F.md5(F.array_join(F.array_sort(F.collect_list("x")), "\n")).alias("all_md5"))


@query("doc_heading_scope", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 0 THEN CASE WHEN (doc_id + pos) % 7 = 0 THEN 'chrome' WHEN (doc_id + pos) % 35 = 30 THEN 'stop' ELSE 'normal' END END AS kind FROM l),
s AS (SELECT doc_id, pos, coalesce(sum(CASE WHEN kind = 'stop' THEN 1 ELSE 0 END) OVER w, 0) AS stops, last_value(kind IGNORE NULLS) OVER w AS scope
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (stops = 0 AND coalesce(scope, 'normal') <> 'chrome') AS BIGINT) AS n_in_scope FROM s GROUP BY doc_id
""")
def doc_heading_scope(spark, folder):
    """Lines inside the marketing part of a text, by stop and chrome headings."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(text.lines_of("text")).alias("pos", "ln"))
    spot = F.col("doc_id") + F.col("pos")
    heading = F.when(F.col("pos") % 5 == 0, F.when(spot % 7 == 0, "Recently Viewed").when(spot % 35 == 30, "Warranty").otherwise(F.lit("Picture")))
    out = extract.heading_scope(lines.withColumn("heading", heading).drop("ln"), ["doc_id"], ["pos"], F.col("heading"))
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("in_scope").alias("n_in_scope"))


@query("doc_typed_lines", f"""
WITH {SQL_MARKED},
l AS (SELECT doc_id, list_filter(list_transform(string_split(md, chr(10)), lambda x: {SQL_TRIM_WS.format('x')}), lambda x: x <> '') AS ls FROM m),
f AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM l),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(s), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '^#{{1,6}}\\s*', ''), '^[-*+]\\s+', '') AS w FROM f),
c AS (SELECT doc_id, i, s, trim(CASE WHEN starts_with(w, '**') AND ends_with(w, '**') AND length(w) > 4 THEN substring(w, 3, length(w) - 4) ELSE w END) AS c, regexp_matches(s, '^#{{1,6}}') AS h FROM w),
d AS (SELECT *, trim(regexp_replace(c, '\\.+$', '')) AS d FROM c WHERE c <> ''),
k AS (SELECT *, bool_or(h) OVER (PARTITION BY doc_id, lower(c)) AS headed FROM d),
n AS (SELECT * FROM k WHERE (h OR NOT headed) AND NOT {SQL_DESCRIBES.format(t='d')}),
u AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, lower(c) ORDER BY i) = 1),
p AS (SELECT *, count(*) FILTER (NOT h AND NOT (starts_with(s, '**') AND ends_with(s, '**')) AND NOT regexp_matches(s, '^[*※]')) OVER (PARTITION BY doc_id ORDER BY i) AS r,
             count(*) FILTER (h) OVER (PARTITION BY doc_id ORDER BY i) AS hs FROM u),
t AS (SELECT doc_id, c, CASE WHEN h THEN 'heading' WHEN starts_with(s, '**') AND ends_with(s, '**') THEN 'bold' WHEN regexp_matches(s, '^[*※]') THEN 'disclaimer'
   WHEN r = 1 AND hs = 0 AND length(c) <= 70 THEN 'title' ELSE 'body' END AS kind, s FROM p)
SELECT doc_id, kind, count(*) AS n, CAST(sum(length(CASE WHEN kind = 'disclaimer' THEN s ELSE c END)) AS BIGINT) AS n_chars FROM t GROUP BY ALL
""")
def doc_typed_lines(spark, folder):
    """Export lines by kind."""
    docs = marked_lines(wide_table(spark, folder, "documents", "doc_id", "text"))
    return channels.typed_lines(docs, ["doc_id"], "md").groupBy("doc_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


@query("doc_fragments", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT doc_id, md5(string_agg('<p>' || replace(replace(replace(replace(ln, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>', chr(10) ORDER BY pos)) AS html_md5,
       left(sha1('v1|shop|' || string_agg('<p>' || replace(replace(replace(replace(ln, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>', chr(10) ORDER BY pos)), 20) AS content_id
FROM l GROUP BY doc_id
""")
def doc_fragments(spark, folder):
    """Escaped fragments and their content ids (K4, K6). One document row gives one fragment."""
    html = F.array_join(F.transform(text.lines_of("text"), lambda ln: F.concat(F.lit("<p>"), urls.xml_escape(ln), F.lit("</p>"))), "\n")
    docs = wide_table(spark, folder, "documents").select("doc_id", html.alias("html"))
    return docs.select("doc_id", F.md5("html").alias("html_md5"), channels.content_hash("html", F.lit("shop")).alias("content_id"))


@query("content_ids", """
SELECT left(sha1('v2|' || source || '|' || text || '|r1'), 20) AS content_id, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL
""")
def content_ids(spark, folder):
    """Content-addressed ids with how many documents share each (K6)."""
    docs = wide_table(spark, folder, "documents").select("doc_id", channels.content_hash("text", "source", "v2", F.lit("r1")).alias("content_id"))
    return docs.groupBy("content_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query("manifest_sync", """
WITH a AS (SELECT 'd' || (doc_id % 50) || '/' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.log' ELSE '.json' END AS rel, length(text) AS size, md5(text) AS md5 FROM documents),
b AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'old/' ELSE '' END || 'd' || (doc_id % 50) || '/' || doc_id || CASE WHEN doc_id % 13 = 0 THEN '.log' ELSE '.json' END AS rel, length(text) AS size, CASE WHEN doc_id % 3 = 0 THEN 'part-2' WHEN doc_id % 7 = 0 THEN md5(text || 'x') ELSE md5(text) END AS md5 FROM documents),
j AS (SELECT coalesce(a.size, b.size) AS size, CASE WHEN b.size IS NULL THEN 'upload' WHEN a.size IS NULL THEN 'download'
  WHEN a.size = b.size AND (NOT regexp_matches(b.md5, '^[0-9a-f]{32}$') OR a.md5 = b.md5) THEN 'unchanged' ELSE 'differs' END AS action
  FROM (SELECT * FROM a WHERE rel NOT LIKE '%.log') a FULL OUTER JOIN (SELECT * FROM b WHERE rel NOT LIKE '%.log') b ON a.rel = b.rel)
SELECT action, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM j GROUP BY action
""")
def manifest_sync(spark, folder):
    """Sync plan of two manifests and its totals."""
    from ..operators import store

    d = F.col("doc_id")
    rel = F.concat(F.lit("d"), (d % 50).cast("string"), F.lit("/"), d.cast("string"), F.when(d % 13 == 0, ".log").otherwise(".json"))
    docs = table(spark, folder, "documents").select("doc_id", F.lit("out").alias("root"), rel.alias("rel"), F.length("text").alias("size"), "text")
    local = docs.select("root", "rel", "size", F.md5("text").alias("md5"))
    etag = F.when(d % 3 == 0, "part-2").when(d % 7 == 0, F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text"))
    remote = docs.select("root", F.concat(F.when(d % 4 == 0, "old/").otherwise(""), "rel").alias("rel"), "size", etag.alias("md5"))
    return store.sync_stats(store.sync_plan(local, remote)).select("action", "n", F.col("bytes").cast("bigint").alias("bytes"))


@query("doc_noise", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)
SELECT doc_id, CAST(count(*) FILTER (regexp_matches(lower(w), '{"|".join(q(w.replace("?", "[?]")) for w in text.SKIP_WORDS)}')) AS BIGINT) AS n_skip,
       CAST(count(*) FILTER (regexp_matches(regexp_replace(w, '^\\s+|\\s+$', '', 'g'), '^[a-zA-Z][a-zA-Z0-9]*(-[a-zA-Z0-9]+)+$|^[a-z][a-z0-9]*[A-Z][a-zA-Z0-9]+$')) AS BIGINT) AS n_class,
       CAST(count(*) FILTER (regexp_matches(regexp_replace(w, '^\\s+|\\s+$', '', 'g'), '^[A-Za-z]{{1,4}}$') AND regexp_replace(w, '^\\s+|\\s+$', '', 'g') <> upper(regexp_replace(w, '^\\s+|\\s+$', '', 'g'))) AS BIGINT) AS n_fragment
FROM l GROUP BY doc_id
""")
def doc_noise(spark, folder):
    """Noise words per text."""
    words = wide_table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("doc_id").agg(
        F.count_if(text.is_skip("w")).alias("n_skip"), F.count_if(text.looks_like_class_name("w")).alias("n_class"),
        F.count_if(text.is_fragment_heading("w")).alias("n_fragment"))


@query("doc_draft", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
i AS (SELECT doc_id, pos, trim(string_split(ln, '. ')[1]) AS t, trim(regexp_replace(substring(ln, length(string_split(ln, '. ')[1]) + 3), '\\s+', ' ', 'g')) AS b FROM l),
u AS (SELECT *, length(t) > 80 AS wide FROM i WHERE t <> '' AND NOT regexp_matches(t, '^[-–]')),
g AS (SELECT * FROM u WHERE wide OR NOT (b = '' AND ends_with(t, '?'))),
f AS (SELECT * FROM g WHERE NOT wide QUALIFY row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) = 1),
a AS (SELECT * FROM f UNION ALL SELECT * FROM g WHERE wide),
n AS (SELECT *, sum(CASE WHEN wide THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM a)
SELECT doc_id, CAST(n AS BIGINT) AS title_no, CASE WHEN wide THEN '- ' || left(t, 400) ELSE '● ' || t || CASE WHEN b <> '' THEN chr(10) || '- ' || left(b, 400) ELSE '' END END AS line
FROM n WHERE n <= 8 AND (NOT wide OR (n > 0 AND n < 8))
""")
def doc_draft(spark, folder):
    """Product-details draft: the first eight titles with their details."""
    first = F.element_at(F.split("ln", r"\. "), 1)
    items = wide_table(spark, folder, "documents").select("doc_id", F.posexplode(text.lines_of("text")).alias("pos", "ln")).select(
        "doc_id", "pos", first.alias("title"), F.substring(F.col("ln"), F.length(first) + 3, F.length("ln")).alias("body"))
    return channels.draft_details(items, ["doc_id"], ["pos"]).select("doc_id", "title_no", "line")


@query("doc_prefix_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
p AS (SELECT doc_id, pos, ln, lag(ln) OVER (PARTITION BY doc_id ORDER BY pos) AS pl FROM l),
i AS (SELECT *, sum(CASE WHEN pl IS NOT NULL AND ln = pl THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT doc_id, CAST(max(g) AS BIGINT) AS n_runs, count(*) AS n_lines FROM i GROUP BY doc_id
""")
def doc_prefix_lines(spark, folder):
    """Runs of equal neighbouring lines per text."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(text.lines_of("text")).alias("pos", "ln"))
    from ..operators.ordered import islands

    runs = islands(lines, ["doc_id"], ["pos"], F.struct("ln"), lambda p: F.col("ln") == p["ln"])
    return runs.groupBy("doc_id").agg(F.max("island").alias("n_runs"), F.count(F.lit(1)).alias("n_lines"))


# ---------------------------------------------------------------- conversations as ordered sections


@query("turn_merge", """
WITH p AS (SELECT *, CASE WHEN role = 'system' THEN 'user' ELSE role END AS r FROM conversations),
c AS (SELECT *, CASE WHEN turn % 3 = 0 AND turn > 0 THEN lag(r) OVER (PARTITION BY conv_id ORDER BY turn) ELSE r END AS k FROM p),
g AS (SELECT *, sum(CASE WHEN k = lk THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island
      FROM (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS lk FROM c))
SELECT conv_id, CAST(island AS BIGINT) AS island, min(turn) AS first_turn, count(*) AS n, any_value(k) AS role,
       first(text ORDER BY length(text) DESC, turn) AS longest, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM g GROUP BY conv_id, island
""")
def turn_merge(spark, folder):
    """Neighbouring turns of one speaker merged, the longest text kept."""
    from ..operators.ordered import Prev

    t = table(spark, folder, "conversations").withColumn("r", F.when(F.col("role") == "system", "user").otherwise(F.col("role")))
    k = scan(t, ["conv_id"], ["turn"], [Prev("pr", F.col("r"))]).withColumn(
        "k", F.when((F.col("turn") % 3 == 0) & (F.col("turn") > 0), F.col("pr")).otherwise(F.col("r")))
    return sections.merge_consecutive(k, ["conv_id"], ["turn"], F.col("k"), [
        F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("n"), F.min("k").alias("role"),
        F.max_by("text", F.struct(F.length("text"), -F.col("turn"))).alias("longest"), F.sum(F.length("text")).alias("n_chars")])


@query("turn_carry", """
WITH f AS (SELECT *, turn % 4 = 1 AS is_t, turn % 4 <> 1 AND role = 'assistant' AS rec FROM conversations),
c AS (SELECT *, sum(CASE WHEN rec THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM f),
t AS (SELECT conv_id, n + 1 AS due, string_agg(trim(text), chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS carried FROM c WHERE is_t GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, coalesce(t.carried, CASE WHEN t.due IS NOT NULL THEN '' END) AS carried FROM c LEFT JOIN t ON t.conv_id = c.conv_id AND c.rec AND t.due = c.n WHERE NOT is_t
""")
def turn_carry(spark, folder):
    """Title turns carried to the next turn that can hold them."""
    t = table(spark, folder, "conversations")
    out = sections.carry_titles(
        t, ["conv_id"], ["turn"], F.col("turn") % 4 == 1, F.col("role") == "assistant", F.col("text"))
    return out.select("conv_id", "turn", "role", "carried")


@query("turn_order", """
WITH g AS (SELECT conv_id, turn, role = 'assistant' AND turn % 5 = 3 AS disc, CASE WHEN turn % 3 = 0 THEN (turn * 7 + conv_id) % 11 ELSE -1 END AS dom,
                  CASE WHEN turn % 2 = 0 THEN (turn * 13 + conv_id * 3) % 101 END AS op FROM conversations),
i AS (SELECT *, sum(CASE WHEN disc AND turn > mn THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp
      FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS mn FROM g)),
h AS (SELECT conv_id, grp, min(op) AS o, first(dom ORDER BY turn) FILTER (dom >= 0) AS dom FROM i GROUP BY ALL),
r AS (SELECT *, coalesce(o, 1000000000 + grp) AS a FROM h),
s AS (SELECT *, last_value(dom IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY a, grp ROWS UNBOUNDED PRECEDING) AS last FROM r)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(s.dom, last, -1), CASE WHEN s.dom IS NULL THEN 1 ELSE 0 END, a, grp, turn) AS BIGINT) AS place
FROM i JOIN s USING (conv_id, grp)
""")
def turn_order(spark, folder):
    """Document order from dom indexes and source positions (W13), then renumbered."""
    from ..operators.ordered import renumber

    turn, conv = F.col("turn"), F.col("conv_id")
    t = table(spark, folder, "conversations").select(
        "conv_id", "turn", ((F.col("role") == "assistant") & (turn % 5 == 3)).alias("disclaimer"),
        F.when(turn % 3 == 0, (turn * 7 + conv) % 11).otherwise(-1).alias("dom_index"),
        F.when(turn % 2 == 0, (turn * 13 + conv * 3) % 101).alias("orig_pos"), F.lit(None).cast("bigint").alias("text_pos"),
        F.lit(None).cast("bigint").alias("rec_pos"))
    out = sections.order_by_document(t, ["conv_id"], ["turn"])
    flat = out.select("conv_id", "turn", "new_order.dom", "new_order.tail", "new_order.anchor", "new_order.grp")
    return renumber(flat, ["conv_id"], ["dom", "tail", "anchor", "grp", "turn"], "place").select("conv_id", "turn", "place")


@query("turn_source_text", """
SELECT conv_id, md5('T' || conv_id || chr(10) || chr(10) || string_agg(trim(text), chr(10) || chr(10) ORDER BY turn)) AS doc_md5
FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY conv_id
""")
def turn_source_text(spark, folder):
    """Source text of a conversation as a product document."""
    t = table(spark, folder, "conversations").select(
        "conv_id", "turn", "text", (F.col("role") == "system").alias("is_disclaimer"), F.concat(F.lit("T"), F.col("conv_id").cast("string")).alias("title"))
    return channels.source_text(t, ["conv_id"], ["turn"]).select("conv_id", F.md5("doc").alias("doc_md5"))


@query("turn_text_runs", """
WITH f AS (SELECT *, role = 'user' AS t, role = 'assistant' AND turn % 4 <> 3 AS g FROM conversations),
p AS (SELECT *, lag(t) OVER (PARTITION BY conv_id ORDER BY turn) AS pt FROM f),
r AS (SELECT *, sum(CASE WHEN pt AND (t OR g) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT conv_id, turn, CAST(run AS BIGINT) AS run, bool_and(t) OVER (PARTITION BY conv_id, run) AS intro FROM r
""")
def turn_text_runs(spark, folder):
    """Text-only turns joined to the picture-like turn after them, else kept as an intro."""
    t = table(spark, folder, "conversations").select("conv_id", "turn", "role")
    out = sections.merge_text_runs(
        t, ["conv_id"], ["turn"], F.col("role") == "user", (F.col("role") == "assistant") & (F.col("turn") % 4 != 3))
    return out.select("conv_id", "turn", "run", "intro")


@query("turn_disclaimers", """
WITH RECURSIVE f AS (SELECT conv_id, turn, turn % 3 = 1 AS note, text AS t FROM conversations),
h AS (SELECT *, last_value(CASE WHEN note THEN NULL ELSE turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS b,
  first_value(CASE WHEN note THEN NULL ELSE turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM f),
g AS (SELECT conv_id, coalesce(b, a) AS turn, string_agg(t, '|' ORDER BY h.turn) AS notes, count(*) AS n FROM h WHERE note GROUP BY ALL)
SELECT f.conv_id, f.turn, coalesce(g.notes, '') AS notes FROM f LEFT JOIN g USING (conv_id, turn) WHERE NOT f.note
""")
def turn_disclaimers(spark, folder):
    """Note-only turns attached to the turn before, or the next one when none came yet."""
    t = table(spark, folder, "conversations").withColumn("note", F.col("text"))
    is_note = F.col("turn") % 3 == 1
    out = sections.attach_disclaimers(
        t, ["conv_id"], ["turn"], is_note, F.when(is_note, F.array("note")).otherwise(F.array().cast("array<string>")))
    return out.select("conv_id", "turn", F.array_join("disclaimers", "|").alias("notes"))


@query("turn_title_pair", """
WITH f AS (SELECT conv_id, turn, turn % 5 = 2 AS d, turn % 5 IN (0, 3) AS t, turn % 5 IN (1, 4) OR length(text) % 2 = 0 AS w FROM conversations),
x AS (SELECT *, t AND NOT d AS tt,
  last_value(CASE WHEN d THEN NULL ELSE turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb,
  first_value(CASE WHEN d THEN NULL ELSE turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS na FROM f),
y AS (SELECT x.*, p.tt AS ptt, n.w AND NOT n.tt AS nw FROM x LEFT JOIN x p ON p.conv_id = x.conv_id AND p.turn = x.pb LEFT JOIN x n ON n.conv_id = x.conv_id AND n.turn = x.na)
SELECT conv_id, turn, CASE WHEN NOT d AND w AND NOT tt AND ptt THEN pb END AS title_turn FROM y WHERE NOT (tt AND coalesce(nw, false))
""")
def turn_title_pair(spark, folder):
    """Title-only turns handed to the next picture-like turn, over notes in between."""
    t = table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    title = (F.col("turn") % 5).isin(0, 3)
    weak = ~title & ((F.col("turn") % 5).isin(1, 4) | (F.col("n") % 2 == 0))
    out = sections.pair_title_image(t, ["conv_id"], ["turn"], title, weak, F.col("turn") % 5 == 2)
    return out.select("conv_id", "turn", F.col("title_from.turn").alias("title_turn"))


@query("turn_captions", """
WITH RECURSIVE f AS (SELECT conv_id, turn, CASE WHEN (turn + conv_id) % 5 = 3 THEN 'media' WHEN turn % 2 = 0 THEN 'media' ELSE 'text' END AS ct,
   CASE WHEN conv_id % 7 = 0 THEN 1 ELSE 3 END AS cols, turn // 6 AS rg, (turn + conv_id) % 9 = 4 AS note FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
   lead(ct) OVER w AS nct, lead(cols) OVER w AS ncols, lead(rg) OVER w AS nrg, lead(note) OVER w AS nnote,
   lag(ct) OVER w AS pct, lag(cols) OVER w AS pcols, lag(rg) OVER w AS prg FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, i, turn, ct = 'media' AND cols > 1 AND coalesce(nct = 'text' AND ncols > 1 AND nrg = rg AND NOT nnote, false) AS paired, false AS used FROM n WHERE i = 1
  UNION ALL
  SELECT n.conv_id, n.i, n.turn,
    n.ct = 'media' AND n.cols > 1 AND coalesce(n.nct = 'text' AND n.ncols > 1 AND n.nrg = n.rg AND NOT n.nnote, false)
      AND NOT (n.pct = 'text' AND n.pcols > 1 AND n.prg = n.rg AND NOT r.used),
    r.paired
  FROM r JOIN n ON n.conv_id = r.conv_id AND n.i = r.i + 1)
SELECT r.conv_id, r.turn, r.paired, r.used AND n.ct = 'text' AS caption FROM r JOIN n USING (conv_id, i)
""")
def turn_captions(spark, folder):
    """Media rows paired with the caption behind them (W27); the SQL walks the rows one by one."""
    turn, conv = F.col("turn"), F.col("conv_id")
    t = table(spark, folder, "conversations").select(
        "conv_id", "turn", F.when((turn + conv) % 5 == 3, "media").when(turn % 2 == 0, "media").otherwise("text").alias("content_type"),
        F.when(conv % 7 == 0, 1).otherwise(3).alias("n_columns"), F.floor(turn / 6).alias("row_group"), ((turn + conv) % 9 == 4).alias("is_note"))
    return sections.pair_captions(t, ["conv_id"], ["turn"]).select("conv_id", "turn", "paired", "caption")


@query("turn_owner", """
WITH f AS (SELECT conv_id, turn, turn % 3 = 1 AS m, turn % 6 = 5 AS d, turn % 4 = 0 AS h, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS tok,
   regexp_replace(text, '/', '', 'g') AS fn FROM conversations),
x AS (SELECT *, last_value(CASE WHEN m OR d THEN NULL ELSE turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS b,
  first_value(CASE WHEN m OR d THEN NULL ELSE turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM f),
y AS (SELECT x.conv_id, x.turn, x.b, x.a, bb.h AS bh, aa.h AS ah,
  len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(x.fn), '[a-z0-9]{3,}')), lambda t: t NOT IN ('jpg','jpeg','png','webp','mp4','webm','gif','desktop','mobile','feature','features','key','2025','2026','side','by','vs6','energy','fridge','freezers')), bb.tok)) AS sb,
  len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(x.fn), '[a-z0-9]{3,}')), lambda t: t NOT IN ('jpg','jpeg','png','webp','mp4','webm','gif','desktop','mobile','feature','features','key','2025','2026','side','by','vs6','energy','fridge','freezers')), aa.tok)) AS sa
  FROM x LEFT JOIN f bb ON bb.conv_id = x.conv_id AND bb.turn = x.b LEFT JOIN f aa ON aa.conv_id = x.conv_id AND aa.turn = x.a WHERE x.m)
SELECT conv_id, turn, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN bh AND NOT ah THEN b WHEN ah AND NOT bh THEN a WHEN sa > sb + 5 THEN a ELSE b END AS owner FROM y
""")
def turn_owner(spark, folder):
    """Which neighbouring text a media turn belongs to."""
    turn = F.col("turn")
    t = table(spark, folder, "conversations").select(
        "conv_id", "turn", (turn % 3 == 1).alias("is_media"), (turn % 6 == 5).alias("is_disclaimer"), (turn % 4 == 0).alias("has_heading"), "text",
        F.replace("text", F.lit("/"), F.lit("")).alias("url"))
    return media.own_media(t, ["conv_id"], ["turn"]).where("is_media").select("conv_id", "turn", F.col("owner.turn").alias("owner"))


def usp_blocks(t):
    """Turns as text blocks of a product: titles cut out of one sentence, so that some hold others; some turns have no title, or one of marks alone."""
    turn, conv = F.col("turn"), F.col("conv_id")
    title = F.substring(F.lit("Smart Inverter Compressor Panel"), (1 + (turn * 5 + conv) % 9).cast("int"), (5 + (turn * 3 + conv) % 12).cast("int"))
    body = F.element_at(F.split("text", r"[.\n]"), 1)
    made = (
        F.when((turn + conv) % 4 == 0, F.concat(body, F.lit("\n* a note\n- more"))).when((turn * 3 + conv) % 11 == 0, F.concat(F.lit("## -–:\n"), body))
        .when((turn + conv) % 5 == 0, F.concat(F.lit("New\n## "), title, F.lit("\n"), body)).otherwise(F.concat(F.lit("## "), title, F.lit("\n"), body, F.lit("\n> "), F.left(body, F.lit(9)))))
    return t.select("conv_id", "turn", made.alias("text"))


@query("turn_usps", r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, substr('Smart Inverter Compressor Panel', CAST(1 + (turn * 5 + conv_id) % 9 AS INT), CAST(5 + (turn * 3 + conv_id) % 12 AS INT)) AS title,
   regexp_split_to_array(text, '[.\n]')[1] AS body FROM conversations),
  m AS (SELECT conv_id, turn, CASE WHEN (turn + conv_id) % 4 = 0 THEN body || chr(10) || '* a note' || chr(10) || '- more' WHEN (turn * 3 + conv_id) % 11 = 0 THEN '## -–:' || chr(10) || body
   WHEN (turn + conv_id) % 5 = 0 THEN 'New' || chr(10) || '## ' || title || chr(10) || body ELSE '## ' || title || chr(10) || body || chr(10) || '> ' || left(body, 9) END AS t FROM c),
  l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\x{2028}\x{A0}]', ' ', 'g'))), lambda x: x <> '' AND NOT starts_with(x, '*')) AS ls FROM m),
  h AS (SELECT *, list_position(list_transform(ls, lambda x: starts_with(x, '#')), true) AS hd, list_transform(ls, lambda x: trim(regexp_replace(x, '^[#>\-\s•]+', ''))) AS cl FROM l WHERE len(ls) > 0),
  f AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS i, coalesce(hd, 0) > 0 AS has, CASE WHEN coalesce(hd, 0) > 0 THEN cl[1] ELSE left(cl[1], 80) END AS title,
     array_to_string(list_filter(cl[2:], lambda x: x <> ''), ' ') AS rest, trim(array_to_string(cl, ' ')) AS whole FROM h),
  k AS (SELECT *, lower(trim(regexp_replace(title, '[\s™®\-–—:]+', ' ', 'g'))) AS key FROM f),
  r AS (SELECT conv_id, 0::BIGINT AS i, []::VARCHAR[] AS ks, []::VARCHAR[] AS ts, []::VARCHAR[] AS ds FROM (SELECT DISTINCT conv_id FROM k)
    UNION ALL
    SELECT conv_id, i, CASE WHEN act = 'new' THEN list_append(ks, key) ELSE ks END, CASE WHEN act = 'new' THEN list_append(ts, title) ELSE ts END,
      CASE WHEN act = 'new' THEN list_append(ds, rest)
        WHEN act = 'more' THEN list_transform(ds, lambda d, j: CASE WHEN j = len(ds) THEN trim(d || ' ' || whole) ELSE d END)
        WHEN act = 'dup' THEN list_transform(ds, lambda d, j: CASE WHEN j = hit AND rest <> '' AND NOT contains(d, rest) THEN trim(d || ' ' || rest) ELSE d END) ELSE ds END
    FROM (SELECT *, CASE WHEN NOT has AND len(ks) > 0 THEN 'more' WHEN key = '' THEN 'none' WHEN hit > 0 THEN 'dup' ELSE 'new' END AS act
      FROM (SELECT r.conv_id, k.i, ks, ts, ds, has, key, title, rest, whole,
        coalesce(list_position(list_transform(ks, lambda u: u = key OR (least(length(u), length(key)) >= 6 AND (contains(u, key) OR contains(key, u)))), true), 0) AS hit
        FROM r JOIN k ON k.conv_id = r.conv_id AND k.i = r.i + 1)))
SELECT conv_id, unnest(ts) AS title, unnest(ds) AS desc, unnest(range(1, len(ts) + 1)) AS place FROM r QUALIFY i = max(i) OVER (PARTITION BY conv_id)
""")
def turn_usps(spark, folder):
    """Selling points per conversation, contained titles merged (A16); the SQL walks the blocks one by one."""
    blocks = usp_blocks(table(spark, folder, "conversations"))
    return channels.usp_list(blocks, ["conv_id"], ["turn"]).select("conv_id", "title", "desc", "place")


@query("doc_generic_pairs", r"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
  b AS (SELECT doc_id, i, (i * 5 + length(ln)) % 7 IN (0, 1, 5) AS h, (i * 5 + length(ln)) % 7 IN (1, 2, 3) AS im, (i + length(ln)) % 3 = 0 AS pr FROM l),
  w AS (SELECT doc_id, 0::BIGINT AS i, NULL::BIGINT AS t, false AS tp, 0 AS steps, 0 AS n, NULL::BIGINT AS got FROM (SELECT DISTINCT doc_id FROM l)
    UNION ALL
    SELECT doc_id, i, CASE WHEN act = 'set' THEN i WHEN act = 'clear' OR (act = 'take' AND n = 2) THEN NULL ELSE t END, CASE WHEN act = 'set' THEN pr ELSE tp END,
      CASE WHEN act = 'set' OR act = 'clear' OR (act = 'take' AND n = 2) THEN 0 ELSE steps END, CASE WHEN act = 'set' THEN 0 WHEN act = 'take' THEN n + 1 ELSE n END, CASE WHEN act = 'take' THEN t END
    FROM (SELECT *, CASE WHEN h AND NOT im THEN CASE WHEN t IS NULL OR pr OR NOT tp THEN 'set' ELSE 'keep' END WHEN NOT h AND im AND t IS NOT NULL THEN 'take'
        WHEN h AND im AND (t IS NULL OR NOT tp OR pr) THEN 'clear' ELSE 'keep' END AS act
      FROM (SELECT w.doc_id, b.i, h, im, pr, CASE WHEN w.t IS NOT NULL AND w.steps + 1 > 10 THEN NULL ELSE w.t END AS t, w.tp, CASE WHEN w.t IS NOT NULL THEN CASE WHEN w.steps + 1 > 10 THEN 0 ELSE w.steps + 1 END ELSE w.steps END AS steps, w.n
        FROM w JOIN b ON b.doc_id = w.doc_id AND b.i = w.i + 1)))
SELECT doc_id, i AS block, got AS title FROM w WHERE got IS NOT NULL
""")
def doc_generic_pairs(spark, folder):
    """Image blocks handed to the title block before them (W18); the SQL walks the blocks one by one."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "ln"))
    i = (F.col("at") + 1).cast("long")
    mark = (i * 5 + F.length("ln")) % 7
    blocks = lines.select("doc_id", i.alias("i"), mark.isin(0, 1, 5).alias("has_heading"), mark.isin(1, 2, 3).alias("has_image"), ((i + F.length("ln")) % 3 == 0).alias("primary"))
    return sections.pair_generic(blocks, ["doc_id"], "i").select("doc_id", F.col("i").alias("block"), F.col("title_at").alias("title"))


@query("turn_listing_text", """
WITH f AS (SELECT conv_id, string_agg(trim(text), chr(10) ORDER BY turn) FILTER (turn % 3 = 0) AS promotion, string_agg(trim(text), chr(10) ORDER BY turn) FILTER (turn % 3 = 1) AS details,
  string_agg(trim(text), chr(10) ORDER BY turn) FILTER (turn % 3 = 2) AS delivery FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, list_filter([CASE WHEN coalesce(promotion, '') <> '' THEN 'Promotion Details:' || chr(10) || chr(10) || regexp_replace(promotion, '^\\s+|\\s+$', '', 'g') END,
  CASE WHEN coalesce(details, '') <> '' THEN 'Own title:' || chr(10) || chr(10) || regexp_replace(details, '^\\s+|\\s+$', '', 'g') END,
  CASE WHEN coalesce(delivery, '') <> '' THEN 'Delivery & Installation Notice:' || chr(10) || chr(10) || regexp_replace(delivery, '^\\s+|\\s+$', '', 'g') END], lambda x: x IS NOT NULL) AS parts FROM f)
SELECT conv_id, CASE WHEN len(parts) = 0 THEN '' ELSE array_to_string(parts, chr(10) || chr(10) || chr(10) || chr(10)) || chr(10) END AS listing FROM p
""")
def turn_listing_text(spark, folder):
    """Plain listing text with default and own titles: every turn's text in its field, in order."""
    said = lambda i: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 3 == i, F.struct("turn", F.trim("text").alias("t"))))), lambda x: x["t"]), "\n")
    f = table(spark, folder, "conversations").groupBy("conv_id").agg(said(0).alias("p"), said(1).alias("d"), said(2).alias("v"))
    fields = F.create_map(F.lit("promotion"), F.col("p"), F.lit("details"), F.col("d"), F.lit("delivery"), F.col("v"))
    titles = F.create_map(F.lit("details"), F.lit("Own title"))
    return f.select("conv_id", channels.listing_text(fields, titles).alias("listing"))
