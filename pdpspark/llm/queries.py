"""The thin queries op1 to op13 and the pipeline over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdpspark.llm import ann, collocations, conversations, decontaminate, html_text, langid, line_dedup, near_dedup, packing, substring, toxicity, url_filter, warc
from pdpspark.llm.common import table

RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def remainder(divisor: int):
    """crc32 of the id as text, modulo divisor; -1 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(-1))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.fit_toxicity(docs, labels.where(remainder(4) != 2))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")


def word_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_spread_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs.where(remainder(3) != 1))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.drop_repeated_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"), F.size("repeats").alias("n_repeats"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with a fault in a quarter of their rows, by crc32 of conv_id:turn; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), body.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    reports, turns = conversations.repaired(damaged(rows))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    found = reports.join(conversations.digests(turns).withColumnRenamed("conv_id", "same"), F.col("conv_id").eqNullSafe(F.col("same")), "left")
    found = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(""), 256)
    return found.select(F.col("id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", empty).alias("repaired_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_nearest, op3_html_text, op4_toxicity, op5_packing, op6_line_dedup, op7_url_filter, op8_decontamination, op9_warc, op10_language, op11_passages, op12_conversations, op13_collocations)}
QUERIES["pipeline"] = pipeline

ORACLES = {
    "op6_line_dedup": """
        WITH cut AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS a FROM documents),
        line AS (SELECT doc_id, source, unnest(range(len(a))) AS pos, trim(unnest(a), ' ') AS x FROM cut),
        spread AS (SELECT x, min({'d': doc_id, 'p': pos}) AS first FROM line WHERE x <> '' GROUP BY x HAVING count(DISTINCT source) >= 4),
        gone AS (SELECT doc_id, pos FROM line JOIN spread USING (x) WHERE {'d': doc_id, 'p': pos} <> first),
        drops AS (SELECT doc_id, list(DISTINCT pos) AS p FROM gone GROUP BY doc_id)
        SELECT doc_id,
               CASE WHEN p IS NULL THEN text ELSE array_to_string(list_filter(list_transform(range(len(a)), lambda i: CASE WHEN list_contains(p, i) THEN NULL ELSE a[i + 1] END), lambda s: s IS NOT NULL), chr(10)) END AS text,
               coalesce(len(a), 0)::BIGINT AS n_lines, coalesce(len(p), 0)::BIGINT AS n_removed
        FROM cut LEFT JOIN drops USING (doc_id)""",
    "op7_url_filter": """
        WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
        fits AS (SELECT page_id, max({'n': length(h || p), 'r': h || p, 'v': v}) AS best FROM parts, rules WHERE (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)""",
    "op8_decontamination": """
        WITH w AS (SELECT 'd' AS t, doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents
                   UNION ALL SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') FROM benchmark),
        s AS (SELECT DISTINCT t, id, unnest(list_transform(range(1, greatest(len(a) - 3, 1)), lambda i: array_to_string(a[i:i + 4], ' '))) AS g FROM w WHERE len(a) >= 5),
        n AS (SELECT id, count(*) AS n_item FROM s WHERE t = 'b' GROUP BY id),
        f AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_found FROM s b JOIN s d ON d.t = 'd' AND b.t = 'b' AND b.g = d.g GROUP BY ALL)
        SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM f JOIN n ON n.id = item_id WHERE n_found >= 0.75 * n_item""",
    "op11_passages": """
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS a FROM documents),
        win AS (SELECT r, unnest(range(1, len(a) - 33)) AS p FROM w WHERE len(a) >= 35),
        keyed AS (SELECT r, p, sha256(array_to_string(a[p:p + 34], ' ')) AS k FROM win JOIN w USING (r)),
        again AS (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM keyed JOIN again USING (k)),
        begun AS (SELECT r, i, NOT exists (SELECT 1 FROM gone g WHERE g.r = gone.r AND g.i = gone.i - 1) AS head FROM gone),
        mark AS (SELECT r, list(i) AS g, count(*) AS n, count(*) FILTER (head) AS h FROM begun GROUP BY r)
        SELECT doc_id, len(a)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN g IS NULL THEN a ELSE list_transform(list_filter(range(1, len(a) + 1), lambda i: NOT list_contains(g, i)), lambda i: a[i]) END, ' ')) AS kept_sha256,
               coalesce(h, 0)::INTEGER AS n_repeats
        FROM w LEFT JOIN mark USING (r)""",
    "op13_collocations": """
        WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\\x20\\x09]+'), lambda x: x <> '') AS a FROM piece),
        total AS (SELECT lang, sum(len(a))::BIGINT AS n FROM w GROUP BY lang),
        gram AS (SELECT lang, m, array_to_string(a[p:p + m - 1], ' ') AS phrase FROM (SELECT lang, a, m, unnest(range(1, len(a) - m + 2)) AS p FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(a) >= m)),
        f AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS a, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 100),
        cut AS (SELECT lang, m, phrase, f, a, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        scored AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, c.k, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
                   FROM cut c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.a[1:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.a[c.k + 1:], ' ') JOIN total t ON t.lang = c.lang),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = b.lang AND length(x.phrase) > length(b.phrase) AND contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * x.f >= 100 * b.a)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
}
