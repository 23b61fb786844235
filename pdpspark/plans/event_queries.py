"""Queries over events: jobs, flags, progress, states, versions, geometry rows, frame scores, activity windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs, media, ranking, store
from ..operators.ordered import scan, Total
from .registry import query, table

STATUS = {"view": "queued", "click": "crawling", "signup": "working", "purchase": "ok", "error": "failed"}
SQL_STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'crawling' WHEN 'signup' THEN 'working' WHEN 'purchase' THEN 'ok' ELSE 'failed' END"


def status_col():
    out = None
    for kind, status in STATUS.items():
        out = F.when(F.col("event_type") == kind, status) if out is None else out.when(F.col("event_type") == kind, status)
    return out


def events(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value", "props").withColumn("status", status_col())


def k_of():
    return F.get_json_object("props", "$.k").cast("int")


SQL_K = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("rows_per_section", f"""
WITH g AS (SELECT user_id AS sec, CAST(floor(value * 10) AS INT) AS rt, {SQL_K} % 7 AS rl, CAST(floor(value * 20) AS INT) AS rw FROM events),
r AS (SELECT sec, floor(rt / 40.0 + 0.5) AS row, count(DISTINCT rl) AS n, min({{'rt': rt, 'rl': rl, 'rw': rw}}) AS f FROM g GROUP BY ALL),
s AS (SELECT sec, max(n) AS n, min(f) AS f FROM r GROUP BY sec)
SELECT sec, n AS imgs_per_row, CASE WHEN n >= 4 THEN 'grid-4' WHEN n = 3 THEN 'grid-3' WHEN f.rw >= 1000 THEN 'full-width' END AS layout FROM s
""")
def rows_per_section(spark, folder):
    """Most pictures on one row per section."""
    g = table(spark, folder, "events").select(
        F.col("user_id").alias("sec"), F.floor(F.col("value") * 10).cast("int").alias("rt"), (k_of() % 7).alias("rl"), F.floor(F.col("value") * 20).cast("int").alias("rw"))
    return media.rows_per_section(g, ["sec"])


SQL_FRAMES = f"""f AS (SELECT user_id AS video_id, event_id, CAST(event_id % 600 AS DOUBLE) / 2 AS t, value AS mean, ({SQL_K} % 97) / 97.0::DOUBLE AS cov, {SQL_K}::DOUBLE AS edge, (event_id % 37)::DOUBLE AS col FROM events),
m AS (SELECT video_id, CASE WHEN max(edge) = 0 THEN 1 ELSE max(edge) END AS me, CASE WHEN max(col) = 0 THEN 1 ELSE max(col) END AS mc FROM f GROUP BY video_id),
s AS (SELECT f.video_id, event_id, t, CASE WHEN mean BETWEEN 12 AND 240 THEN round(0.45::DOUBLE * cov + 0.35::DOUBLE * edge / me + 0.20::DOUBLE * col / mc, 4) ELSE 0.0::DOUBLE END AS score FROM f JOIN m USING (video_id))"""


def frames(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").alias("video_id"), "event_id", ((F.col("event_id") % 600).cast("double") / 2).alias("t"), F.col("value").alias("mean"),
        ((k_of() % 97) / F.lit(97.0)).alias("cov"), k_of().cast("double").alias("edge"), (F.col("event_id") % 37).cast("double").alias("col"))


@query("frame_scores", f"WITH {SQL_FRAMES} SELECT video_id, event_id, score FROM s")
def frame_scores(spark, folder):
    """Frame scores relative to the maxima of their video."""
    return ranking.score_frames(frames(spark, folder)).select("video_id", "event_id", "score")


@query("frame_top3", f"""
WITH {SQL_FRAMES}, p AS (SELECT DISTINCT video_id, t, score FROM s WHERE score > 0),
a AS (SELECT video_id, 1 AS rank, first(t ORDER BY score DESC, t) AS t, max(score) AS score FROM p GROUP BY video_id),
p2 AS (SELECT p.* FROM p JOIN a USING (video_id) WHERE abs(p.t - a.t) >= 2), b AS (SELECT video_id, 2 AS rank, first(t ORDER BY score DESC, t) AS t, max(score) AS score FROM p2 GROUP BY video_id),
p3 AS (SELECT p2.* FROM p2 JOIN b USING (video_id) WHERE abs(p2.t - b.t) >= 2), c AS (SELECT video_id, 3 AS rank, first(t ORDER BY score DESC, t) AS t, max(score) AS score FROM p3 GROUP BY video_id)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c
""")
def frame_top3(spark, folder):
    """Best three frames per video at least two seconds apart."""
    return ranking.top_frames(ranking.score_frames(frames(spark, folder)))


def items(spark, folder):
    """Job items made of events: a job per user, a row per event."""
    e = F.col("event_id")
    return events(spark, folder).select(
        F.col("user_id").alias("job_id"), e.alias("row"), F.when(F.col("event_type") == "click", "working").otherwise(F.col("status")).alias("status"),
        (e % 4 == 0).alias("register"), (e % 9 == 0).alias("force"), (e % 3 == 0).alias("crawled"), (k_of() % 5).alias("prev_len"),
        (k_of() % 3).alias("missing_images"), (k_of() % 8).alias("missing_texts"), F.when(e % 6 == 0, 2).otherwise(0).alias("frames"),
        (k_of() % 20).alias("all_images"), F.when(e % 25 == 0, "oops").otherwise("").alias("summary_error"), (e % 50 == 0).alias("fuzzy"),
        (e % 5).alias("alts"), F.when(F.col("user_id") % 2 == 0, "shopee").otherwise("lazada").alias("channel"),
        F.when(e % 2 == 0, "crawl").otherwise("content").alias("stage"))


SQL_ITEMS = f"""it AS (SELECT user_id AS job_id, event_id AS "row", CASE WHEN event_type = 'click' THEN 'working' ELSE {SQL_STATUS} END AS status, event_id % 4 = 0 AS register, event_id % 9 = 0 AS force, event_id % 3 = 0 AS crawled,
  {SQL_K} % 5 AS prev_len, {SQL_K} % 3 AS mi, {SQL_K} % 8 AS mt, CASE WHEN event_id % 6 = 0 THEN 2 ELSE 0 END AS fr, {SQL_K} % 20 AS ai, event_id % 25 = 0 AS se, event_id % 50 = 0 AS fz, event_id % 5 AS al, user_id % 2 = 0 AS shopee, event_id % 2 = 0 AS cr FROM events),
fl AS (SELECT job_id, "row", unnest(list_filter([CASE WHEN status = 'failed' THEN {{'code': CASE WHEN cr THEN 'crawl' ELSE 'content' END, 'sev': 'error', 'n': CAST(NULL AS BIGINT)}} END,
  CASE WHEN status <> 'failed' AND mi > 0 THEN {{'code': 'qa', 'sev': 'warn', 'n': mi::BIGINT}} END, CASE WHEN status <> 'failed' AND mt >= 5 THEN {{'code': 'qaTx', 'sev': 'info', 'n': mt::BIGINT}} END,
  CASE WHEN status <> 'failed' AND fr > 0 THEN {{'code': 'frame', 'sev': 'info', 'n': fr::BIGINT}} END, CASE WHEN status <> 'failed' AND shopee AND ai > 12 THEN {{'code': 'over12', 'sev': 'info', 'n': ai::BIGINT}} END,
  CASE WHEN status <> 'failed' AND se THEN {{'code': 'summary', 'sev': 'warn', 'n': CAST(NULL AS BIGINT)}} END, CASE WHEN status <> 'failed' AND fz THEN {{'code': 'fuzzy', 'sev': 'warn', 'n': CAST(NULL AS BIGINT)}} END,
  CASE WHEN status <> 'failed' AND al > 0 THEN {{'code': 'alts', 'sev': 'info', 'n': al::BIGINT}} END], lambda x: x IS NOT NULL)) AS f FROM it)"""


@query("job_flags", f"""WITH {SQL_ITEMS}, a AS (SELECT job_id, "row", f.code AS code, f.sev AS sev, f.n AS n FROM fl)
SELECT it.job_id, it."row", code, sev, n FROM it LEFT JOIN a USING (job_id, "row")""")
def job_flags(spark, folder):
    """Review flags per item; items without one keep an empty row."""
    return jobs.review_flags(items(spark, folder))


@query("job_view", f"""
WITH {SQL_ITEMS}, r AS (SELECT DISTINCT job_id, "row" FROM fl WHERE f.sev <> 'info'), j AS (SELECT it.*, r."row" IS NOT NULL AS review FROM it LEFT JOIN r USING (job_id, "row"))
SELECT job_id, count(*) AS total, count(*) FILTER (status IN ('ok', 'failed')) AS done, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (status = 'ok' AND prev_len > 0) AS replaced, count(*) FILTER (register OR force) AS crawl_total, count(*) FILTER ((register OR force) AND (crawled OR status = 'failed')) AS crawl_done,
 count(*) FILTER (review) AS review, count(*) FILTER (status = 'ok' AND NOT review) AS clean_ok FROM j GROUP BY job_id
""")
def job_view(spark, folder):
    """Counters per job, review rows from the flags."""
    it = items(spark, folder)
    return jobs.job_view(it, jobs.review_flags(it).where("code is not null"))


@query("failure_kinds", f"""
WITH {SQL_ITEMS}, e AS (SELECT job_id, bool_and(f.code = 'crawl') AS c, bool_and(f.code = 'content') AS t FROM fl WHERE f.sev = 'error' GROUP BY ALL),
j AS (SELECT DISTINCT user_id AS job_id FROM events)
SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'upload' WHEN job_id % 5 < 3 THEN CASE WHEN c THEN 'crawl' WHEN t THEN 'content' ELSE 'items' END ELSE 'server' END AS kind FROM j LEFT JOIN e USING (job_id)
""")
def failure_kinds(spark, folder):
    """Why a job failed."""
    flags = jobs.review_flags(items(spark, folder)).where("code is not null")
    j = table(spark, folder, "events").select(F.col("user_id").alias("job_id")).distinct().withColumn(
        "error", F.when(F.col("job_id") % 5 == 0, "uploaded file expired").when(F.col("job_id") % 5 < 3, "no row could be filled").otherwise("boom"))
    return jobs.failure_kind(j, flags).select("job_id", "kind")


@query("build_check", f"""
WITH b AS (SELECT user_id AS job_id, event_id AS pos, CAST(floor(value) AS BIGINT) AS "row", event_id % 3 = 0 AS register, event_id % 7 = 0 AS force, {SQL_K} % 2 = 0 AS known, {SQL_K} % 3 = 0 AS url_ok FROM events),
u AS (SELECT * FROM b WHERE "row" >= 1 AND ((known AND NOT register) OR (register AND url_ok)) QUALIFY row_number() OVER (PARTITION BY job_id, "row" ORDER BY pos) = 1),
p AS (SELECT job_id, count(*) AS n, count(*) FILTER (register OR force) AS r FROM u GROUP BY ALL)
SELECT j.job_id, coalesce(n, 0) AS n_items, coalesce(r, 0) AS n_register, CASE WHEN coalesce(n, 0) = 0 THEN 'no_items' WHEN n > 2000 THEN 'too_many_rows' WHEN r > 300 THEN 'too_many_register' END AS error
FROM (SELECT DISTINCT job_id FROM b) j LEFT JOIN p ON p.job_id = j.job_id
""")
def build_check(spark, folder):
    """Request checks of a bulk job (F16)."""
    b = table(spark, folder, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("pos"), F.floor("value").alias("row"), (F.col("event_id") % 3 == 0).alias("register"),
        (F.col("event_id") % 7 == 0).alias("force"), (k_of() % 2 == 0).alias("known"), (k_of() % 3 == 0).alias("url_ok"))
    return jobs.validate_build(b)[1]


@query("job_snapshot", f"""
WITH e AS (SELECT user_id AS job_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status, {SQL_K} AS percent FROM events)
SELECT job_id, max(ts) AS ts, first(status ORDER BY ts DESC, CASE status WHEN 'completed' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END DESC, status DESC, percent DESC) AS status,
  first(percent ORDER BY ts DESC, CASE status WHEN 'completed' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END DESC, status DESC, percent DESC) AS percent FROM e GROUP BY job_id
""")
def job_snapshot(spark, folder):
    """Latest state per job (M2)."""
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("processing")
    e = table(spark, folder, "events").select(F.col("user_id").alias("job_id"), "ts", status.alias("status"), k_of().alias("percent"))
    return jobs.job_snapshot(e)


@query("job_states", f"""
WITH e AS (SELECT user_id * 100 + CAST(floor(value / 20) AS BIGINT) AS item, event_id, {SQL_STATUS} AS status FROM events),
s AS (SELECT *, CASE status WHEN 'queued' THEN 0 WHEN 'crawling' THEN 1 WHEN 'working' THEN 2 ELSE 3 END AS stage FROM e),
t AS (SELECT *, stage > coalesce(max(stage) OVER (PARTITION BY item ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS legal FROM s)
SELECT item, event_id, status, legal, last_value(CASE WHEN legal THEN status END IGNORE NULLS) OVER (PARTITION BY item ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS state FROM t
""")
def job_states(spark, folder):
    """Item state machine: forward moves only (M3)."""
    e = events(spark, folder).select((F.col("user_id") * 100 + F.floor(F.col("value") / 20)).alias("item"), "event_id", "status")
    return jobs.item_states(e, ["item"], ["event_id"])


@query("job_progress", f"""
WITH e AS (SELECT user_id AS job_id, event_id, {SQL_K} // 25 * 25 AS percent FROM events)
SELECT job_id, event_id, percent FROM e QUALIFY percent IS DISTINCT FROM lag(percent) OVER (PARTITION BY job_id ORDER BY event_id)
""")
def job_progress(spark, folder):
    """Events that change the percent of a job (M1)."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("job_id"), "event_id", (F.floor(k_of() / 25) * 25).cast("int").alias("percent"))
    return jobs.job_progress(e, ["job_id"], ["event_id"])


@query("distinct_content", f"SELECT DISTINCT user_id AS job_id, {SQL_K} AS slug FROM events")
def distinct_content(spark, folder):
    """One content computation per job and slug (M5)."""
    return jobs.distinct_content(table(spark, folder, "events").select(F.col("user_id").alias("job_id"), k_of().alias("slug")))


@query("kept_jobs", "SELECT event_id, user_id FROM events WHERE ts > (TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY)")
def kept_jobs(spark, folder):
    """Rows inside the retention time (M6)."""
    e = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return jobs.expire(e, "ts", now=F.lit("2024-01-25 00:00:00").cast(e.schema["ts"].dataType)).select("event_id", "user_id")


@query("activity_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def activity_tumbling(spark, folder):
    """Counts per day and type (M9)."""
    return jobs.tumbling(table(spark, folder, "events"), "1 day")


@query("activity_session", """
WITH p AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pt, event_id FROM events),
s AS (SELECT *, sum(CASE WHEN pt IS NOT NULL AND epoch_us(ts) - epoch_us(pt) < 14400000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM p)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session
""")
def activity_session(spark, folder):
    """Sessions by four hours of inactivity (M9), parallel inside one hot user."""
    e = table(spark, folder, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return jobs.sessions(e, ["user_id"], ["ts", "event_id"], 14400)


def versions(spark, folder):
    """Versioned texts made of events: a product per user, numbered in order."""
    e = table(spark, folder, "events").select(
        F.col("user_id").alias("key"), "event_id", "ts", F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("corp"),
        F.when(k_of() % 6 == 0, "").otherwise(F.col("props")).alias("details"), (k_of() % 10 == 3).alias("deleted"))
    return scan(e, ["key"], ["event_id"], [Total("v", F.lit(1))]).withColumn("v", F.col("v").cast("int"))


SQL_VERSIONS = f"""ve AS (SELECT user_id AS key, event_id, ts, 'c' || (user_id % 4) AS corp, CASE WHEN {SQL_K} % 6 = 0 THEN '' ELSE props END AS details, {SQL_K} % 10 = 3 AS deleted,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS v FROM events)"""


@query("version_current", f"""
WITH {SQL_VERSIONS}, r AS (SELECT * FROM ve WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE WHEN v = key % 30 + 1 THEN 1 ELSE 0 END DESC, v DESC) = 1)
SELECT key, v::INT AS v, details FROM r WHERE details <> ''
""")
def version_current(spark, folder):
    """Version a product shows: pinned if it still exists, else the last; blank ones show nothing (V2)."""
    s = versions(spark, folder)
    pins = s.select("key").distinct().withColumn("v", (F.col("key") % 30 + 1).cast("int"))
    return store.current_version(s, pins, ["key"], blank=F.col("details") == "").select("key", "v", "details")


@query("version_index", f"WITH {SQL_VERSIONS} SELECT corp, key, max(v)::INT AS v, max_by(ts, v) AS ts FROM ve WHERE NOT deleted GROUP BY ALL")
def version_index(spark, folder):
    """Latest live version per corporation and product (V4)."""
    return store.listing_index(versions(spark, folder), "corp", ["key"]).select("corp", "key", "v", "ts")


@query("version_append", f"""
WITH {SQL_VERSIONS}, t AS (SELECT key, max(v) AS top FROM ve GROUP BY key), n AS (SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY event_id) AS r FROM ve WHERE event_id % 10 = 0)
SELECT n.key, n.event_id, (top + r)::INT AS v FROM n JOIN t ON t.key = n.key
""")
def version_append(spark, folder):
    """Numbers of appended versions go on after the highest ever given (V1)."""
    s = versions(spark, folder)
    batch = s.where("event_id % 10 = 0").drop("v", "deleted").withColumn("note", F.lit("new"))
    out = store.add_version(s.withColumn("note", F.lit("old")), batch, ["key"], ["event_id"])
    return out.where("note = 'new'").select("key", "event_id", "v")


@query("version_delete", f"""
WITH {SQL_VERSIONS}, p AS (SELECT DISTINCT key, (key % 30 + 1)::INT AS v FROM ve), g AS (SELECT key, v FROM ve WHERE v % 4 = 0)
SELECT p.key, p.v::INT AS v, (SELECT count(*) FROM ve WHERE ve.key = p.key AND NOT deleted AND v % 4 <> 0) AS live FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.key = p.key AND g.v = p.v)
""")
def version_delete(spark, folder):
    """Deleted versions become tombstones and lose their pins (V3)."""
    s = versions(spark, folder)
    pins = s.select("key").distinct().withColumn("v", (F.col("key") % 30 + 1).cast("int"))
    left, kept = store.delete_version(s, pins, s.where("v % 4 = 0").select("key", "v"), ["key"])
    live = left.groupBy("key").agg(F.count_if(~F.col("deleted")).alias("live"))
    return kept.join(live, "key").select("key", "v", "live")


@query("soft_delete", """
SELECT user_id AS slug, event_id, CASE WHEN user_id % 7 = 0 THEN 'trash/t1/' || user_id END AS trash_key FROM events
""")
def soft_delete(spark, folder):
    """Product rows split into the remaining ones and the trash with its stamp (K7)."""
    e = table(spark, folder, "events").select(F.col("user_id").alias("slug"), "event_id")
    rest, trash = store.soft_delete(e, e.where("slug % 7 = 0").select("slug"), "t1")
    return rest.withColumn("trash_key", F.lit(None).cast("string")).unionByName(trash.select("slug", "event_id", "trash_key"))


@query("bundle_entries", """
WITH e AS (SELECT event_id, left(md5(event_id::VARCHAR), CASE WHEN event_id % 11 = 0 THEN 19 ELSE 20 END) AS hash, CASE WHEN event_id % 13 = 0 THEN 'x.gif' ELSE 'slice-' || (event_id % 5) || '.jpg' END AS file,
  'p' || user_id || '/' || CASE WHEN event_id % 17 = 0 THEN 'same' ELSE event_id::VARCHAR END || '.jpg' AS path FROM events),
c AS (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM e)
SELECT event_id, CASE WHEN length(hash) <> 20 THEN 'bad hash' WHEN file = 'x.gif' THEN 'bad file' WHEN n > 1 THEN 'duplicate path' END AS problem FROM c
""")
def bundle_entries(spark, folder):
    """Manifest entries with their problem (K8)."""
    e = F.col("event_id")
    entries = table(spark, folder, "events").select(
        "event_id", F.left(F.md5(e.cast("string")), F.when(e % 11 == 0, 19).otherwise(20)).alias("hash"),
        F.when(e % 13 == 0, "x.gif").otherwise(F.concat(F.lit("slice-"), (e % 5).cast("string"), F.lit(".jpg"))).alias("file"),
        F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit("/"), F.when(e % 17 == 0, "same").otherwise(e.cast("string")), F.lit(".jpg")).alias("path"))
    return store.bundle_manifest(entries, entries.select("hash", "file"))[0].select("event_id", "problem")


@query("scene_choices", f"""
WITH m AS (SELECT event_id AS video, 'f' || event_id AS url, ['a' || event_id, 'b' || event_id] AS alt, {SQL_K} AS k FROM events),
c AS (SELECT *, CASE k % 4 WHEN 0 THEN 'a' || video WHEN 1 THEN 'f' || video WHEN 2 THEN 'zz' END AS src FROM m)
SELECT video, CASE WHEN k % 4 < 2 THEN src ELSE url END AS url, CASE WHEN k % 4 < 2 THEN url END AS first_src, k % 4 < 2 AS confirmed FROM c
""")
def scene_choices(spark, folder):
    """Chosen scenes applied when offered, the first source kept (V6)."""
    e = F.col("event_id").cast("string")
    m = table(spark, folder, "events").select(
        F.col("user_id").alias("page_id"), F.col("event_id").alias("video"), F.concat(F.lit("f"), e).alias("url"), F.lit(None).cast("string").alias("first_src"),
        F.array(F.concat(F.lit("a"), e), F.concat(F.lit("b"), e)).alias("alternatives"), F.lit(False).alias("confirmed"), k_of().alias("k"))
    src = F.when(F.col("k") % 4 == 0, F.concat(F.lit("a"), F.col("video").cast("string"))).when(
        F.col("k") % 4 == 1, F.concat(F.lit("f"), F.col("video").cast("string"))).otherwise("zz")
    choices = m.where("k % 4 < 3").select("page_id", "video", src.alias("src"))
    return jobs.apply_scene(m.drop("k"), choices)[0].select("video", "url", "first_src", "confirmed")


@query("latest_products", "SELECT user_id AS slug, max(ts) AS crawled_at, 'c' || (user_id % 3) AS country FROM events WHERE user_id % 3 = 1 GROUP BY ALL")
def latest_products(spark, folder):
    """Products of a country, newest first (O1)."""
    p = table(spark, folder, "events").groupBy(F.col("user_id").alias("slug")).agg(F.max("ts").alias("crawled_at")).withColumn(
        "country", F.concat(F.lit("c"), (F.col("slug") % 3).cast("string")))
    return ranking.latest_products(p, "c1")
