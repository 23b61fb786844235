"""Bulk jobs: item flags, counters, snapshots, state machine, progress, description filling, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .ordered import Fill, Highest, Prev, first_rows, per_key, scan

CELL_MAX = 32767
MAX_ROWS, MAX_REGISTER = 2000, 300
# How far along an item is; the last three end it.
STAGE = {"queued": 0, "crawling": 1, "working": 2, "ok": 3, "failed": 3, "cancelled": 3}
TTL_DAYS = 7


def review_flags(items: DataFrame) -> DataFrame:
    """One row per flag of an item (F14); items without a flag keep one row with NULL flag columns.

    items: missing_images, missing_texts, frames, all_images, summary_error, fuzzy, alts, channel, status, stage.
    """
    flag = lambda on, code, sev, n: F.when(on, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("sev"), n.cast("bigint").alias("n")))
    failed = F.col("status") == "failed"
    ok = ~failed
    none = F.lit(None)
    flags = F.array_compact(F.array(
        F.when(failed, F.struct(F.col("stage").alias("code"), F.lit("error").alias("sev"), none.cast("bigint").alias("n"))),
        flag(ok & (F.col("missing_images") > 0), "qa", "warn", F.col("missing_images")),
        flag(ok & (F.col("missing_texts") >= 5), "qaTx", "info", F.col("missing_texts")),
        flag(ok & (F.col("frames") > 0), "frame", "info", F.col("frames")),
        flag(ok & (F.col("channel") == "shopee") & (F.col("all_images") > 12), "over12", "info", F.col("all_images")),
        flag(ok & (F.coalesce("summary_error", F.lit("")) != ""), "summary", "warn", none),
        flag(ok & F.coalesce("fuzzy", F.lit(False)), "fuzzy", "warn", none),
        flag(ok & (F.coalesce("alts", F.lit(0)) > 0), "alts", "info", F.col("alts")),
    ))
    return items.select("job_id", "row", F.inline_outer(flags))


def job_view(items: DataFrame, flags: DataFrame | None = None) -> DataFrame:
    """Counters per job (A5). items: job_id, row, status, register, force, crawled, prev_len; flags: job_id, row, sev."""
    rows = items
    if flags is not None:
        due = flags.where(F.col("sev") != "info").select("job_id", "row").distinct().withColumn("review", F.lit(True))
        rows = items.join(due, ["job_id", "row"], "left")
    rows = rows.withColumn("review", F.coalesce("review", F.lit(False)))
    crawl = F.col("register") | F.col("force")
    ok, failed = F.col("status") == "ok", F.col("status") == "failed"
    return rows.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok | failed).alias("done"), F.count_if(ok).alias("ok"), F.count_if(failed).alias("failed"),
        F.count_if(ok & (F.col("prev_len") > 0)).alias("replaced"), F.count_if(crawl).alias("crawl_total"),
        F.count_if(crawl & (F.col("crawled") | failed)).alias("crawl_done"), F.count_if("review").alias("review"),
        F.count_if(ok & ~F.col("review")).alias("clean_ok"),
    )


def failure_kind(jobs: DataFrame, flags: DataFrame) -> DataFrame:
    """Why a job failed, in user terms (F15). jobs: job_id, error; flags: job_id, code, sev."""
    per = flags.where("sev = 'error'").groupBy("job_id").agg(
        F.bool_and(F.col("code") == "crawl").alias("__crawl"), F.bool_and(F.col("code") == "content").alias("__content"))
    e = F.coalesce("error", F.lit(""))
    kind = (
        F.when(e.rlike("(?i)uploaded file expired"), "upload")
        .when(e.rlike("(?i)no row could be filled"), F.when(F.col("__crawl"), "crawl").when(F.col("__content"), "content").otherwise("items"))
        .otherwise("server")
    )
    return jobs.join(per, "job_id", "left").withColumn("kind", kind).drop("__crawl", "__content")


def validate_build(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted items, error per job or NULL) (F16): the first entry of a row number counts; limits are errors, not cuts.

    items: job_id, pos, row, register, force, known BOOLEAN, url_ok BOOLEAN.
    """
    usable = items.where((F.col("row") >= 1) & ((F.col("known") & ~F.col("register")) | (F.col("register") & F.col("url_ok"))))
    kept = first_rows(usable, ["job_id", "row"], ["pos"])
    per = kept.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("register") | F.col("force")).alias("reg"))
    n, reg = F.coalesce("n", F.lit(0)), F.coalesce("reg", F.lit(0))
    error = F.when(n == 0, "no_items").when(n > MAX_ROWS, "too_many_rows").when(reg > MAX_REGISTER, "too_many_register")
    return kept, items.select("job_id").distinct().join(per, "job_id", "left").select("job_id", n.alias("n_items"), reg.alias("n_register"), error.alias("error"))


def fill_descriptions(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Description cells after a job (K3). rows: row, slug, status, old; content: slug, text.

    A row changes only when its status is ok; texts past the cell limit are errors; prev_len is the length replaced.
    Of a text past the limit only its length meets the rows, and texts are never broadcast, however small their table looks.
    """
    length = F.length("text")
    fitting = content.withColumns({"__size": length, "text": F.when(length <= CELL_MAX, F.col("text"))})
    joined = rows.join(fitting.hint("merge"), "slug", "left")
    size = F.col("__size")
    long = (F.col("status") == "ok") & F.coalesce(size > CELL_MAX, F.lit(False))
    ok = (F.col("status") == "ok") & F.col("text").isNotNull()
    return joined.withColumns({
        "value": F.when(ok, F.col("text")).otherwise(F.col("old")),
        "prev_len": F.when(ok, F.length(F.trim(F.coalesce("old", F.lit(""))))),
        "fill_error": F.when(long, F.concat(F.lit("too long for one cell: "), size.cast("string"))),
    }).drop("text", "__size")


def job_snapshot(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Latest state per job (M2): completed beats failed beats processing at the same instant. events: ts, status, percent."""
    rank = F.when(F.col("status") == "completed", 2).when(F.col("status") == "failed", 1).otherwise(0)
    return events.groupBy(key).agg(F.max(F.struct("ts", rank.alias("rank"), "status", "percent")).alias("s")).select(
        key, F.col("s.ts").alias("ts"), F.col("s.status").alias("status"), F.col("s.percent").alias("percent")
    )


def stage_of(status: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STAGE.items() for x in pair])
    return F.try_element_at(table, urls._c(status))


@per_key
def item_states(events: DataFrame, keys, order, status: str = "status", block=None) -> DataFrame:
    """Every event with `legal` and `state` (M3): items only move forward and an ended item stays ended.

    An event is legal when its stage is past the highest one so far (an illegal event never is, so the running maximum
    over all events equals the one over legal events); the state is the status of the last legal event.
    """
    staged = events.withColumn("__stage", stage_of(status))
    seen = scan(staged, keys, order, [Highest("__top", F.col("__stage"), strict=True)], block)
    judged = seen.withColumn("legal", F.coalesce(F.col("__stage") > F.coalesce("__top", F.lit(-1)), F.lit(False)))
    out = scan(judged, keys, order, [Fill("state", F.when(F.col("legal"), F.col(status)))], block)
    return out.drop("__stage", "__top")


@per_key
def job_progress(events: DataFrame, keys, order, percent: str = "percent", block=None) -> DataFrame:
    """Events whose percent differs from the one before (M1)."""
    out = scan(events, keys, order, [Prev("__p", F.struct(F.col(percent).alias("v")))], block)
    return out.where(F.col("__p").isNull() | ~F.col("__p.v").eqNullSafe(F.col(percent))).drop("__p")


def distinct_content(items: DataFrame) -> DataFrame:
    """One content computation per (job, slug) (M5)."""
    return items.dropDuplicates(["job_id", "slug"])


def expire(df: DataFrame, at: str, ttl: str = "INTERVAL 7 DAYS", now: Column | None = None) -> DataFrame:
    """Rows younger than the retention time (M6)."""
    limit = (now if now is not None else F.current_timestamp()) - F.expr(ttl)
    return df.where(F.col(at) > limit)


def tumbling(events: DataFrame, size: str = "1 day", kind: str = "event_type") -> DataFrame:
    """Counts per fixed window and kind (M9)."""
    return events.groupBy(F.window("ts", size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), kind, "n")


@per_key
def sessions(events: DataFrame, keys, order, gap_seconds: int = 1800, block=None) -> DataFrame:
    """Sessions by inactivity as islands (M9): the batch form that stays parallel inside one hot user.

    An event starts a session when the event before is `gap_seconds` or more away, as session_window has it.
    """
    from .ordered import islands

    numbered = islands(
        events, keys, order, F.struct(F.col("ts").alias("ts")),
        lambda p: F.unix_micros("ts") - F.unix_micros(p["ts"]) < F.lit(gap_seconds * 1_000_000), "session", block,
    )
    return numbered.groupBy(*keys, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


def apply_scene(media: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(media, rejected choices) (V6): a chosen scene must be one of those offered; the first source stays known.

    media: page_id, video, url, first_src, alternatives ARRAY<STRING>, confirmed; choices: page_id, video, src.
    """
    first = F.coalesce("first_src", "url")
    options = F.array_distinct(F.array_prepend(F.coalesce("alternatives", F.array().cast("array<string>")), first))
    asked = media.withColumns({"__first": first, "__options": options}).join(choices, ["page_id", "video"], "left")
    good = F.coalesce(F.array_contains("__options", F.col("src")), F.lit(False))
    updated = asked.withColumns({
        "url": F.when(good, F.col("src")).otherwise(F.col("url")), "first_src": F.when(good, F.col("__first")).otherwise(F.col("first_src")),
        "confirmed": F.col("confirmed") | good,
    }).select(*media.columns)
    offered = media.select("page_id", "video", F.array_distinct(F.array_prepend(F.coalesce("alternatives", F.array().cast("array<string>")), first)).alias("__o"))
    rejects = choices.join(offered, ["page_id", "video"], "left").where(~F.coalesce(F.array_contains("__o", F.col("src")), F.lit(False))).withColumn(
        "reason", F.when(F.col("__o").isNull(), "video not found").otherwise("not an offered scene")).drop("__o")
    return updated, rejects


def item_key(url: Column | str) -> Column:
    return urls.slugify(url)
