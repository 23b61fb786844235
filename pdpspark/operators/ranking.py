"""Scores and picks: video frames, image sources, first-n reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordered import first_rows


def score_frames(frames: DataFrame, video: str = "video_id") -> DataFrame:
    """Frame scores (A18): coverage, edges and colour relative to the video's maxima; 0 for near-black or near-white frames.

    The maxima are pre-aggregated per video and joined back, so a long video does not meet in one window.
    """
    tops = frames.groupBy(video).agg(F.max("edge").alias("__e"), F.max("col").alias("__c"))
    top = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    score = F.round(0.45 * F.col("cov") + 0.35 * F.col("edge") / top("__e") + 0.20 * F.col("col") / top("__c"), 4)
    return frames.join(tops, video).withColumn(
        "score", F.when(F.col("mean").between(12, 240), score).otherwise(F.lit(0.0))
    ).drop("__e", "__c")


def top_frames(scored: DataFrame, video: str = "video_id", n: int = 3, gap: float = 2.0) -> DataFrame:
    """Best n frames at least `gap` seconds apart (O4), earlier frame first on ties.

    Greedy picking needs one pass per pick: the best frame left, then only frames far enough from all picks. Each pass is
    a partial aggregate over all videos at once.
    """
    left = cut_lineage(scored.where("score > 0").select(video, "t", "score"))
    best = F.max(F.struct("score", (-F.col("t")).alias("nt"))).alias("b")
    picks = None
    for rank in range(1, n + 1):
        pick = left.groupBy(video).agg(best).select(
            video, F.lit(rank).alias("rank"), (-F.col("b.nt")).alias("t"), F.col("b.score").alias("score")
        )
        picks = pick if picks is None else picks.unionByName(pick)
        if rank < n:
            near = pick.select(video, F.col("t").alias("__t"))
            left = left.join(near, video).where(F.abs(F.col("t") - F.col("__t")) >= gap).drop("__t")
            left = cut_lineage(left)
    return picks


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First n rows per key with their place."""
    return first_rows(df, keys, order, n=n, rank="place")


def keep_ratio(w: Column, h: Column, target: float) -> Column:
    """Share of a picture that stays when it fills a box of the target ratio."""
    r = w / h
    return F.least(r / F.lit(target), F.lit(target) / r)


def pick_source(images: DataFrame, keys: list[str], w: int, h: int, pos: str = "pos") -> DataFrame:
    """Image candidate that loses least in a w x h box, the first on a tie (O7). images: width, height."""
    rows = images.where("width > 0 and height > 0").withColumn("keep", F.round(keep_ratio(F.col("width"), F.col("height"), w / h), 9))
    return rows.groupBy(*keys).agg(F.max(F.struct("keep", (-F.col(pos)).alias("np"))).alias("b")).select(
        *keys, (-F.col("b.np")).alias(pos), F.col("b.keep").alias("keep")
    )


def closest_ratio(images: DataFrame, keys: list[str], target: float, pos: str = "pos") -> DataFrame:
    """Image whose aspect ratio is closest to the target; images without one come last."""
    ar = F.coalesce("ar", F.lit(0.0))
    far = F.when(ar > 0, F.round(F.abs(ar - F.lit(target)), 9)).otherwise(F.lit(1e9))
    return images.groupBy(*keys).agg(F.min(F.struct(far.alias("d"), F.col(pos).alias("p"))).alias("b")).select(
        *keys, F.col("b.p").alias(pos)
    )


def latest_products(products: DataFrame, country: str | None = None) -> DataFrame:
    """Products newest first (O1)."""
    rows = products if country is None else products.where(F.col("country") == country)
    return rows.orderBy(F.desc("crawled_at"), "slug")


def review_first(rows: DataFrame) -> DataFrame:
    """Rows that need review first."""
    return rows.orderBy(F.desc("review"), "row")
