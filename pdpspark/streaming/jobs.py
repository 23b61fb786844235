"""Structured Streaming forms of the job life cycle: progress, snapshots, item states, catalogue upserts, activity windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import STAGE

EVENT_SCHEMA = "job_id bigint, item bigint, event_id bigint, ts timestamp, status string, percent int"
TIMEOUT_MS = 20 * 60 * 1000
#: An item that says nothing for as long as jobs are kept is forgotten.
KEEP_MS = 7 * 24 * 3600 * 1000


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    """A key's events of one trigger by event_id; Arrow cuts them into chunks in no order. Their number is bounded by the files of a trigger."""
    frames = [f for f in batches if len(f)]
    return pd.concat(frames).sort_values("event_id", ignore_index=True) if frames else None


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Event files as a stream, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def _changes(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows whose percent differs from the one kept; a job that falls silent reports a timeout once."""
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"job_id": [key[0]], "event_id": [-1], "percent": [None], "note": ["timeout"]})
        return
    last = state.get[0] if state.exists else None
    frame = _in_order(batches)
    if frame is not None:
        before = frame["percent"].shift()
        before.iloc[0] = last
        changed = frame[frame["percent"].ne(before)]
        last = int(frame["percent"].iloc[-1])
        if len(changed):
            yield pd.DataFrame({
                "job_id": changed["job_id"], "event_id": changed["event_id"], "percent": changed["percent"], "note": ["changed"] * len(changed),
            })
    if last is not None:
        state.update((last,))
        state.setTimeoutDuration(TIMEOUT_MS)


def job_progress(events: DataFrame) -> DataFrame:
    """Change-only progress per job (M1): the state is the last percent, with a processing-time timeout of 20 minutes."""
    return events.groupBy("job_id").applyInPandasWithState(
        _changes, "job_id bigint, event_id bigint, percent int, note string", "percent int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def job_snapshot(events: DataFrame) -> DataFrame:
    """Latest state per job (M2); run in update or complete mode."""
    rank = F.when(F.col("status") == "completed", 2).when(F.col("status") == "failed", 1).otherwise(0)
    return events.groupBy("job_id").agg(F.max(F.struct("ts", rank.alias("rank"), "status", "percent")).alias("s")).select(
        "job_id", F.col("s.ts").alias("ts"), F.col("s.status").alias("status"), F.col("s.percent").alias("percent"))


def _states(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Legal moves only raise the stage; the state is the highest stage so far and its status."""
    if state.hasTimedOut:
        state.remove()
        return
    top, status = state.get if state.exists else (-1, "")
    frame = _in_order(batches)
    if frame is not None:
        stage = frame["status"].map(STAGE).fillna(-1).astype(int)
        best = stage.cummax().shift(fill_value=-1).clip(lower=top)
        legal = stage > best
        kept = frame["status"].where(legal).ffill().fillna(status)
        top, status = max(top, int(stage.max())), str(kept.iloc[-1])
        yield pd.DataFrame({
            "item": frame["item"], "event_id": frame["event_id"], "status": frame["status"], "legal": legal, "state": kept.replace("", None)})
    state.update((top, status))
    state.setTimeoutDuration(KEEP_MS)


def item_states(events: DataFrame) -> DataFrame:
    """Item state machine (M3): every event with `legal` and the state after it; the state of an item goes after seven silent days."""
    return events.groupBy("item").applyInPandasWithState(
        _states, "item bigint, event_id bigint, status string, legal boolean, state string", "top int, status string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def distinct_content(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One content request per job and slug while both are inside the watermark (M5)."""
    return items.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "slug"])


def expire(events: DataFrame, ttl: str = "7 days") -> DataFrame:
    """Rows younger than the retention time by the clock of each batch (M6)."""
    return events.where(F.col("ts") > F.current_timestamp() - F.expr(f"INTERVAL {ttl}"))


def activity_windows(events: DataFrame, size: str, slide: str | None = None, gap: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts per event-time window, or per session of a user when `gap` is given; late rows fall out (M9)."""
    timed = events.withWatermark("ts", delay)
    if gap is not None:
        return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
            "user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    return timed.groupBy(F.window("ts", size, slide or size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _latest(rows: DataFrame) -> DataFrame:
    """Rows of the highest version of each bucket; the list holds one row a bucket, so its size is the number of buckets."""
    last = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(last), ["bucket", "version"], "left_semi")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue that `upsert_catalog` keeps, one row a key."""
    return _latest(spark.read.option("mergeSchema", True).parquet(path)).drop("bucket", "version")


def upsert_catalog(path: str, key: str = "slug", order: str = "crawled_at", buckets: int = 256) -> Callable[[DataFrame, int], None]:
    """foreachBatch function (M7): the newest crawl of a product replaces its row, and only the buckets of keys in the batch are written.

    The table is cut into `buckets` by the hash of the key (a fixed number for the life of a table, sized so that one bucket is an ordinary
    write). A batch reads the last version of its buckets before it, merges, and writes them as `bucket=b/version=batch`; other buckets are
    neither read nor written, old versions are never touched, so a batch that breaks off or runs again gives the same table. Rows with a null key
    go; of rows with an equal key and order the greatest by all columns stays.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != key]
        spark = batch.sparkSession

        def newest(rows: DataFrame, columns: list[str]) -> DataFrame:
            return rows.groupBy("bucket", key).agg(F.max(F.struct(F.col(order).alias("__order"), *columns)).alias("r")).select(
                "bucket", key, *[F.col(f"r.{c}").alias(c) for c in columns])

        fresh = newest(batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")), rest)
        old = _stored(spark, path)
        if old is not None:
            touched = F.broadcast(fresh.select("bucket").distinct())  # at most `buckets` rows
            old = _latest(old.where(F.col("version") < batch_id).join(touched, "bucket", "left_semi")).drop("version")
            both = old.unionByName(fresh, allowMissingColumns=True)
            fresh = newest(both, [c for c in both.columns if c not in ("bucket", key)])
        fresh.withColumn("version", F.lit(batch_id)).repartition("bucket").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)

    return upsert
