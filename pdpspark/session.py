"""Session defaults for standalone runs; on a cluster the submitted settings win."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "pdpspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the plans that are made and run inside; the former ones come back after."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or for a local session without it one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="pdpspark-shared-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


TASK_ROWS = 200_000


def dealt(df: DataFrame, keys: Sequence[str], rows: int, most: int = TASK_ROWS) -> DataFrame:
    """df dealt out by keys, about `most` of its `rows` rows to a task; one that is no more than that on each core stays as it is.

    Adaptive execution joins shuffle partitions by their compressed bytes, which for wide or repetitive rows are a small part of the memory
    that sorts and windows take. A number given here stands.
    """
    n = -(-rows // most)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


#: Shuffle files go when the table made from them is written.
FREED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Without adaptive execution a materialised table keeps the keys it is dealt out by, so that joins by them find it in place.
IN_PLACE = FREED | {"spark.sql.adaptive.enabled": "false"}


def beside(df: DataFrame, keys: Sequence[str], rows: int, most: int = TASK_ROWS) -> DataFrame:
    """df dealt out by keys as `placed` deals a table of so many rows, so that the two meet without another shuffle."""
    return df.repartition(max(-(-rows // most), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def placed(df: DataFrame, keys: Sequence[str], rows: int, most: int = TASK_ROWS) -> DataFrame:
    """df dealt out by keys, about `most` of its `rows` rows to a task, and materialised so: joins and groups by the keys don't shuffle it again."""
    with settings(df.sparkSession, IN_PLACE):
        return cut_lineage(beside(df, keys, rows, most))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder the cluster names, so that lost executors replay only from there.

    A local session without that setting (unit tests) gets a folder of its own; a cluster without it keeps the longer plan.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                return df
            folder = tempfile.mkdtemp(prefix="pdpspark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
