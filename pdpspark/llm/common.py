"""Helpers that the operators of this subpackage share: reading tables, shared folders, words and shingles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words end at space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE_WORDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a session without that setting (tests) gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    """Batches to Python are bounded by bytes from now on, as whole texts go there; Spark's own bound is rows and 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and gives the optimizer its true size."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Lower-cased words of the whole text, in order; null for null."""
    return F.filter(F.split(ascii_lower(text), SPACES), lambda w: w != "")


def shingle_hashes(tokens: Column, k: int = SHINGLE_WORDS) -> Column:
    """64-bit hashes of the k-word shingles; an empty array where there are fewer words."""
    spans = F.when(F.size(tokens) >= k, F.sequence(F.lit(1), F.size(tokens) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(spans, lambda i: F.xxhash64(F.slice(tokens, i, k)))
