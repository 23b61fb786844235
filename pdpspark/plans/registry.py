"""Named queries: a Spark plan each, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return plan

    return register


WIDE = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TASK_TEXTS = 4000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table that is read in fewer parts than there are cores, or in parts of more than TASK_TEXTS rows, spread for work that is
    heavy per row. Tables of many small files, as on a cluster, stay as they are read.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_TEXTS))
    return df.repartition(parts, key) if df.rdd.getNumPartitions() < parts else df


def wide_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Texts or pages for per-row work: the columns used, spread over the cores."""
    df = table(spark, folder, name)
    return spread(df.select(*columns) if columns else df, WIDE[name])
