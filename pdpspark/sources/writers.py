"""Writers: product tables by country, filled sheets, trash."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_products(tables: dict[str, DataFrame], path: str, partition: str = "country") -> None:
    """Write product tables (K1); only the partitions that occur are replaced."""
    for name, frame in tables.items():
        writer = frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if partition in frame.columns:
            writer = writer.partitionBy(partition)
        writer.parquet(f"{path}/{name}")


def write_sheet(rows: DataFrame, path: str, key: str = "upload_id") -> None:
    """Write filled description sheets as CSV, one folder per upload (K3)."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).partitionBy(key).csv(path)


def append_trash(trash: DataFrame, path: str) -> None:
    """Keep deleted rows by their stamp (K7)."""
    trash.write.mode("append").partitionBy("stamp").parquet(path)
