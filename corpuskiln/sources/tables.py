"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; times without a zone count as the session's (UTC here)."""
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return rows.withColumns({c: rows[c].cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})
