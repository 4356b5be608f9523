"""Tables as distributed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(table: DataFrame, key: str, ranks: int, val: Column) -> DataFrame:
    """(rank, idx, val) from a table with a dense key 0, 1, ...: neighbouring keys go to neighbouring ranks."""
    return table.select((F.col(key) % ranks).cast("int").alias("rank"), F.floor(F.col(key) / ranks).cast("bigint").alias("idx"), val.alias("val"))


def explode(x: DataFrame) -> DataFrame:
    """(rank, idx, val) from the dense form (rank, vals: array)."""
    return x.select("rank", F.posexplode("vals").alias("idx", "val")).withColumn("idx", F.col("idx").cast("bigint"))


def gathered(x: DataFrame) -> DataFrame:
    """The dense form (rank, vals: array) of (rank, idx, val); for buffers that fit a row."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "val")))
    return x.groupBy("rank").agg(F.transform(rows, lambda r: r["val"]).alias("vals"))


def counts(x: DataFrame) -> tuple[int, int]:
    """Smallest and largest number of elements on any rank that has some."""
    row = x.groupBy("rank").agg(F.count("*").alias("n")).agg(F.min("n"), F.max("n")).first()
    return (row[0] or 0, row[1] or 0)
