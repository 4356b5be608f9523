"""Provenance: which source elements reached each element of a result.

``traced`` puts an element's own place in the stead of its value, so that a plan
that only moves carries places along; ``all_sources`` collects them per element, as
a reduction would. The checks return rows that break an operator's rule, none if it
holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmesh.model import Comm
from rankmesh.operators import collectives as C


def traced(x: DataFrame) -> DataFrame:
    """(rank, idx, val): val tells src_rank and src_idx."""
    return x.select("rank", "idx", F.struct(F.col("rank").alias("src_rank"), F.col("idx").alias("src_idx")).alias("val"))


def all_sources(x: DataFrame, comm: Comm, **how) -> DataFrame:
    """(rank, idx, sources): every place, with repeats, that the plan of ``all_reduce`` takes in for an element."""
    own = traced(x).withColumn("val", F.array("val"))
    return C.all_reduce(own, comm, trace=True, **how).withColumnRenamed("val", "sources")


def broken_reduction(x: DataFrame, comm: Comm | int, **how) -> DataFrame:
    """(idx): elements of an all-reduce that don't come from every rank just once, at their own place, or that a rank doesn't get just once."""
    comm = Comm(comm) if isinstance(comm, int) else comm
    ranks = F.array_sort(F.transform("sources", lambda s: s["src_rank"]))
    whole = (ranks == F.sequence(F.lit(0), F.lit(comm.size - 1))) & F.forall("sources", lambda s: s["src_idx"] == F.col("idx"))
    got = all_sources(x, comm, **how).select("rank", "idx", F.coalesce(whole, F.lit(False)).alias("whole"))
    got = got.groupBy("idx").agg(F.bool_and("whole").alias("whole"), F.count("*").alias("n"), F.countDistinct("rank").alias("ranks"))
    # an element that no rank gets is broken, too
    every = x.select("idx").distinct().join(got, "idx", "full")
    return every.filter(~F.coalesce(F.col("whole") & (F.col("n") == comm.size) & (F.col("ranks") == comm.size), F.lit(False))).select("idx")


def broken_move(result: DataFrame, src_rank: Column, src_idx: Column) -> DataFrame:
    """Elements of a moved traced array that don't come from where the columns, over the result's rank and idx, say."""
    return result.filter((F.col("val.src_rank") != src_rank) | (F.col("val.src_idx") != src_idx))


def broken(result: DataFrame, want: DataFrame) -> DataFrame:
    """Elements of a traced result that aren't there just as ``want`` (rank, idx, src_rank, src_idx) has them, and those that are missing or there twice.

    Where values are arrays of sources, every one of them counts.
    """
    if result.schema["val"].dataType.typeName() == "array":
        result = result.select("rank", "idx", F.explode_outer("val").alias("val"))
    got = result.select(F.col("rank").cast("int").alias("rank"), F.col("idx").cast("bigint").alias("idx"), "val.src_rank", "val.src_idx")
    cols = got.columns
    want = want.select(*[F.col(c).cast(got.schema[c].dataType).alias(c) for c in cols])
    both = got.withColumn("n", F.lit(1)).unionByName(want.withColumn("n", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("n").alias("n")).filter("n != 0")
