"""Collectives over arrays: (rank, idx, vals), where vals is an array of one length for each idx."""

from __future__ import annotations

from functools import reduce as left_fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmesh import validate
from rankmesh.functions import reductions as R
from rankmesh.model import Comm
from rankmesh.operators import collectives as C
from rankmesh.operators.collectives import _everywhere, _split


def all_reduce(x: DataFrame, comm: Comm, op: str = "sum", dtype: str = "fp64", strict: bool = True) -> DataFrame:
    """Every rank gets the arrays reduced place by place over ranks, in the strict order or that of ascending ranks.

    Arrays stay whole: there is no row for each element. With few ranks there is one
    aggregate for each, beyond that one array of the ranks' arrays. A rank without an
    array at an idx counts as one of nulls, which a sum keeps and max and min pass over.
    """
    d = validate.reduction(op, dtype)
    kind = f"array<{d.spark}>"
    # zip_with fills up the shorter array with nulls
    none = F.array().cast(kind)

    def step(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda p, q: R.combine(op, d, p, q).cast(d.spark))

    if comm.size <= R.MOST_COLUMNS:
        parts = x.groupBy("idx").agg(*(F.max(F.when(F.col("rank") == r, F.col("vals"))).cast(kind).alias(f"v{r}") for r in range(comm.size)))
        own = [F.col(f"v{r}") for r in range(comm.size)]
        values = [F.coalesce(v, none) for v in own]
        out = R.in_halving_tree(values, step) if strict else left_fold(step, values)
        out = F.when(F.coalesce(*own).isNotNull(), out)
    else:
        rows = F.array_sort(F.collect_list(F.struct("rank", F.col("vals").cast(kind).alias("vals"))))
        # each rank's place is its own, also where others have no array
        by_rank = F.transform(F.sequence(F.lit(0), F.lit(comm.size - 1)), lambda k: F.get(F.filter("rows", lambda r: r["rank"] == k), 0)["vals"])
        own = F.when(F.size("rows") == comm.size, F.transform("rows", lambda r: r["vals"])).otherwise(by_rank)
        parts = x.groupBy("idx").agg(rows.alias("rows")).select("idx", F.transform(own, lambda v: F.coalesce(v, none)).alias("v"), F.exists("rows", lambda r: r["vals"].isNotNull()).alias("some"))
        out = R.halving_tree_of(F.col("v"), comm.size, step) if strict else F.aggregate(F.slice("v", 2, F.size("v")), F.element_at("v", 1), step)
        out = F.when(F.col("some"), out)
    return _everywhere(parts.select("idx", out.alias("val")), comm).withColumnRenamed("val", "vals")


def reduce_scatter(x: DataFrame, comm: Comm, count: int, op: str = "sum", dtype: str = "fp64", strict: bool = True) -> DataFrame:
    """As ``all_reduce``, but rank r gets the arrays of block r alone; every rank holds ``count`` arrays for each rank."""
    validate.count(count)
    out = all_reduce(x, Comm(comm.size), op, dtype, strict).filter("rank = 0").select("idx", F.col("vals").alias("val"))
    return _split(out, count).withColumnRenamed("val", "vals")


def all_gather(x: DataFrame, comm: Comm, count: int) -> DataFrame:
    """Every rank gets all ranks' arrays, one rank after another; each holds ``count``."""
    return C.all_gather(x.withColumnRenamed("vals", "val"), comm, count).withColumnRenamed("val", "vals")


def all_to_all(x: DataFrame, comm: Comm, count: int) -> DataFrame:
    """Block d of rank s becomes block s of rank d, whole arrays at a time."""
    return C.all_to_all(x.withColumnRenamed("vals", "val"), comm, count).withColumnRenamed("val", "vals")
