"""Preconditions. Wrong arguments raise ValueError, combinations that aren't supported NotImplementedError."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmesh.model import DTYPES, MOST_COUNT, REDUCTIONS, Comm, DType


def dtype_of(name: str, moving: bool = True) -> DType:
    if name not in DTYPES:
        raise ValueError(f"no such element type: {name}")
    if moving and not DTYPES[name].moves:
        raise NotImplementedError(f"{name} can't be moved")
    return DTYPES[name]


def reduction(op: str, dtype: str, operator: str = "all_reduce") -> DType:
    """Whether ``operator`` may reduce ``dtype`` by ``op``."""
    d = dtype_of(dtype, moving=False)
    if op not in REDUCTIONS:
        raise ValueError(f"no such reduction: {op}")
    if operator == "reduce_scatter" and dtype == "hif8":
        raise NotImplementedError("hif8 may be reduced here, but its arithmetic is the device's and unknown")
    if not d.reduces or operator == "reduce_scatter_v" and dtype in ("uint64", "fp64", "hif8"):
        raise NotImplementedError(f"{operator} doesn't reduce {dtype}")
    if op == "prod" and not d.multiplies:
        raise NotImplementedError(f"{dtype} has no product")
    return d


def root(comm: Comm, rank: int) -> None:
    if not comm.has(rank):
        raise ValueError(f"rank {rank} isn't one of the {comm.size}")


def count(n: int, divisor: int = 1) -> None:
    if not 0 <= n <= MOST_COUNT:
        raise ValueError(f"a count of {n} is out of range")
    if n % divisor:
        raise ValueError(f"{n} elements can't be split evenly among {divisor} ranks")


def none(rows: DataFrame, bad: Column, what: str) -> None:
    """Raise if any row is bad; at most one row reaches the driver."""
    found = rows.filter(bad).limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0].asDict()}")


def dense(x: DataFrame, comm: Comm, n: int) -> None:
    """Every rank holds elements 0 to n - 1 once: same counts everywhere, no holes, no nulls."""
    none(x, F.col("val").isNull() | F.col("rank").isNull() | F.col("idx").isNull() | ~F.col("rank").between(0, comm.size - 1) | ~F.col("idx").between(0, n - 1), "an element that no buffer has")
    per = x.groupBy("rank").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("places"))
    none(per, (F.col("n") != n) | (F.col("places") != n), "a rank with another count, or an element held twice")


def extents(rows: DataFrame, comm: Comm, cnt: str = "cnt", displ: str = "displ", key: str = "rank", apart: list[str] | None = None) -> None:
    """Counts and displacements aren't negative, ranks exist and come once; with ``apart``, intervals of the same ``apart`` don't overlap."""
    none(rows, (F.col(cnt) < 0) | (F.col(displ) < 0) | (F.col(cnt) > MOST_COUNT) | ~F.col(key).between(0, comm.size - 1), "an extent out of range")
    if apart is not None:
        from pyspark.sql import Window

        # ranges without length touch nothing; the number of extents is bounded by the ranks
        order = Window.partitionBy(*(apart or [F.lit(0)])).orderBy(displ)
        end = F.max(F.col(displ) + F.col(cnt)).over(order.rowsBetween(Window.unboundedPreceding, -1))
        none(rows.filter(F.col(cnt) > 0).withColumn("before", end), F.col("before") > F.col(displ), "overlapping extents")


def blocks(rows: DataFrame, comm: Comm) -> None:
    """Extents (src, dst, scnt, sdispl, rcnt, rdispl): counts in range, what is sent is what is received, and no pair comes twice."""
    some = [F.col(c).between(0, MOST_COUNT) for c in ("scnt", "sdispl", "rcnt", "rdispl")] + [F.col(c).between(0, comm.size - 1) for c in ("src", "dst")]
    none(rows, ~F.coalesce(reduce(and_, some), F.lit(False)), "an extent out of range")
    none(rows, F.col("scnt") != F.col("rcnt"), "a rank that expects another count than is sent")
    none(rows.groupBy("src", "dst").count(), F.col("count") > 1, "two extents for one pair of ranks")


def matrix(rows: DataFrame, comm: Comm) -> None:
    """A matrix (src, dst, cnt): the largest entry is a legal count, the smallest isn't negative, and no pair comes twice."""
    none(rows, ~F.coalesce(F.col("cnt").between(0, MOST_COUNT) & F.col("src").between(0, comm.size - 1) & F.col("dst").between(0, comm.size - 1), F.lit(False)), "a count out of range")
    none(rows.groupBy("src", "dst").count(), F.col("count") > 1, "two counts for one pair of ranks")


def counts(x: DataFrame, extents: DataFrame) -> None:
    """Every rank holds just as many elements as its extent (rank, cnt, displ) has, without holes."""
    per = x.groupBy("rank").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("places"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    both = extents.select("rank", "cnt").join(per, "rank", "full")
    n = F.coalesce("n", F.lit(0))
    fine = (n == F.col("cnt")) & ((n == 0) | (F.col("places") == n) & (F.col("first") == 0) & (F.col("last") == n - 1))
    none(both, ~F.coalesce(fine, F.lit(False)), "a rank that holds another count than its extent")
