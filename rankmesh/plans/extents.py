"""Counts and displacements as relations, and the join of elements with them.

An extent relation has a row for each rank (rank, cnt, displ) or pair of ranks, so
the group's size bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extent rows that are broadcast; beyond, the join is a shuffle on the same keys.
BROADCAST_ROWS = 1 << 17


def local(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A few rows as a local relation: the optimizer folds it, and no task has to read it from Python."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    names, types = zip(*(part.split() for part in schema.split(",")), strict=True)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names)))


def small(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if there are so few that it may be; else the join is a shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def kept(rows: DataFrame) -> DataFrame:
    """Extents that were computed, as a local relation if they are few: each use would compute them again otherwise."""
    held = rows.limit(BROADCAST_ROWS + 1).toArrow()
    return rows.sparkSession.createDataFrame(held) if held.num_rows <= BROADCAST_ROWS else rows


def from_lists(spark: SparkSession, cnt: list[int], displ: list[int] | None = None) -> DataFrame:
    """(rank, cnt, displ); without displacements the blocks follow one another."""
    if displ is None:
        displ = [sum(cnt[:k]) for k in range(len(cnt))]
    return local(spark, "rank int, cnt bigint, displ bigint", [(r, c, d) for r, (c, d) in enumerate(zip(cnt, displ, strict=True))])


def from_matrix(matrix: DataFrame) -> DataFrame:
    """(src, dst, scnt, sdispl, rcnt, rdispl) from a count matrix (src, dst, cnt): blocks follow one another on both sides."""
    sent = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    received = Window.partitionBy("dst").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    return matrix.select(
        "src",
        "dst",
        F.col("cnt").cast("bigint").alias("scnt"),
        F.coalesce(F.sum("cnt").over(sent), zero).cast("bigint").alias("sdispl"),
        F.col("cnt").cast("bigint").alias("rcnt"),
        F.coalesce(F.sum("cnt").over(received), zero).cast("bigint").alias("rdispl"),
    )


def within(x: DataFrame, extents: DataFrame, cnt: str, displ: str, on: list[tuple[str, str]] | None = None) -> DataFrame:
    """Elements joined with the extents that hold their idx: displ <= idx < displ + cnt, and columns ``on`` (of x, of extents) agree.

    A range alone would make a nested loop. Both sides are cut into strides about as
    long as an extent instead, so that this is a hash join on the stride with a few
    rows for each extent; the range decides within the stride.
    """
    stats = extents.agg(F.count("*"), F.max(F.col(displ) + F.col(cnt)), F.sum(cnt)).first()
    rows, reach = stats[0], max(stats[1] or 1, 1)
    stride = max(1, -(-max(stats[2] or 1, 1) // max(rows, 1)), reach >> 24)
    cut = extents.filter(F.col(cnt) > 0).withColumn("_stride", F.explode(F.sequence(F.floor(F.col(displ) / stride), F.floor((F.col(displ) + F.col(cnt) - 1) / stride))))
    if rows <= BROADCAST_ROWS:
        cut = F.broadcast(cut)
    x = x.withColumn("_at", F.floor(F.col("idx") / stride))
    match = (x["_at"] == cut["_stride"]) & (x["idx"] >= cut[displ]) & (x["idx"] < cut[displ] + cut[cnt])
    for left, right in on or []:
        match &= x[left] == cut[right]
    return x.join(cut, match).drop("_at", "_stride")
