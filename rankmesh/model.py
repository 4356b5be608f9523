"""Data model: element types, reductions and groups of ranks.

A distributed array is a relation (rank, idx, val): element ``idx`` of the buffer
that rank ``rank`` holds. There are no nulls, and (rank, idx) is unique.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REDUCTIONS = ("sum", "prod", "max", "min")
#: Elements that one rank may hold.
MOST_COUNT = 0x7FFFFFFFF
#: Levels of a hierarchy of ranks.
MOST_LEVELS = 4


@dataclass(frozen=True)
class DType:
    """An element type: its size, the Spark type that carries it, and what it may be used for."""

    name: str
    size: int
    spark: str
    moves: bool = True
    reduces: bool = True
    multiplies: bool = False
    signed_bits: int = 0  # of integers that wrap around


#: Sizes and legality of the element types. Unsigned types widen, and types that can only be moved are bytes.
DTYPES = {
    d.name: d
    for d in (
        DType("int8", 1, "tinyint", multiplies=True, signed_bits=8),
        DType("int16", 2, "smallint", signed_bits=16),
        DType("int32", 4, "int", multiplies=True, signed_bits=32),
        DType("int64", 8, "bigint", multiplies=True, signed_bits=64),
        DType("uint8", 1, "smallint", reduces=False),
        DType("uint16", 2, "int", reduces=False),
        DType("uint32", 4, "bigint", reduces=False),
        DType("uint64", 8, "decimal(20,0)", multiplies=True),
        DType("fp16", 2, "float", multiplies=True),
        DType("bfp16", 2, "float"),
        DType("fp32", 4, "float", multiplies=True),
        DType("fp64", 8, "double", multiplies=True),
        DType("int128", 16, "decimal(38,0)", moves=False, reduces=False),
        DType("hif8", 1, "binary", reduces=False),
        DType("fp8e4m3", 1, "binary", reduces=False),
        DType("fp8e5m2", 1, "binary", reduces=False),
        DType("fp8e8m0", 1, "binary", reduces=False),
    )
}


@dataclass(frozen=True)
class Comm:
    """A group of ``size`` ranks; ``levels[k][r]`` is the group of rank r on level k (server, pod, super-pod, ...)."""

    size: int
    levels: tuple[tuple[int, ...], ...] = field(default=())

    def __post_init__(self) -> None:
        if self.size < 1:
            raise ValueError("a group has one rank at least")
        if len(self.levels) > MOST_LEVELS:
            raise ValueError(f"a hierarchy has {MOST_LEVELS} levels at most")
        if any(len(level) != self.size for level in self.levels):
            raise ValueError("every level needs a group for each rank")

    @classmethod
    def nested(cls, shape: list) -> Comm:
        """From nested lists, such as super-pods of servers of devices; the leaves are ranks in order."""
        paths: list[tuple[int, ...]] = []

        def walk(node: object, path: tuple[int, ...]) -> None:
            if isinstance(node, list):
                for k, child in enumerate(node):
                    walk(child, (*path, k))
            else:
                paths.append(path[:-1])

        walk(shape, ())
        depth = len(paths[0]) if paths else 0
        # the innermost level first; groups are numbered by their whole path
        names = [sorted({p[: depth - k] for p in paths}) for k in range(depth)]
        return cls(len(paths), tuple(tuple(names[k].index(p[: depth - k]) for p in paths) for k in range(depth)))

    def ranks(self, spark: SparkSession) -> DataFrame:
        """(rank): one row for each; the group's size bounds it, so it may be broadcast."""
        return spark.range(self.size).select(F.col("id").cast("int").alias("rank"))

    def has(self, *ranks: int) -> bool:
        return all(0 <= r < self.size for r in ranks)
