"""Linear models fitted by batches, whose gradients are summed over executors.

An example has features (places in the weight vector, each with a share), a class,
a target and a weight. Each step needs, for each class, the sum of its examples'
values, gradients and weights. What an example adds is a whole number of
``1 / UNIT``, so that sums are exact: they don't hang on how examples are dealt out,
and few examples may be summed on the driver and many on the executors with the
same result to the last bit. Very many examples are dealt out to slices, of which
each step takes one; all are taken in turn.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmesh.llm.common import new_folder, partitions, written
from rankmesh.llm.spm import _Shared

#: Rows of examples: places, shares, class (0 or 1), target and weight.
SCHEMA = "places array<int>, shares array<float>, class int, target double, weight double"
UNIT = float(1 << 20)
#: Up to so many features in all examples together, 8 bytes each, the driver sums; beyond, the executors do,
#: and each step takes a slice of about as many, or of one part in ``SLICES`` if that is more.
LOCAL, SLICES = 4_000_000, 250
#: Features of the examples that the driver works on at a time.
ENTRIES = 500_000

#: From scores, targets and classes to values and their derivatives.
Loss = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


class Block:
    """Some examples over ``n`` weights as arrays."""

    def __init__(self, rows: pa.Table, n: int):
        rows = rows.combine_chunks()
        lists = rows["places"].combine_chunks()
        self.n, self.sizes = n, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        self.places, self.shares = (rows[c].combine_chunks().flatten().to_numpy() for c in ("places", "shares"))
        self.kind, self.target, self.weight = (rows[c].to_numpy() for c in ("class", "target", "weight"))
        self.begins = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        #: where an entry's gradient goes: its place, and the places of the other class after those of the first
        self.to = self.places + np.repeat(self.kind, self.sizes).astype(np.int32) * n

    def sums(self, w: np.ndarray, b: float, loss: Loss) -> tuple[np.ndarray, np.ndarray]:
        """Sums of values, derivatives and weights by class, and of gradients by class and place; whole numbers."""
        z = np.full(len(self.sizes), b)
        if len(self.begins):
            z[self.sizes > 0] += np.add.reduceat(w[self.places] * self.shares, self.begins)
        value, slope = loss(z, self.target)
        value, slope, weight = (np.rint(x * UNIT) for x in (value * self.weight, slope * self.weight, self.weight))
        each = np.rint(np.repeat(slope, self.sizes) * self.shares)
        heads = np.stack([np.bincount(self.kind, x, 2) for x in (value, slope, weight)])
        return heads, np.bincount(self.to, each, 2 * self.n).reshape(2, self.n)


class Batch:
    """All examples: a function from a step and weights to the sums over the step's examples."""

    def __init__(self, examples: DataFrame, n: int, loss: Loss, local: int = LOCAL, always: int | None = None, slices: int | None = None):
        """``always``: a class whose examples, of which a parameter bounds the number, belong to every slice."""
        self.n, self.loss = n, loss
        examples = written(examples, "examples")
        entries = examples.agg(F.sum(F.size("places").cast("long"))).first()[0] or 0
        self.blocks: list[Block] = []
        self.local = entries <= local
        self.slices = slices or min(max(1, -(-entries // LOCAL)), SLICES)
        if self.local:
            rows = examples.toArrow().combine_chunks()
            # few at a time, as a step's own arrays are several times as large as the examples
            step = max(1, len(rows) * ENTRIES // max(entries, 1))
            self.blocks = [Block(rows.slice(k, step), n) for k in range(0, len(rows), step)]
        else:
            spark, mark = examples.sparkSession, F.xxhash64("places", "shares", "class", "target")
            own = F.pmod(mark, F.lit(self.slices)).cast("int")
            path = new_folder(spark, "slices")
            parts = partitions(spark, 8 * entries)
            dealt = examples.withColumn("slice", own if always is None else F.when(F.col("class") == always, -1).otherwise(own))
            dealt.repartition(parts, "slice", F.pmod(F.shiftright(mark, 20), F.lit(-(-parts // self.slices)))).write.partitionBy("slice").parquet(path)
            self.examples = spark.read.schema(T.StructType([*examples.schema.fields, T.StructField("slice", T.IntegerType())])).parquet(path)

    def sums(self, step: int, w: np.ndarray, b: float) -> tuple[np.ndarray, np.ndarray]:
        if self.local:
            heads, grads = np.zeros((3, 2)), np.zeros((2, self.n))
            for block in self.blocks:
                got = block.sums(w, b, self.loss)
                heads += got[0]
                grads += got[1]
            return heads / UNIT, grads / UNIT
        shared, loss, n = _Shared(self.examples.sparkSession, (w, b)), self.loss, self.n

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, offset = shared.value
            heads, grads = np.zeros((3, 2)), np.zeros((2, n))
            for batch in batches:
                got = Block(pa.Table.from_batches([batch]), n).sums(own, offset, loss)
                heads += got[0]
                grads += got[1]
            some = np.flatnonzero(grads.any(0))
            both = [np.concatenate([grads[k, some], heads[:, k]]).astype(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([some, [-1, -2, -3]]).astype(np.int32)), *map(pa.array, both)], ["place", "g0", "g1"])

        # at most one row for each weight reaches the driver
        slice_ = self.examples.filter(F.col("slice").isin(-1, step % self.slices)).drop("slice")
        rows = slice_.mapInArrow(run, "place int, g0 long, g1 long").groupBy("place").agg(F.sum("g0").alias("g0"), F.sum("g1").alias("g1")).toArrow()
        place, both = rows["place"].to_numpy(), np.stack([rows[c].to_numpy() for c in ("g0", "g1")]) / UNIT
        heads, grads = np.stack([both[:, place == k].sum(1) for k in (-1, -2, -3)]), np.zeros((2, n))
        grads[:, place[place >= 0]] = both[:, place >= 0]
        shared.broadcast.destroy()
        return heads, grads


def descend(n: int, offset: float, gradient: Callable[[int, np.ndarray, float], np.ndarray], steps: int, rate: float, floor: float = 1e-10) -> tuple[np.ndarray, float]:
    """Adam from zero weights; ``gradient`` gives that of all weights and, last, of the offset."""
    w, b, m, v = np.zeros(n), offset, np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        g = gradient(t, w, b)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + floor)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))
