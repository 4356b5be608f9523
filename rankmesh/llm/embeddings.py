"""Embedding near-duplicates by collision-counting projections.

Unit vectors are projected on random directions. In each direction the values are
sorted, and around each query's value a window holds whatever collides with it
there. Two vectors of cosine 0.9 collide in most directions, unrelated ones in few;
pairs are verified if they collide in at least as many as all but a few of
the pairs to be found do, a number that the binomial distribution calibrates.

To keep this from all pairs, vectors meet only within cells: the signs of a few
further projections, in several tables. Signs are taken from the mean of all
vectors on, so that a direction that all have in common doesn't crowd a cell. How
many signs and tables follows from the number of vectors and from how far they lie
from their mean: the least work that lets the share of pairs asked for meet. A cell
that is crowded all the same is split in the same way, from a mean of its own.
Projections are kept as whole steps of a byte each. Where vectors are wide, only
these are dealt out by cells; vectors follow where a pair collides.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmesh.llm.common import scratch, written
from rankmesh.llm.components import components, lowest

COSINE = 0.9
#: Shares of the pairs at the very threshold that meet in a cell, and that pass the first and the whole count; nearer pairs do more often.
MEET, PASS_FIRST, PASS = 0.98, 0.995, 0.985
#: Directions in which collisions are counted, at first and in all; half a window in units of the distance at the threshold, and in steps.
FIRST, DIRECTIONS, WINDOW, STEPS = 32, 128, 1.5, 20
#: Vectors in a cell on average; a cell with over four times as many is split by signs from its own mean, for which
#: about ``SAMPLE`` of its vectors stand, and what is crowded then is dealt out in pairs of chunks of twice as many.
CELL, SAMPLE = 1024, 64
BLOCK = 256
#: What it costs to deal a vector out to a table, in pairs whose collisions are counted.
COPY = 256
#: Vectors of more bytes follow their projections.
WIDE = 1024
#: Steps to which projections are cut off, so that their differences fit a byte.
LIMIT = 106
#: Distances from the mean are counted in bins of this width.
BIN = 0.01


def chance(x: float) -> float:
    """Share of a normal distribution within x standard deviations."""
    return math.erf(x / math.sqrt(2))


def least_count(directions: int, share: float, window: float = WINDOW) -> int:
    """The largest count that ``share`` of pairs at the threshold reach."""
    p, tail = chance(window), 0.0
    for k in range(directions, 0, -1):
        tail += math.comb(directions, k) * p**k * (1 - p) ** (directions - k)
        if tail >= share:
            return k
    return 0


def same_side(spread: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """How likely two unit vectors at the threshold, both so far from the mean, are on one side of a random plane through it."""
    d = math.sqrt(2 - 2 * cosine)
    # nearer to the mean than half their distance two can't both be
    return 1 - 2 * np.arcsin(d / (2 * np.maximum(spread, 0.6 * d))) / math.pi


def tables_for(vectors: int, cosine: float = COSINE, share: float = MEET, cell: int = CELL, spread: np.ndarray | None = None, counts: np.ndarray | None = None) -> tuple[int, int]:
    """Signs for each cell, and tables, so that ``share`` of pairs at the threshold share a cell of some table, with the least work.

    ``spread`` and ``counts``: how many vectors lie how far from the mean; 1 without them.
    """
    spread, counts = (np.ones(1), np.ones(1)) if spread is None else (spread, counts / counts.sum())
    p, best = same_side(spread, cosine), (math.inf, 0, 1)
    for signs in range(max(0, math.ceil(math.log2(max(vectors, 1) / cell))) + 1):
        low, high = 0, 1
        meet = lambda t: (counts * (1 - (1 - p**signs) ** t)).sum()  # noqa: B023, E731
        while meet(high) < share:
            low, high = high, 2 * high
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (low, mid) if meet(mid) >= share else (mid, high)
        each = vectors / 2**signs
        best = min(best, (high * (each + COPY * max(1, each / (2 * cell))), signs, high))
    return best[1:]


def cells(units: np.ndarray, centre: np.ndarray | float, signs: int, tables: int, seed: int = 60) -> np.ndarray:
    """The cell of each unit vector in each table."""
    planes = np.random.default_rng([seed, units.shape[1]]).standard_normal((signs * tables, units.shape[1]))
    sides = ((units - centre) @ planes.T > 0).reshape(len(units), tables, signs)
    return (sides * (1 << np.arange(signs, dtype=np.int32))).sum(2, dtype=np.int32)


def _units(vectors: np.ndarray) -> np.ndarray:
    # first by the largest part, so that no square over- or underflows
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def marks(units: np.ndarray, centre: np.ndarray | float = 0.0, cosine: float = COSINE) -> np.ndarray:
    """Projections in whole steps, int8: (vector, direction)."""
    directions = np.random.default_rng([6, units.shape[1]]).standard_normal((DIRECTIONS, units.shape[1]))
    step = WINDOW * math.sqrt(2 - 2 * cosine) / STEPS
    return np.clip(np.rint((units - centre) @ directions.T / step), -LIMIT, LIMIT).astype(np.int8)


def collisions(q: np.ndarray, first: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs whose projections collide often enough: i < j, or with ``first``, i below it and j not."""
    # two values that are half a window apart may be rounded a step further apart
    half, n = STEPS + 1, len(q)
    own = q[:, :FIRST].astype(np.int16)
    order = np.argsort(own, axis=0, kind="stable")
    kind = np.int16 if n < 32_000 else np.int32
    rank, low, high = (np.empty(own.shape, kind) for _ in range(3))
    np.put_along_axis(rank, order, np.arange(n, dtype=kind)[:, None], 0)
    for d in range(FIRST):
        line = own[order[:, d], d]
        low[:, d] = np.searchsorted(line, own[:, d] - half)
        high[:, d] = np.searchsorted(line, own[:, d] + half, side="right")
    rank, need_first, need = np.ascontiguousarray(rank.T), least_count(FIRST, PASS_FIRST), least_count(DIRECTIONS, PASS)
    last = n if first is None else first
    for a in range(0, last, BLOCK):
        b = min(a + BLOCK, last)
        begin = a if first is None else first
        count = np.zeros((b - a, n - begin), np.uint8)
        for d in range(FIRST):
            line = rank[d, begin:][None, :]
            count += (line >= low[a:b, d, None]) & (line < high[a:b, d, None])
        i, j = np.nonzero(count >= need_first)
        i, j = i + a, j + begin
        if first is None:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 14):
            p, r = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
            enough = (np.abs(q[p].astype(np.int16) - q[r]) <= half).sum(1) >= need
            yield p[enough], r[enough]


def near(x: np.ndarray, y: np.ndarray | None, cosine: float = COSINE, centre: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of pairs of unit vectors, of ``x`` and ``y`` or within ``x`` (i < j), that collide often enough and reach the cosine."""
    both = x if y is None else np.concatenate([x, y])
    found = [(np.zeros(0, np.int64),) * 2]
    for i, j in collisions(marks(both, centre, cosine), None if y is None else len(x)):
        close = np.einsum("ij,ij->i", both[i], both[j]) >= cosine
        found.append((i[close], j[close]))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return i, j - (0 if y is None else len(x))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _by_size(vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Vectors of one length at a time: the length, their places, and the unit vectors."""
    sizes = np.diff(vectors.offsets.to_numpy())
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield size, at, _units(vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size))


def _colliding(key: tuple, rows: pa.Table) -> pa.Table:
    """The vectors of a cell that collide often enough with any other, by their projections alone."""
    a, b = key[2].as_py(), key[3].as_py()
    q = np.frombuffer(b"".join(rows["marks"].to_pylist()), np.int8).reshape(len(rows), -1)
    part = rows["chunk"].to_numpy()
    order = np.arange(len(q)) if a == b else np.concatenate([np.flatnonzero(part == a), np.flatnonzero(part == b)])
    some = np.zeros(len(q), bool)
    for i, j in collisions(q[order], None if a == b else int((part == a).sum())):
        some[i] = some[j] = True
    return rows.drop_columns(["marks"]).take(pa.array(order[some]))


def _cell(cosine: float, centres: dict[int, np.ndarray]) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        table, a, b = (key[k].as_py() for k in (0, 2, 3))
        units, part = _units(_matrix(rows["vector"])), rows["chunk"].to_numpy()
        node, n, cells = rows["node"].to_numpy(), rows["n"].to_numpy(), _matrix(rows["cells"])
        first, second = (np.arange(len(node)), None) if a == b else (np.flatnonzero(part == a), np.flatnonzero(part == b))
        i, j = near(units[first], None if second is None else units[second], cosine, centres.get(units.shape[1], 0.0))
        i, j = first[i], (first if second is None else second)[j]
        # a pair that shares a cell of an earlier table has been counted there
        new = ~(cells[i, :table] == cells[j, :table]).any(1)
        if (sub := key[1].as_py()["sub"]) > 0:
            parts = _matrix(rows["subs"])
            new &= ~(parts[i, :sub] == parts[j, :sub]).any(1)
        i, j = i[new], j[new]
        links = np.bincount(np.concatenate([i, j]), np.concatenate([n[j], n[i]]), len(node)).astype(np.int64)
        some = np.flatnonzero(links)
        root = list(range(len(node)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        tree = []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if (x := find(p)) != (y := find(q)):
                root[x] = y
                tree.append((p, q))
        p, q = (node[[t[k] for t in tree]] if tree else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": np.concatenate([node[some], p]), "b": pa.array([*[None] * len(some), *q.tolist()], pa.int64()), "links": pa.array([*links[some].tolist(), *[None] * len(p)], pa.int64())})

    return run


def valid(vector: Column) -> Column:
    """Whether a vector can link: not null, no null or non-finite component, and not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _centre(classes: DataFrame, size: int, m: int) -> np.ndarray:
    """The mean of the unit vectors of one length, from whole numbers, whose sums don't hang on their order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, units in _by_size(batch.column(0)):
                sums += np.rint(units * 2**24).astype(np.int64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], ["place", "s"])

    sums = classes.filter(F.size("vector") == size).select("vector").mapInArrow(run, "place long, s long").groupBy("place").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[sums["place"].to_numpy()] = sums["s"].to_numpy() / 2**24 / m
    return out


def _spread(classes: DataFrame, size: int, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors of one length lie how far from their mean, in bins."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(int(2 / BIN) + 2, np.int64)
        for batch in batches:
            for _, _, units in _by_size(batch.column(0)):
                counts += np.bincount((np.linalg.norm(units - centre, axis=1) / BIN).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bin", "n"])

    got = classes.filter(F.size("vector") == size).select("vector").mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    return (got["bin"].to_numpy() + 0.5) * BIN, got["n"].to_numpy().astype(float)


def _split(placed: DataFrame, crowded: DataFrame, cosine: float, cell: int) -> DataFrame:
    """Rows (node, table, cell, size, subs: the parts of the cell that the vector is in) for the vectors of crowded cells (table, cell, size, m)."""
    at = ["table", "cell", "size"]
    rows = placed.select("node", "vector", F.size("vector").alias("size"), F.posexplode("cells").alias("table", "cell")).join(crowded, at)
    some = rows.filter(F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / SAMPLE)) == 0)
    some = some.groupBy(*at, "m").agg(F.array_sort(F.collect_list(F.struct("node", "vector"))).alias("some"))
    some = some.select(*at, "m", F.flatten(F.transform("some", lambda x: x["vector"])).alias("some"))

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, m, flat in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                units = _units(np.array(flat).reshape(-1, size))
                centre = units.mean(0)
                spread = np.linalg.norm(units - centre, axis=1)
                out.append((centre, *tables_for(m, cosine, MEET, cell, spread, np.ones(len(spread)))))
            centres, signs, tables = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(centres, pa.list_(pa.float64())), pa.array(signs, pa.int32()), pa.array(tables, pa.int32())], [*at, "centre", "signs", "tables"])

    centres = some.mapInArrow(describe, "table int, cell int, size int, centre array<double>, signs int, tables int")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            subs: list[np.ndarray] = [np.zeros(1, np.int32)] * batch.num_rows
            cases, which = np.unique(own, axis=0, return_inverse=True)
            for k in range(len(cases)):
                rows = np.flatnonzero(which.ravel() == k)
                first = int(rows[0])
                # a cell of which no vector stands for the others stays whole
                if (centre := batch.column(5)[first].as_py()) is not None:
                    units = _units(batch.column(4).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
                    for r, x in zip(rows.tolist(), cells(units, np.array(centre), batch.column(6)[first].as_py(), batch.column(7)[first].as_py(), 61), strict=True):
                        subs[r] = x
            yield pa.RecordBatch.from_arrays([batch.column(3), *batch.columns[:3], pa.array(subs, pa.list_(pa.int32()))], ["node", *at, "subs"])

    rows = rows.join(centres, at, "left").select(*at, "node", "vector", "centre", "signs", "tables")
    return rows.mapInArrow(place, "node long, table int, cell int, size int, subs array<int>")


def linked(rows: DataFrame, cosine: float = COSINE, cell: int = CELL, wide_bytes: int = WIDE) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``rows`` (vec_id, embedding); other columns are ignored.

    Vectors link at a cosine of ``cosine`` or more, in double precision; every
    link found is a true one, and 0.96 of those at the very threshold are found,
    more of the closer ones. A vector that is null, empty or zero, or holds nulls
    or non-finite components, links with nothing; vectors of unlike lengths don't
    link. Equal vectors are one node and link with each other. n_links counts
    other rows linked directly; component_id is the smallest vec_id reachable
    (null ids don't count; a set of nulls alone has null); kept tells whether
    vec_id is component_id. No rows give none.
    """
    kind = rows.schema["embedding"].dataType
    exact = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if exact else "array<double>").alias("vector"))
    good = rows.filter(valid(F.col("vector")))
    classes = good.groupBy("vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"))
    # two hashes stand for the vector in the last join
    same = [F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("k")]
    classes = written(classes.select("*", *same, F.monotonically_increasing_id().alias("node")), "vectors")
    # lengths that fill a cell, which the others can't crowd; there is at most one for each CELL vectors
    sizes = classes.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("m"))
    sizes = {r["size"]: r.m for r in sizes.filter(F.col("m") > cell).collect()}
    centres = {size: _centre(classes, size, m) for size, m in sizes.items()}
    most = max(sizes, key=sizes.get, default=0)
    signs, tables = tables_for(sizes[most], cosine, MEET, cell, *_spread(classes, most, centres[most])) if sizes else (0, 1)
    wide = most * (4 if exact else 8) > wide_bytes

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((batch.num_rows, tables), np.int32)
            marked = [b""] * batch.num_rows
            for size, at, units in _by_size(batch.column(1)):
                centre = centres.get(size, 0.0)
                found[at] = cells(units, centre, signs, tables)
                if wide:
                    for i, q in zip(at.tolist(), marks(units, centre, cosine), strict=True):
                        marked[i] = q.tobytes()
            offsets = pa.array(np.arange(batch.num_rows + 1) * tables, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1))), pa.array(marked, pa.binary())], ["node", "vector", "n", "cells", "marks"])

    placed = T.StructType([T.StructField("node", T.LongType()), T.StructField("vector", classes.schema["vector"].dataType), T.StructField("n", T.LongType()), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("marks", T.BinaryType())])
    placed = written(classes.select("node", "vector", "n").mapInArrow(place, placed), "cells")
    size = F.size("vector").alias("size")
    held = ["marks"] if wide else ["vector", "n", "cells"]
    filed = placed.select("node", *held, size, F.posexplode("cells").alias("table", "cell"))
    counted = placed.select(F.posexplode("cells").alias("table", "cell"), size).groupBy("table", "cell", "size").agg(F.count("*").alias("m"))
    crowded = written(counted.filter(F.col("m") > 4 * cell), "crowded")
    at = ["table", "cell", "size"]
    none = {"sub": F.lit(-1), "subcell": F.lit(0), "subs": F.array().cast("array<int>"), "chunks": F.lit(1)}
    if crowded.isEmpty():
        filed = filed.withColumns(none)
    else:
        split = written(_split(placed, crowded, cosine, cell), "split")
        each = split.select("node", *at, "subs", F.posexplode("subs").alias("sub", "subcell"))
        parts = [*at, "sub", "subcell"]
        chunks = each.groupBy(*parts).agg(F.count("*").alias("m")).withColumn("chunks", F.when(F.col("m") > 4 * cell, F.ceil(F.col("m") / (2 * cell))).otherwise(1).cast("int"))
        fine = each.join(chunks.drop("m"), parts).join(placed.select("node", *held), "node")
        filed = filed.join(crowded.drop("m"), at, "left_anti").withColumns(none).unionByName(fine)
    filed = filed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # a chunk meets every chunk of its cell, itself among them
    filed = filed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    filed = filed.select("node", *held, "subs", "table", F.struct("cell", "size", "sub", "subcell").alias("cell"), F.least("chunk", "with").alias("a"), F.greatest("chunk", "with").alias("b"), "chunk")
    if wide:
        met = filed.groupBy("table", "cell", "a", "b").applyInArrow(_colliding, filed.drop("marks").schema)
        filed = written(met, "vectors-colliding").join(placed.drop("marks"), "node")
    found = filed.groupBy("table", "cell", "a", "b").applyInArrow(_cell(cosine, centres), "a long, b long, links long")
    found = written(found, "vector-links")
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    with scratch(rows.sparkSession):
        parts = written(components(found.filter("b is not null").select("a", "b")), "vector-components", keep=True)
    own = classes.select("node", "low").join(parts, "node")
    lows = own.join(lowest(own, "component", "low", "component_id"), "component").select("node", "component_id")
    classes = classes.join(links, "node", "left").join(lows, "node", "left")
    classes = classes.select("h", "k", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "low").alias("component_id"))
    out = good.select("vec_id", *same).join(classes, ["h", "k"]).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~valid(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
