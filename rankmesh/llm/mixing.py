"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is wanted the same fractional number of times, its
source's target over its source's size. The whole part is given to all; the
fractional parts are rounded in pairs of a document and all smaller ones together,
or of two documents where their probabilities have come to differ: words move at
random from one side to the other, keeping their sum, until one side is whole. So
each document keeps its expected number of copies, while the words
that a source takes hardly vary; what can't be made whole is a small document. Documents are rounded in
groups of some thousands; each group leaves at most one document undecided, and
these meet in a tree of further groups until one is left for each source. Rows
that agree in everything that matters here are one class, rounded by count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmesh.llm.common import WORD_PATTERN, columns, free, text_or_empty, written

#: Documents rounded together, on average, and undecided ones that meet in a node of the tree.
LEAF, FAN = 4096, 64
#: No document is repeated more often.
MOST = 3
#: Up to so many sources, their totals are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Rows of one class that are handled together.
SPAN = 10_000
_EPS = 1e-9


def round_alike(p: float, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Round documents of one probability ``p``; sizes fall and are above 0, ``draw`` has a uniform number for each.

    Each document in turn is paired with all smaller ones together: words move
    one way or the other, with odds that keep every expectation, until the
    document or the rest is whole. The rest shares what it gives or takes by size,
    so its probabilities stay alike. Returns 1 or 0 for each, the place of the one
    left undecided (or -1) and its words. The sum of the words stays the same.
    """
    out = np.zeros(len(size), np.int64)
    rest = (np.cumsum(size[::-1])[::-1] - size).tolist()
    live, left = -1, 0.0
    for i, (s, r, u) in enumerate(zip(size.tolist(), rest, draw.tolist(), strict=True)):
        if p <= _EPS or p >= 1 - _EPS:
            out[i] = p > 0.5
            continue
        y = p * s
        up, down = min(s - y, p * r), min(y, (1 - p) * r)
        if up + down > 0:
            step = up if u * (up + down) < down else -down
            y, p = y + step, p - step / r
        if y <= _EPS * s or y >= s - _EPS * s:
            out[i] = y > s / 2
        else:
            live, left = i, y
    return out, live, left


def round_pairs(mass: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int, float]:
    """As ``round_alike``, for documents whose probabilities ``mass / size`` differ: two at a time.

    Words move between two documents until one is whole; the other meets the next.
    """
    out = np.zeros(len(mass), np.int64)
    live, y, t = -1, 0.0, 0.0
    for i, (x, s, u) in enumerate(zip(mass.tolist(), size.tolist(), draw.tolist(), strict=True)):
        if live >= 0 and _EPS * s < x < s - _EPS * s:
            up, down = min(t - y, x), min(y, s - x)
            step = up if u * (up + down) < down else -down
            y, x = y + step, x - step
            if y <= _EPS * t or y >= t - _EPS * t:
                out[live] = y > t / 2
                live = -1
        if x <= _EPS * s or x >= s - _EPS * s:
            out[i] = x > s / 2
        else:
            live, y, t = i, x, float(s)
    return out, live, y if live >= 0 else 0.0


def _node(seed: int, leaf: bool, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Round one group; the undecided document keeps its words unless the group is its source's last."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [(c, "descending" if c == "size" else "ascending") for c in ("size", "doc_id", "key", "rows", "mass")]))
        name = ",".join(str(k.as_py()) for k in key)
        rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(f"{seed},{name}".encode(), digest_size=8).digest(), "big"))
        size, mass = rows["size"].to_numpy(), rows["mass"].to_numpy().copy()
        # a document without words has nothing to move: it is rounded on its own, as if it had one word
        draw, copies = rng.random(len(size)), np.zeros(len(size), np.int64)
        none = size == 0
        copies[none] = draw[none] < mass[none]
        rest, live = ~none, -1
        if leaf:  # one source, hence one probability, but for rows that occur again
            alike = np.flatnonzero(rest & (rows["rows"].to_numpy() == 1))
            if len(alike):
                copies[alike], live, left = round_alike(float(mass[alike[0]] / size[alike[0]]), size[alike], draw[alike])
                rest[alike] = False
                if live >= 0:  # what it leaves meets the others
                    live = alike[live]
                    rest[live], mass[live] = True, left
        at = np.flatnonzero(rest)
        copies[at], live, left = round_pairs(mass[at], size[at], rng.random(len(at)))
        open_ = np.full(len(size), np.nan)
        if live >= 0 and last:
            copies[at[live]] = rng.random() * size[at[live]] < left
        elif live >= 0:
            open_[at[live]] = left
        return rows.set_column(rows.schema.get_field_index("extra"), "extra", pa.array(copies)).set_column(rows.schema.get_field_index("mass"), "mass", pa.array(open_))

    return run


def _key() -> Column:
    """What tells rows of one doc_id apart: a hash of the text, and whether the id is null."""
    return F.xxhash64(F.col("doc_id").isNull(), "text")


def targets(totals: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = MOST) -> DataFrame:
    """``totals`` (source, words, ...) with no and target, for any number of sources.

    Sources are numbered in order of code points, null last, and weigh ``weights``
    in turn. They share all words by weight; nothing gets over ``most`` times its
    words, and the excess is shared again until nothing is above. Each round is
    one aggregate: only sums reach the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    numbered = written(totals.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "mix-numbered")
    # places count on within a partition; partitions are in order, and so few that a row of each may be broadcast
    part, begins, sofar = F.shiftright("place", 33), [], 0
    for r in sorted(numbered.groupBy(part.alias("part")).count().collect(), key=lambda r: r.part):
        begins.append((r.part, sofar))
        sofar += r["count"]
    begins = F.broadcast(totals.sparkSession.createDataFrame(begins, "part long, begin long"))
    numbered = numbered.join(begins, part == F.col("part")).withColumn("no", F.col("begin") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    numbered = written(numbered.withColumn("weight", weight).drop("place", "part", "begin"), "mix-sources")
    limit, level, full = F.col("words") * float(most), None, -1
    total = numbered.agg(F.sum("words")).first()[0] or 0
    while True:
        above = limit < F.lit(level or 0.0) * F.col("weight")
        n, given, rest = numbered.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, limit)), F.lit(0.0)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not rest:
            break
        full, level = n, (total - given) / rest
    return numbered.withColumn("target", F.least(limit, F.lit(level or 0.0) * F.col("weight")))


def sized(docs: DataFrame) -> DataFrame:
    """Rows (source, doc_id, key, size, rows): the classes of rows that are alike, and how many rows each has."""
    size = F.regexp_count(text_or_empty(), F.lit(WORD_PATTERN)).cast("long")
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), size.alias("size"))
    return rows.groupBy("source", "doc_id", "key", "size").agg(F.count("*").alias("rows"))


def source_targets(docs: DataFrame, weights: Sequence[float] = (1, 2, 3)) -> DataFrame:
    """Rows (source, source_size, target): see ``plan``."""
    totals = sized(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    return targets(totals, weights).select("source", F.col("words").alias("source_size"), "target")


def plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = 42, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """How often to take each document so that the sources meet their targets.

    Takes ``doc_id``, ``text`` and ``source`` of ``docs``; other columns are
    ignored. A document's size is its number of words, 0 where the text is null.
    Sources in order of code points, null last, weigh ``weights`` in turn and
    share all words by weight; a source gets at most 3 times its size, and the
    excess goes to the others by weight. Rows: doc_id, key (a hash of the
    text), source, size, source_size, target, copies, taken; one for each row
    of ``docs``, repeated ids and rows included; rows that agree in doc_id, text
    and source share their copies out evenly. A null doc_id is an id like any
    other. Groups and draws depend on the rows alone, so a rerun
    on the same rows agrees however they are partitioned. No rows give none.
    """
    classes = written(sized(docs), "mix-sizes")
    totals = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("words"), F.ceil(F.count("*") / leaf).alias("leaves"))
    sources = written(targets(totals, weights), "mix-targets")
    few, deep = sources.agg(F.count("*"), F.coalesce(F.max("leaves"), F.lit(0))).first()
    wanted = F.when(F.col("words") > 0, F.least(F.col("target") / F.col("words"), F.lit(float(MOST)))).otherwise(0.0)
    sources = sources.withColumn("wanted", wanted)
    small = F.broadcast(sources) if few <= BROADCAST_SOURCES else sources
    own = classes.join(small.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    whole, part = F.floor("wanted"), (F.col("wanted") - F.floor("wanted")) * F.col("rows")
    # of rows that are alike so many get one copy more; only what is left of one row is rounded
    node = F.pmod(F.xxhash64("doc_id", "size", "key"), F.col("leaves"))
    leaves = own.select("no", node.alias("node"), "doc_id", "key", "size", "rows", F.lit(0).cast("long").alias("extra"), ((part - F.floor(part)) * F.greatest("size", F.lit(1))).alias("mass"))
    schema, decided, level = leaves.schema, [], 0
    while True:
        last = deep <= 1
        done = leaves.groupBy("no", "node").applyInArrow(_node(seed + level, level == 0, last), schema)
        if last:
            decided.append(done)
            break
        done = written(done, "mix-level")
        decided.append(done.filter(F.isnan("mass")))
        leaves = done.filter(~F.isnan("mass")).withColumn("node", F.floor(F.col("node") / fan))
        deep, level = -(-deep // fan), level + 1
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    out = out.join(small, "no").withColumn("extra", F.col("extra") + F.floor(part))
    out = out.select("doc_id", "key", "source", "size", F.col("words").alias("source_size"), "target", whole.cast("long").alias("whole"), "extra", "rows")
    # back to one row for each row of a class: the first ones have the extra copies
    span = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + SPAN, F.col("rows")) - 1))
    each = out.filter(F.col("rows") <= SPAN).withColumn("from", F.lit(0).cast("long"))
    large = out.filter(F.col("rows") > SPAN).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(SPAN).cast("long"))))
    each = each.unionByName(large.repartition("doc_id", "key", "from")).withColumn("at", span)
    copies = F.col("whole") + (F.col("at") < F.col("extra")).cast("long")
    return each.select("doc_id", "key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``wanted`` (rows of ``plan``) has copies of it.

    Rows that agree in doc_id and text share their copies out evenly.
    """
    id_, key, copies, rows, salt, at, place, n = free(docs, "id", "key", "copies", "rows", "salt", "at", "place", "n")
    own = docs.select(*columns(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(id_), _key().alias(key), F.monotonically_increasing_id().alias(place))
    wanted = wanted.groupBy(F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).filter(F.col(copies) > 0)
    wanted = written(wanted, "mix-copies")
    # very many rows that are alike are numbered in parts
    own = own.join(wanted, [id_, key]).withColumn(salt, F.when(F.col(rows) > SPAN, F.pmod(F.xxhash64(place), F.ceil(F.col(rows) / SPAN))).otherwise(0))
    number = F.row_number().over(Window.partitionBy(id_, key, salt).orderBy(place)).cast("long")
    if wanted.filter(F.col(rows) > SPAN).isEmpty():
        own = own.withColumn(at, number)
    else:
        before = F.coalesce(F.sum(n).over(Window.partitionBy(id_, key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = own.filter(F.col(rows) > SPAN).groupBy(id_, key, salt).agg(F.count("*").alias(n)).withColumn(n, before)
        own = own.join(parts, [id_, key, salt], "left").withColumn(at, number + F.coalesce(F.col(n), F.lit(0))).drop(n)
    each = F.floor(F.col(copies) / F.col(rows)) + (F.col(at) <= F.col(copies) % F.col(rows)).cast("long")
    return own.withColumn(n, each).filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*columns(docs))
