"""Collectives over distributed arrays (rank, idx, val).

``comm`` is the group of ranks. Element types are names of ``rankmesh.model.DTYPES``.
Arguments and extents, which are small, are always checked. What only the data can
tell is checked where ``held``, the number of elements that each rank must hold, is
given; operators with an extent for each rank check the ranks' counts unless
``check`` is False.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmesh import validate
from rankmesh.model import Comm
from rankmesh.plans import extents as E
from rankmesh.plans import shapes as S


def _everywhere(x: DataFrame, comm: Comm) -> DataFrame:
    """(idx, val) on every rank. A filter on rank in what follows reaches the small side, so that unwanted copies are never made."""
    return x.crossJoin(F.broadcast(comm.ranks(x.sparkSession))).select("rank", "idx", "val")


def reduced(x: DataFrame, comm: Comm, op: str = "sum", dtype: str = "int64", order: str = "any", hints: Mapping[str, int] | None = None, tuner: S.Tuner | None = None, operator: str = "all_reduce", trace: bool = False, held: int | None = None) -> DataFrame:
    """(idx, val): element by element over all ranks.

    ``order`` is any, fixed (the same sums on every run: ranks in ascending order)
    or strict (the halving tree). A group of one rank is returned as it is.
    With ``trace``, values are arrays of sources, and the plan that would reduce puts them together instead.
    With ``held``, ValueError unless every rank holds elements 0 to held - 1 just once.
    """
    if held is not None:
        validate.dense(x, comm, held)
    d = validate.reduction(op, dtype, operator)
    if order not in S.ORDERS:
        raise ValueError(f"no such order: {order}")
    if comm.size == 1:
        return x.select("idx", (F.col("val") if trace else F.col("val").cast(d.spark)).alias("val"))
    q = S.Request(op, d, comm, order)
    return S.choose(q, hints, tuner).shape.build(x.select("rank", "idx", "val"), replace(q, op=S.R.TRACE) if trace else q)


def all_reduce(x: DataFrame, comm: Comm, op: str = "sum", dtype: str = "int64", **how) -> DataFrame:
    """Every rank gets all elements, reduced over ranks. All ranks hold equally many."""
    return _everywhere(reduced(x, comm, op, dtype, **how), comm)


def all_reduce_one_shot(x: DataFrame, comm: Comm, op: str = "sum", dtype: str = "int64") -> DataFrame:
    """As ``all_reduce``, by gathering everything first and reducing on each rank: for comparison only."""
    q = S.Request(op, validate.reduction(op, dtype), comm)
    copies = x.select(F.col("rank").alias("src"), "idx", "val").crossJoin(F.broadcast(comm.ranks(x.sparkSession)))
    own = S.R.unordered(op, q.dtype, F.col("val"))
    if own is not None:
        return copies.groupBy("rank", "idx").agg(own.alias("val"))
    parts, out = S.R.ordered(op, q.dtype, F.col("val"), F.col("src"), comm.size, False)
    return copies.groupBy("rank", "idx").agg(*parts).select("rank", "idx", out.cast(q.dtype.spark).alias("val"))


def reduce(x: DataFrame, comm: Comm, root: int, op: str = "sum", dtype: str = "int64", **how) -> DataFrame:
    """As ``all_reduce``, for the root alone; other ranks get no rows."""
    validate.root(comm, root)
    return reduced(x, comm, op, dtype, operator="reduce", **how).select(F.lit(root).cast("int").alias("rank"), "idx", "val")


def reduce_scatter(x: DataFrame, comm: Comm, count: int, op: str = "sum", dtype: str = "int64", **how) -> DataFrame:
    """Rank r gets block r of the reduced elements; every rank holds ``count`` for each rank."""
    validate.count(count)
    out = reduced(x, comm, op, dtype, operator="reduce_scatter", **how)
    return _split(out, count)


def _split(x: DataFrame, count: int) -> DataFrame:
    if count == 0:
        return x.select(F.lit(0).alias("rank"), "idx", "val").limit(0)
    return x.select(F.floor(F.col("idx") / count).cast("int").alias("rank"), (F.col("idx") % count).cast("bigint").alias("idx"), "val")


def reduce_scatter_v(x: DataFrame, comm: Comm, extents: DataFrame, op: str = "sum", dtype: str = "int64", **how) -> DataFrame:
    """Rank r gets the reduced elements of its extent (rank, cnt, displ), numbered from 0; extents may leave holes."""
    validate.extents(extents, comm)
    out = reduced(x, comm, op, dtype, operator="reduce_scatter_v", **how)
    return E.within(out, extents, "cnt", "displ").select(F.col("rank").cast("int").alias("rank"), (F.col("idx") - F.col("displ")).cast("bigint").alias("idx"), "val")


def all_gather(x: DataFrame, comm: Comm, count: int, check: bool = False) -> DataFrame:
    """Every rank gets all ranks' elements, one rank after another; each holds ``count``, which ``check`` makes sure of."""
    validate.count(count)
    if check:
        validate.dense(x, comm, count)
    return _everywhere(x.select((F.col("rank").cast("bigint") * count + F.col("idx")).alias("idx"), "val"), comm)


def gather(x: DataFrame, comm: Comm, root: int, count: int) -> DataFrame:
    """As ``all_gather``, for the root alone. (An addition; groups of operators elsewhere have it as a phase only.)"""
    validate.root(comm, root)
    validate.count(count)
    return x.select(F.lit(root).cast("int").alias("rank"), (F.col("rank").cast("bigint") * count + F.col("idx")).alias("idx"), "val")


def all_gather_v(x: DataFrame, comm: Comm, extents: DataFrame, check: bool = True) -> DataFrame:
    """Every rank gets all ranks' elements; those of rank r go to its extent (rank, cnt, displ).

    Extents don't overlap, and may leave holes. Raises ValueError if a rank holds
    another count than its extent; without ``check`` (one aggregate over the
    elements' places) an element beyond its extent still fails the query.
    """
    validate.extents(extents, comm, apart=[])
    if check:
        validate.counts(x, extents)
    where = E.small(extents.select(F.col("rank").alias("_rank"), "displ", "cnt"))
    at = F.when(F.col("idx") < F.col("cnt"), F.col("displ") + F.col("idx")).otherwise(F.raise_error(F.lit("an element beyond its rank's extent")).cast("bigint"))
    moved = x.join(where, x["rank"] == F.col("_rank"), "left").select(at.cast("bigint").alias("idx"), "val")
    return _everywhere(moved, comm)


def broadcast(x: DataFrame, comm: Comm, root: int) -> DataFrame:
    """Every rank gets the root's elements. Further value columns go along."""
    validate.root(comm, root)
    own = x.filter(F.col("rank") == root).drop("rank")
    return own.crossJoin(F.broadcast(comm.ranks(x.sparkSession))).select("rank", *own.columns)


def scatter(x: DataFrame, comm: Comm, root: int, count: int) -> DataFrame:
    """Rank r gets block r of the root's elements; the root holds ``count`` for each rank."""
    validate.root(comm, root)
    validate.count(count)
    return _split(x.filter(F.col("rank") == root), count)


def all_to_all(x: DataFrame, comm: Comm, count: int) -> DataFrame:
    """Block d of rank s becomes block s of rank d: a projection, nothing is shuffled."""
    validate.count(count)
    if count == 0:
        return x.limit(0)
    return x.select(F.floor(F.col("idx") / count).cast("int").alias("rank"), (F.col("rank").cast("bigint") * count + F.col("idx") % count).alias("idx"), "val")


def all_to_all_v(x: DataFrame, comm: Comm, extents: DataFrame) -> DataFrame:
    """Elements of rank src at [sdispl, sdispl + scnt) go to rank dst at rdispl and on; ``extents`` is (src, dst, scnt, sdispl, rcnt, rdispl), where rcnt is scnt."""
    validate.blocks(extents, comm)
    moved = E.within(x, extents, "scnt", "sdispl", [("rank", "src")])
    return moved.select(F.col("dst").cast("int").alias("rank"), (F.col("rdispl") + F.col("idx") - F.col("sdispl")).cast("bigint").alias("idx"), "val")


def all_to_all_vc(x: DataFrame, comm: Comm, matrix: DataFrame) -> DataFrame:
    """As ``all_to_all_v``, from the matrix (src, dst, cnt) of counts; blocks follow one another."""
    validate.matrix(matrix, comm)
    return all_to_all_v(x, comm, E.kept(E.from_matrix(matrix)))


def send_recv(x: DataFrame, comm: Comm, pairs: DataFrame) -> DataFrame:
    """Rank dst gets what rank src holds, for each pair (src, dst); a rank may send to several, and receives from one."""
    validate.none(pairs, ~F.coalesce(F.col("src").between(0, comm.size - 1) & F.col("dst").between(0, comm.size - 1), F.lit(False)), "a rank that isn't one of the group")
    validate.none(pairs.groupBy("dst").count(), F.col("count") > 1, "a rank that receives from several")
    who = E.small(pairs.select("src", "dst"))
    return x.join(who, x["rank"] == F.col("src")).select(F.col("dst").cast("int").alias("rank"), "idx", "val")


def send(x: DataFrame, comm: Comm, src: int, dst: int) -> DataFrame:
    """What rank src holds, on rank dst. In a group of one rank there is no one to send to, and no rows come out."""
    validate.root(comm, src)
    validate.root(comm, dst)
    if src == dst:
        return x.select("rank", "idx", "val").limit(0)
    return x.filter(F.col("rank") == src).select(F.lit(dst).cast("int").alias("rank"), "idx", "val")


def recv(x: DataFrame, comm: Comm, dst: int, src: int, schema: str | None = None) -> DataFrame:
    """The other half of ``send``: the same rows. With ``schema``, the receiver's declared type of val, into which values have to fit."""
    out = send(x, comm, src, dst)
    if schema is None:
        return out
    own = F.col("val").try_cast(schema)
    fits = F.col("val").isNull() | (own.isNotNull() & own.cast(x.schema["val"].dataType).eqNullSafe(F.col("val")))
    return out.withColumn("val", F.when(fits, own).otherwise(F.raise_error(F.lit(f"a value that {schema} can't hold")).cast(schema)))


def item(rank: int, ordinal: int, kind: str, peer: int, base: int, cnt: int) -> tuple[int, int, str, int, int, int]:
    """A row for ``batch_send_recv``: rank sends to, or receives from, peer elements [base, base + cnt) of its own buffer."""
    if kind not in ("send", "recv"):
        raise ValueError(f"an item sends or receives: {kind}")
    validate.count(base)
    validate.count(cnt)
    return rank, ordinal, kind, peer, base, cnt


def items(x: DataFrame, rows: list[tuple]) -> DataFrame:
    """Items as a relation."""
    return E.local(x.sparkSession, "rank int, ordinal int, kind string, peer int, base bigint, cnt bigint", rows)


def matched_items(items: DataFrame) -> DataFrame:
    """Sends and receives of ``items`` (rank, ordinal, kind, peer, base, cnt) that belong together: (src, dst, cnt, sbase, rbase).

    The k-th send from a rank to another meets the k-th receive there from it, in
    order of ordinal. Raises ValueError if one is alone or the counts differ.
    """
    from pyspark.sql import Window

    items = items.withColumn("nth", F.row_number().over(Window.partitionBy("rank", "peer", "kind").orderBy("ordinal")))
    sends = items.filter("kind = 'send'").select(F.col("rank").alias("src"), F.col("peer").alias("dst"), "nth", F.col("cnt").alias("scnt"), F.col("base").alias("sbase"))
    receives = items.filter("kind = 'recv'").select(F.col("peer").alias("src"), F.col("rank").alias("dst"), "nth", F.col("cnt").alias("rcnt"), F.col("base").alias("rbase"))
    both = sends.join(receives, ["src", "dst", "nth"], "full")
    validate.none(both, ~F.col("scnt").eqNullSafe(F.col("rcnt")), "a send and a receive that don't match")
    return both.select("src", "dst", F.col("scnt").alias("cnt"), "sbase", "rbase")


def batch_send_recv(x: DataFrame, comm: Comm, items: DataFrame) -> DataFrame:
    """All items at once; see ``matched_items``. Elements [base, base + cnt) of the sender go to the receiver's base and on."""
    moved = E.within(x, matched_items(items), "cnt", "sbase", [("rank", "src")])
    return moved.select(F.col("dst").cast("int").alias("rank"), (F.col("rbase") + F.col("idx") - F.col("sbase")).cast("bigint").alias("idx"), "val")


def barrier(x: DataFrame, tasks: int = 2) -> DataFrame:
    """``x`` unchanged, none of whose rows is handed on before ``tasks`` tasks have met.

    The tasks are a barrier stage of their own, which needs a free slot for each;
    its single row gates ``x``, whose rows stay in the JVM.
    """

    def run(batches):
        from pyspark import BarrierTaskContext

        BarrierTaskContext.get().barrier()
        yield from batches

    met = x.sparkSession.range(0, tasks, 1, tasks).mapInArrow(run, "id long", barrier=True).agg(F.count("*").alias("_met")).filter(F.col("_met") == tasks)
    return x.crossJoin(F.broadcast(met)).select(*[x[c] for c in x.columns])


def by_rank(x: DataFrame, comm: Comm) -> DataFrame:
    """``x`` with the elements of rank r in partition r exactly."""
    return x.repartitionById(comm.size, F.col("rank"))
