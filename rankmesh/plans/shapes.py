"""Plan shapes of a reduction, and the choice among them.

All shapes give the same result but for the order of floating-point sums. The
choice works like this: hard filters remove shapes that can't give the result
asked for, soft filters those that are seldom worth it, hints sort the rest into
tiers, a tuner may change costs (below 0 removes a shape), and the cheapest of the
best tier is taken. If filters and hints leave nothing, soft filters and hints are
dropped, as a plan is better than none.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmesh.functions import reductions as R
from rankmesh.model import Comm, DType

#: How firmly the order of a reduction is fixed: not at all, by rank, or as the halving tree.
ORDERS = ("any", "fixed", "strict")


@dataclass(frozen=True)
class Request:
    op: str
    dtype: DType
    comm: Comm
    order: str = "any"


def needs_order(q: Request) -> str:
    """The order that is due: products, half precision and everything asked for; integers, max and min never need one beyond that."""
    if q.op in ("max", "min"):
        return "any"
    if q.order == "strict" and not (q.dtype.name in ("fp16", "fp32", "bfp16", "fp64") and q.comm.size > 2):
        return "fixed" if R.unordered(q.op, q.dtype, F.lit(0)) is None else "any"
    if q.order == "any" and R.unordered(q.op, q.dtype, F.lit(0)) is None:
        return "fixed"
    return q.order


def one_stage(x: DataFrame, q: Request) -> DataFrame:
    """(idx, val): one shuffle, pre-aggregated."""
    return x.groupBy("idx").agg(R.unordered(q.op, q.dtype, F.col("val")).alias("val"))


def by_level(x: DataFrame, q: Request) -> DataFrame:
    """(idx, val): within each group of every level in turn, then over all."""
    for k, groups in enumerate(q.comm.levels):
        of = F.element_at(F.array(*[F.lit(g) for g in groups]), F.col("rank") + 1) if k == 0 else None
        if of is None:
            # a group of the level below lies within one of this level
            up = dict(zip(q.comm.levels[k - 1], groups, strict=True))
            of = F.element_at(F.create_map(*[F.lit(v) for pair in up.items() for v in pair]), F.col("rank"))
        x = x.groupBy(of.alias("rank"), "idx").agg(R.unordered(q.op, q.dtype, F.col("val")).alias("val"))
    return one_stage(x, q)


def _in_order(x: DataFrame, q: Request, tree: bool) -> DataFrame:
    parts, out = R.ordered(q.op, q.dtype, F.col("val"), F.col("rank"), q.comm.size, tree)
    return x.groupBy("idx").agg(*parts).select("idx", (out if q.op == R.TRACE else out.cast(q.dtype.spark)).alias("val"))


def left_fold(x: DataFrame, q: Request) -> DataFrame:
    """(idx, val): ranks in ascending order."""
    return _in_order(x, q, False)


def halving_tree(x: DataFrame, q: Request) -> DataFrame:
    """(idx, val): the strict order."""
    return _in_order(x, q, True)


@dataclass(frozen=True)
class Shape:
    """A plan: what makes it, which orders it keeps, whether it is legal and sensible, and its cost in shuffled rows for each input row."""

    name: str
    build: Callable[[DataFrame, Request], DataFrame]
    orders: tuple[str, ...]
    cost: Callable[[Request], float]
    legal: Callable[[Request], bool] = lambda q: True
    sensible: Callable[[Request], bool] = lambda q: True


SHAPES: dict[str, Shape] = {}


def register(shape: Shape) -> Shape:
    """Add a plan shape, or put one in place of another of the same name."""
    SHAPES[shape.name] = shape
    return shape


def _any(q: Request) -> bool:
    return R.unordered(q.op, q.dtype, F.lit(0)) is not None


register(Shape("one_stage", one_stage, ("any",), lambda q: 1.0, _any))
register(Shape("by_level", by_level, ("any",), lambda q: 1.0 + len(q.comm.levels), lambda q: _any(q) and bool(q.comm.levels), lambda q: q.comm.size > 64))
register(Shape("left_fold", left_fold, ("any", "fixed"), lambda q: 1.5))
register(Shape("halving_tree", halving_tree, ("any", "strict"), lambda q: 2.0))

Tuner = Callable[[dict[str, float]], Mapping[str, float]]


@dataclass
class Choice:
    """The shape taken, the costs that were compared, and why others were not."""

    shape: Shape
    costs: dict[str, float]
    rejected: dict[str, str]

    def explain(self) -> str:
        return "\n".join([f"{'*' if n == self.shape.name else ' '} {n}: cost {c:g}" for n, c in self.costs.items()] + [f"  {n}: {why}" for n, why in self.rejected.items()])


def choose(q: Request, hints: Mapping[str, int] | None = None, tuner: Tuner | None = None) -> Choice:
    """``hints``: 1 for a preferred shape, -1 for an unwanted one."""
    order, hints = needs_order(q), dict(hints or {})
    if unknown := set(hints) - set(SHAPES):
        raise ValueError(f"no such plan shape: {', '.join(sorted(unknown))}")
    rejected: dict[str, str] = {}
    legal = {}
    for name, s in SHAPES.items():
        if order not in s.orders:
            rejected[name] = f"doesn't keep the order: {order}"
        elif not s.legal(q):
            rejected[name] = "not possible for this reduction and group"
        else:
            legal[name] = s
    if not legal:
        raise NotImplementedError(f"no plan for {q.op} of {q.dtype.name} in {order} order over {q.comm.size} ranks")
    kept = {n: s for n, s in legal.items() if s.sensible(q) or hints.get(n, 0) > 0 or tuner}
    kept = kept or legal
    best = max(hints.get(n, 0) for n in kept)
    tier = {n: s for n, s in kept.items() if hints.get(n, 0) == best} if best >= 0 else legal
    costs = {n: s.cost(q) for n, s in tier.items()}
    if tuner:
        changed = {n: c for n, c in tuner(dict(costs)).items() if n in tier}
        costs = {n: c for n, c in changed.items() if c >= 0} or costs
    for n in legal:
        if n not in costs:
            rejected[n] = "not worth it here, unwanted, or a lower tier"
    return Choice(SHAPES[min(costs, key=costs.get)], costs, rejected)
