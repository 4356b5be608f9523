"""Operators by name: the collectives, and any that a caller adds.

``run`` looks an operator up and calls it. A name may have several plans, each with
a cost; the cheapest that is legal for the call is taken, unless one is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rankmesh.model import Comm
from rankmesh.operators import collectives as C
from rankmesh.plans import extents as E

Operator = Callable[..., DataFrame]


@dataclass(frozen=True)
class Plan:
    name: str
    build: Operator
    cost: Callable[..., float]
    legal: Callable[..., bool]


OPERATORS: dict[str, dict[str, Plan]] = {}


def operator(name: str, plan: str = "plain", cost: Callable[..., float] = lambda *a, **k: 1.0, legal: Callable[..., bool] = lambda *a, **k: True) -> Callable[[Operator], Operator]:
    """Register the decorated function (x, comm, ...) -> DataFrame as a plan of the operator ``name``; one of the same plan is replaced."""

    def add(build: Operator) -> Operator:
        OPERATORS.setdefault(name, {})[plan] = Plan(plan, build, cost, legal)
        return build

    return add


def choose(name: str, x: DataFrame, comm: Comm, *args, **how) -> Plan:
    """The cheapest legal plan; of equal ones the one registered first."""
    if name not in OPERATORS:
        raise ValueError(f"no such operator: {name}")
    legal = [p for p in OPERATORS[name].values() if p.legal(x, comm, *args, **how)]
    if not legal:
        raise NotImplementedError(f"no plan of {name} for these arguments")
    return min(legal, key=lambda p: p.cost(x, comm, *args, **how))


def run(name: str, x: DataFrame, comm: Comm, *args, plan: str | None = None, **how) -> DataFrame:
    """The result of operator ``name``, by the plan asked for or the one that ``choose`` takes."""
    if plan is None:
        return choose(name, x, comm, *args, **how).build(x, comm, *args, **how)
    if plan not in OPERATORS.get(name, {}):
        raise ValueError(f"no such plan of {name}: {plan}")
    return OPERATORS[name][plan].build(x, comm, *args, **how)


for _name in ("all_reduce", "reduce", "reduce_scatter", "reduce_scatter_v", "all_gather", "all_gather_v", "gather", "broadcast", "scatter", "all_to_all", "all_to_all_v", "all_to_all_vc", "send_recv", "send", "recv", "batch_send_recv"):
    operator(_name)(getattr(C, _name))


@operator("all_reduce", "one_shot", lambda x, comm, *a, **k: float(comm.size))
def _one_shot(x: DataFrame, comm: Comm, op: str = "sum", dtype: str = "int64") -> DataFrame:
    return C.all_reduce_one_shot(x, comm, op, dtype)


@operator("broadcast", "scatter_all_gather", lambda x, comm, *a, **k: 2.0, lambda x, comm, *a, **k: x.columns == ["rank", "idx", "val"])
def _in_two_passes(x: DataFrame, comm: Comm, root: int) -> DataFrame:
    """The root's elements dealt out to all ranks in turn, then gathered by all."""
    own = x.filter(x["rank"] == root)
    dealt = own.select((own["idx"] % comm.size).cast("int").alias("rank"), "idx", "val")
    return C._everywhere(dealt.select("idx", "val"), comm)


@operator("all_gather", "extents", lambda x, comm, *a, **k: 2.0)
def _by_extents(x: DataFrame, comm: Comm, count: int) -> DataFrame:
    """With an extent for each rank, as if they were unequal."""
    return C.all_gather_v(x, comm, E.from_lists(x.sparkSession, [count] * comm.size), check=False)


@operator("all_to_all", "matrix", lambda x, comm, *a, **k: 2.0)
def _by_matrix(x: DataFrame, comm: Comm, count: int) -> DataFrame:
    """With a count for each pair of ranks, as if they were unequal."""
    pairs = [(s, d, count) for s in range(comm.size) for d in range(comm.size)]
    return C.all_to_all_vc(x, comm, E.local(x.sparkSession, "src int, dst int, cnt bigint", pairs))
