"""Costs of communication patterns, and the plan shape that stands for each in Spark.

A cost counts steps (a seconds each), moved bytes (b seconds each) and reduced
bytes (c seconds each) of an operator on n bytes over p ranks. The figures compare
patterns; Spark's own planner picks its physical operators.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    """Steps of one pass (a reduce-scatter or all-gather) over p ranks, the share of n bytes that a rank moves in it, and the plan shape."""

    steps: Callable[[int], int]
    moved: Callable[[int], float]
    shape: str


def _log(p: int) -> int:
    return math.ceil(math.log2(p))


#: Steps and traffic of each pattern.
PATTERNS = {
    "mesh": Pattern(lambda p: 1, lambda p: 1 / p, "one_stage"),
    "ring": Pattern(lambda p: p - 1, lambda p: (p - 1) / p, "one_stage"),
    "star": Pattern(lambda p: 1, lambda p: 1.0, "one_stage"),
    "halving_doubling": Pattern(_log, lambda p: (p - 1) / p, "halving_tree"),
    "uneven_ring": Pattern(_log, lambda p: (p - 1) / p, "by_level"),
    "uneven_bruck": Pattern(_log, lambda p: (p - 1) / p, "by_level"),
    "asymmetric_levels": Pattern(_log, lambda p: (p - 1) / p, "by_level"),
}
#: Passes of an operator, and whether it reduces.
PASSES = {
    "scatter": (1, False),
    "gather": (1, False),
    "all_gather": (1, False),
    "reduce_scatter": (1, True),
    "broadcast": (2, False),
    "reduce": (2, True),
    "all_reduce": (2, True),
}


def cost(operator: str, pattern: str, n: float, p: int, a: float, b: float, c: float) -> float:
    """Seconds of an operator by a pattern: its passes' steps and traffic, and (p - 1) / p of the bytes reduced once.

    A ring passes a broadcast or a reduction on whole, in one pass. Halving and
    doubling over a number of ranks that isn't a power of two first folds the rest
    into it, and unfolds it in the end where there are two passes.
    """
    if operator not in PASSES:
        raise ValueError(f"no cost rule for {operator}")
    if pattern not in PATTERNS:
        raise ValueError(f"no such pattern: {pattern}")
    if p < 2:
        return 0.0
    (passes, reduces), own = PASSES[operator], PATTERNS[pattern]
    if pattern == "ring" and operator in ("broadcast", "reduce"):
        return (p - 1) * (a + n * b + reduces * n * c)
    if pattern == "star":
        return passes * (a + n * b) + reduces * (p - 1) * n * c
    extra = 0.0
    if pattern == "halving_doubling" and p & (p - 1):
        extra = a + n * b + reduces * n * c + (passes - 1) * (a + n * b)
        p = 1 << p.bit_length() - 1
    return extra + passes * (own.steps(p) * a + own.moved(p) * n * b) + reduces * (p - 1) / p * n * c


def all_reduce_cost(pattern: str, n: float, p: int, a: float, b: float, c: float) -> float:
    return cost("all_reduce", pattern, n, p, a, b, c)


def pairwise_cost(matrix: Sequence[Sequence[float]], a: float, b: float) -> float:
    """Seconds of an all-to-all in rounds: in round k rank i sends to rank i + k, and the round lasts as long as its largest block."""
    p = len(matrix)
    return sum(a + b * max(matrix[i][(i + k) % p] for i in range(p)) for k in range(1, p))


def pipeline_cost(operator: str, n: float, p: int, servers: int, within: tuple[float, float], between: tuple[float, float]) -> float:
    """Seconds of an all-gather, reduce-scatter or all-reduce whose steps between servers run beside those within; ``within`` and ``between`` are (a, b) of either."""
    if operator not in ("all_gather", "reduce_scatter", "all_reduce"):
        raise ValueError(f"no pipeline of {operator}")
    inner, outer = (n / p * b + a for a, b in (within, between))
    return PASSES[operator][0] * (max(inner, outer) * (servers - 1) + inner)


def levels_cost(n: float, groups: Sequence[int], convergence: float, a: float, b: float, c: float) -> float:
    """Seconds of a reduce-scatter over groups of unequal sizes: within the largest group, then between groups, whose links are ``convergence`` times as slow."""
    m, most, g = min(groups), max(groups), len(groups)
    steps = 2 * (math.ceil(math.log2(most)) + math.ceil(math.log2(g)))
    inner, outer = (most - 1) / most, (g - 1) / (g * m)
    return steps * a + 2 * (inner + outer * convergence) * n * b + (inner + outer) * n * c


def output_count(operator: str, count: int, size: int = -1, counts: list[int] | None = None, displs: list[int] | None = None) -> int:
    """Elements of a rank's result, by the shape rules of tensors' first dimension; -1 where something it needs is unknown (-1)."""
    if operator in ("all_reduce", "broadcast", "reduce", "all_to_all", "send", "receive"):
        return count
    if operator == "all_gather":
        return -1 if count < 0 or size < 0 else count * size
    if operator == "reduce_scatter":
        if count < 0 or size < 0:
            return -1
        if count % size:
            raise ValueError(f"{count} elements can't be split evenly among {size} ranks")
        return count // size
    if operator in ("all_gather_v", "all_to_all_v"):
        if counts is None or any(c < 0 for c in counts):
            return -1
        displs = displs if displs is not None else [sum(counts[:k]) for k in range(len(counts))]
        return max((d + c for c, d in zip(counts, displs, strict=True) if c), default=0)
    if operator in ("reduce_scatter_v", "all_to_all_vc"):
        return -1 if counts is None or any(c < 0 for c in counts) else sum(counts)
    raise ValueError(f"no shape rule for {operator}")
