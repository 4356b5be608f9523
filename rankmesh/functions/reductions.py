"""The reduction algebra as Spark columns.

Integers wrap around as in two's complement, values of 16-bit floating types are
added in single precision and rounded to nearest-even, and a fixed order makes floating
sums the same however rows are partitioned. As in Spark, a NaN is the greatest
value for max, and min passes it over.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce as left_fold

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmesh.model import DType

#: Beyond so many ranks a fixed order is evaluated over a sorted array instead of a column for each rank.
MOST_COLUMNS = 64
#: In the stead of a reduction: values are arrays, which are put together with repeats.
TRACE = "trace"
_2_32, _2_64 = 1 << 32, 1 << 64


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it; else a chain of steps would grow without bound."""
    return F.element_at(F.transform(F.array(x), f), 1)


def wrap(x: Column, bits: int) -> Column:
    """A bigint (or, for 64 bits, a decimal) folded into a signed integer of ``bits`` bits."""
    if bits < 64:
        sign = 1 << bits - 1
        return x.bitwiseAND(F.lit((1 << bits) - 1)).bitwiseXOR(F.lit(sign)) - F.lit(sign)
    low = F.pmod(x.cast("decimal(38,0)"), F.lit(str(_2_64)).cast("decimal(38,0)"))
    return (low - F.when(low >= F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(_2_64)).cast("decimal(38,0)")).otherwise(F.lit("0").cast("decimal(38,0)"))).cast("bigint")


def wrapped_sum(val: Column, bits: int) -> Column:
    """Aggregate: the sum of signed integers, wrapped; no intermediate overflows."""
    if bits < 64:
        return wrap(F.sum(val.cast("bigint")), bits)
    # two limbs of 32 bits: both sums stay far from overflow, and shifts wrap
    low = F.sum(val.bitwiseAND(F.lit(_2_32 - 1)))
    high = F.sum(F.shiftright(val, 32)) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_2_32 - 1)))


def _rounded(x: Column, places: int, least: int, most: float) -> Column:
    """A float rounded to ``places`` binary places after the first, ties to even; exponents from ``least`` on; beyond ``most`` infinite."""
    d = F.abs(x.cast("double"))
    e = F.floor(F.log2(d))  # may be off by one next to a power of two
    two = F.lit(2.0)
    e = F.when(F.pow(two, e + 1) <= d, e + 1).when(F.pow(two, e) > d, e - 1).otherwise(e)
    step = F.pow(two, F.greatest(e, F.lit(least)) - places)
    out = F.rint(d / step) * step
    out = F.when(out > most, F.lit(float("inf"))).otherwise(out) * F.signum(x.cast("double"))
    return F.when((d == 0) | F.isnan(d) | (d == float("inf")), x.cast("double")).otherwise(out).cast("float")


def to_half(x: Column) -> Column:
    """A float rounded to the nearest half-precision value, ties to even; beyond 65504 (rounded) infinite."""
    return _rounded(x, 10, -14, 65504.0)


def to_bfloat(x: Column) -> Column:
    """A float rounded to the nearest bfloat16 value (8 bits of precision, the exponents of a float), ties to even."""
    return _rounded(x, 7, -126, float.fromhex("0x1.fep127"))


#: Types whose steps are rounded, and how.
ROUNDED = {"fp16": to_half, "bfp16": to_bfloat}


def _uint64_product(a: Column, b: Column) -> Column:
    """Modulo 2^64, by halves of b, so that no product has more than 38 digits."""
    two_32, mod = (F.lit(str(x)).cast("decimal(38,0)") for x in (_2_32, _2_64))
    low = F.pmod(b.cast("decimal(38,0)"), two_32)
    high = ((b.cast("decimal(38,0)") - low) / two_32).cast("decimal(12,0)")  # exact: nothing is left over to be rounded
    a = a.cast("decimal(20,0)")
    upper = F.pmod((a * high).cast("decimal(38,0)"), two_32) * F.lit(str(_2_32)).cast("decimal(12,0)")
    return F.pmod(upper.cast("decimal(38,0)") + (a * low.cast("decimal(12,0)")).cast("decimal(38,0)"), mod).cast("decimal(20,0)")


def combine(op: str, dtype: DType, a: Column, b: Column) -> Column:
    """One step of a reduction, in the element type's own arithmetic."""
    if op == "max":
        return F.greatest(a, b)
    if op == "min":
        return F.least(a, b)
    if op == TRACE:
        return F.concat(a, b)
    if dtype.signed_bits:
        if dtype.signed_bits == 64:
            a, b = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
        else:
            a, b = a.cast("bigint"), b.cast("bigint")
        out = a + b if op == "sum" else a * b
        return let(out, lambda v: wrap(v, 64)) if dtype.signed_bits == 64 else wrap(out, dtype.signed_bits).cast(dtype.spark)
    if dtype.name == "uint64":
        if op == "sum":
            return F.pmod(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), F.lit(str(_2_64)).cast("decimal(38,0)")).cast("decimal(20,0)")
        return let(F.struct(a.alias("a"), b.alias("b")), lambda v: _uint64_product(v["a"], v["b"]))
    if dtype.spark == "float":
        out = (a.cast("double") + b.cast("double") if op == "sum" else a.cast("double") * b.cast("double")).cast("float")
        return let(out, ROUNDED[dtype.name]) if dtype.name in ROUNDED else out
    return a + b if op == "sum" else a * b


def fold(op: str, dtype: DType, values: list[Column]) -> Column:
    """Left fold in order of rank."""
    return left_fold(lambda a, b: combine(op, dtype, a, b), values)


def in_halving_tree(values: list[Column], step: Callable[[Column, Column], Column]) -> Column:
    """The strict order: while n > 1 values are left, with m the largest power of two below n, each value from m on is put before the one m places back."""
    left = list(values)
    while len(left) > 1:
        m = 1 << (len(left) - 1).bit_length() - 1
        for s in range(m, len(left)):
            left[s % m] = step(left[s], left[s % m])
        left = left[:m]
    return left[0]


def halving_tree(op: str, dtype: DType, values: list[Column]) -> Column:
    return in_halving_tree(values, lambda a, b: combine(op, dtype, a, b))


def halving_tree_of(values: Column, size: int, step: Callable[[Column, Column], Column]) -> Column:
    """The strict order over an array of ``size`` values: a few nested steps, however many there are."""

    def halve(n: int) -> Callable[[Column], Column]:
        m = 1 << (n - 1).bit_length() - 1

        def run(v: Column) -> Column:
            return F.transform(F.slice(v, 1, m), lambda x, s: F.when(s + m < n, step(F.get(v, s + m), x)).otherwise(x))

        return run

    while size > 1:
        values = let(values, halve(size))
        size = 1 << (size - 1).bit_length() - 1
    return F.get(values, F.lit(0))


def unordered(op: str, dtype: DType, val: Column) -> Column | None:
    """An aggregate that Spark can pre-aggregate in any order, or None if the reduction needs a fixed one."""
    if op in ("max", "min"):
        return getattr(F, op)(val)
    if op == TRACE:
        return F.flatten(F.collect_list(val))
    if op == "sum":
        if dtype.signed_bits:
            return wrapped_sum(val, dtype.signed_bits).cast(dtype.spark)
        if dtype.name == "uint64":
            return F.pmod(F.sum(val.cast("decimal(38,0)")), F.lit(str(_2_64)).cast("decimal(38,0)")).cast("decimal(20,0)")
        if dtype.name in ("fp32", "fp64"):
            return F.sum(val).cast(dtype.spark)
    return None


def ordered(op: str, dtype: DType, val: Column, rank: Column, size: int, tree: bool) -> tuple[list[Column], Column]:
    """Aggregates (to be aliased v0, v1, ...) and the column over them that reduces in a fixed order of ranks.

    With few ranks there is an aggregate for each, all of them pre-aggregated;
    beyond that one array of the group's (rank, val), as long as there are ranks.
    """
    if size <= MOST_COLUMNS:
        parts = [F.max(F.when(rank == r, val)).alias(f"v{r}") for r in range(size)]
        return parts, (halving_tree if tree else fold)(op, dtype, [F.col(f"v{r}") for r in range(size)])
    rows = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), val.alias("val")))), lambda x: x["val"])
    own = F.col("v0")

    def step(a: Column, b: Column) -> Column:
        return combine(op, dtype, a, b) if op == TRACE else combine(op, dtype, a, b).cast(dtype.spark)

    if tree:
        return [rows.alias("v0")], halving_tree_of(own, size, step)
    return [rows.alias("v0")], F.aggregate(F.slice(own, 2, F.size(own)), F.element_at(own, 1), step)
