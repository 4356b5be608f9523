"""Collectives against the plain meaning of each, on small arrays."""

from __future__ import annotations

import functools
import json
import operator

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmesh import lineage, validate
from rankmesh.functions import reductions as R
from rankmesh.model import DTYPES, Comm
from rankmesh.operators import arrays, registry
from rankmesh.operators import collectives as C
from rankmesh.plans import extents as E
from rankmesh.plans import families, rules, shapes
from rankmesh.sources import relations, topology

P = 8
COMM = Comm(P)


def array(spark, buffers, kind="bigint"):
    rows = [(r, i, v) for r, b in enumerate(buffers) for i, v in enumerate(b)]
    return spark.createDataFrame(rows, f"rank int, idx bigint, val {kind}")


def held(x) -> dict[int, list]:
    out: dict[int, dict] = {}
    for r in x.collect():
        assert r.idx not in out.setdefault(r["rank"], {})
        out[r["rank"]][r.idx] = r.val
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


@pytest.fixture(scope="module")
def same(spark):
    return array(spark, [list(range(P))] * P).cache()


@pytest.fixture(scope="module")
def own(spark):
    return array(spark, [[r] * P for r in range(P)]).cache()


# the samples: eight ranks, small whole numbers


def test_all_reduce(same):
    assert held(C.all_reduce(same, COMM)) == {r: [8 * i for i in range(P)] for r in range(P)}


def test_reduce_reaches_the_root_alone(same):
    assert held(C.reduce(same, COMM, 0)) == {0: [8 * i for i in range(P)]}


def test_broadcast(same):
    assert held(C.broadcast(same, COMM, 0)) == {r: list(range(P)) for r in range(P)}


def test_all_gather_and_gather(spark):
    x = array(spark, [[r] for r in range(P)])
    assert held(C.all_gather(x, COMM, 1)) == {r: list(range(P)) for r in range(P)}
    assert held(C.gather(x, COMM, 3, 1)) == {3: list(range(P))}


def test_reduce_scatter(same):
    assert held(C.reduce_scatter(same, COMM, 1)) == {r: [8 * r] for r in range(P)}


def test_scatter(same):
    assert held(C.scatter(same, COMM, 0, 1)) == {r: [r] for r in range(P)}


def test_all_to_all_forms(spark, own):
    want = {r: list(range(P)) for r in range(P)}
    assert held(C.all_to_all(own, COMM, 1)) == want
    ones = spark.createDataFrame([(s, d, 1) for s in range(P) for d in range(P)], "src int, dst int, cnt bigint")
    assert held(C.all_to_all_vc(own, COMM, ones)) == want
    assert held(C.all_to_all_v(own, COMM, E.from_matrix(ones))) == want


def test_all_gather_v(spark):
    x = array(spark, [[r] * (r + 1) for r in range(P)])
    assert held(C.all_gather_v(x, COMM, E.from_lists(spark, [r + 1 for r in range(P)])))[5] == [r for r in range(P) for _ in range(r + 1)]


def test_reduce_scatter_v(spark):
    x = array(spark, [[r] * 36 for r in range(P)])
    assert held(C.reduce_scatter_v(x, COMM, E.from_lists(spark, [r + 1 for r in range(P)]))) == {r: [28] * (r + 1) for r in range(P)}


def test_send_recv_and_ring(spark, own):
    pairs = spark.createDataFrame([(r, r + 1) for r in range(0, P, 2)], "src int, dst int")
    assert held(C.send_recv(own, COMM, pairs)) == {r: [r - 1] * P for r in range(1, P, 2)}
    items = [i for r in range(P) for i in ((r, 0, "send", (r + 1) % P, 0, P), (r, 1, "recv", (r - 1) % P, 0, P))]
    items = spark.createDataFrame(items, "rank int, ordinal int, kind string, peer int, base bigint, cnt bigint")
    assert held(C.batch_send_recv(own, COMM, items)) == {r: [(r - 1) % P] * P for r in range(P)}


def test_send_and_receive_one(own):
    assert held(C.send(own, COMM, 2, 5)) == {5: [2] * P} == held(C.recv(own, COMM, 5, 2))
    assert C.send(own, COMM, 3, 3).count() == 0
    with pytest.raises(ValueError):
        C.send(own, COMM, 0, P)
    with pytest.raises(ValueError):
        C.item(0, 0, "push", 1, 0, 1)
    both = C.items(own, [C.item(0, 0, "send", 1, 2, 3), C.item(1, 0, "recv", 0, 5, 3), C.item(0, 1, "send", 1, 0, 1), C.item(1, 7, "recv", 0, 0, 1)])
    assert sorted((r["rank"], r.idx, r.val) for r in C.batch_send_recv(own, COMM, both).collect()) == [(1, 0, 0), (1, 5, 0), (1, 6, 0), (1, 7, 0)]


# beyond the samples


def test_unequal_blocks_with_holes_and_empty_ranks(spark):
    rng = np.random.default_rng(1)
    p = 4
    cnt = rng.integers(0, 4, (p, p))
    cnt[2] = 0
    sdispl = np.cumsum(cnt, 1) - cnt + np.arange(p)[None, :]
    rdispl = np.cumsum(cnt, 0) - cnt + 2 * np.arange(p)[:, None]
    x = array(spark, [rng.integers(0, 100, 40).tolist() for _ in range(p)])
    ext = spark.createDataFrame([(s, d, int(cnt[s, d]), int(sdispl[s, d]), int(cnt[s, d]), int(rdispl[s, d])) for s in range(p) for d in range(p)], "src int, dst int, scnt bigint, sdispl bigint, rcnt bigint, rdispl bigint")
    own = {(r["rank"], r.idx): r.val for r in x.collect()}
    want = {(d, int(rdispl[s, d]) + k): own[s, int(sdispl[s, d]) + k] for s in range(p) for d in range(p) for k in range(cnt[s, d])}
    assert {(r["rank"], r.idx): r.val for r in C.all_to_all_v(x, Comm(p), ext).collect()} == want


@pytest.mark.parametrize("kind", [n for n, d in DTYPES.items() if d.signed_bits or n == "uint64"])
@pytest.mark.parametrize("op", ["sum", "prod", "max", "min"])
def test_integers_wrap(spark, kind, op):
    d = DTYPES[kind]
    if op == "prod" and not d.multiplies:
        with pytest.raises(NotImplementedError):
            C.all_reduce(array(spark, [[1]] * 3), Comm(3), op, kind)
        return
    bits = d.signed_bits or 64
    low, high = (0, (1 << 64) - 1) if kind == "uint64" else (-(1 << bits - 1), (1 << bits - 1) - 1)
    import decimal
    import random

    rng = random.Random(kind + op)
    values = [[rng.choice([low, high, rng.randint(low, high)]) for _ in range(6)] for _ in range(3)]
    put = (lambda v: decimal.Decimal(v)) if kind == "uint64" else (lambda v: v)
    got = held(C.all_reduce(array(spark, [[put(v) for v in b] for b in values], d.spark), Comm(3), op, kind))
    for i in range(6):
        column = [b[i] for b in values]
        want = {"sum": sum(column), "prod": column[0] * column[1] * column[2], "max": max(column), "min": min(column)}[op]
        if op in ("sum", "prod"):
            want %= 1 << bits
            want -= (1 << bits) * (kind != "uint64" and want >= 1 << bits - 1)
        assert [int(got[r][i]) for r in range(3)] == [want] * 3


def test_half_precision_rounds_to_even(spark):
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 1 << 32, 4000, dtype=np.uint32).view(np.float32)
    some = np.concatenate([bits, rng.normal(0, 1, 2000).astype(np.float32), np.float32([0, -0.0, 65504, 65519.99, 65520, -70000, 2**-24, 2**-25, 3 * 2**-26, 1 + 2**-11, 1 + 3 * 2**-11, np.inf, -np.inf])])
    some = some[~np.isnan(some)]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in some], "v float").select(R.to_half(F.col("v"))).collect()]
    with np.errstate(over="ignore"):
        assert np.array_equal(np.float32(got), some.astype(np.float16).astype(np.float32))


def test_half_precision_sum_in_order(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 100, (5, 50)).astype(np.float16)
    got = held(C.all_reduce(array(spark, [[float(v) for v in b] for b in values], "float"), Comm(5), "sum", "fp16"))
    want = values[0]
    for b in values[1:]:
        want = (want.astype(np.float32) + b.astype(np.float32)).astype(np.float16)
    assert np.array_equal(np.float16(got[2]), want)


@pytest.mark.parametrize("p", [2, 3, 4, 5, 8])
def test_strict_order_is_the_halving_tree(spark, p):
    rng = np.random.default_rng(p)
    v = (rng.normal(0, 1, (p, 30)) * 10.0 ** rng.integers(-8, 8, (p, 30))).tolist()

    def tree(x):
        x = list(x)
        while len(x) > 1:
            m = 1
            while m * 2 < len(x):
                m *= 2
            for s in range(m, len(x)):
                x[s % m] = x[s] + x[s % m]
            x = x[:m]
        return x[0]

    x = array(spark, v, "double")
    assert held(C.all_reduce(x, Comm(p), "sum", "fp64", order="strict"))[0] == ([tree(c) for c in zip(*v, strict=True)] if p > 2 else [a + b for a, b in zip(*v, strict=True)])
    left = held(C.all_reduce(x.repartition(5), Comm(p), "sum", "fp64", order="fixed"))[p - 1]
    assert left == [functools.reduce(operator.add, c) for c in zip(*v, strict=True)]


def test_order_over_many_ranks(spark):
    p = 70
    x = array(spark, [[0.1 * r, 1e16 * (-1) ** r] for r in range(p)], "double")
    want = [0.0, 1e16]
    for r in range(1, p):
        want = [want[0] + 0.1 * r, want[1] + 1e16 * (-1) ** r]
    assert held(C.reduce(x, Comm(p), 0, "sum", "fp64", order="fixed"))[0] == want


def test_shapes_agree(spark):
    rng = np.random.default_rng(5)
    comm = Comm.nested([[[0, 1, 2], [3, 4, 5]], [[6, 7]]])
    assert comm.levels == ((0, 0, 0, 1, 1, 1, 2, 2), (0, 0, 0, 0, 0, 0, 1, 1))
    x = array(spark, rng.integers(-(10**9), 10**9, (8, 20)).tolist())
    plain = held(C.all_reduce(x, comm))
    for name in shapes.SHAPES:
        assert held(C.all_reduce(x, comm, hints={name: 1})) == plain
    assert held(C.all_reduce_one_shot(x, comm)) == plain


def test_choice():
    q = shapes.Request("sum", DTYPES["int64"], Comm(4))
    assert shapes.choose(q).shape.name == "one_stage"
    assert shapes.choose(q, tuner=lambda c: {**c, "left_fold": 0.0}).shape.name == "left_fold"
    assert shapes.choose(q, tuner=lambda c: {n: -1.0 for n in c}).shape.name == "one_stage"
    assert shapes.choose(q, hints={n: -1 for n in ("one_stage", "left_fold", "halving_tree")}).shape.name == "one_stage"
    assert "doesn't keep the order" in shapes.choose(shapes.Request("prod", DTYPES["fp32"], Comm(4))).explain()
    assert shapes.choose(shapes.Request("sum", DTYPES["fp64"], Comm(4), "strict")).shape.name == "halving_tree"
    with pytest.raises(ValueError):
        shapes.choose(q, hints={"nothing": 1})


def test_one_rank_and_no_elements(spark):
    x = array(spark, [[1, 2]])
    assert held(C.all_reduce(x, Comm(1))) == {0: [1, 2]} == held(C.all_gather(x, Comm(1), 2))
    none = x.limit(0)
    for y in (C.all_reduce(none, COMM), C.reduce_scatter(none, COMM, 0), C.all_to_all(none, COMM, 0), C.all_gather(none, COMM, 0), C.reduce_scatter_v(none, COMM, E.from_lists(spark, [0] * P))):
        assert y.columns == ["rank", "idx", "val"] and y.count() == 0


def test_wrong_arguments(spark, own):
    for call in (lambda: C.reduce(own, COMM, P), lambda: C.all_reduce(own, COMM, "avg"), lambda: C.all_reduce(own, COMM, "sum", "int3"), lambda: C.all_gather(own, COMM, -1), lambda: C.all_reduce(own, COMM, order="some"), lambda: Comm(0), lambda: Comm(2, ((0,),)), lambda: validate.count(7, 2)):
        with pytest.raises(ValueError):
            call()
    for op, kind, operator in (("sum", "uint8", "all_reduce"), ("prod", "int16", "all_reduce"), ("sum", "int128", "all_reduce"), ("sum", "fp64", "reduce_scatter_v"), ("sum", "hif8", "reduce_scatter"), ("prod", "bfp16", "all_reduce")):
        with pytest.raises(NotImplementedError):
            validate.reduction(op, kind, operator)
    with pytest.raises(NotImplementedError):
        validate.dtype_of("int128")
    lone = spark.createDataFrame([(0, 0, "send", 1, 0, 1)], "rank int, ordinal int, kind string, peer int, base bigint, cnt bigint")
    with pytest.raises(ValueError):
        C.batch_send_recv(own, COMM, lone)


def test_checks_against_data(spark, own):
    validate.dense(own, COMM, P)
    with pytest.raises(ValueError):
        validate.dense(own.filter("rank != 3 or idx != 2"), COMM, P)
    with pytest.raises(ValueError):
        validate.dense(own.unionByName(own.filter("rank = 1 and idx = 1")), COMM, P)
    validate.extents(E.from_lists(spark, [2, 0, 3], [0, 1, 2]), Comm(3), apart=[])
    with pytest.raises(ValueError):
        validate.extents(E.from_lists(spark, [2, 2, 3], [0, 1, 3]), Comm(3), apart=[])
    with pytest.raises(ValueError):
        validate.extents(E.from_lists(spark, [-1]), Comm(1))


def test_lineage(spark, own):
    x = lineage.traced(own)
    assert lineage.broken_reduction(own, P).count() == 0
    assert lineage.broken_reduction(own.filter("rank != 2 or idx != 0"), P).count() == 1
    moved = C.all_to_all(x, COMM, 1)
    assert lineage.broken_move(moved, F.col("idx"), F.col("rank")).count() == 0
    assert lineage.broken_move(C.all_gather(x, COMM, P), F.floor(F.col("idx") / P), F.col("idx") % P).count() == 0


def test_lineage_goes_through_the_plan(spark, own, monkeypatch):
    from dataclasses import replace

    assert lineage.broken_reduction(own.unionByName(own.filter("rank = 1 and idx = 0")), P).count() == 1
    for shape in shapes.SHAPES:
        assert lineage.broken_reduction(own, Comm(P, ((0, 0, 0, 0, 1, 1, 1, 1), (0,) * P)), hints={shape: 1}).count() == 0
    one = shapes.SHAPES["one_stage"]
    monkeypatch.setitem(shapes.SHAPES, "one_stage", replace(one, build=lambda x, q: one.build(x.filter("rank != 1 or idx != 0"), q)))
    assert lineage.broken_reduction(own, COMM).count() == 1


def test_arrays(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0, 1, (3, 4, 5))
    x = spark.createDataFrame([(r, i, v[r, i].tolist()) for r in range(3) for i in range(4)], "rank int, idx bigint, vals array<double>")
    got = {(r["rank"], r.idx): r.vals for r in arrays.all_reduce(x, Comm(3)).collect()}
    assert got == {(r, i): (v[1, i] + (v[2, i] + v[0, i])).tolist() for r in range(3) for i in range(4)}
    assert {tuple(r.vals) for r in arrays.all_reduce(x, Comm(3), "max").filter("rank = 0").collect()} == {tuple(v[:, i].max(0)) for i in range(4)}


def test_forms_and_placement(spark, own):
    assert sorted(relations.explode(relations.gathered(own)).collect()) == sorted(own.collect())
    assert relations.counts(own) == (P, P)
    where = C.by_rank(own, COMM).select("rank", F.spark_partition_id().alias("part")).distinct().collect()
    assert all(r["rank"] == r.part for r in where) and len(where) == P


def test_barrier(own):
    out = C.barrier(own, 2)
    assert out.columns == own.columns and sorted(out.collect()) == sorted(own.collect())


def test_rank_filter_is_pushed_below_the_copies(spark, own):
    """The filter is on the small side of the join that makes the copies, not above it."""
    plan = C.broadcast(own, COMM, 1).filter("rank = 3")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    join = next(k for k, line in enumerate(plan) if "Join" in line)
    assert not any("Filter" in line for line in plan[:join])
    ranks = next(k for k, line in enumerate(plan) if "Range (" in line)
    assert any("Filter" in line and "3" in line for line in plan[join:ranks])


def bfloat(x: np.ndarray) -> np.ndarray:
    """Nearest bfloat16, ties to even, by the bits of a float."""
    bits = x.astype(np.float32).view(np.uint32).astype(np.uint64)
    rounded = (bits + 0x7FFF + (bits >> 16 & 1)) >> 16 << 16
    return rounded.astype(np.uint32).view(np.float32)


def test_bfloat_rounds_to_even(spark):
    rng = np.random.default_rng(2)
    some = np.concatenate([rng.integers(0, 1 << 32, 4000, dtype=np.uint32).view(np.float32), rng.normal(0, 1, 2000).astype(np.float32), np.float32([0, -0.0, 1 + 2**-10, 1 + 2**-8, 1 + 3 * 2**-8, 3.39e38, 3.4e38, -3.4e38, 2**-126, 1e-40, np.inf, -np.inf])])
    some = some[~np.isnan(some)]
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in some], "v float").select(R.to_bfloat(F.col("v"))).collect()]
    assert np.array_equal(np.float32(got), bfloat(some))


def test_bfloat_sum_rounds_each_step(spark):
    rng = np.random.default_rng(4)
    values = bfloat(rng.normal(0, 100, (5, 50)))
    x = array(spark, [[float(v) for v in b] for b in values], "float")
    want = values[0]
    for b in values[1:]:
        want = bfloat(want + b)
    assert np.array_equal(np.float32(held(C.all_reduce(x, Comm(5), "sum", "bfp16"))[2]), want)
    assert held(C.all_reduce(array(spark, [[1.0], [2.0**-10]], "float"), Comm(2), "sum", "bfp16"))[0] == [1.0]


@pytest.mark.parametrize("p", [65, 100, 128])
def test_strict_order_over_many_ranks(spark, p):
    rng = np.random.default_rng(p)
    v = (rng.normal(0, 1, (p, 4)) * 10.0 ** rng.integers(-8, 8, (p, 4))).tolist()

    def tree(x):
        x = list(x)
        while len(x) > 1:
            m = 1 << (len(x) - 1).bit_length() - 1
            for s in range(m, len(x)):
                x[s % m] = x[s] + x[s % m]
            x = x[:m]
        return x[0]

    want = [tree(c) for c in zip(*v, strict=True)]
    assert held(C.reduce(array(spark, v, "double"), Comm(p), 0, "sum", "fp64", order="strict"))[0] == want
    rows = spark.createDataFrame([(r, 0, b) for r, b in enumerate(v)], "rank int, idx bigint, vals array<double>")
    assert arrays.all_reduce(rows, Comm(p)).filter("rank = 1").first().vals == want
    left = arrays.all_reduce(rows, Comm(p), strict=False).filter("rank = 0").first().vals
    assert left == [functools.reduce(operator.add, c) for c in zip(*v, strict=True)]


def test_preconditions_of_unequal_blocks(spark, own):
    ext = E.from_lists(spark, [P] * P)
    with pytest.raises(ValueError):  # rank 2 holds fewer, then more, than its extent
        C.all_gather_v(own.filter("rank != 2 or idx != 7"), COMM, ext)
    with pytest.raises(ValueError):
        C.all_gather_v(own, COMM, E.from_lists(spark, [P] * 2 + [P - 1] + [P] * 5))
    with pytest.raises(ValueError):
        C.all_gather_v(own, COMM, E.from_lists(spark, [P] * P, [0] * P))
    with pytest.raises(Exception, match="beyond its rank's extent"):
        C.all_gather_v(own, COMM, E.from_lists(spark, [P - 1] * P), check=False).collect()
    block = "src int, dst int, scnt bigint, sdispl bigint, rcnt bigint, rdispl bigint"
    for rows in ([(0, 1, 4, 0, 2, 0)], [(0, P, 1, 0, 1, 0)], [(0, 1, -1, 0, -1, 0)], [(0, 1, 1, 0, 1, 0)] * 2, [(0, None, 1, 0, 1, 0)]):
        with pytest.raises(ValueError):
            C.all_to_all_v(own, COMM, spark.createDataFrame(rows, block))
    for rows in ([(0, 1, -1)], [(0, 1, 1 << 40)], [(0, 1, 1)] * 2, [(0, 9, 1)]):
        with pytest.raises(ValueError):
            C.all_to_all_vc(own, COMM, spark.createDataFrame(rows, "src int, dst int, cnt bigint"))
    for rows in ([(0, P)], [(0, 1), (2, 1)]):
        with pytest.raises(ValueError):
            C.send_recv(own, COMM, spark.createDataFrame(rows, "src int, dst int"))
    with pytest.raises(ValueError):
        C.all_reduce(own.filter("rank != 3 or idx != 2"), COMM, held=P)
    with pytest.raises(ValueError):
        C.all_gather(own, COMM, P - 1, check=True)
    assert held(C.all_reduce(own, COMM, held=P))[0] == [sum(range(P))] * P


def test_received_schema(spark):
    x = array(spark, [[1, 300], [0, 0]])
    assert dict(C.recv(x, Comm(2), 1, 0, "smallint").dtypes)["val"] == "smallint"
    assert held(C.recv(x, Comm(2), 1, 0, "smallint")) == {1: [1, 300]}
    with pytest.raises(Exception, match="tinyint can't hold"):
        C.recv(x, Comm(2), 1, 0, "tinyint").collect()


def rank_table(levels, **more) -> str:
    return json.dumps({"rank_count": len(levels), "rank_list": [{"rank_id": r, "level_list": [{"net_layer": k, "net_instance_id": n} for k, n in own.items()]} for r, own in enumerate(levels)]} | more)


def test_rank_tables():
    comm = topology.from_rank_table(rank_table([{0: "b", 1: "x"}, {0: "b", 1: "x"}, {0: "a", 1: "x"}, {0: "c", 1: "y"}], version="2.0"))
    assert comm == Comm(4, ((0, 0, 1, 2), (0, 0, 0, 1)))
    assert topology.from_rank_table(rank_table([{}, {}])) == Comm(2)
    for bad in (rank_table([{0: "a"}, {}]), rank_table([{0: "a", 1: "x"}, {0: "a", 1: "y"}]), rank_table([{}], rank_count=2), rank_table([{k: "a" for k in range(5)}]), json.dumps({"rank_list": [{"rank_id": 0}, {"rank_id": 0}]}), json.dumps({"rank_list": [{"rank_id": 1}]})):
        with pytest.raises(ValueError):
            topology.from_rank_table(bad)


def test_tuner_rules():
    text = json.dumps({"version": 1, "op_types": {"allreduce": {"rules": [
        {"match": {"min_ranks": 4, "max_ranks": 8, "min_bytes": 0, "max_bytes": 64, "data_type": "FP32"}, "template": "meshoneshot", "cost": 0.25},
        {"match": {"min_ranks": 8, "max_ranks": 8, "min_bytes": 0, "max_bytes": 1000}, "template": "nhr", "cost": 0.0},
        {"match": {"min_ranks": 8, "max_ranks": 8}, "template": "mesh", "cost": -1},
    ]}}})
    table = rules.load(text)
    comm = Comm.nested([[0, 1, 2, 3], [4, 5, 6, 7]])
    for dtype, count, want in (("fp32", 16, {"one_stage": 0.25}), ("fp32", 17, {"by_level": 0.0}), ("int64", 16, {"by_level": 0.0}), ("int64", 1000, {"one_stage": -1.0})):
        q = shapes.Request("sum", DTYPES[dtype], comm)
        tune = rules.tuner(table, "all_reduce", q, count)
        plain = {"one_stage": 1.0, "by_level": 2.0, "left_fold": 1.5}
        assert tune(plain) == plain | want
        taken = shapes.choose(q, tuner=tune).shape.name
        assert taken == ("left_fold" if want.get("one_stage") == -1 else next(iter(want)))
    assert rules.tuner(table, "reduce", q, 1)({"one_stage": 1.0}) == {"one_stage": 1.0}
    assert rules.shape_of("meshconcurnhrnhr") == "one_stage" and rules.shape_of("nothing") is None
    for bad in ({"version": 2}, {"version": 1, "op_types": {"x": {"rules": [{"match": {}}]}}}, {"version": 1, "op_types": {"x": {"rules": [{"match": {}, "template": "mesh", "cost": -2}]}}}):
        with pytest.raises(ValueError):
            rules.load(json.dumps(bad))


def test_operators_by_name(spark, same, own, monkeypatch):
    monkeypatch.setattr(registry, "OPERATORS", {k: dict(v) for k, v in registry.OPERATORS.items()})
    assert held(registry.run("all_reduce", same, COMM)) == held(C.all_reduce(same, COMM)) == held(registry.run("all_reduce", same, COMM, plan="one_shot"))
    for name, args in (("broadcast", (3,)), ("all_gather", (P,)), ("all_to_all", (1,))):
        plans = list(registry.OPERATORS[name])
        assert len(plans) > 1 and registry.choose(name, own, COMM, *args).name == "plain"
        results = [held(registry.run(name, own, COMM, *args, plan=p)) for p in plans]
        assert all(r == results[0] for r in results)

    @registry.operator("turned")
    def turned(x, comm, by):
        return x.select(((F.col("rank") + by) % comm.size).cast("int").alias("rank"), "idx", "val")

    @registry.operator("turned", "slow", cost=lambda *a, **k: 5.0)
    def slow(x, comm, by):
        return turned(x, comm, by).repartition(2)

    assert held(registry.run("turned", own, COMM, 2))[2] == [0] * P == held(registry.run("turned", own, COMM, by=2, plan="slow"))[2]
    registry.operator("turned", legal=lambda *a, **k: False)(turned)
    assert registry.choose("turned", own, COMM, 1).name == "slow"
    for call in (lambda: registry.run("nothing", own, COMM), lambda: registry.run("turned", own, COMM, plan="x")):
        with pytest.raises(ValueError):
            call()


def test_lineage_of_moves(own):
    x, at = lineage.traced(own), own.select("rank", "idx", F.col("rank").alias("src_rank"), F.col("idx").alias("src_idx"))
    assert lineage.broken(x, at).count() == 0
    assert lineage.broken(x.filter("rank != 1 or idx != 0"), at).count() == 1
    assert lineage.broken(x.unionByName(x.filter("rank = 1 and idx = 0")), at).count() == 1
    assert lineage.broken(x.withColumn("idx", 7 - F.col("idx")), at).count() == 2 * P * P
    assert lineage.broken(x.withColumn("val", F.array("val", "val")), at).count() == P * P


def test_array_forms(spark):
    v = np.random.default_rng(8).normal(0, 1, (3, 6, 2))
    x = spark.createDataFrame([(r, i, v[r, i].tolist()) for r in range(3) for i in range(6)], "rank int, idx bigint, vals array<double>")
    got = {(r["rank"], r.idx): r.vals for r in arrays.reduce_scatter(x, Comm(3), 2).collect()}
    assert got == {(i // 2, i % 2): (v[1, i] + (v[2, i] + v[0, i])).tolist() for i in range(6)}
    assert {(r["rank"], r.idx): r.vals for r in arrays.all_gather(x, Comm(3), 6).collect()} == {(d, r * 6 + i): v[r, i].tolist() for d in range(3) for r in range(3) for i in range(6)}
    assert {(r["rank"], r.idx): r.vals for r in arrays.all_to_all(x, Comm(3), 2).collect()} == {(i // 2, r * 2 + i % 2): v[r, i].tolist() for r in range(3) for i in range(6)}


def test_costs_and_output_counts():
    assert families.all_reduce_cost("ring", 8, 4, 1, 0, 0) == 6
    assert families.all_reduce_cost("mesh", 8, 4, 0, 1, 0) == 4
    assert families.all_reduce_cost("halving_doubling", 8, 1, 1, 1, 1) == 0
    assert families.output_count("all_gather", 3, 4) == 12 and families.output_count("all_gather", -1, 4) == -1
    assert families.output_count("reduce_scatter", 12, 4) == 3
    assert families.output_count("all_to_all_v", 0, counts=[1, 2], displs=[5, 0]) == 6
    with pytest.raises(ValueError):
        families.output_count("reduce_scatter", 5, 4)
    assert families.cost("broadcast", "ring", 10, 4, 1, 1, 0) == 33 and families.cost("reduce_scatter", "ring", 8, 4, 0, 0, 1) == 6
    assert families.cost("all_gather", "star", 8, 4, 1, 1, 1) == 9 and families.cost("scatter", "uneven_bruck", 8, 5, 1, 0, 0) == 3
    assert families.cost("reduce_scatter", "halving_doubling", 8, 6, 1, 0, 0) == 3  # one step to fold, two to halve
    assert families.pairwise_cost([[0, 3, 1], [2, 0, 5], [4, 1, 0]], 1, 1) == 2 + 5 + 2
    assert families.pipeline_cost("all_reduce", 16, 8, 3, (0, 1), (1, 2)) == 2 * (5 * 2 + 2)
    assert families.levels_cost(12, [2, 4], 2, 1, 0, 0) == 6
    for call in (lambda: families.cost("all_to_all", "ring", 1, 2, 1, 1, 1), lambda: families.cost("reduce", "none", 1, 2, 1, 1, 1), lambda: families.pipeline_cost("reduce", 1, 2, 2, (1, 1), (1, 1))):
        with pytest.raises(ValueError):
            call()
