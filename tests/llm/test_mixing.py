from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_tools import prose, table

from rankmesh.llm import mixing


def refilled(sizes, weights, total, most=3):
    """Brute force: share by weight, stop at the limit, share the excess again until nothing is above."""
    out, free, rest = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while free:
        w = sum(weights[i] for i in free)
        full = {i for i in free if rest * weights[i] / w > most * sizes[i]}
        if not full:
            for i in free:
                out[i] = rest * weights[i] / w
            break
        for i in full:
            out[i] = most * sizes[i]
            rest -= out[i]
        free -= full
    return out


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(12):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, 1, 10, 500, 3000]) for _ in range(n)]
        names = sorted(rng.sample(["a", "B", "é", "", "zz", "日", "b", "A", "0", "~"], n - 1)) + [None]
        rows = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, words long").repartition(3)
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert [got[s] for s in names] == pytest.approx(refilled(sizes, [1 + k % 3 for k in range(n)], sum(sizes)))


def test_very_many_sources(spark):
    """Every row is a source of its own; none reaches the driver."""
    n = 100_000
    rows = spark.range(n).selectExpr("cast(id as string) source", "id % 7 words")
    names = sorted(map(str, range(n)))
    sizes = [int(s) % 7 for s in names]
    got = mixing.targets(rows).toPandas().set_index("source").loc[names]
    want = refilled(sizes, [1 + k % 3 for k in range(n)], sum(sizes))
    assert np.allclose(got.target, want) and got.target.sum() == pytest.approx(sum(sizes))


@pytest.mark.parametrize("alike", [True, False])
def test_rounding_keeps_the_sum_and_expectations(alike):
    rng = np.random.default_rng(1)
    size = np.sort(rng.integers(1, 1000, 40))[::-1].astype(np.int64)
    p = np.full(40, 0.3) if alike else rng.random(40)
    mean = np.zeros(40)
    for _ in range(4000):
        got, live, left = mixing.round_alike(0.3, size, rng.random(40)) if alike else mixing.round_pairs(p * size, size, rng.random(40))
        assert (got * size).sum() + left == pytest.approx((p * size).sum())
        if live >= 0:
            assert 0 < left < size[live]
            got = got.astype(float)
            got[live] = left / size[live]
        mean += got / 4000
    assert np.abs(mean - p).max() < 0.04


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.choice([5, 20, 60])), rng.choice(["big"] * 6 + ["a", "B", "é", None])) for i in range(900)]
    return table(spark, rows).cache()


def test_plan_meets_targets(docs):
    rows = mixing.plan(docs, leaf=32, fan=4).collect()
    assert len(rows) == docs.count() == len({r.doc_id for r in rows})
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    words, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert (r["size"], r.source) == (len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id][0] or "")), text[r.doc_id][1])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        words[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(words, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in names] == pytest.approx(refilled([words[s] for s in names], [1 + k % 3 for k in range(len(names))], sum(words.values())))
    for s in names:
        assert abs(taken[s] - target[s]) <= 60, s


def test_reruns_agree_however_rows_are_dealt_out(docs):
    a, b = (sorted((r.doc_id, r.copies) for r in mixing.plan(d, leaf=32, fan=4).collect()) for d in (docs, docs.repartition(5)))
    assert a == b


def test_reruns_agree_on_repeated_ids(spark):
    """Several texts of each id, and rows that occur again."""
    rng = random.Random(5)
    rows = [(i // 2, prose(i if i % 5 else 7, rng.choice([20, 20, 40])), rng.choice("ab")) for i in range(400)]
    docs = table(spark, rows + rows[:60] + [(3, "same text", "a")] * 500)
    got = [sorted((r.doc_id, r.key, r.copies) for r in mixing.plan(docs.repartition(n), leaf=32, fan=4).collect()) for n in (1, 2, 5, 7)]
    assert got[0] == got[1] == got[2] == got[3] and len(got[0]) == 960
    keys = Counter((i, k) for i, k, _ in got[0])
    assert keys.most_common(1)[0][1] == 500
    alike = [c for i, k, c in got[0] if (i, k) == keys.most_common(1)[0][0]]
    assert max(alike) - min(alike) <= 1


def test_rows_alike_are_dealt_out_by_count(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 16)
    docs = table(spark, [(1, "a b c", "s")] * 300 + [(k, prose(k, 10), "t") for k in range(2, 60)]).withColumn("n_chars", F.monotonically_increasing_id()).cache()
    plan = mixing.plan(docs, leaf=8).cache()
    assert plan.count() == docs.count()
    copies = [r.copies for r in plan.filter("doc_id = 1").collect()]
    assert len(copies) == 300 and max(copies) - min(copies) <= 1
    assert abs(3 * sum(copies) - plan.filter("doc_id = 1").first().target) <= 30
    out = mixing.apply(docs, plan).filter("doc_id = 1").groupBy("n_chars").count().collect()
    each = [r["count"] for r in out] + [0] * (300 - len(out))
    assert sum(each) == sum(copies) and max(each) - min(each) <= 1


def test_callers_columns_survive(spark):
    docs = spark.createDataFrame([(k, f"w{k} x y", "s", f"i{k}", f"k{k}", k, 2 * k) for k in range(30)], "doc_id long, text string, source string, _id string, _key string, _n long, `id` long").withColumn("copies", F.lit("c"))
    out = mixing.apply(docs, mixing.plan(docs))
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}


def test_apply_repeats_whole_rows(docs):
    plan = mixing.plan(docs, leaf=32).cache()
    out = mixing.apply(docs, plan)
    assert out.columns == docs.columns
    got, want = defaultdict(int), {r.doc_id: r.copies for r in plan.collect() if r.copies}
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == want


def test_odd_rows(odd, none):
    plan = mixing.plan(odd).cache()
    assert plan.count() == odd.count()
    assert {r.taken for r in plan.filter("size = 0").collect()} == {0}
    assert mixing.apply(odd, plan).count() == plan.agg({"copies": "sum"}).first()[0]
    assert mixing.plan(none).count() == 0 == mixing.apply(none, mixing.plan(none)).count()
