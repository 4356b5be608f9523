from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tests_llm_tools import prose, table

from rankmesh.llm import linear
from rankmesh.llm import toxicity as T


@pytest.fixture(scope="module")
def data(spark):
    """A tenth of the documents hold one of a few words, or one of many words with the same beginning."""
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1500):
        words, toxic = prose(i, rng.randint(5, 80)).split(), rng.random() < 0.12
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["vilewort", "badly", "grubol" + "".join(rng.choices("aeiouxyz", k=3))]))
        rows.append((i, " ".join(words), "a"))
        if rng.random() < 0.6:
            labels.append((i, 1, int(toxic)))
    return table(spark, rows).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache(), labels


def test_held_out_documents(data):
    docs, labels, known = data
    got = {r.doc_id: r for r in T.judged(docs, labels).collect()}
    assert len(got) == 1500
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, toxic) for i, _, toxic in known if got[i].held_out]
    assert sum(t for _, t in held) > 15
    assert sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.01 * len(held)
    again = {r.doc_id: r.score for r in T.judged(docs.repartition(3), labels.repartition(2)).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in got.items())


def test_held_out_labels_are_not_used(data):
    docs, labels, _ = data
    from pyspark.sql import functions as F

    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (T.train(docs, x) for x in (labels, turned))
    assert a.weights == b.weights and a.offset == b.offset


def examples(spark, rows):
    return spark.createDataFrame(rows, linear.SCHEMA)


def slow_fit(rows, n, prior):
    """The same descent, example by example."""
    w, b = np.zeros(n), math.log(prior / (1 - prior))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    n_u, n_p = (sum(r[4] for r in rows if r[2] == k) for k in (0, 1))
    for t in range(1, T.EPOCHS + 1):
        risk, pu, pp = 0.0, np.zeros(n + 1), np.zeros(n + 1)
        for places, _, positive, _, weight in rows:
            s = 1 / (1 + math.exp(-(b + sum(w[k] for k in places))))
            g = np.zeros(n + 1)
            g[[*places, n]] = weight * s * (1 - s)
            if positive:
                risk, pp = risk - prior * weight * s / n_p, pp + g / n_p
            else:
                risk, pu = risk + weight * s / n_u, pu + g / n_u
        g = pu - 2 * prior * pp if risk >= 0 else prior * pp - pu
        g[:-1] += T.DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = T.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def test_fit_against_brute_force(spark):
    """Many documents with one feature are confirmed, so that the unlabelled part's risk goes below zero, too."""
    rng = random.Random(4)
    rows = [(sorted(rng.sample(range(5), rng.randint(0, 3))), 0, 0.0, float(rng.choice([1, 1, 7]))) for _ in range(60)]
    rows += [(sorted({0, rng.randrange(5)}), 1, 0.0, 1.0) for _ in range(25)]
    rows = [(p, [1.0] * len(p), k, t, x) for p, k, t, x in rows]
    for prior in (0.1, 0.4):
        w, b = T.fit(linear.Batch(examples(spark, rows), 5, T.loss), prior)
        slow = slow_fit(rows, 5, prior)
        assert np.allclose(w, slow[0], atol=2e-2) and abs(b - slow[1]) < 2e-2


def test_risk(spark):
    # a feature of all positives and of the positives among the unlabelled, and one of everything
    rng = np.random.default_rng(1)
    rows = [([0, 1] if k < 200 or rng.random() < 0.2 else [1], [1.0] * 2, int(k < 200), 0.0, 1.0) for k in range(600)]
    rows = [(p, s[: len(p)], *rest) for p, s, *rest in rows]
    w, b = T.fit(linear.Batch(examples(spark, rows), 2, T.loss), 0.2)
    assert w[0] + w[1] + b > 2 and w[1] + b < -1


def test_slices_are_taken_in_turn(spark):
    rng = random.Random(6)
    rows = [(p, [1.0] * len(p), int(k < 30), 0.0, 1.0 + k) for k in range(200) for p in [sorted(rng.sample(range(6), rng.randint(1, 4)))]]
    w, batch = np.linspace(-1, 1, 6), linear.Batch(examples(spark, rows), 6, T.loss, 0, always=1, slices=4)
    whole = linear.Batch(examples(spark, rows), 6, T.loss).sums(0, w, 0.5)
    parts = [batch.sums(t, w, 0.5) for t in range(1, 5)]
    for k in (0, 1):  # every slice has all positives; each unlabelled example is in one
        grads = [x[1][k] for x in parts]
        assert np.array_equal(sum(grads) if k == 0 else grads[0], whole[1][k]) and np.array_equal(sum(x[0][:, 0] for x in parts), whole[0][:, 0])
    assert all(np.array_equal(x[0][:, 1], whole[0][:, 1]) for x in parts) and all(x[0][2, 0] > 0 for x in parts)


def test_the_executors_sums_are_the_drivers(data, monkeypatch):
    docs, labels, _ = data
    monkeypatch.setattr(T, "EPOCHS", 15)
    a, b = (T.train(docs.repartition(n), labels, local) for n, local in ((3, 10**9), (5, 0)))
    assert a.weights == b.weights and a.offset == b.offset and a.weights


def test_the_query_against_brute_force(data):
    """Features, their choice, a dense descent and scores, without Spark."""
    docs, labels, known = data
    texts = {r.doc_id: r.text for r in docs.collect()}
    learn = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    known = [(i, toxic) for i, _, toxic in known if i in set(learn)]
    prior = sum(t for _, t in known) / len(known)
    positive = sorted({texts[i] for i, t in known if t})
    every = [texts[i] for i in learn]
    words = {t: set(t.lower().encode().split()) for t in [*positive, *every]}
    held = {t: {f for w in ws for f in T.features(w)} for t, ws in words.items()}
    p, u, docs_of = Counter(), Counter(), Counter()
    for t in positive:
        p.update(f for w in words[t] for f in T.features(w))
        docs_of.update(held[t])
    copies = Counter(every)
    for t in every:
        for w in words[t]:
            for f in T.features(w):
                u[f] += 1 / copies[t]
    n_p, n_u = len(positive), len(copies)
    names = []
    for f in sorted(p):
        chance = (p[f] + u[f]) * n_p / (n_p + n_u)
        if docs_of[f] >= 3 and (p[f] - chance) / math.sqrt(chance * n_u / (n_p + n_u)) >= 4 and p[f] / n_p >= 2 * u[f] / n_u:
            names.append(f)
    got = T.train(docs, labels)
    assert sorted(got.weights) == names and got.prior == prior

    def dense(ts):
        return np.array([[f in held[t] for f in names] + [True] for t in ts], float)

    x_p, x_u = dense(positive), dense(sorted(copies))
    w, m, v = np.append(np.zeros(len(names)), math.log(prior / (1 - prior))), 0.0, 0.0
    for t in range(1, T.EPOCHS + 1):
        s_p, s_u = (1 / (1 + np.exp(-(x @ w))) for x in (x_p, x_u))
        pp, pu = (x.T @ (s * (1 - s)) / len(s) for x, s in ((x_p, s_p), (x_u, s_u)))
        g = pu - 2 * prior * pp if s_u.mean() - prior * s_p.mean() >= 0 else prior * pp - pu
        g[:-1] += T.DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - T.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
    for t in [*positive[:50], *every[:200]]:
        want = 1 / (1 + math.exp(-float(dense([t])[0] @ w)))
        assert abs(got.score(t) - want) < 0.05


def test_heads_tell_no_feature_away():
    rng = random.Random(5)
    words = {"".join(rng.choices("abé日", k=rng.randint(1, 8))).encode() for _ in range(400)}
    table = frozenset(rng.sample(sorted({f for w in words for f in T.features(w)}), 60))
    found = T._Found(table)
    for w in words:
        assert found(w.decode()) == {f for f in T.features(w) if f in table}
        assert all(T.head(f.rstrip(b" ")) == T.head(w) for f in T.features(w))


def test_very_frequent_copies_count_once(spark, data):
    """A third of the documents are copies of one clean text, and as many of one toxic text."""
    docs, labels, known = data
    extra = table(spark, [(10_000 + k, "one clean text " + prose(1, 30), "a") for k in range(1500)] + [(20_000 + k, "vilewort " + prose(2, 30), "a") for k in range(1500)])
    got = {r.doc_id: r for r in T.judged(docs.unionByName(extra), labels).collect()}
    held = [(got[i].predicted, toxic) for i, _, toxic in known if got[i].held_out]
    assert sum(p for p, t in held if t) >= 0.9 * sum(t for _, t in held) and sum(p for p, t in held if not t) <= 0.01 * len(held)
    assert all(not r.predicted for i, r in got.items() if 10_000 <= i < 20_000) and all(r.predicted for i, r in got.items() if i >= 20_000)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, None), (None, None, 1), (7, None, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 0")):
        got = T.judged(odd, known).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert T.judged(none, known).count() == 0
    assert T.reject(odd, labels).columns == odd.columns
    assert T.reject(odd, labels.limit(0)).count() == odd.count()


def test_callers_columns_survive(spark, odd):
    docs = odd.withColumnRenamed("fp", "toxicity").withColumnRenamed("ids", "_toxicity")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = T.reject(docs, labels)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


def test_training_bounds_are_not_cut():
    assert T.POSITIVES == 20_000 and not hasattr(T, "UNLABELLED") and not hasattr(T, "IMPLIED") and not hasattr(T, "FEATURES")
