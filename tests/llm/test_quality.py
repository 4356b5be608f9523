from __future__ import annotations

import random
import re

import numpy as np
import pytest
from tests_llm_tools import prose, table

from rankmesh.llm import linear
from rankmesh.llm import quality as Q


def spoilt(text: str, kind: int, rng: random.Random) -> str:
    words = text.split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words)
    return " ".join(w for w in words[:6] for _ in range(20))


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    rows, good = [], {}
    for i in range(800):
        text, good[i] = prose(i, rng.randint(8, 120)), rng.random() < 0.85
        rows.append((i, text if good[i] else spoilt(text, rng.randrange(3), rng), "a"))
    return table(spark, rows).cache(), good


def test_good_documents_stay_and_bad_ones_go(data):
    docs, good = data
    got = {r.doc_id: r for r in Q.judged(docs).collect()}
    assert len(got) == len(good)
    assert sum(got[i].kept for i in good if good[i]) == sum(good.values())
    assert sum(not got[i].kept for i in good if not good[i]) >= 0.97 * sum(not g for g in good.values())
    assert all(len(r.votes) == len(Q.LABELLERS) and r.kept == (r.score >= 0.5) for r in got.values())
    kept = Q.reject(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_estimates_come_near_the_truth():
    rng = np.random.default_rng(3)
    flags = np.array([[0.7, 0.02], [0.5, 0.01], [0.6, 0.05], [0.4, 0.001]])
    good = rng.random(200_000) < 0.8
    bits = rng.random((200_000, 4)) < flags[:, good.astype(int)].T
    patterns, counts = np.unique(bits @ (1 << np.arange(4)), return_counts=True)
    found = Q.estimate(patterns, counts.astype(float), 4)
    assert abs(found.prior - 0.8) < 0.02 and np.abs(found.flags - flags).max() < 0.03
    assert ((found.posterior(bits @ (1 << np.arange(4))) > 0.5) == good).mean() > 0.93


def test_traits():
    t = Q.Traits.of("AB cd\ncd CD!! é### x.")
    assert (t.words, t.shouts, t.repeats, t.distinct, t.same_lines) == (6, 1 / 6, 1 / 6, 5 / (0.634 * 6**0.75), 0)
    assert t.upper == 4 / 9 and t.marked == 1 / 6 and t.closed == 2 / 6 and t.top == 2 / 6
    assert Q.Traits.of("").words == 0 and Q.votes("") == 1 << list(Q.LABELLERS).index("empty")
    assert Q.shape("Wörld's12###") == "Aaa'a00##"


def test_fit_against_brute_force(spark):
    """Logistic regression with soft targets, example by example."""
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        places = sorted(rng.sample(range(6), rng.randint(0, 4)))
        target = rng.choice([0.02, 0.3, 0.9, 0.99])
        rows.append((places, [rng.choice([0.25, 0.5, 1.0]) for _ in places], int(target > 0.5), target, 1.0))
    n = [sum(r[2] == k for r in rows) for k in (0, 1)]
    w, b, m, v = np.zeros(6), 0.0, np.zeros(7), np.zeros(7)
    for t in range(1, Q.EPOCHS + 1):
        g = np.zeros(7)
        for places, shares, kind, target, _ in rows:
            d = 0.5 / n[kind] * (1 / (1 + np.exp(-(b + sum(w[p] * s for p, s in zip(places, shares, strict=True))))) - target)
            for p, s in zip(places, shares, strict=True):
                g[p] += d * s
            g[6] += d
        g[:6] += Q.DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = Q.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:6], b - move[6]
    df = spark.createDataFrame(rows, linear.SCHEMA)
    got = Q.fit(linear.Batch(df, 6, Q.loss))
    assert np.allclose(got[0], w, atol=1e-3) and abs(got[1] - b) < 1e-3


def test_the_executors_sums_are_the_drivers(data, monkeypatch):
    docs, _ = data
    monkeypatch.setattr(Q, "EPOCHS", 15)
    a, b = (Q.train(docs.repartition(n), local=local) for n, local in ((3, 10**9), (5, 0)))
    assert (a.weights == b.weights).all() and a.offset == b.offset and a.weights.any()


def test_variety_at_every_length():
    """No length switches the labeller off."""
    flag = Q.LABELLERS["variety"]
    words = [f"w{k}" for k in range(20_000)]
    for n in (6, 20, 300, 2000, 20_000):
        assert not flag(Q.Traits.of(" ".join(words[:n]))) and flag(Q.Traits.of(" ".join(words[:2] * (n // 2))))


def test_callers_columns_survive(odd):
    docs = odd.withColumnRenamed("fp", "_text").withColumnRenamed("ids", "_0").withColumnRenamed("row", "pattern")
    out = Q.reject(docs)
    rows = list(map(str, docs.collect()))
    assert out.columns == docs.columns and all(str(r) in rows for r in out.collect())


def test_the_query_against_brute_force(data):
    """Votes, accuracies, a dense descent and scores, text by text, without Spark."""
    docs, _ = data
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id < 150").collect()]
    votes = np.array([Q.votes(t) for _, t in rows])
    patterns, counts = np.unique(votes, return_counts=True)
    found = Q.estimate(patterns, counts.astype(float))
    texts = sorted({t for _, t in rows})
    used = sorted({int(b) for t in texts for b in Q.hashed(t)})
    place = {b: k for k, b in enumerate(used)}

    def features(t):
        x = np.zeros(len(used) + 1)
        for b in Q.hashed(t).tolist():
            if b in place:
                x[place[b]] += 1 / max(len(t.split()), 1)
        x[-1] = 1
        return x

    x, target = np.stack([features(t) for t in texts]), found.posterior(np.array([Q.votes(t) for t in texts]))
    good = target > 0.5
    weight = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1))
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, Q.EPOCHS + 1):
        g = x.T @ (weight * (1 / (1 + np.exp(-(x @ w))) - target))
        g[:-1] += Q.DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - Q.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    w[-1] += np.log(found.prior / (1 - found.prior))
    got = {r.doc_id: r for r in Q.judged(docs.filter("doc_id < 150")).collect()}
    for (i, t), pattern in zip(rows, votes.tolist(), strict=True):
        want = 1 / (1 + np.exp(-(features(t) @ w)))
        assert abs(got[i].score - want) < 0.02 and got[i].votes == "".join(str(pattern >> k & 1) for k in range(len(Q.LABELLERS)))
        assert abs(got[i].posterior - found.posterior(np.array([pattern]))[0]) < 1e-9


def test_ends_of_words_against_brute_force():
    rng = random.Random(12)
    for _ in range(300):
        text = "".join(rng.choices("ab.,!?;:#$%é日 \t\n\x0b\x0c\r\x1c\x85", k=rng.randint(0, 60)))
        words, t = re.findall(r"[^\x20\x09-\x0D]+", text), Q.Traits.of(text)
        n = max(len(words), 1)
        assert t.words == len(words) and t.closed == sum(w[-1] in ".,!?;:" for w in words) / n
        assert t.marked == sum(w[-1] in "#$%&*|<>{}[]\\^~=@_+" for w in words) / n


def test_odd_rows(odd, none):
    got = Q.judged(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert Q.judged(none).count() == 0 == Q.reject(none).count()
    assert Q.reject(odd).columns == odd.columns
