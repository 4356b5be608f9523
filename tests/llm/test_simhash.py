from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from tests_llm_tools import prose, table

from rankmesh.llm import simhash as S
from rankmesh.llm.components import components


def brute_hash(text: str) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_fingerprints():
    texts = ["", " \n", "One", "one two", "One TWO three", "a a a a a a", "É é\x0bü\x1cz\xa0q w", prose(1, 500), "x " * 3000, prose(2, 4)]
    assert [int(x) for x in S.simhashes(texts)] == [brute_hash(t) for t in texts]


def test_some_key_brings_every_near_pair_together():
    rng = random.Random(1)
    for blocks in (4, 5, 6, 7, 9):
        masks = [m % (1 << 64) for m in S.masks(blocks)]
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 3):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


def test_pivots_lose_no_link():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 8, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 8).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 8).astype(np.uint64)) for _ in range(40))]))
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 3, 1))
    assert joined(len(fps), S.near(fps)) == joined(len(fps), near)
    assert len(near) > len(S.near(fps)) > 0


def groups_of(rows, brute):
    ids = [r[0] for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if bin(brute[i] ^ brute[j]).count("1") <= 3]
    root = joined(len(rows), near)
    low: dict[int, int] = {}
    for i, r in enumerate(root):
        low[r] = min(low.get(r, ids[i]), ids[i])
    return {ids[i]: low[root[i]] for i in range(len(rows))}


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        words = prose(i % 40, 150).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i * 3, " ".join(words), "a"))
    brute = [brute_hash(t) for _, t, _ in rows]
    for crowd in (S.CROWD, 3):  # the second files most keys again
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.groups(table(spark, rows), crowd).collect()}
        assert {i: c for i, (_, c) in got.items()} == groups_of(rows, brute)
        assert all(got[r[0]][0] == f"{b:016x}" for r, b in zip(rows, brute, strict=True))
    kept = S.one_of_each(table(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups_of(rows, brute).values()))


def test_a_crowded_key_of_42_bits(spark, monkeypatch):
    """Thousands of fingerprints that agree in 42 bits: no task meets more than a part, and no link is lost."""
    rng = np.random.default_rng(7)
    mask = S.masks(S.FINE)[5]
    rest = [b for b in range(64) if not mask >> b & 1]
    fps = np.zeros(3000, np.uint64)
    for b in rest:
        fps |= rng.integers(0, 2, 3000).astype(np.uint64) << np.uint64(b)
    fps = np.unique(fps | np.uint64(0xABCDEF0123456789 & mask % (1 << 64)))
    met, near = [], S.near
    monkeypatch.setattr(S, "near", lambda x, *a: (met.append(len(x)), near(x, *a))[1])
    rows = [(m, int(np.int64(np.uint64(f)) & np.int64(m)), int(np.int64(f))) for m in S.finest(mask) for f in fps.view(np.int64)]
    rows.sort()
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["mask", "key", "fp"])
    place = {int(f): k for k, f in enumerate(fps.view(np.int64))}
    got = [(place[a], place[b]) for out in S._link(True)([batch]) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    pairs = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps) <= 3, 1))
    assert joined(len(fps), got) == joined(len(fps), pairs) and max(met) < len(fps) / 40
    assert all(64 - bin(m % (1 << 64)).count("1") <= 12 for x in S.masks(S.FINE) for m in S.finest(x))
    monkeypatch.undo()
    prints = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = [(place[r.a], place[r.b]) for r in S.links(prints, 200).collect()]
    assert joined(len(fps), found) == joined(len(fps), pairs)


def test_callers_columns_survive(spark):
    docs = spark.createDataFrame([(k, f"text {k % 9} of words", f"i{k}", f"k{k}", k) for k in range(30)], "doc_id long, text string, _id string, _key string, id long").withColumnRenamed("id", "key")
    out = S.one_of_each(docs)
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()} and out.count() == 9


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(40)] + [(7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = joined(200, [e for e in edges if None not in e])
    assert got == {n: want[n] for a, b in edges if b is not None and a != b for n in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    got = S.groups(odd).collect()
    assert len(got) == odd.count()
    empty = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in empty} == {2, 3, 4, None} and {r.component_id for r in empty} == {2}
    kept = S.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum(not (r.text or "").strip() for r in rows) == 1 and len(rows) == len({r.component_id if r.component_id is not None else r.fingerprint for r in got})
    assert S.groups(none).count() == 0 == S.one_of_each(none).count()


def test_distance_tables_find_all_close_pairs():
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 64, (40, 2), dtype=np.uint64)
    prints = base[rng.integers(0, 40, 900)]
    for _ in range(9):  # up to 9 bits of each are turned
        prints[np.arange(900), rng.integers(0, 2, 900)] ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    group = np.sort(rng.integers(0, 60, 900))
    for distance in (16, 40):
        i, j = S.close(group, prints, distance)
        got = {(min(p), max(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(a, b) for a in range(900) for b in range(a + 1, 900) if group[a] == group[b] and int(np.bitwise_count(prints[a] ^ prints[b]).sum()) <= distance}
        assert got == want and len(got) == len(i) and want
    assert [len(x) for x in S.close(group[:0], prints[:0], 40)] == [0, 0]


def test_wide_fingerprints_follow_the_majority():
    rng = np.random.default_rng(12)
    one, many = rng.integers(0, 1 << 64, 1, dtype=np.uint64), rng.integers(0, 1 << 64, 700, dtype=np.uint64)
    bits = np.array([np.unpackbits(S.wide(many[k : k + 1]).view(np.uint8)) for k in range(700)], int)
    assert (np.unpackbits(S.wide(many).view(np.uint8)) == (2 * bits.sum(0) > 700)).all()
    assert (S.wide(np.repeat(one, 600)) == S.wide(one)).all() and abs(bits.mean() - 0.5) < 0.01
