from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from tests_llm_tools import prose, table

from rankmesh.llm import nearcopies as N
from rankmesh.llm.simhash import apart, wide


def brute_set(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def likeness(a: str, b: str) -> float:
    x, y = brute_set(a), brute_set(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def brute_groups(rows: list[tuple]) -> list[int]:
    """The smallest id of each group."""
    left, firsts = dict(sorted((r[0], r[1]) for r in rows)), []
    while left:
        first = min(left)
        firsts.append(first)
        todo = [left.pop(first)]
        while todo:
            text = todo.pop()
            for i in [i for i, t in left.items() if likeness(text, t) >= 0.8]:
                todo.append(left.pop(i))
    return firsts


@pytest.fixture(scope="module")
def edited():
    """Families of texts, most a few edits apart: at likenesses on either side of 0.8."""
    rng = random.Random(3)
    rows = []
    for i in range(150):
        words = prose(i % 25, 200).split()
        for k in rng.sample(range(200), rng.choice([0, 1, 2, 3, 4, 6, 9])):
            words[k] = f"changed{i}"
        rows.append((i * 3, " ".join(words), "a"))
    return rows


def test_groups_against_brute_force(spark, edited):
    want = brute_groups(edited)
    assert 25 < len(want) < 120
    for span in (N.SPAN, 2):  # the second files keys again and deals them out in chunks of two
        assert sorted(r.doc_id for r in N.one_of_each(table(spark, edited), span=span).collect()) == want


def test_a_large_group_is_not_one_tasks(spark, monkeypatch):
    """Hundreds of near copies of one text, a chain that leads away from it, and texts that are not near any: no task meets all of them."""
    rng = random.Random(8)
    words = prose(77, 150).split()
    rows = []
    for i in range(400):
        own = list(words)
        own[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(own), "a"))
    chain = list(words)
    for i in range(30):
        chain[5 * i] = f"chain{i}"
        rows.append((1000 + i, " ".join(chain), "a"))
    rows += [(2000 + i, " ".join([*words[: 60 + i], *prose(900 + i, 60).split()]), "a") for i in range(20)]
    want = brute_groups(rows)
    assert want[0] == 0 and 1 < len(want) < 25
    assert sorted(r.doc_id for r in N.one_of_each(table(spark, rows), span=64).collect()) == want


def test_chunks_bring_all_groups_together(spark):
    rng = random.Random(9)
    members = [(band, fp, fp % 40 if fp % 3 else 7) for band in range(3) for fp in rng.sample(range(1000), 50 + 150 * band)]
    members += [(9, fp, 1) for fp in range(100)]
    dealt = N._dealt(spark.createDataFrame(members, "band long, fp long, label long"), 20).collect()
    groups: dict[int, dict[int, int]] = {}
    for r in dealt:
        groups.setdefault(r.band, {})[r.fp] = r.label
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    for band in range(3):
        own = [(fp, label) for k, fp, label in members if k == band]
        assert all((min(a, b), max(a, b)) in met for a, x in own for b, y in own if a != b and x != y)
    assert max(map(len, groups.values())) < 100 and len(dealt) < 20 * len(members)


def test_the_stage_drops_near_copies_that_differ_in_many_simhash_bits(spark, edited):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["near_copies"]
    assert sorted(r.doc_id for r in stage(spark, table(spark, edited), "").collect()) == brute_groups(edited)


def test_odd_rows(odd, none):
    kept = N.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [r.text for r in rows if (r.text or "").strip()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text for r in odd.collect() if (r.text or "").strip()}
    assert sum(not (r.text or "").strip() for r in rows) == 1
    assert N.one_of_each(none).count() == 0


@pytest.mark.parametrize("n", [1000, 12_000_000])
def test_texts_at_the_likeness_share_a_key_and_stay_within_the_radius(n):
    rng = np.random.default_rng(13)
    bits, number = N.tables(n)
    places = N.choices(bits, number)
    assert places.shape == (number, bits) and all(len(set(p)) == bits for p in places.tolist())
    shared = close = 0
    for _ in range(400):
        all_ = rng.integers(0, 1 << 64, 200, dtype=np.uint64)  # 180 each, 160 in common
        a, b = wide(all_[:180]), wide(all_[20:])
        x, y = (np.unpackbits(p[: N.KEYED].view(np.uint8))[places] for p in (a, b))
        shared += bool((x == y).all(1).any())
        close += bool(apart(a[N.KEYED :], b[N.KEYED :]) <= N.radius(128, 0.8, N.SPARE) and apart(a, b) <= N.radius(64 * len(a), 0.8, N.WIDE_SPARE))
    assert shared >= 398 and close >= 399


def test_candidates_connect_what_is_close_whatever_the_size_of_a_key(monkeypatch):
    """SimHash keys of up to 24 texts are held, others handed on whole, also over several batches."""
    monkeypatch.setattr(N, "ROWS", 64)
    rng = np.random.default_rng(14)
    base = rng.integers(0, 1 << 64, (30, 2), dtype=np.uint64)
    rows = []
    for band, size in enumerate([5, 1, 20, 300, 2, 24, 60, 7, 200]):
        for fp in sorted(rng.choice(10_000, size, replace=False).tolist()):
            p = base[rng.integers(0, 30)].copy()
            for k in rng.integers(0, 128, 18).tolist():
                p[k // 64] ^= np.uint64(1) << np.uint64(k % 64)
            rows.append((band, fp, *p.view(np.int64).tolist()))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 17], strict=True)], ["band", "fp", "p0", "p1"]) for k in range(0, len(rows), 17)]
    found = [r for b in N._candidates(40, 24)(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    large = {3, 6, 8}
    members = [(band, a) for band, a, b in found if b is None]
    assert sorted(members) == sorted((band, fp) for band, fp, *_ in rows if band in large)
    links = {(a, b) for band, a, b in found if b is not None}
    for band in range(9):
        own = {fp: np.array(p).view(np.uint64) for k, fp, *p in rows if k == band}
        near = [(a, b) for a in own for b in own if a < b and int(apart(own[a], own[b])) <= 40]
        if band in large:
            assert {(min(own), b) for a, b in near if a == min(own)} <= links
            continue
        root = {fp: fp for fp in own}
        for a, b in near:
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        assert {(v, k) for k, v in root.items() if v != k} <= links


def test_stars_connect_what_the_links_connect(spark):
    rng = random.Random(15)
    pairs = {tuple(sorted(rng.sample(range(k, k + 60), 2))) for k in range(0, 600, 60) for _ in range(rng.choice([20, 40, 300]))}
    found = [(None, a, b) for a, b in sorted(pairs)] * 2 + [(5, a, None) for a in range(700, 720)]
    firsts, coarse = (x.collect() for x in N._stars(spark.createDataFrame(found, "band long, a long, b long").repartition(5)))
    assert {r.b: r.a for r in firsts} == {b: min(x for x, y in pairs if y == b) for _, b in pairs} and len(firsts) == len({b for _, b in pairs})
    label = [N.connected(600, *np.array(p).T).tolist() for p in (sorted(pairs), [(r.a, r.b) for r in coarse])]
    assert label[0] == label[1] and len(coarse) == len(set(coarse)) <= len(pairs) and all(r.a < r.b for r in coarse)


def test_a_group_meets_in_about_a_link_for_each_text_not_one_for_each_table(spark, monkeypatch):
    rng = random.Random(16)
    words = prose(78, 150).split()
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(own), "a"))
    edges, components = [], N.components
    monkeypatch.setattr(N, "components", lambda e: edges.append(e.distinct().count()) or components(e))
    assert [r.doc_id for r in N.one_of_each(table(spark, rows)).collect()] == [0]
    assert max(edges) < 4 * len(rows)
