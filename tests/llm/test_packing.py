from __future__ import annotations

import random

import numpy as np
import pytest
from tests_llm_tools import prose, table

from rankmesh.llm import packing as K


def test_tree_finds_the_least_sufficient_room():
    rng = random.Random(1)
    for most in (1, 2, 7, 8, 100):
        rooms, own, nothing = K.Rooms(most), [], 0
        for k in range(400):
            if rng.random() < 0.5:
                room = rng.randint(0, most)
                rooms.add(room, k)
                own.append(room)
            else:
                need = rng.randint(0, most)
                fit = [r for r in own if r >= need]
                got = rooms.take(need)
                if fit:
                    assert got[0] == min(fit)
                    own.remove(got[0])
                else:
                    nothing += 1
                    assert got is None
        assert nothing


def test_packing_is_lossless_and_best_fit():
    rng = random.Random(2)
    for _ in range(200):
        length = rng.choice([1, 5, 16])
        sizes = [rng.randint(0, 40) for _ in range(rng.randint(0, 40))]
        rows = K.pack(sizes, length)
        parts: dict[int, list] = {}
        for row in rows:
            assert 0 < sum(b - a for _, a, b in row) <= length
            for doc, a, b in row:
                parts.setdefault(doc, []).append((a, b))
        for doc, n in enumerate(sizes):
            own = sorted(parts.get(doc, []))
            assert [x for a, b in own for x in range(a, b)] == list(range(n))
        rooms = []
        for rest in sorted((n % length for n in sizes if n % length), reverse=True):
            fit = [r for r in rooms if r >= rest]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - rest)
            else:
                rooms.append(length - rest)
        assert len(rows) == len(rooms) + sum(n // length for n in sizes)


@pytest.fixture(scope="module")
def tokenizer():
    return K.Tokenizer(K.load_ranks())


def read_back(rows, tokenizer) -> dict[int, str]:
    parts: dict[int, list] = {}
    for r in rows:
        ids = np.frombuffer(r.ids, tokenizer.type)
        assert r.width == 2 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and not ids[r.n_tokens :].any()
        assert r.resets == (r.cu_seqlens if r.n_tokens < len(ids) else r.cu_seqlens[:-1])
        places = K.positions(r.resets, len(ids))
        for doc, begin, a, b in zip(r.doc_ids, r.begins, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert places[a:b].tolist() == list(range(b - a))
            parts.setdefault(doc, []).append((begin, ids[a:b]))
    return {doc: tokenizer.decode(np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])])) for doc, p in parts.items()}


@pytest.mark.parametrize("window", [200, K.WINDOW])
def test_texts_come_back(spark, tokenizer, window):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.choice([1, 5, 60, 400])) + rng.choice(["", "  ü\n日本"]), "a") for i in range(80)]
    packed = K.packed(table(spark, rows).repartition(3), length=64, window=window)
    assert read_back(packed.collect(), tokenizer) == {i: t for i, t, _ in rows}


def test_files_and_digests(spark, odd, none, tokenizer, tmp_path):
    packed = K.packed(odd.filter("doc_id is null or doc_id not in (7, 9)"), length=128)
    K.write(packed, str(tmp_path / "packs"))
    back = read_back(spark.read.parquet(str(tmp_path / "packs")).collect(), tokenizer)
    assert back == {r.doc_id: r.text for r in odd.collect() if r.text and r.doc_id not in (7, 9)}
    assert "ids_sha256" in K.digests(packed).columns and K.digests(packed).count() == packed.count()
    assert K.packed(none).count() == 0
