from __future__ import annotations

import random

import numpy as np
import pytest
from tests_llm_tools import prose, table

from rankmesh.llm import spm


@pytest.fixture(scope="module")
def vocabulary():
    return spm.load()


def best(v: spm.Vocabulary, s: str) -> int:
    """The highest total of whole scores over all segmentations, by the plain recurrence."""
    top = [0] + [None] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - v.longest), j):
            hit = v.whole.get(s[i:j])
            score = hit[0] if hit else v.whole_unknown if j == i + 1 else None
            if score is not None and (top[j] is None or top[i] + score > top[j]):
                top[j] = top[i] + score
    return top[-1]


def pieces(v: spm.Vocabulary, s: str) -> list[tuple[int, int, int]]:
    return [p for settled in spm.segment(v, s) for p in settled]


def total(v: spm.Vocabulary, s: str, parts) -> int:
    return sum(v.whole[s[i:j]][0] if k >= 0 else v.whole_unknown for i, j, k in parts)


def test_segments_are_the_best(vocabulary):
    rng = random.Random(1)
    for _ in range(120):
        s = "".join(rng.choice(["th", "e", "▁", "ing", "é", "日", "\n", "X", "zq", "▁▁"]) for _ in range(rng.randint(0, 150)))
        parts = pieces(vocabulary, s)
        assert "".join(s[i:j] for i, j, _ in parts) == s
        assert all(vocabulary.whole[s[i:j]][1] == k for i, j, k in parts if k >= 0)
        assert total(vocabulary, s, parts) == best(vocabulary, s)


class Watched(str):
    """A text that notes how far it was read."""

    last = 0

    def __getitem__(self, k):
        if isinstance(k, slice):
            Watched.last = max(Watched.last, k.start)
        return str.__getitem__(self, k)


@pytest.mark.parametrize("text", [prose(1, 3000), prose(1, 3000).replace(" ", ""), "12345 " * 3000, "日本" * 5000])
def test_settles_early(vocabulary, text):
    """Pieces come out long before the end, and what is held doesn't grow with the text, spaces or none."""
    s, end, times = ("▁" + text).replace(" ", "▁"), 0, 0
    Watched.last = 0
    for settled in spm.segment(vocabulary, Watched(s)):
        assert settled[0][0] == end and Watched.last - settled[0][0] < 64 + 64 + 2 * vocabulary.longest
        end, times = settled[-1][1], times + 1
    assert end == len(s) and times > len(s) / 200


def test_overlapping_paths_are_settled_where_they_meet():
    """Pieces reach over every position, so that only back pointers tell."""
    names = [f"<0x{b:02X}>" for b in range(256)] + ["a", "aa", "aaa", "▁"]
    v = spm.Vocabulary(names, [0.0] * 256 + [-2.5, -2.75, -2.5, -1.5], ["byte"] * 256 + ["normal"] * 4, False)
    for n in (1, 2, 3, 63, 64, 65, 200, 1001):
        s = "a" * n
        parts = list(spm.segment(v, s))
        assert total(v, s, [p for x in parts for p in x]) == best(v, s)
        assert n < 200 or len(parts) > 1


def test_paths_that_never_meet(vocabulary):
    """Each residue of a run of one character may keep a path of its own to the end; that costs no more than a look at twice the length now and then."""
    for text in ("a" * 100_000, "ab" * 50_000):
        parts = pieces(vocabulary, "▁" + text)
        assert parts[0][0] == 0 and parts[-1][1] == len(text) + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert total(vocabulary, "▁" + "a" * 3000, pieces(vocabulary, "▁" + "a" * 3000)) == best(vocabulary, "▁" + "a" * 3000)


def test_the_querys_path_streams(vocabulary, monkeypatch):
    """Whatever a document's length and its words', the encoder's ids come from the window, which stays small."""
    whole, held = spm.segment, []

    def watched(v, s):
        Watched.last = 0
        for settled in whole(v, Watched(s)):
            held.append(Watched.last - settled[0][0])
            yield settled

    monkeypatch.setattr(spm, "segment", watched)
    e = spm.Encoder(vocabulary)
    text = prose(4, 5000) + " " + prose(6, 3000).replace(" ", "") + " " + prose(5, 10)
    ids = np.frombuffer(e.encode(text), "<i4").tolist()
    assert e.decode(ids) == text and len(held) > 300 and max(held) < 128 + 2 * vocabulary.longest


def test_words_that_come_again_are_coded_as_in_the_whole(vocabulary):
    e = spm.Encoder(vocabulary)
    for text in (prose(2, 400), "The quick\nbrown  fox  \n jumps", "  two before", "a" * 200 + " b"):
        s = (spm.SPACE + text).replace(" ", spm.SPACE)
        ids = np.frombuffer(e.encode(text), "<i4").tolist()
        want = []
        for i, j, k in pieces(vocabulary, s):
            want += [k] if k >= 0 else [vocabulary.bytes[b] for b in s[i:j].encode()]
        assert ids == want


def test_round_trip(vocabulary):
    e = spm.Encoder(vocabulary)
    rng = random.Random(3)
    texts = ["", " ", "  a ", "\n", "\n\n x", "▁", "a▁ ▁b\n▁c", "日本語 ё 🙂", "\x00\x1f", "w" * 3000, "\n▁▁ ▁"]
    texts += ["".join(rng.choice([" ", "\n", "▁", "é", "the", "🙂", "\t", "Q"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t in texts:
        assert e.decode(np.frombuffer(e.encode(t), "<i4").tolist()) == t
    e.cache.old, keep = {}, spm.CACHE
    try:
        spm.CACHE = 3  # the cache turns over again and again
        for t in texts:
            assert e.decode(np.frombuffer(e.encode(t), "<i4").tolist()) == t
    finally:
        spm.CACHE = keep


def test_many_line_ends_and_no_space(vocabulary):
    e = spm.Encoder(vocabulary)
    for text in ("\n" * 100_000, "\n".join(f"word{k % 977}" for k in range(100_001))):
        ids = np.frombuffer(e.encode(text), "<i4").tolist()
        assert ids.count(vocabulary.bytes[10]) == 100_000
        assert e.decode(ids) == text


def test_a_vocabulary_whose_pieces_span_words():
    names = [f"<0x{b:02X}>" for b in range(256)] + ["▁a", "a▁b", "b", "▁", "a", "a▁"]
    v = spm.Vocabulary(names, [0.0] * 256 + [-1.5, -1.25, -2.0, -3.0, -2.5, -2.5], ["byte"] * 256 + ["normal"] * 6, False)
    e = spm.Encoder(v)
    assert not e.alone
    for t in ("a b", "aa b a", "c a", "b" * 100):
        s = "▁" + t.replace(" ", "▁")
        assert total(v, s, pieces(v, s)) == best(v, s)
        assert e.decode(np.frombuffer(e.encode(t), "<i4").tolist()) == t
    with pytest.raises(ValueError):
        spm.Vocabulary(["a"], [0.0], ["normal"], False)


def test_columns(odd, none, vocabulary):
    coded = spm.encode(odd, vocabulary, check="row")
    assert coded.columns == [c for c in odd.columns if c not in ("ids", "row")] + ["ids", "row"]
    rows = coded.collect()
    assert all((r.ids is None and r.row is None) if r.text is None else (r.row and (len(r.ids) > 0) == (r.text != "")) for r in rows)
    back = spm.decode(coded, vocabulary, out="again").collect()
    assert [r.again for r in back] == [r.text for r in back]
    assert spm.encode(none, vocabulary).count() == 0 == spm.decode(spm.encode(none, vocabulary), vocabulary).count()


def test_agreement_with_the_library(vocabulary, spark):
    """The model file is a BPE one, whose merges are not a best segmentation: lengths agree closely, ids need not."""
    import sentencepiece

    own, lib = spm.Encoder(vocabulary), sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    texts = [prose(k, 200) for k in range(10)]
    a, b = (sum(map(len, x)) for x in ([np.frombuffer(own.encode(t), "<i4") for t in texts], lib.encode(texts)))
    assert a <= 1.05 * b
    assert all(lib.decode(np.frombuffer(own.encode(t), "<i4").tolist()) == t for t in texts)
    assert table(spark, [(1, texts[0], "a")]).count() == 1


def test_no_broadcast_is_taken_for_another(spark):
    assert len({spm._Shared(spark, k).id for k in range(50)}) == 50
