"""SentencePiece encoding by streaming Viterbi, and decoding.

The vocabulary is that of a SentencePiece model file. A unigram model's scores
are log probabilities and are used as they are; a BPE model's are ranks of its
merges, which Zipf's law turns into log probabilities. The encoder finds the
segmentation of the highest total score. It keeps scores for a window as long as
the longest piece, and commits ids as soon as the back pointers of all live
positions meet in one boundary, so a text of any length needs little memory.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rankmesh.llm.common import chunks, plus

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What a character outside the vocabulary costs below the lowest score, as in the public library.
UNKNOWN_PENALTY = 10.0
#: Merges that a BPE model may not make have scores below this.
UNUSABLE = -1e6
#: Scores are added as whole millionths, so that sums, and ties, don't hang on the order of adding.
MICRO = 1e6
#: Characters between two looks at whether all paths meet.
LOOK = 32
#: Words whose ids a worker keeps, and as many older ones.
CACHE = 250_000


class Vocabulary:
    """Pieces of a model file: ids and scores by string, and the ids of the 256 bytes."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], bpe: bool):
        """``kinds`` has for each piece: normal, byte or other (control, unknown, unused)."""
        self.pieces, self.kinds = pieces, kinds
        # a single character can always stand alone, even one that no merge makes
        usable = [i for i, k in enumerate(kinds) if k == "normal" and (scores[i] > UNUSABLE or len(pieces[i]) == 1)]
        if bpe:
            last = min((scores[i] for i in usable if scores[i] > UNUSABLE), default=0.0) - 1
            rank = {i: 1 - (scores[i] if scores[i] > UNUSABLE else last) for i in usable}
            norm = math.log(sum(1 / r for r in rank.values())) if usable else 0.0
            self.score = {pieces[i]: -math.log(r) - norm for i, r in rank.items()}
        else:
            self.score = {pieces[i]: scores[i] for i in usable}
        self.id = {pieces[i]: i for i in usable}
        self.bytes = [i for i, k in enumerate(kinds) if k == "byte"]
        if len(self.bytes) != 256:
            raise ValueError("the vocabulary needs a piece for each of the 256 bytes, or texts can't be encoded losslessly")
        self.unknown = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.whole_unknown = round(MICRO * self.unknown)
        self.longest = max(map(len, self.score), default=1)
        #: whole score and id of each piece
        self.whole = {p: (round(MICRO * self.score[p]), i) for p, i in self.id.items()}
        #: no piece has a space mark but at its beginning: then a boundary lies before each one
        self.by_word = all(SPACE not in p[1:] for p in self.score)
        #: what each id decodes to
        self.raw = [bytes([self.bytes.index(i)]) if k == "byte" else p.replace(SPACE, " ").encode() if k == "normal" else b"" for i, (p, k) in enumerate(zip(pieces, kinds, strict=True))]

    @cached_property
    def trie(self) -> dict:
        """Character -> (further characters, whole score or None, id). Each worker builds its own."""
        out: dict = {}
        for p, (score, i) in sorted(self.whole.items()):
            node = out
            for c in p[:-1]:
                node = node.setdefault(c, ({}, None, -1))[0]
            node[p[-1]] = (node.get(p[-1], ({},))[0], score, i)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "trie"}


def load(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver; workers get the vocabulary, whose size the file fixes, by broadcast."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    kinds = ["byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal" for i in ids]
    scores = [m.get_score(i) for i in ids]
    # log probabilities aren't whole numbers throughout; ranks are
    bpe = all(float(s).is_integer() for s, k in zip(scores, kinds, strict=True) if k == "normal")
    return Vocabulary([m.id_to_piece(i) for i in ids], scores, kinds, bpe)


def segment(v: Vocabulary, s: str) -> Iterator[list[tuple[int, int, int]]]:
    """Best segmentation of ``s``: lists of (begin, end, id or -1) in order, each given out as soon as it is settled.

    Scores and back pointers are held from the last settled boundary on. A boundary
    is settled when all paths that may still go on meet in it: at once where no piece
    reaches beyond it, and else when their back pointers are followed, every 64
    characters at first. Of equal scores the one with the shortest last piece wins, so that
    paths through a run of one character have all but their ends in common. A
    character that is no piece makes a piece of its own.
    """
    n, trie, unknown, longest = len(s), v.trie, v.whole_unknown, v.longest
    floor, pad = float("-inf"), longest + 2 * LOOK
    # position ``base`` is settled; the lists hold what is known of base, base + 1, ...
    base, reach, next_look, room = 0, 0, LOOK, min(n, pad) + 1
    best, back, piece = [floor] * room, [0] * room, [-1] * room
    best[0] = 0
    for i in range(n):
        k = i - base
        if i >= next_look:
            meet = i if reach == i else _meet(best, back, base, i, reach)
            if meet > base:
                yield _trace(back, piece, base, meet)
                k, cut = i - meet, meet - base
                best, back, piece, base = best[cut:], back[cut:], piece[cut:], meet
                room -= cut
            next_look = i + max(LOOK, (i - base) // 2)  # paths that won't meet aren't followed again and again
        if room <= k + longest and room <= n - base:
            best += [floor] * pad
            back += [0] * pad
            piece += [-1] * pad
            room += pad
        at = best[k]
        end, node = k + 1, trie
        if at + unknown >= best[end]:
            best[end], back[end], piece[end] = at + unknown, i, -1
        for j, c in enumerate(s[i : i + longest], end):
            hit = node.get(c)
            if hit is None:
                break
            node, score, own = hit
            if score is not None:
                end = j
                if at + score >= best[j]:
                    best[j], back[j], piece[j] = at + score, i, own
        if base + end > reach:
            reach = base + end
    if n > base:
        yield _trace(back, piece, base, n)


def _meet(best: list[float], back: list[int], base: int, i: int, reach: int) -> int:
    """The last boundary that all paths through the positions from i to reach have in common."""
    live = {j for j in range(i, reach + 1) if best[j - base] > float("-inf")}
    while len(live) > 1:
        top = max(live)
        live.discard(top)
        live.add(back[top - base])
    return live.pop()


def _trace(back: list[int], piece: list[int], base: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while end > base:
        begin = back[end - base]
        out.append((begin, end, piece[end - base]))
        end = begin
    out.reverse()
    return out


class _Cache(dict):
    """Ids of words. When it is full it becomes the old one, from which words that come again are taken over."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, word: str | tuple[str]) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
            if len(got) > 256:
                return got
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class Encoder:
    """Texts to ids and back.

    All ids come from ``segment``. Where no piece spans a space or a line end, every
    path meets there, so that what is settled between two of them is the same in any
    text: it is kept, and taken again when the word comes again.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self.alone = v.by_word and not any("\n" in p for p in v.score)
        self.line_end = struct.pack("<i", v.bytes[10])
        self.cache = _Cache(self._word)

    def _word(self, word: str | tuple[str]) -> bytes:
        """Ids of a word after a space, or of a line end and the word after it, given as a tuple. A space mark in it is spelt in bytes."""
        head, word = (b"", SPACE + word) if type(word) is str else (self.line_end, word[0])
        if SPACE in word[1:] or word[:1] == SPACE and head:
            mark = struct.pack("<3i", *(self.v.bytes[b] for b in SPACE.encode()))
            first, *rest = word[not head :].split(SPACE)
            return head + mark.join([self._ids(first if head else SPACE + first), *map(self._ids, rest)])
        return head + self._ids(word)

    def _ids(self, s: str) -> bytes:
        out: list[int] = []
        for settled in segment(self.v, s):
            for i, j, k in settled:
                out += [k] if k >= 0 else [self.v.bytes[b] for b in s[i:j].encode("utf-8", "surrogatepass")]
        return struct.pack(f"<{len(out)}i", *out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32. An empty text has none. A space mark in the text is spelt in bytes."""
        if not text:
            return b""
        if self.alone:
            first, *lines = text.split("\n")
            words: list[str | tuple[str]] = first.split(" ")
            for line in lines:  # no piece has a line end, so what follows one stands alone
                head, *rest = line.split(" ")
                words.append((head,))
                words += rest
            return b"".join(map(self.cache.__getitem__, words))
        if SPACE in text:
            raise ValueError("this vocabulary can't tell a space mark in a text from a space")
        return self._ids((SPACE + text).replace(" ", SPACE))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement marks."""
        raw = self.v.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace")[1:]


_ENCODERS: dict[object, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder in each worker; another vocabulary takes its place."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    """A broadcast value and what tells it from others."""

    def __init__(self, spark, value):
        self.broadcast = spark.sparkContext.broadcast(value)
        self.id = uuid.uuid4().hex  # workers live on; no later value may be taken for this one

    @property
    def value(self):
        return self.broadcast.value


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text as array<int>; null texts have null ids, empty texts none.

    With ``check``, a boolean column of that name tells whether decoding gives
    the text again (null for a null text). A column of the new names is replaced.
    """
    shared = _Shared(docs.sparkSession, vocabulary or load())
    docs = docs.drop(out, *([check] if check else []))
    schema = plus(docs, (out, "array<int>"), *([(check, "boolean")] if check else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for batch in chunks(batches, text, 1 << 20):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            raw = [None if t is None else e.encode(t) for t in texts]
            ends = np.cumsum([0, *(len(r) // 4 if r else 0 for r in raw)], dtype=np.int32)
            flat = np.frombuffer(b"".join([r for r in raw if r]), "<i4")
            none = [r is None for r in raw]
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(none) if any(none) else None)
            new = [ids]
            if check:
                listed = flat.tolist()
                new.append(pa.array([None if t is None else e.decode(listed[a:b]) == t for t, a, b in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, out, *([check] if check else [])])

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: Vocabulary | None = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of each array of ids; null ids give a null text. A column named ``out`` is replaced."""
    shared = _Shared(rows.sparkSession, vocabulary or load())
    rows = rows.drop(out)
    schema = plus(rows, (out, "string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for batch in batches:
            got = [None if r is None else e.decode(r) for r in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)
