"""Language-model scoring by subword lattices.

A text is one lattice, from the beginning of its first word to its end. Between two
word boundaries a word is reached by one edge, the word as a whole, weighted by its
discounted count, and by all its spellings: a gate with the mass that discounting
freed, then a piece that opens the word, pieces or bytes that go on, and the word's
end. An existing vocabulary's scores weight the pieces: they are a part of each
piece's probability, and the spellings of every training word under them give the
expected counts that are the other part. One forward recursion in log space sums
over all segmentations and gives the text's marginal probability. No piece spans a
word boundary, so all paths meet there, and the recursion over a word that comes
again is done once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmesh.llm.common import chunks, fold, text_or_empty, words_of, written
from rankmesh.llm.spm import SPACE, Vocabulary, _Shared, load

#: So many of the most frequent words, of so many bytes, at most, are broadcast; texts meet the counts of all others in a join.
HEAD, HEAD_BYTES = 200_000, 64
#: Words counted by a task, and bytes of text, before it hands the counts on.
COUNTED, COUNTED_BYTES = 500_000, 64 << 20
#: The part of a piece's probability that comes from the vocabulary's own score.
OWN = 0.1
#: E and M steps.
ROUNDS = 2
LN10 = math.log(10)
#: A count's place in the histogram that finds the frequent words: 8 steps for each doubling.
STEPS = 8
#: Spans looked up together.
SPANS = 1 << 19

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SLOTS = 20


class Pieces:
    """Pieces by the hash of their characters, so that spans of many words are looked up at once."""

    def __init__(self, names: list[str]):
        self.longest = max(map(len, names), default=1)
        keys = np.array([self.prefixes(np.array([[ord(c) for c in p]], np.uint64))[0, -1] for p in names], np.uint64) if names else np.zeros(0, np.uint64)
        slots = self.slots(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.places = keys[order], order.astype(np.int32)
        self.begin = np.searchsorted(slots[order], np.arange((1 << _SLOTS) + 1)).astype(np.int32)
        self.most = int(np.diff(self.begin).max(initial=0))
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.longest, _BASE)]), dtype=np.uint64)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * _MIX) >> np.uint64(64 - _SLOTS)

    @staticmethod
    def prefixes(points: np.ndarray) -> np.ndarray:
        """Hashes of all beginnings of rows of code points, the empty one first."""
        out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
        mixed = (points + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(31)
        for j in range(points.shape[1]):
            out[:, j + 1] = out[:, j] * _BASE + mixed[:, j]
        return out

    def find(self, hashes: np.ndarray, begin: int, end: int) -> np.ndarray:
        """Places of the pieces that begin at begin .. end - 1 and have 1, 2, ... characters: (word, begin, length), -1 for none."""
        words, n = hashes.shape[0], hashes.shape[1] - 1
        out = np.full((words, end - begin, min(self.longest, n - begin)), -1, np.int32)
        for k in range(1, out.shape[2] + 1):
            last = min(end, n - k + 1)
            if last <= begin:
                break
            keys = (hashes[:, begin + k : last + k] - hashes[:, begin:last] * self.powers[k]).ravel()
            slot = self.slots(keys)
            at, stop = self.begin[slot], self.begin[slot + np.uint64(1)]
            got = np.full(len(keys), -1, np.int32)
            for p in range(self.most):
                some = np.flatnonzero(at + p < stop)
                if not len(some):
                    break
                hit = self.keys[at[some] + p] == keys[some]
                got[some[hit]] = self.places[at[some[hit]] + p]
            out[:, : last - begin, k - 1] = got.reshape(words, -1)
        return out


class Spelling:
    """Log probabilities of pieces, of bytes, and of a word's end. Pieces that begin with a space mark open a word, others go on."""

    def __init__(self, names: list[str], piece: np.ndarray, byte: np.ndarray, end: float, pieces: Pieces | None = None):
        self.names, self.piece, self.byte, self.end = names, piece, byte, end
        self.opens = np.array([p.startswith(SPACE) for p in names], bool)
        self.pieces = pieces or Pieces(names)

    @classmethod
    def of(cls, v: Vocabulary) -> Spelling:
        """The vocabulary's scores as they are; bytes have its lowest score less the unknown penalty, the end costs nothing."""
        names = [p for p in v.score if SPACE not in p[1:]]
        return cls(names, np.array([v.score[p] for p in names]), np.full(256, v.unknown), 0.0)

    def learned(self, counts: np.ndarray, words: float, first: Spelling, own: float = OWN) -> Spelling:
        """From expected counts of pieces and, after them, bytes, over ``words`` words; ``own`` of each probability comes from ``first``."""
        n = len(self.names)
        kept = np.exp(np.concatenate([first.piece, first.byte, [0.0]]))  # and the end, once for each word
        got = np.concatenate([counts, [words]])
        opens, out = np.concatenate([self.opens, np.zeros(257, bool)]), np.zeros(n + 257)
        for which in (opens, ~opens):
            if which.any():
                share = got[which] / got[which].sum() if got[which].sum() else kept[which] / kept[which].sum()
                out[which] = (1 - own) * share + own * kept[which] / kept[which].sum()
        with np.errstate(divide="ignore"):
            out = np.log(out)
        return Spelling(self.names, out[:n], out[n:-1], float(out[-1]), self.pieces)

    def _weights(self, points: np.ndarray, hashes: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For the edges (word, begin, length): places of pieces, -1 for none and -2 for a character's bytes, and log probabilities."""
        place = self.pieces.find(hashes, begin, end)
        if (points[:, 1:] == ord(SPACE)).any():  # a space mark of the word's own opens nothing
            later = place[:, max(0, 1 - begin) :]
            later[(later >= 0) & self.opens[later]] = -1
        lp = np.where(place >= 0, self.piece[place] if len(self.piece) else -np.inf, -np.inf)
        # a character that is no piece: its bytes; the space mark has to be in a piece
        bare = place[:, :, 0] < 0
        if begin == 0:
            bare[:, 0] = False
        if bare.any():
            chars, at = np.unique(points[:, begin:end][bare], return_inverse=True)
            costs = np.array([self.byte[list(chr(c).encode("utf-8", "surrogatepass"))].sum() for c in chars.tolist()])
            lp[:, :, 0][bare] = costs[at]
            place[:, :, 0][bare] = -2
        return place, lp

    def _batches(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of one length at a time: their places in the list, code points with the space mark before them, and hashes."""
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            step = max(1, SPANS // ((size + 1) * min(self.pieces.longest, size + 1)))
            for k in range(0, len(own), step):
                at = own[k : k + step]
                raw = "".join(SPACE + words[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass")
                points = np.frombuffer(raw, np.uint32).reshape(len(at), size + 1).astype(np.uint64)
                yield at, points, self.pieces.prefixes(points)

    def _spans(self, n: int, words: int) -> Iterator[tuple[int, int]]:
        step = max(1, SPANS // (words * self.pieces.longest))
        for begin in range(0, n, step):
            yield begin, min(begin + step, n)

    def _forward(self, points: np.ndarray, hashes: np.ndarray, gate: float) -> np.ndarray:
        words, n = points.shape
        alpha = np.full((words, n + 1), -np.inf)
        alpha[:, 0] = gate
        for begin, end in self._spans(n, words):
            _, lp = self._weights(points, hashes, begin, end)
            for i in range(begin, end):
                k = min(lp.shape[2], n - i)
                alpha[:, i + 1 : i + k + 1] = np.logaddexp(alpha[:, i + 1 : i + k + 1], alpha[:, i, None] + lp[:, i - begin, :k])
        return alpha

    def log_probabilities(self, words: list[str], whole: np.ndarray | None = None, gate: float = 0.0) -> np.ndarray:
        """ln of the sum over all paths from a word's beginning to its end: the forward recursion.

        A path is the edge for the whole word, of weight ``whole`` (ln), or the
        ``gate`` (ln) and a spelling.
        """
        out = np.full(len(words), -np.inf) if whole is None else whole.copy()
        for at, points, hashes in self._batches(words):
            out[at] = np.logaddexp(out[at], self._forward(points, hashes, gate)[:, -1] + self.end)
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece and, after the pieces, each byte is expected in the spellings of the words, each word once."""
        out = np.zeros(len(self.names) + 256)
        for _, points, hashes in self._batches(words):
            alpha = self._forward(points, hashes, 0.0)
            count, n = points.shape
            beta = np.full((count, n + 1), -np.inf)
            beta[:, n] = 0.0
            total = alpha[:, n]
            for begin, end in reversed(list(self._spans(n, count))):
                place, lp = self._weights(points, hashes, begin, end)
                for i in reversed(range(begin, end)):
                    k = min(lp.shape[2], n - i)
                    beta[:, i] = np.logaddexp.reduce(lp[:, i - begin, :k] + beta[:, i + 1 : i + k + 1], 1)
                used = place != -1
                w, i, k = np.nonzero(used)
                i += begin
                with np.errstate(invalid="ignore"):
                    x = np.exp(alpha[w, i] + lp[used] + beta[w, i + k + 1] - total[w])
                x[~np.isfinite(x)] = 0.0
                kinds = place[used]
                out[: len(self.names)] += np.bincount(kinds[kinds >= 0], x[kinds >= 0], len(self.names))
                bare = kinds == -2
                chars, own = np.unique(points[w[bare], i[bare]], return_inverse=True)
                for c, s in zip(chars.tolist(), np.bincount(own, x[bare], len(chars)).tolist(), strict=True):
                    for b in chr(c).encode("utf-8", "surrogatepass"):
                        out[len(self.names) + b] += s
        return out


def _counts(docs: DataFrame) -> DataFrame:
    """Rows (word, c, t): how often a word comes in training texts, and in all; ends are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        rest: Counter = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            words = [*train, *(w for w in rest if w not in train)]
            c = [train[w] for w in words]
            got = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array([a + rest[w] for w, a in zip(words, c, strict=True)], pa.int64())], ["word", "c", "t"])
            train.clear(), rest.clear()
            return got

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (rest if held else train).update(words_of(text))
                size += len(text)
                if len(train) + len(rest) > COUNTED or size > COUNTED_BYTES:
                    yield out()
                    size = 0
        if train or rest:
            yield out()

    counted = docs.select(text_or_empty().alias("text"), "held_out").mapInArrow(run, "word binary, c long, t long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def _expected(words: DataFrame, spelling: _Shared, n: int) -> np.ndarray:
    """Expected counts of ``n`` pieces and bytes over all words, each once; a row for each piece reaches the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = spelling.value, np.zeros(n)
        for batch in _gathered(batches):
            sums += own.expected([w.decode() for w in batch.column(0).to_pylist()])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["place", "n"])

    sums = words.select("word").mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(sums["place"].to_numpy(), sums["n"].to_numpy(), n)


def _gathered(batches: Iterable[pa.RecordBatch], rows: int = 1 << 15, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together, as work on many words at once is cheaper; of ``most`` bytes, or a single one of more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= most):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
        held.append(batch)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def score(docs: DataFrame, vocabulary: Vocabulary | None = None, head: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """Score every text, learning from those whose crc32(doc_id as text) mod 10 is not 0.

    Takes ``doc_id`` and ``text`` of ``docs``; other columns are ignored. A null
    text counts as empty; an empty text has the end as its only token. A null
    doc_id is trained on. Repeated rows are separate texts. Rows: doc_id,
    held_out, n_tokens, n_known (tokens that training texts have), train_tokens,
    base_score (log10, words by additive smoothing), score (log10, the model's).
    No documents give no rows.

    Counts of all words stay distributed. The most frequent, ``head`` at most and
    of 64 bytes at most, are broadcast; each text's other words meet
    their counts in a join.
    """
    spark = docs.sparkSession
    v = vocabulary or load()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 10) == 0, F.lit(False)).alias("held_out"), "text")
    counts = written(_counts(docs), "lm-counts")
    bins = (F.floor(F.log2("t") * STEPS)).cast("int")
    stats = counts.agg(F.sum("c").alias("c"), F.sum((F.col("c") > 0).cast("long")).alias("v"), *(F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2))).first()
    ends = docs.filter("not held_out").count()
    seen, types = stats.c or 0, stats.v or 0
    n_train, kinds = seen + ends, types + (ends > 0)
    discount = stats.n1 / (stats.n1 + 2 * stats.n2) if stats.n1 and stats.n2 else 0.5
    # the lowest count that at most ``head`` words reach; very long words aren't broadcast, however frequent
    short = F.length("word") <= HEAD_BYTES
    least, held = math.inf, 0
    for r in sorted(counts.filter(short).groupBy(bins.alias("bin")).count().collect(), key=lambda r: -r.bin):
        held += r["count"]
        if held > head:
            break
        least = r.bin
    # the first E step is under the vocabulary's scores, each later one under what the M step before it made
    first = spelling = Spelling.of(v)
    for _ in range(rounds if types else 0):
        spelling = spelling.learned(_expected(counts.filter("c > 0"), _Shared(spark, spelling), len(first.names) + 256), types, first)
    if not types:
        spelling = spelling.learned(np.zeros(len(first.names) + 256), 0.0, first)
    shared = _Shared(spark, spelling)
    base = math.log10(n_train + 0.1 * (kinds + 1))
    end_base, end_own = math.log10(ends + 0.1) - base, math.log10((ends + 0.5) / (n_train + 1.5))
    gate = math.log(discount * types + 1) - math.log(n_train + 1.5)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Spelling = shared.value
        for batch in _gathered(batches):
            words, c = batch.column(0), batch.column(1).to_numpy()
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0)) - math.log(n_train + 1.5)
            own = model.log_probabilities([w.decode() for w in words.to_pylist()], whole, gate) / LN10
            yield pa.RecordBatch.from_arrays([words, pa.array(c > 0), pa.array(np.log10(c + 0.1) - base), pa.array(own)], ["word", "known", "base", "own"])

    judged = "word binary, known boolean, base double, own double"
    common = short & (bins >= (least if least < math.inf else 1 << 30))
    top = _Shared(spark, counts.filter(common).select("word", "c").mapInArrow(judge, judged).toArrow())
    rare = counts.filter(~common).select("word", "c").mapInArrow(judge, judged)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _table(top)
        for batch in chunks(batches, "text", 1 << 20):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            sums, rest, ends_at = [], [], [0]
            ns: list[int] = []
            for text in texts:
                words = words_of(text)
                n_known, b, o = 0, 0.0, 0.0
                for w, k in Counter(words).items():
                    hit = known.get(w)
                    if hit is None:
                        rest.append(w)
                        ns.append(k)
                    else:
                        n_known += k * hit[0]
                        b += k * hit[1]
                        o += k * hit[2]
                ends_at.append(len(rest))
                sums.append((len(words) + 1, n_known, b, o))
            tail = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.StructArray.from_arrays([pa.array(rest, pa.binary()), pa.array(ns, pa.int64())], ["word", "k"]))
            cols = [pa.array(x, t) for x, t in zip(zip(*sums, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "held_out", "row")]
            yield pa.RecordBatch.from_arrays([*keep, *cols, tail], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "own", "tail"])

    rows = docs.select("doc_id", "held_out", F.monotonically_increasing_id().alias("row"), text_or_empty().alias("text"))
    rows = rows.mapInArrow(look, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, own double, tail array<struct<word:binary,k:long>>")
    rows = written(rows, "lm-texts")
    tail = rows.select("row", F.explode("tail").alias("x")).select("row", "x.word", "x.k").join(rare, "word")
    k = F.col("k")
    tail = tail.groupBy("row").agg(F.sum(k * F.col("known").cast("long")).alias("t_known"), F.sum(k * F.col("base")).alias("t_base"), F.sum(k * F.col("own")).alias("t_own"))
    both = rows.drop("tail").join(tail, "row", "left")
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("t_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("t_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("own") + F.coalesce("t_own", F.lit(0.0)) + end_own).alias("score"),
    )


_TABLES: dict[object, dict] = {}


def _table(shared: _Shared) -> dict[bytes, tuple[bool, float, float]]:
    """The frequent words' scores, built once by each worker."""
    if shared.id not in _TABLES:
        _TABLES.clear()
        t = shared.value
        _TABLES[shared.id] = dict(zip(t["word"].to_pylist(), zip(*(t[c].to_pylist() for c in ("known", "base", "own")), strict=True), strict=True))
    return _TABLES[shared.id]
