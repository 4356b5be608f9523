"""Quality by weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer.

Each heuristic labeller looks at one trait of a text and flags it as bad or lets it
pass. How often each pattern of flags occurs is counted over all documents.
Expectation-maximisation estimates from these counts, without any true label,
what share of texts is good and how often each labeller flags good and bad ones. The labels' posterior probabilities then train a linear scorer over
hashed words and word shapes, which judges every text.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmesh.llm import linear
from rankmesh.llm.common import chunks, columns, plus, sample_ids, scratch, text_or_empty, written
from rankmesh.llm.spm import _Shared

#: Documents that the scorer is fitted on, at most.
SAMPLE = 8_000
BITS = 18
THRESHOLD = 0.5
EPOCHS, RATE, DECAY = 150, 0.3, 1e-6
_SYMBOLS = b"#$%&*|<>{}[]\\^~=@_+"
_WHITE, _CLOSING = b" \t\n\v\f\r", b".,!?;:"
_UPPER, _LOWER, _ASCII, _BLACK = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128)), bytes(range(33, 127))


def _among(own: bytes) -> np.ndarray:
    """Whether each byte is one of these."""
    out = np.zeros(256, bool)
    out[list(own)] = True
    return out


_IS_WHITE, _IS_CLOSING, _IS_SYMBOL = map(_among, (_WHITE, _CLOSING, _SYMBOLS))


@dataclass
class Traits:
    """What the labellers look at. Shares are 0 to 1."""

    words: int
    upper: float  # of ASCII letters
    symbols: float  # of bytes
    letters: float  # and digits, of bytes but white space; any byte beyond ASCII counts as one
    marked: float  # words that end in a symbol
    shouts: float  # '!!' for each word
    repeats: float  # words equal to the one before
    top: float  # the most frequent word's share
    distinct: float  # different words, over 0.634 times the words to the power 0.75, as longer texts have fewer for each word
    closed: float  # words that end in punctuation
    same_lines: float  # lines that occurred before

    @classmethod
    def of(cls, text: str) -> Traits:
        raw = text.encode()
        words = raw.lower().split()
        n, size = max(len(words), 1), max(len(raw), 1)
        count = Counter(words)
        white = _IS_WHITE[np.frombuffer(raw + b" ", np.uint8)]
        # the last byte of each word
        last = np.frombuffer(raw, np.uint8)[~white[:-1] & white[1:]]
        upper, lower, digits, black = (len(raw) - len(raw.translate(None, x)) for x in (_UPPER, _LOWER, b"0123456789", _BLACK))
        lines = raw.split(b"\n")
        return cls(
            len(words),
            upper / max(upper + lower, 1),
            (size - len(raw.translate(None, _SYMBOLS))) / size if raw else 0.0,
            (upper + lower + digits + len(raw.translate(None, _ASCII))) / max(black + len(raw.translate(None, _ASCII)), 1),
            int(_IS_SYMBOL[last].sum()) / n,
            raw.count(b"!!") / n,
            sum(map(bytes.__eq__, words, words[1:])) / n,
            max(count.values(), default=0) / n,
            len(count) / (0.634 * n**0.75),
            int(_IS_CLOSING[last].sum()) / n,
            1 - len(set(lines)) / len(lines),
        )


#: The labellers: each flags one fault. Several look at the same fault in different ways.
LABELLERS = {
    "case": lambda t: t.upper > 0.5,
    "shouting": lambda t: t.shouts > 0.1,
    "all_closed": lambda t: t.words >= 30 and t.closed > 0.6,
    "none_closed": lambda t: t.words >= 60 and t.closed < 0.005,
    "symbols": lambda t: t.symbols > 0.03,
    "letters": lambda t: t.words >= 5 and t.letters < 0.85,
    "marked": lambda t: t.words >= 5 and t.marked > 0.1,
    "stutter": lambda t: t.words >= 5 and t.repeats > 0.2,
    "one_word": lambda t: t.words >= 20 and t.top > 0.3,
    "variety": lambda t: t.words > 0 and t.distinct < 1,
    "lines": lambda t: t.same_lines > 0.5,
    "empty": lambda t: t.words == 0,
}


def votes(text: str) -> int:
    """The labellers' flags as bits, the first labeller's lowest."""
    traits = Traits.of(text)
    return sum(flag(traits) << j for j, flag in enumerate(LABELLERS.values()))


@dataclass
class Accuracies:
    """The share of good texts, and flags[j, y]: how likely labeller j flags a text of class y (0 bad, 1 good)."""

    prior: float
    flags: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that a text with these flags is good."""
        bits = (patterns[:, None] >> np.arange(len(self.flags))) & 1
        odds = bits @ np.log(self.flags[:, 1] / self.flags[:, 0]) + (1 - bits) @ np.log((1 - self.flags[:, 1]) / (1 - self.flags[:, 0]))
        return 1 / (1 + np.exp(-np.clip(odds + math.log(self.prior / (1 - self.prior)), -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 100) -> Accuracies:
    """Expectation-maximisation from counted patterns of flags; at the start each flag makes a text less likely to be good."""
    bits = (patterns[:, None] >> np.arange(labellers)) & 1
    q, prior = 0.95 * 0.3 ** bits.sum(1), -1.0
    for _ in range(rounds):
        good, bad = counts * q, counts * (1 - q)
        flags = np.stack([(bits.T @ bad + 0.1) / (bad.sum() + 1), (bits.T @ good + 0.01) / (good.sum() + 1)], 1)
        found = Accuracies(min(max(good.sum() / counts.sum(), 1e-3), 1 - 1e-3), flags)
        q = found.posterior(patterns)
        if abs(found.prior - prior) < 1e-9:
            break
        prior = found.prior
    return found


def shape(word: str) -> str:
    """Letters as A or a, digits as 0, anything else as it is; runs of one symbol become two of it."""
    out: list[str] = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out[-2:] != [s, s]:
            out.append(s)
    return "".join(out)


class _Words(dict):
    """Bytes of a word -> its hash, and above that its shape's hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = zlib.crc32(shape(word.decode("utf-8", "replace")).encode()) << 31 | zlib.crc32(word) & 0x7FFFFFFF
        return got


_WORDS = _Words()


def hashed(text: str) -> np.ndarray:
    """Bucket of every word, shape, pair of shapes and repeated word; the last bucket is for repeats alone."""
    return _buckets(text.encode().split())


def _buckets(words: list[bytes]) -> np.ndarray:
    both = np.fromiter(map(_WORDS.__getitem__, words), np.int64, len(words))
    word, form = both & 0x7FFFFFFF, both >> 31
    half = (1 << BITS - 1) - 1
    pairs = (form[:-1] * 31 + form[1:] * 17 + 5) % half + half
    same = np.full(int((word[1:] == word[:-1]).sum()), 2 * half, np.int64)
    return np.concatenate([word % half, form % half + half, pairs, same])


def loss(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The logistic loss with soft targets, and its slope."""
    return np.logaddexp(0, z) - z * target, linear.sigmoid(z) - target


def fit(batch: linear.Batch) -> tuple[np.ndarray, float]:
    """Logistic regression with soft targets, in which both classes weigh the same, however rare one is.

    Full batches, exact sums and zero weights at the start, so that equal input gives equal weights.
    """

    def gradient(step: int, w: np.ndarray, b: float) -> np.ndarray:
        heads, grads = batch.sums(step, w, b)
        g = (np.concatenate([grads, heads[1][:, None]], 1) * (0.5 / np.maximum(heads[2], 1))[:, None]).sum(0)
        g[:-1] += DECAY * w
        return g

    return linear.descend(batch.n, 0.0, gradient, EPOCHS, RATE, 1e-8)


@dataclass
class Model:
    weights: np.ndarray
    offset: float
    accuracies: Accuracies

    def score(self, text: str) -> float:
        """Probability that the text is good, by the linear scorer."""
        words = text.encode().split()
        z = self.offset + self.weights[_buckets(words)].sum() / max(len(words), 1)
        return 1 / (1 + math.exp(-min(max(z, -500), 500)))


def train(docs: DataFrame, sample: int = SAMPLE, local: int = linear.LOCAL) -> Model | None:
    """Count votes over all documents, estimate the labellers, fit the scorer; None if there are no documents.

    The scorer is fitted on ``sample`` documents at most, those whose ids have the
    smallest hashes; the labellers' accuracies come from all documents.
    ``local``: see ``linear.Batch``.
    """
    with scratch(docs.sparkSession):
        return _train(docs, sample, local)


def _train(docs: DataFrame, sample: int, local: int) -> Model | None:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()
        for batch in chunks(batches, "text", 1 << 20):
            got.update(map(votes, batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], ["pattern", "n"])

    # at most 2 to the power of the number of labellers
    table = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    if not table:
        return None
    table.sort(key=lambda r: r.pattern)
    accuracies = estimate(np.array([r.pattern for r in table]), np.array([r.n for r in table], float))
    chosen = written(sample_ids(docs, sample), "quality-sample").withColumnRenamed("doc_id", "chosen")

    def see(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            texts = batch.column(0).to_pylist()
            found = [np.unique(hashed(t), return_counts=True) for t in texts]
            shares = [(k / max(len(t.encode().split()), 1)).astype(np.float32) for t, (_, k) in zip(texts, found, strict=True)]
            target = accuracies.posterior(np.array([votes(t) for t in texts], np.int64))
            rows = [pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())), pa.array((target > 0.5).astype(np.int32)), pa.array(target), pa.array(np.ones(len(texts)))]
            yield pa.RecordBatch.from_arrays(rows, ["places", "shares", "class", "target", "weight"])

    # the parameter bounds the ids, and so the broadcast
    seen = docs.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("chosen"))).select("text").distinct()
    w, b = fit(linear.Batch(seen.mapInArrow(see, linear.SCHEMA), 1 << BITS, loss, local))
    # the fit weighs both classes alike; a text is judged by how common they are
    return Model(w, b + math.log(accuracies.prior / (1 - accuracies.prior)), accuracies)


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with pattern (the votes), posterior (of the votes) and score; null texts count as empty. Columns of these names are replaced."""
    shared = _Shared(docs.sparkSession, model)
    docs = docs.drop("pattern", "posterior", "score")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in chunks(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            pattern = np.array([votes(t) for t in texts], np.int64)
            new = [pa.array(pattern), pa.array(own.accuracies.posterior(pattern)), pa.array([own.score(t) for t in texts], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "pattern", "posterior", "score"])

    return docs.mapInArrow(run, plus(docs, ("pattern", "long"), ("posterior", "double"), ("score", "double")))


def judged(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train, and score every document. Rows: doc_id, votes (a digit for each labeller: 1 if it flags the text), posterior, score, kept.

    One row for each row of ``docs``; a null or empty text is bad by one labeller
    and has the scorer's offset as its score. No documents give no rows.
    """
    rows = scored(docs.select("doc_id", "text"), train(docs))
    digits = F.concat(*[F.shiftright("pattern", j).bitwiseAND(1).cast("string") for j in range(len(LABELLERS))])
    return rows.select("doc_id", digits.alias("votes"), "posterior", "score", (F.col("score") >= threshold).alias("kept"))


def reject(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those whose score is below ``threshold``, with the same columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select(*[c.alias(n) for c, n in zip(columns(docs), names, strict=True)]).withColumnRenamed(names[docs.columns.index("text")], "text")
    kept = scored(own, train(docs)).filter(F.col("score") >= threshold)
    return kept.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
