"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents, whatever is known of
them, are the unlabelled part, in which toxic ones hide. A linear model over words
and beginnings of words is trained in numpy by the risk that the class prior
corrects: the prior times the positives' loss, plus the unlabelled texts' loss as
negatives less the prior times the positives' loss as negatives, where that
difference is not let below zero. Its gradients are summed over executors.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmesh.llm import linear
from rankmesh.llm.common import chunks, fold, free, plus, sample_ids, scratch, text_or_empty, words_of, written
from rankmesh.llm.spm import _Shared

#: Confirmed toxic documents that the classifier is fitted on, at most. Unlabelled documents have no bound.
POSITIVES = 20_000
#: What a feature needs: confirmed documents, standard deviations above chance, and that it is so many times
#: as frequent in confirmed documents as in all.
LEAST, DEVIATIONS, LIFT = 3, 4.0, 2.0
#: Beginnings of words that are features, in characters. Whole words are features too.
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
EPOCHS, RATE, DECAY = 300, 0.1, 1e-4
#: Copies of a text that make up over one in so many of all rows count once, all of them together.
OFTEN = 100_000


def features(word: bytes) -> list[bytes]:
    """A word, and its beginnings (marked by a trailing white space, which no word has)."""
    text = word.decode("utf-8", "replace")
    return [word, *(text[:k].encode() + b" " for k in BEGINNINGS if len(text) >= k)]


def head(word: bytes) -> bytes:
    """The first characters of a word, as many as its shortest beginning among the features has: all its features have the same."""
    return word[: BEGINNINGS[0]] if word.isascii() else word.decode("utf-8", "replace")[: BEGINNINGS[0]].encode()


def heads(table: Iterable[bytes]) -> frozenset[bytes]:
    """The heads of features: a word with another has none of them, which most words are soon told by."""
    return frozenset(head(f.rstrip(b" ")) for f in table)


def _held(text: str) -> set[bytes]:
    return set().union(*(features(w) for w in set(words_of(text))))


@dataclass
class Model:
    """Weights of features, an offset and the class prior."""

    weights: dict[bytes, float]
    offset: float
    prior: float

    def __post_init__(self) -> None:
        self.found = _Found(self.weights)

    def score(self, text: str) -> float:
        """Probability of the label: the logistic of the weights of the features that the text has, each once."""
        weights = self.weights
        z = self.offset + math.fsum(weights[f] for f in self.found(text))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def loss(z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sigmoid loss as a negative (as a positive it is 1 less that), and its slope."""
    s = linear.sigmoid(z)
    return s, s * (1 - s)


def step(w: np.ndarray, heads: np.ndarray, grads: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk from sums over unlabelled (0) and positive (1) examples."""
    n = np.maximum(heads[2], 1)
    whole = np.concatenate([grads, heads[1][:, None]], 1) / n[:, None]
    rest = heads[0, 0] / n[0] - prior * heads[0, 1] / n[1]
    # the gradient of the whole risk, or the way back up where the unlabelled part's risk went below zero
    g = whole[0] - 2 * prior * whole[1] if rest >= 0 else prior * whole[1] - whole[0]
    g[:-1] += DECAY * w
    return g


def fit(batch: linear.Batch, prior: float) -> tuple[np.ndarray, float]:
    """Minimise the non-negative risk over all examples (class 1 is positive, 0 unlabelled).

    Exact sums and a fixed start, so that equal input gives equal weights.
    """

    def gradient(t: int, w: np.ndarray, b: float) -> np.ndarray:
        return step(w, *batch.sums(t, w, b), prior)

    return linear.descend(batch.n, math.log(prior / (1 - prior)), gradient, EPOCHS, RATE)


def mark() -> Column:
    """A text's hash."""
    return F.xxhash64("text")


def _worth(docs: DataFrame) -> DataFrame:
    """Rows (text, worth): 2^20 over the number of rows that share the text where these are many, else 2^20.

    Only texts that make up over one in ``OFTEN`` of all rows reach the driver,
    at most ``OFTEN`` of them.
    """
    counts = written(docs.groupBy(mark().alias("mark")).agg(F.count("*").alias("n")), "toxic-copies")
    n = counts.agg(F.sum("n")).first()[0] or 0
    often = F.broadcast(counts.filter((F.col("n") > 1) & (F.col("n") * OFTEN >= n)))
    worth = F.rint(F.lit(linear.UNIT) / F.coalesce("n", F.lit(1))).cast("long")
    return docs.join(often, mark() == F.col("mark"), "left").select("text", worth.alias("worth"))


def _counted(rows: DataFrame, only: _Shared | None = None) -> DataFrame:
    """Rows (feature, n, texts): the worth of the texts (text, worth) that hold it, once for each different word that has it, and once for each text.

    With ``only``, of that set's features, and texts is left at 0. Words are
    counted first, and their features once for each different word of a task.
    Texts are counted as if all were worth 1, as confirmed ones are.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()  # of texts that count once each
        shared: Counter = Counter()  # the worth of the others'
        texts: Counter = Counter()
        one = int(linear.UNIT)
        some = None if only is None else heads(only.value)

        def out() -> pa.RecordBatch:
            sums: Counter = Counter()
            for w in words.keys() | shared.keys():
                if some is not None and head(w) not in some:
                    continue
                n = words[w] * one + shared[w]
                for f in features(w):
                    if only is None or f in only.value:
                        sums[f] += n
            got = [pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64()), pa.array([texts[f] * one for f in sums], pa.int64())]
            words.clear(), shared.clear(), texts.clear()
            return pa.RecordBatch.from_arrays(got, ["feature", "n", "texts"])

        for batch in batches:
            for text, worth in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = set(words_of(text))
                if worth == one:
                    words.update(held)
                else:
                    shared.update(dict.fromkeys(held, worth))
                if only is None:
                    texts.update(_held(text))
                if len(words) + len(shared) > 500_000:
                    yield out()
        yield out()

    return rows.mapInArrow(run, "feature binary, n long, texts long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


class _Found:
    """Which features of a table a text has, each once; what a word gives is kept."""

    def __init__(self, table):
        self.table, self.heads, self.cache = table, heads(table), {}

    def __call__(self, text: str) -> set[bytes]:
        cache, table, heads_, found = self.cache, self.table, self.heads, set()
        if len(cache) > 400_000:
            cache.clear()
        for w in set(words_of(text)):
            hit = cache.get(w)
            if hit is None:
                hit = cache[w] = tuple(f for f in features(w) if f in table) if head(w) in heads_ else ()
            if hit:
                found.update(hit)
        return found


def train(docs: DataFrame, labels: DataFrame, local: int = linear.LOCAL) -> Model:
    """Fit on labels outside the held-out fold (crc32(doc_id as text) mod 4 is 2).

    A document is confirmed toxic if any of its labels in ``labels`` (doc_id,
    toxic) is 1; a null label says nothing. Of confirmed documents 20,000 at most
    are used, those whose ids have the smallest hashes, and of their texts that
    occur again one. All documents outside the fold are unlabelled ones, confirmed
    ones among them; a text that makes up over one in 100,000 of them counts once.
    The prior is the share of toxic ones among labelled documents, 0.05 where
    there are none. Without a confirmed document the model gives every text the
    prior's probability, at most 0.05. ``local``: see ``linear.Batch``.
    """
    with scratch(docs.sparkSession):
        return _train(docs, labels, local)


def _train(docs: DataFrame, labels: DataFrame, local: int) -> Model:
    spark = docs.sparkSession
    learn = F.coalesce(fold("doc_id", 4) != 2, F.lit(False))
    labels = labels.filter(learn & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = written(labels, "toxic-labels")
    n, n_toxic = labels.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    prior = min(max(n_toxic / n, 1e-3), 0.5) if n else 0.05
    unknown = Model({}, math.log(0.05 / 0.95), 0.05)
    if not n_toxic:
        return unknown
    docs = docs.filter(learn).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # a parameter bounds the ids, and so the broadcast
    chosen = written(sample_ids(labels.filter("toxic = 1").select("doc_id"), POSITIVES), "toxic-sample")
    toxic = written(docs.join(F.broadcast(chosen), "doc_id").select("text").distinct().withColumn("worth", F.lit(int(linear.UNIT)).cast("long")), "toxic-texts")
    n_p = toxic.count()
    if not n_p:
        return unknown
    every = _worth(docs.select("text"))
    # the features of enough confirmed texts; these, and so the broadcast, follow the bounded sample
    common = _counted(toxic).filter(F.col("texts") >= LEAST * int(linear.UNIT)).select("feature", F.col("n").alias("p"))
    common = written(common, "toxic-features")
    candidates = _Shared(spark, frozenset(bytes(r.feature) for r in common.select("feature").toLocalIterator()))
    n_u = written(every.groupBy("worth").agg(F.count("*").alias("rows")), "toxic-worths").agg(F.sum(F.col("worth") * F.col("rows"))).first()[0] / linear.UNIT
    table = common.join(_counted(every, candidates).select("feature", F.col("n").alias("u")), "feature", "left")
    p, u = F.col("p") / linear.UNIT, F.coalesce("u", F.lit(0)) / linear.UNIT
    # how far a feature's share among positives is above what its share among all would give
    chance = (p + u) * (n_p / (n_p + n_u))
    above = (p - chance) / F.sqrt(chance * (n_u / (n_p + n_u)) + 1e-9)
    names = sorted(bytes(r.feature) for r in table.filter((above >= DEVIATIONS) & (p / n_p >= LIFT * u / n_u)).select("feature").collect())
    if not names:
        return Model({}, math.log(min(prior, 0.05) / (1 - min(prior, 0.05))), prior)
    place = _Shared(spark, {f: i for i, f in enumerate(names)})

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = place.value, _Found(place.value)
        for batch in batches:
            lists = [sorted(own[f] for f in found(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int32())), *batch.columns[1:]], ["places", "worth", "class"])

    texts = every.withColumn("class", F.lit(0)).unionByName(toxic.withColumn("class", F.lit(1)))
    # examples with the same features are alike: their weights are summed
    alike = texts.mapInArrow(find, "places array<int>, worth long, class int").groupBy("places", "class").agg((F.sum("worth") / linear.UNIT).alias("weight"))
    alike = alike.select("places", F.transform("places", lambda x: F.lit(1.0).cast("float")).alias("shares"), "class", F.lit(0.0).alias("target"), "weight")
    w, b = fit(linear.Batch(alike, len(names), loss, local, always=1), prior)
    return Model(dict(zip(names, w.tolist(), strict=True)), b, prior)


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each whole text in a column ``name`` (replaced if there); null texts count as empty."""
    shared = _Shared(docs.sparkSession, model)
    docs = docs.drop(name)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value
        for batch in chunks(batches, "text", 1 << 20):
            got = [own.score(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, plus(docs, (name, "double")))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Train, and score every document. Rows: doc_id, held_out, score, predicted; one for each row of ``docs``.

    A null doc_id is not held out and never trained on. No documents give no rows.
    """
    rows = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    rows = scored(rows, train(docs, labels), "score")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored ``threshold`` or higher, with the same columns."""
    (name,) = free(docs, "toxicity")
    return scored(docs, train(docs, labels), name).filter(F.col(name) < threshold).drop(name)
