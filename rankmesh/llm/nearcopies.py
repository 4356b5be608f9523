"""Near copies by SimHash and pivot distance tables over the shingles that texts share; an exact count decides.

A text is the set of its runs of five words. Two texts are near copies if their
sets have a Jaccard likeness of 0.8 or more. At exactly that likeness SimHash
fingerprints differ in 15 % of their bits on average, 10 of 64, for which no choice
of blocks is left. So fingerprints are wide: 1,024 bits file a text under tables of
keys, each of some bits of its own, so many tables that two texts at that likeness
share a key with probability 0.9998. Within a key, pivot distance tables over 128
further bits discard pairs that are farther apart than near copies get, and what is
left is verified on them (``simhash.close``). Last, the sets themselves are counted, so that
no link rests on an estimate.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmesh.llm.common import chunks, partitions, scratch, text_or_empty, words_of, written
from rankmesh.llm.components import components
from rankmesh.llm.simhash import SEED, apart, close, first_of_groups, row_key, wide

SHINGLE, LIKENESS = 5, 0.8
#: Words of a fingerprint that keys are drawn from; the others are compared within a key.
KEYED = 16
#: Bits of a key at least, and how many texts share one by chance otherwise (as a power of 2).
LEAST_BITS, CROWD_BITS = 13, 5
#: Two texts at just the likeness asked for share no key with this probability.
MISS = 2e-4
#: Standard deviations that near copies' distances are given above what is expected, within a key and over the wide fingerprint.
SPARE, WIDE_SPARE = 5, 8
#: Texts that meet in a task, of either side. Keys of more are dealt out in chunks.
SPAN = 2048
#: Rows that are looked at together.
ROWS = 1 << 16
#: Keys that are broadcast, in rows.
KEYS = 100_000
#: Sets of shingles that are broadcast, in bytes.
BROADCAST = 32 << 20


def differing(likeness: float) -> float:
    """The share of bits in which two fingerprints at this likeness differ, at most on average (for sets that aren't very small)."""
    return math.acos(2 * likeness / (1 + likeness)) / math.pi


def radius(bits: int, likeness: float, spare: float) -> int:
    """Differing bits that near copies don't exceed, but for chance (``spare`` standard deviations)."""
    p = differing(likeness)
    return math.ceil(bits * p + spare * math.sqrt(bits * p * (1 - p)))


def tables(n: int, likeness: float = LIKENESS) -> tuple[int, int]:
    """For ``n`` texts: bits of a key, and the number of tables."""
    bits = max(LEAST_BITS, n.bit_length() - CROWD_BITS)
    return bits, math.ceil(math.log(MISS) / math.log1p(-((1 - differing(likeness)) ** bits)))


@cache
def choices(bits: int, number: int) -> np.ndarray:
    """(number, bits): the places of each table's bits. No bit is drawn anew before all are."""
    rng, each = np.random.default_rng(5), 64 * KEYED // bits
    rounds = [rng.permutation(64 * KEYED)[: each * bits].reshape(each, bits) for _ in range(-(-number // each))]
    return np.concatenate(rounds)[:number]


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """The different runs of ``n`` words as sorted XXH64. No words: none. Fewer than n: one run of all."""
    words, digest = words_of(text), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(n)))], np.uint64))


def _signed(raw: bytes, seed: int = SEED) -> int:
    h = xxhash.xxh64_intdigest(raw, seed)
    return h - (1 << 64) if h >> 63 else h


def _keyed(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, key, fp: a hash of the set of shingles, size: how many, print: its wide fingerprint). A null text counts as empty; it has fp 0 and no print."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            sets = [shingles(t, n) for t in batch.column(2).to_pylist()]
            fps = pa.array([_signed(s.tobytes()) if len(s) else 0 for s in sets], pa.int64())
            prints = pa.array([wide(s).tobytes() if len(s) else None for s in sets], pa.binary())
            sizes = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, sizes, prints], ["doc_id", "key", "fp", "size", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long, size int, print binary")


def _words(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), "<u8").reshape(len(prints), -1)


def _filed(nodes: DataFrame, bits: int, number: int) -> DataFrame:
    """Rows (fp, print) to (band, fp, p0, p1), one for each table; p0 and p1 are the bits that are compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, powers = choices(bits, number), 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _words(batch.column(1).to_pylist())
            flat = np.unpackbits(np.ascontiguousarray(words[:, :KEYED]).view(np.uint8), axis=1)
            values = (flat[:, places.ravel()].reshape(len(words), number, bits) * powers).sum(-1) + (np.arange(number) << 40)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * number, pa.int32()), pa.array(values.ravel(), pa.int64()))
            rest = [pa.array(np.ascontiguousarray(words[:, KEYED + k]).view(np.int64)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest, bands], ["fp", "p0", "p1", "bands"])

    return nodes.select("fp", "print").mapInArrow(run, "fp long, p0 long, p1 long, bands array<long>").select(F.explode("bands").alias("band"), "fp", "p0", "p1")


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows the first row that the pairs (i, j) connect it with."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        left = label[i] != label[j]
        i, j = i[left], j[left]
    while (label[label] != label).any():
        label = label[label]
    return label


def _candidates(distance: int, span: int):
    """Rows (band, fp, p0, p1) sorted by band and fp to links (null, a, b), which connect all that chains of pairs at ``distance`` in a band connect.

    Bands of more than ``span`` texts aren't held: their texts come out as (band, fp, null), and are linked to the first where that is near.
    """

    def settle(x: list[np.ndarray], lead: tuple | None) -> Iterator[pa.RecordBatch]:
        band, fp, *p = x
        prints = np.stack(p, axis=1).view(np.uint64)
        first, size = np.searchsorted(band, band), np.searchsorted(band, band, side="right") - np.searchsorted(band, band)
        large = size > span
        if lead is not None:
            large |= band == lead[0]
        at = np.flatnonzero(~large)
        label = at[connected(len(at), *close(band[at], prints[at], distance))]
        of, own = fp[label], fp[at]
        out = [(np.zeros(0, np.int64), of[label != at], own[label != at])]
        at = np.flatnonzero(large)
        if len(at):
            base, low = prints[first[at]], fp[first[at]]
            if lead is not None:
                same = band[at] == lead[0]
                base[same], low[same] = lead[2], lead[1]
            near_ = (apart(prints[at], base) <= distance) & (fp[at] != low)
            out.append((np.zeros(0, np.int64), low[near_], fp[at][near_]))
            yield pa.RecordBatch.from_arrays([pa.array(band[at]), pa.array(fp[at]), pa.nulls(len(at), pa.int64())], ["band", "a", "b"])
        for _, a, b in out:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], ["band", "a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, lead = 0, None  # the first text of a large band that goes on
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                count += batch.num_rows
            if count < max(ROWS, 2 * span):
                continue
            x = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(x[0], x[0][-1]))
            if count - cut > span:  # the last band is large already
                ahead = lead if lead is not None and lead[0] == x[0][-1] else (x[0][cut], x[1][cut], np.array([x[2][cut], x[3][cut]]).view(np.uint64))
                yield from settle(x, lead)
                held, count, lead = [], 0, ahead
            else:
                yield from settle([c[:cut] for c in x], lead)
                lead = lead if lead is not None and lead[0] == x[0][-1] else None
                held, count = [[c[cut:] for c in x]], count - cut
        if count:
            yield from settle([np.concatenate(c) for c in zip(*held, strict=True)], lead)

    return run


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """Rows (fp, text) to (fp, own: the set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, n).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["fp", "own"])

    return texts.mapInArrow(run, "fp long, own binary")


def alike(prints: np.ndarray, sizes: np.ndarray, label: np.ndarray, i: int, likeness: float) -> np.ndarray:
    """Places after ``i`` of sets with another label that may be near copies, by their sizes and fingerprints."""
    j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
    j = j[np.minimum(sizes[j], sizes[i]) >= likeness * np.maximum(sizes[j], sizes[i]) - 1e-9]
    most = radius(64 * prints.shape[1], likeness, WIDE_SPARE)
    # few at a time, as there may be very many
    return np.concatenate([j[k : k + 4096][apart(prints[j[k : k + 4096]], prints[i]) <= most] for k in range(0, len(j), 4096)] or [j])


def near(prints: np.ndarray, sets: list[np.ndarray], likeness: float = LIKENESS, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect all that chains of near copies connect; each is itself a pair of near copies. What has one ``label`` is connected already."""
    label = np.arange(len(sets)) if label is None else np.unique(label, return_inverse=True)[1]
    sizes, out = np.array([len(s) for s in sets]), []
    for i in range(len(sets) - 1):
        joined: set[int] = set()
        for o in alike(prints, sizes, label, i, likeness).tolist():
            if label[o] not in joined and jaccard(sets[i], sets[o]) >= likeness - 1e-9:
                joined.add(int(label[o]))
                out.append((i, o))
        if joined:
            label[np.isin(label, list(joined))] = label[i]
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _by_band(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, tuple]]]:
    """Rows (band, fp, ...) sorted by band: each band with what its texts have, each text once."""
    held: dict[int, tuple] = {}
    at = None
    for batch in batches:
        for band, fp, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if band != at:
                if len(held) > 1:
                    yield at, held
                held, at = {}, band
            held[fp] = tuple(rest)
    if len(held) > 1:
        yield at, held


def _meeting(likeness: float):
    """Rows (band, fp, label, size, print) sorted by band to those (band, fp, label) that may be a near copy of another label's."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for band, held in _by_band(batches):
            labels, sizes, raw = zip(*held.values(), strict=True)
            prints, sizes, label = _words(raw), np.array(sizes), np.array(labels)
            some = np.zeros(len(label), bool)
            for i in range(len(label) - 1):
                j = alike(prints, sizes, label, i, likeness)
                some[j] = True
                some[i] |= len(j) > 0
            at = np.flatnonzero(some)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([band] * len(at), pa.int64()), pa.array(np.array(list(held), np.int64)[at]), pa.array(label[at], pa.int64())], ["band", "fp", "label"])

    return run


def _link(likeness: float):
    """Rows (band, fp, label, print, own) sorted by band to links (a, b)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_band(batches):
            fps, (labels, prints, raw) = list(held), zip(*held.values(), strict=True)
            found = near(_words(prints), [np.frombuffer(r, np.uint64) for r in raw], likeness, np.array(labels))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([fps[p[k]] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _stars(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of links (a, b) with a < b: the one with the smallest a of each b, and links (a, b) that connect what all of them connect.

    A text has a link for each table in which it shares a key, and those of a group
    of near copies are mostly to the same few texts. So all but the smallest a of a b
    move from b to that smallest a, where they repeat; what is left is one link for
    each b and the different ones that moved. A b has one a for each table at most.
    """
    stars = found.filter("b is not null").groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("all"))
    stars = written(stars, "stars")
    firsts = stars.select("a", "b")
    moved = stars.filter(F.size("all") > 1).select("a", F.explode("all").alias("b")).filter("b > a")
    return firsts, written(firsts.unionByName(moved).distinct(), "coarse")


def _few(keys: DataFrame) -> DataFrame:
    """Marked for broadcast where there are few: a key with very many texts isn't dealt to one task then."""
    return F.broadcast(keys) if keys.limit(KEYS + 1).count() <= KEYS else keys


def _compared(pairs: DataFrame, sets: DataFrame, each: float, likeness: float) -> DataFrame:
    """Those of the links (a, b) whose texts are near copies; each b is there once."""
    of = sets.select(F.col("fp").alias("a"), F.col("own").alias("other")).join(pairs.select("a").distinct(), "a")
    if pairs.agg(F.countDistinct("a")).first()[0] * each <= BROADCAST:
        of = F.broadcast(of)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            yes = pa.array([jaccard(x, y) >= likeness - 1e-9 for x, y in zip(own, other, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(yes) for k in (0, 1)], ["a", "b"])

    return pairs.join(sets.select(F.col("fp").alias("b"), "own"), "b").join(of, "a").select("a", "b", "own", "other").mapInArrow(compare, "a long, b long")


def _dealt(members: DataFrame, span: int) -> DataFrame:
    """Bands (band, fp, label) of any size as (band, fp, label) of 2 * span texts or about: every two texts of a band that have different labels meet.

    The texts of a band's largest label needn't meet one another. They, and the
    others, are dealt out to chunks; the others' chunks meet one another and
    each chunk of the largest label's. Bands whose texts all have one label go.
    """
    counts = members.groupBy("band", "label").agg(F.count("*").alias("n"))
    bands = counts.groupBy("band").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).filter("labels > 1")
    split = F.col("n") > span
    bands = written(bands, "bands").select("band", F.when(split, F.col("most.label")).alias("largest"), F.when(split, F.ceil(F.col("most.n") / span)).otherwise(0).cast("int").alias("chunks"), F.when(split, F.ceil((F.col("n") - F.col("most.n")) / span)).otherwise(1).cast("int").alias("others"))
    rows = members.join(_few(bands), "band")
    own = F.coalesce(F.col("label") == F.col("largest"), F.lit(False))
    rows = rows.withColumn("own", own).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.when(own, F.col("chunks")).otherwise(F.col("others"))).cast("int"))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("x"), F.greatest(k, F.col("chunk")).alias("y"), F.lit(False).alias("z")))
    with_ = F.when(F.col("chunks") > 0, F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.col("chunk").alias("x"), k.alias("y"), F.lit(True).alias("z")))).otherwise(F.array().cast("array<struct<x:int,y:int,z:boolean>>"))
    theirs = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda k: F.struct(k.alias("x"), F.col("chunk").alias("y"), F.lit(True).alias("z")))
    rows = rows.withColumn("meet", F.explode(F.when(F.col("own"), theirs).otherwise(F.concat(among, with_))))
    return rows.select(F.xxhash64("band", "meet").alias("band"), "fp", "label")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` (band, fp) with the label of what ``found`` (a, b) connects."""
    parts = written(components(found), "parts").withColumnRenamed("node", "fp")
    return members.join(parts, "fp", "left").select("band", "fp", F.coalesce("component", "fp").alias("label"))


def _banded(rows: DataFrame, size: int, *then: str) -> DataFrame:
    """``rows`` dealt out by band and sorted by it."""
    return rows.repartition(partitions(rows.sparkSession, size), "band").sortWithinPartitions("band", *then)


def links(docs: DataFrame, rows: DataFrame, n: int = SHINGLE, likeness: float = LIKENESS, span: int = SPAN) -> DataFrame:
    """Links (a, b) between the fps of ``rows`` (as ``_keyed`` gives them) that connect what chains of near copies connect.

    Every different set is filed under a key in each table. What pivot distance
    tables leave of a key's pairs makes coarse groups. Each text of a group is
    compared with one of it first; after that only texts of different labels
    meet, in chunks, so that no task meets more than a bounded number of texts. Only
    texts of coarse groups are read again.
    """
    spark = docs.sparkSession
    nodes = rows.filter("print is not null").dropDuplicates(["fp"]).select("fp", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("key").alias("_key"), "size", "print")
    nodes = written(nodes, "nodes")
    count = nodes.count()
    bits, number = tables(count, likeness)
    filed = _banded(_filed(nodes, bits, number), 40 * number * count, "fp")
    found = written(filed.mapInArrow(_candidates(radius(128, likeness, SPARE), span), "band long, a long, b long"), "candidates")
    firsts, coarse = _stars(found)

    # rows with one id and one text are one text
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), row_key().alias("_key"), text_or_empty().alias("text")).dropDuplicates(["_id", "_key"])

    def sets_of(fps: DataFrame) -> DataFrame:
        wanted = nodes.select("fp", "_id", "_key").join(fps.distinct(), "fp")
        return written(_sets(texts.join(wanted, ["_id", "_key"]).select("fp", "text"), n), "sets")

    sets = sets_of(firsts.select(F.explode(F.array("a", "b")).alias("fp")))
    each = sets.agg(F.avg(F.length("own"))).first()[0] or 0.0
    same = written(_compared(firsts, sets, each, likeness), "first-links")

    groups = components(coarse).select(F.col("component").alias("band"), F.col("node").alias("fp"))
    members = groups.unionByName(found.filter("b is null").select("band", F.col("a").alias("fp")))
    dealt = written(_dealt(written(_labelled(members, same), "labelled"), span), "dealt")
    prints = nodes.select("fp", "size", "print")
    met = prints.join(dealt, "fp").select("band", "fp", "label", "size", "print")
    met = written(_banded(met, 200 * dealt.count()).mapInArrow(_meeting(likeness), "band long, fp long, label long"), "meeting")
    more = met.select("fp").distinct().join(sets.select("fp"), "fp", "left_anti")
    if not more.isEmpty():
        sets = sets.unionByName(sets_of(more))
    whole = met.join(sets, "fp").join(prints, "fp").select("band", "fp", "label", "print", "own")
    last = _banded(whole, int((each + 200) * met.count())).mapInArrow(_link(likeness), "a long, b long")
    return same.unionByName(last).distinct()


def one_of_each(docs: DataFrame, n: int = SHINGLE, likeness: float = LIKENESS, span: int = SPAN) -> DataFrame:
    """``docs`` with one document of each set that chains of near copies connect, and the same columns.

    Near copies have a Jaccard likeness of ``likeness`` or more over runs of ``n``
    words. Which one stays is as in ``simhash.one_of_each``. Texts without words
    are copies of one another.
    """
    rows = written(_keyed(docs, n), "keyed")
    with scratch(docs.sparkSession):
        parts = written(components(links(docs, rows, n, likeness, span)), "components", keep=True).withColumnRenamed("node", "fp")
    return first_of_groups(docs, rows.select("doc_id", "key", "fp"), parts)
