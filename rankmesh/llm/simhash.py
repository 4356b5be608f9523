"""SimHash near-duplicates by pivot distance tables.

Every different fingerprint is filed under parts of its bits: of b blocks, two
fingerprints at 3 or fewer differing bits agree in b - 3 at least, so that each
choice of b - 3 blocks makes a table in which some shared key brings them
together. Within a key, a table of Hamming distances to reference fingerprints
discards pairs: by the triangle inequality, the distances of near fingerprints to
a reference differ by 3 at most. The first distance is sorted, so that only a
window of it is looked at; what the largest difference leaves is verified.

The distances alone can't bring pairs together in sublinear time: to any one
reference, 46 of 100 pairs of unrelated 64-bit fingerprints differ by 3 or less.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmesh.llm.common import chunks, columns, free, partitions, scratch, text_or_empty, words_of, written
from rankmesh.llm.components import components, lowest

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Reference fingerprints: drawn once from a fixed seed.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 24, dtype=np.uint64)
#: A key with more fingerprints is left to a finer filing, in which keys have more bits.
CROWD = 2048
#: Blocks of the second filing, and of the bits that a key of it leaves in the third.
FINE, FINEST = 9, 6
#: Pairs looked at together.
PAIRS = 1 << 18


def simhashes(texts: list[str], n: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if over half the shingles' XXH64 have it. No words: 0. Fewer than n: one shingle."""
    hashes: list[int] = []
    ends: list[int] = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = words_of(text)
        if 0 < len(words) <= n:
            hashes.append(digest(b" ".join(words), SEED))
        elif words:
            hashes += [digest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(n)))]
        ends.append(len(hashes))
    out, ends = np.zeros(len(texts), np.uint64), np.array(ends, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = np.flatnonzero(ends > begins)
    if len(full):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, begins[full], axis=0, dtype=np.int64)
        most = 2 * counts > (ends - begins)[full, None]
        out[full] = np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


#: What each word of a wide fingerprint adds to a shingle's hash before it is mixed.
_ADDED = np.arange(1, 19, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide(hashes: np.ndarray) -> np.ndarray:
    """A fingerprint of ``len(_ADDED)`` words of 64 bits from shingles' hashes (uint64, one at least): a bit is 1 if over half of them have it."""
    counts = np.zeros(64 * len(_ADDED), np.int64)
    for k in range(0, len(hashes), 255):  # so that a byte holds the counts
        x = hashes[k : k + 255, None] + _ADDED
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(times)
        x ^= x >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view("<u8")


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of several words, row by row."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int32)


def close(group: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of one group at ``distance`` or fewer differing bits; rows are sorted by ``group``, ``prints`` has some words of each.

    By tables of distances to reference fingerprints, many groups at once. At large
    distances references drawn at random discard nothing, so they are the group's own:
    its first fingerprint, by which it is sorted, and the one farthest from that.
    """
    n = len(group)
    first = np.searchsorted(group, group)
    table = apart(prints, prints[first])
    order = np.lexsort((table, group))
    own, table, group = prints[order], table[order], group[order]
    last = np.searchsorted(group, group, side="right") - 1
    other = apart(own, own[last])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    i, step = np.arange(n), 0
    while len(i):
        step += 1
        i = i[i + step <= last[i]]
        i = i[table[i + step] - table[i] <= distance]
        j = i + step
        keep = np.abs(other[i] - other[j]) <= distance
        x, y = i[keep], j[keep]
        keep = apart(own[x], own[y]) <= distance
        found.append((order[x[keep]], order[y[keep]]))
    return tuple(np.concatenate([p[k] for p in found] or [np.zeros(0, np.int64)]) for k in (0, 1))


def row_key() -> Column:
    """What tells rows of one doc_id apart: a hash of the text, and whether the id is null."""
    return F.xxhash64(F.col("doc_id").isNull(), "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, fp: the fingerprint as a signed long). A null text counts as empty."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 18):
            prints = simhashes(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """The bits of every choice of ``blocks - distance`` of the blocks, as signed longs."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(parts, blocks - distance))]


def finest(mask: int, distance: int = DISTANCE) -> list[int]:
    """``mask`` (a signed long) with every choice of ``FINEST - distance`` of the blocks of its other bits."""
    rest = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(rest) * k // FINEST for k in range(FINEST + 1)]
    parts = [sum(1 << b for b in rest[x:y]) for x, y in zip(cuts, cuts[1:])]
    every = (mask % (1 << 64) | sum(c) for c in combinations(parts, FINEST - distance))
    return [m - (1 << 64) if m >> 63 else m for m in every]


def near(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect all of ``fps`` (uint64, all different) that chains of near fingerprints connect: places (i, j).

    Every near pair is found; of pairs within one connected set, a spanning tree is returned.
    """
    table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    table, own = table[order], fps[order]
    ends = np.searchsorted(table[:, 0], table[:, 0] + distance, side="right")
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out, widths = [], ends - np.arange(len(fps)) - 1
    begin = 0
    while begin < len(fps):
        end = begin + max(1, int(np.searchsorted(np.cumsum(widths[begin:]), PAIRS, side="right")))
        w = widths[begin:end]
        i = np.repeat(np.arange(begin, begin + len(w)), w)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w)
        for k in range(1, len(PIVOTS)):
            if not len(i):
                break
            keep = np.abs(table[i, k] - table[j, k]) <= distance
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(own[i] ^ own[j]) <= distance
        i, j = order[i[keep]], order[j[keep]]
        label = np.array([find(x) for x in range(len(fps))])  # pairs that are connected already needn't be looked at
        keep = label[i] != label[j]
        for a, b in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            if (x := find(a)) != (y := find(b)):
                root[x] = y
                out.append((a, b))
        begin = end
    return out


def _link(last: bool, crowd: int = CROWD):
    """Rows sorted by (mask, key) to links (a, b, null); fingerprints of a crowded key come out as (fp, null, mask) unless this is the last filing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the fingerprints of the key at hand, which may go on
        count, at, full = 0, None, False

        def settle() -> list[tuple[int, int | None, int | None]]:
            fps = np.concatenate(held) if len(held) != 1 else held[0]
            if full:
                return [(x, None, int(at[0])) for x in fps.tolist()]
            return [(int(fps[i]), int(fps[j]), None) for i, j in near(fps.view(np.uint64))] if len(fps) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            out: list[tuple[int, int | None, int | None]] = []
            spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True))
            for x, y in spans:
                if (mask[x], key[x]) != at:
                    if count > 1:
                        out += settle()
                    held, count, at, full = [], 0, (mask[x], key[x]), False
                held.append(fp[x:y])
                count += y - x
                if full or not last and count > crowd:
                    full = True
                    out += settle()
                    held = [fp[:0]]
            if out:
                yield _links(out)
        if count > 1 and (out := settle()):
            yield _links(out)

    return run


def _links(rows: list[tuple[int, int | None, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["a", "b", "mask"])


def _filed(prints: DataFrame, n: int, last: bool, crowd: int) -> DataFrame:
    """Rows (fp, mask) to links; there are ``n`` of them, or about."""
    rows = prints.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    rows = rows.repartition(partitions(prints.sparkSession, 24 * n, n), "mask", "key").sortWithinPartitions("mask", "key")
    return rows.mapInArrow(_link(last, crowd), "a long, b long, mask long")


def _under(prints: DataFrame, masks: list[int]) -> DataFrame:
    return prints.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect whatever chains of near fingerprints connect; ``prints`` has one row (fp) for each.

    The number of blocks follows the number of fingerprints, so that unrelated
    ones seldom share a key. The fingerprints of a key that is crowded all the
    same are filed again under keys of 42 bits or more, and those of keys that
    are crowded still under 52 or more, of which there are 4,096 different ones
    at most for a key: no task meets more, and nothing is left out.
    """
    n = max(prints.count(), 2)
    own = masks(next((b for b, most in ((4, 13), (5, 21), (6, 28)) if n <= 1 << most), 7))
    found = written(_filed(_under(prints, own), n * len(own), False, crowd), "links")
    out = found.filter("b is not null")
    crowded = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if n := crowded.count():
        own = masks(FINE)
        found = written(_filed(_under(crowded, own), n * len(own), False, crowd), "links")
        out = out.unionByName(found.filter("b is not null"))
        crowded = found.filter("b is null").select(F.col("a").alias("fp"), F.col("mask").alias("of"))
        if n := crowded.count():
            table = [(m, x) for m in own for x in finest(m)]
            # a fixed number of rows, whatever the input
            finer = F.broadcast(prints.sparkSession.createDataFrame(table, "of long, mask long"))
            out = out.unionByName(_filed(crowded.join(finer, "of").select("fp", "mask").distinct(), n * len(table) // len(own), True, crowd))
    return out.select("a", "b").distinct()


def groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``docs``.

    Takes ``doc_id`` and ``text``; other columns are ignored. component_id is the
    smallest doc_id in the set of rows that chains of fingerprints at 3 or fewer
    differing bits connect; null ids don't count, and a set of nulls alone has
    null. A null or empty text has the fingerprint 0 and is linked like any other.
    Repeated rows and ids stay. No rows give none.
    """
    rows = written(fingerprinted(docs), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    parts = _parts(classes, crowd)
    own = classes.join(parts, "fp")
    lows = own.join(lowest(own, "component", "low", "component_id"), "component").select("fp", "component_id")
    # written, so that both sides of the next join come straight from a shuffle and a crowded fingerprint can be split
    of = written(classes.join(lows, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "groups")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _parts(prints: DataFrame, crowd: int) -> DataFrame:
    """Rows (fp, component) of those of the different fingerprints ``prints`` that are linked."""
    with scratch(prints.sparkSession):
        return written(components(links(prints.select("fp"), crowd)), "components", keep=True).withColumnRenamed("node", "fp")


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one document of each group of near copies, and the same columns.

    The one with the smallest doc_id stays, null ids coming last; of several
    rows with that id the one with the smallest text hash, and of rows that
    agree in both any single one. Whole rows are shuffled once.
    """
    rows = written(fingerprinted(docs), "fingerprints")
    return first_of_groups(docs, rows, _parts(rows.select("fp").distinct(), crowd))


def first_of_groups(docs: DataFrame, rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``docs`` with the first document of each group: ``rows`` (doc_id, key, fp) of one component in ``parts`` (fp, component), or else of one fp."""
    group = F.coalesce("component", "fp")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "key")
    kept = rows.join(parts, "fp", "left").groupBy(group.alias("group")).agg(F.min(rank).alias("first"))
    names = free(docs, "id", "key")
    kept = kept.select(*[F.col(f"first.{c}").alias(n) for c, n in zip(("id", "key"), names, strict=True)])
    own = docs.select(*columns(docs), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(names[0]), row_key().alias(names[1]))
    return own.join(kept, names).dropDuplicates(names).select(*columns(docs))
