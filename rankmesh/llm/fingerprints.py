"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level. On each level runs of one symbol
become one symbol, deterministic coin tossing gives neighbouring symbols small
distinct labels, and a phrase begins at each local maximum of the labels. A
phrase is named by a hash of its symbols, and the names are the next level's
symbols. Where a phrase begins depends only on a few symbols around it, so equal
substrings get equal phrases but for a margin at either end, whatever their
offset. A fingerprint holds the name of the whole text and the smallest names
of the phrases of two levels (about 9 and 27 characters long), from which the
likeness of two texts is estimated.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmesh.llm.common import partitions, plus, text_or_empty

#: Phrase names kept in a fingerprint, and the levels that they come from.
SKETCH, LEVELS = 64, (2, 3)
ROOT_DIGITS, NAME_DIGITS = 16, 8
#: Code points parsed at once; a longer text is parsed alone.
CHUNK = 1 << 16

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
EMPTY = "0" * ROOT_DIGITS


def _mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers in place."""
    x ^= x >> np.uint64(30)
    x *= _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def _coin_table() -> np.ndarray:
    """label[left * 128 + own]: twice the lowest differing bit's place, plus the own bit there."""
    left, own = np.divmod(np.arange(128 * 128, dtype=np.uint16), np.uint16(128))
    x = left ^ own
    low = (x & (~x + np.uint16(1))).astype(np.uint16)
    place = np.bitwise_count((low - np.uint16(1)) & np.uint16(127)).astype(np.uint16)
    return np.where(x == 0, 0, 2 * place + ((own & low) != 0)).astype(np.uint8)


_COIN = _coin_table()
#: One odd factor for each place in a phrase (labels under 14 have a local maximum at least every 26 places).
_FACTOR = _mix(np.arange(1, 65, dtype=np.uint64) * _A) | np.uint64(1)


def parse(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of ``s``, and which of them begin a text.

    ``first`` marks the symbols that begin a text; no phrase spans two texts.
    """
    n = len(s)
    new = first.copy()
    new[1:] |= s[1:] != s[:-1]
    if not new.all():
        at = np.flatnonzero(new)
        run = np.diff(at, append=n).astype(np.uint64)
        s, first = s[at], first[at]
        long = run > 1
        if s.dtype == np.uint32:  # code points have 21 bits, the run gets the rest
            s[long] |= ((run[long] * _A) >> np.uint64(53)).astype(np.uint32) << np.uint32(21)
        else:
            s[long] = _mix(s[long] + run[long] * _A)
        n = len(s)
    # deterministic coin tossing: names to labels under 128, then under 14
    x = np.empty_like(s)
    x[0] = 1
    np.bitwise_xor(s[1:], s[:-1], out=x[1:])
    x[first] = 1
    one = s.dtype.type(1)
    x &= ~x + one
    label = np.bitwise_count(x - one)
    label = ((label << 1) | ((s & x) != 0)) & 127
    pair = np.empty(n, np.uint16)
    pair[1:] = label[:-1]
    pair[first] = label[first] ^ 1
    pair <<= 7
    pair |= label
    label = _COIN.take(pair)
    cut = first.copy()
    if n > 2:
        cut[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    at = np.flatnonzero(cut)
    size = np.diff(at, append=n)
    place = np.arange(n)
    place -= np.repeat(at, size)
    place &= 63
    v = _FACTOR.take(place)
    v *= s
    name = np.add.reduceat(v, at)
    name ^= size.astype(np.uint64) * _C
    return _mix(name), first[at]


def fingerprints(texts: list[str]) -> list[str]:
    """Hex fingerprints: 16 digits name the whole text, then up to 64 phrase names of 8 digits, ascending.

    An empty text has 16 zeros and no names. Equal texts have equal fingerprints.
    """
    out = [EMPTY] * len(texts)
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    points = np.frombuffer("".join([texts[i] for i in full]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(texts[i]) for i in full])
    first = np.zeros(len(points), bool)
    first[np.cumsum(sizes) - sizes] = True
    s, names, docs = points, [], []
    for level in range(1, max(LEVELS) + 1):
        s, first = parse(s, first)
        if level in LEVELS:
            names.append(s)
            docs.append(np.cumsum(first) - 1)
    # the whole text: its phrases of the last level in order, with its length
    at = np.flatnonzero(first)
    place = np.arange(len(s), dtype=np.uint64) - np.repeat(at.astype(np.uint64), np.diff(at, append=len(s)))
    root = _mix(np.add.reduceat(_mix(s + place * _A), at) ^ sizes.astype(np.uint64) * _C)
    roots = root.astype(">u8").tobytes().hex()
    doc, short = np.concatenate(docs), (np.concatenate(names) >> np.uint64(32)).astype(np.uint32)
    key = np.unique((doc.astype(np.uint64) << np.uint64(32)) | short)  # sorted by text, then by name
    doc, short = (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32)
    begin = np.searchsorted(doc, np.arange(len(full)))
    end = np.minimum(np.append(begin[1:], len(doc)), begin + SKETCH)
    hexed = short.astype(">u4").tobytes().hex()
    for k, i in enumerate(full):
        out[i] = roots[16 * k : 16 * k + 16] + hexed[NAME_DIGITS * begin[k] : NAME_DIGITS * end[k]]
    return out


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints' texts are, 0 to 1: the share of phrases in common (Dice).

    The smallest names of the union are a uniform sample of it; the share j of
    them in both is turned into 2j / (1 + j). Equal fingerprints give 1.
    """
    if a == b:
        return 1.0
    x, y = ({p[i : i + NAME_DIGITS] for i in range(ROOT_DIGITS, len(p), NAME_DIGITS)} for p in (a, b))
    union = sorted(x | y)[:SKETCH]
    if not union:
        return 0.0
    both = x & y
    j = sum(u in both for u in union) / len(union)
    return 2 * j / (1 + j)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint column; null texts count as empty. A column of that name is replaced. Nothing is shuffled."""
    docs = docs.drop(out)
    schema = plus(docs, (out, "string"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            prints = [p for i in range(0, len(texts), 32) for p in fingerprints(texts[i : i + 32])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints)], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def edited_against_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose second half comes from the next document.

    Takes ``doc_id`` and ``text`` of ``docs``; other columns are ignored. The
    next document is the one with the next smaller doc_id; after the smallest
    comes the largest. Null ids count as smaller than any; rows of one id are in
    falling order of a hash of their texts. Null texts count as empty. A lone document is its own
    next. No document gives no row. Rows: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt out by ranges of doc_id, and an id that many rows share, or
    null, by ranges of the hash. The first document of each range
    also goes to the range before it, so that every task sees the next document
    of each of its own; only those few ids (one per range) reach the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n, n_ids, size = docs.agg(F.count("*"), F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = partitions(spark, size, n)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    ranged = _ranged(own, n, n_ids, parts)
    heads = sorted(((r.part, r.top.doc_id, r.top["hash"]) for r in ranged.groupBy("part").agg(F.max(F.struct("doc_id", "hash")).alias("top")).collect()), reverse=True)
    # each range's head is the next document of the range before it; one row per range, so the broadcast is bounded
    after = [(*top, part) for (part, *_), (_, *top) in zip(heads, heads[1:] + heads[:1], strict=True)]
    after = F.broadcast(spark.createDataFrame(after, "top long, of long, before int"))
    extra = ranged.join(after, F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("hash") == F.col("of"))).select("doc_id", "text", "hash", F.col("before").alias("part"), F.lit(True).alias("ghost"))
    rows = ranged.withColumn("ghost", F.lit(False)).unionByName(extra)
    if heads:
        rows = rows.repartitionById(heads[0][0] + 1, "part")
    rows = rows.sortWithinPartitions("ghost", F.desc_nulls_last("doc_id"), F.desc("hash"), "text").drop("hash")
    return rows.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _ranged(docs: DataFrame, n: int, n_ids: int, parts: int) -> DataFrame:
    """``docs`` (doc_id, hash, ...) with part, the number of a row's range by doc_id and hash, in their order: null ids first, then ranges of about as many rows each."""
    cuts = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 20 * parts)).first()[0] or [0]
    # an id that fills several ranges gets them for itself; ids beyond 2^53 aren't told apart well enough for that
    hot = {float(c): k + 1 for c, k in Counter(cuts).items() if k > 1 and abs(c) < 1 << 53}
    splits = [-float("inf"), *sorted({float(c) for c in cuts} | {c + 1 for c in hot}), float("inf")]
    each = [hot.get(x, 1) for x in splits[:-1]]
    # a null id has the number after the last as its bucket
    each.append(max(1, -(-(n - n_ids) * parts // max(n, 1))))
    begins = [sum(each[:k]) + each[-1] for k in range(len(each) - 1)] + [0]
    at = F.col("bucket").cast("int") + 1
    of = [F.element_at(F.array(*map(F.lit, x)), at) for x in (begins, each)]
    sub = F.least(F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * of[1]), of[1] - 1)
    docs = Bucketizer(splits=splits, inputCol="x", outputCol="bucket", handleInvalid="keep").transform(docs.withColumn("x", F.col("doc_id").cast("double")))
    return docs.withColumn("part", (of[0] + sub).cast("int")).drop("x", "bucket")


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part, ghosts last; each row but a ghost is compared with the row after it."""
    held: list[tuple] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        prints = fingerprints([r[1] for r in held])
        mine = [i for i, r in enumerate(held) if not r[3] and (i + 1 < len(held) or last)]
        edited = []
        for i in mine:
            text, half = held[i][1], len(held[i][1]) // 2
            edited.append(text[: len(text) - half] + held[i + 1][1][:half])
        changed = fingerprints(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([held[i][0] for i in mine], pa.int64()),
                pa.array([len(held[i][1]) for i in mine], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
                pa.array([prints[i] for i in mine], pa.string()),
                pa.array(changed, pa.string()),
                pa.array([likeness(prints[i], c) for i, c in zip(mine, changed, strict=True)], pa.float64()),
                pa.array([likeness(prints[i], prints[i + 1]) for i in mine], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    size = 0
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "part", "ghost")), strict=True):
            if row[3] and held and held[-1][3] and held[-1][2] == row[2]:
                continue  # another row of the same id: only the first is the next document
            held.append(row)
            size += len(row[1])
            if size >= CHUNK:
                yield from flush(False)
                del held[:-1]
                size = len(row[1])
    yield from flush(True)
