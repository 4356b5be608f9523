"""Token ids packed into rows of one length by best-fit decreasing.

Texts are encoded by a byte-level BPE vocabulary. Each task packs its documents
in windows of a bounded number of tokens: documents longer than a row are split
into pieces, full rows first, and then pieces in order of falling length each go
to the row with the least room that still takes them, found in a segment tree over
room sizes. No token is lost. Each packed row has its ids as a block of
little-endian numbers, the cumulative lengths of its segments, and the places where
positions start again, as attention kernels and binary datasets want them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmesh.llm.common import chunks
from rankmesh.llm.spm import _Shared

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts text: contractions, letters, digits, other marks and white space.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH, PAD = 2048, 0
#: Tokens packed together: a task holds so many at most, or one longer document.
WINDOW = 1 << 21


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    """A vocabulary of token bytes and their ids, one base64 pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokenizer:
    """Byte-level BPE; ids as little-endian numbers of two bytes where the vocabulary allows."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.type = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), self.type)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode(ids.tolist())


class Rooms:
    """Open rows by the room that they have; a segment tree over room sizes finds the least sufficient one."""

    def __init__(self, most: int):
        self.size = 1 << max(most, 1).bit_length()
        self.some = [0] * (2 * self.size)  # how many open rows are below each node
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.some[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of ``need`` or more; it is no longer open."""
        at = need + self.size
        if not self.some[at]:
            # up to the first ancestor with a filled right sibling, and down its left side
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at <<= 1
                if not self.some[at]:
                    at += 1
        room = at - self.size
        row = self.rows[room].pop()
        self._count(room, -1)
        return room, row


def pack(lengths: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Rows of segments (document, begin, end), best fit in order of falling length.

    Documents longer than ``length`` give full rows and a rest. Empty ones are in
    no row. Of equal lengths the earlier document comes first.
    """
    rows: list[list[tuple[int, int, int]]] = []
    pieces = []
    for doc, n in enumerate(lengths):
        full = n - n % length
        rows += [[(doc, a, a + length)] for a in range(0, full, length)]
        if n > full:
            pieces.append((full - n, doc, full, n))
    rooms = Rooms(length)
    for minus, doc, a, b in sorted(pieces):
        got = rooms.take(-minus)
        if got is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = got
        rows[row].append((doc, a, b))
        if room + minus > 0:
            rooms.add(room + minus, row)
    return rows


@dataclass
class _Window:
    docs: list
    ids: list[np.ndarray]
    tokens: int = 0


SCHEMA = "shard int, row long, ids binary, width int, n_tokens int, doc_ids array<long>, begins array<long>, cu_seqlens array<int>, resets array<int>"


def packed(docs: DataFrame, length: int = LENGTH, ranks: dict[bytes, int] | None = None, pad: int = PAD, window: int = WINDOW) -> DataFrame:
    """Token rows of ``docs`` (doc_id, text); other columns are ignored.

    A row of the result is a packed row: shard (the task) and row (its number
    there), ids (``length`` little-endian numbers of ``width`` bytes, ``pad``
    after the last token), n_tokens, and for its segments in order doc_ids, begins
    (the place of the segment's first token in its document), cu_seqlens (0, then
    the end of each segment) and resets (where positions start again at 0: the
    begin of each segment, and of the padding if there is any). Null and empty
    texts have no tokens and come in no row; null ids stay null. Documents are
    packed where they are read, without a shuffle, so the same files and settings
    give the same rows.
    """
    from pyspark import TaskContext

    shared = _Shared(docs.sparkSession, ranks or load_ranks())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, done = _tokenizer(shared), TaskContext.get().partitionId(), 0

        def out(w: _Window) -> Iterator[pa.RecordBatch]:
            nonlocal done
            rows = pack([len(x) for x in w.ids], length)
            for k in range(0, len(rows), 256):
                part = rows[k : k + 256]
                matrix = np.full((len(part), length), pad, own.type)
                lengths = [[b - a for _, a, b in row] for row in part]
                for line, row in zip(matrix, part, strict=True):
                    got = np.concatenate([w.ids[d][a:b] for d, a, b in row])
                    line[: len(got)] = got
                ends = [np.cumsum(n).tolist() for n in lengths]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard] * len(part), pa.int32()),
                        pa.array(range(done, done + len(part)), pa.int64()),
                        pa.array([line.tobytes() for line in matrix], pa.binary()),
                        pa.array([own.type.itemsize] * len(part), pa.int32()),
                        pa.array([e[-1] for e in ends], pa.int32()),
                        pa.array([[w.docs[d] for d, _, _ in row] for row in part], pa.list_(pa.int64())),
                        pa.array([[a for _, a, _ in row] for row in part], pa.list_(pa.int64())),
                        pa.array([[0, *e] for e in ends], pa.list_(pa.int32())),
                        pa.array([[0, *(e if e[-1] < length else e[:-1])] for e in ends], pa.list_(pa.int32())),
                    ],
                    ["shard", "row", "ids", "width", "n_tokens", "doc_ids", "begins", "cu_seqlens", "resets"],
                )
                done += len(part)

        held = _Window([], [])
        for batch in chunks(batches, "text", 1 << 20):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                ids = own.encode(text)
                if held.tokens and held.tokens + len(ids) > window:
                    yield from out(held)
                    held = _Window([], [])
                held.docs.append(doc)
                held.ids.append(ids)
                held.tokens += len(ids)
        if held.tokens:
            yield from out(held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


_TOKENIZERS: dict[object, Tokenizer] = {}


def _tokenizer(shared: _Shared) -> Tokenizer:
    if shared.id not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[shared.id] = Tokenizer(shared.value)
    return _TOKENIZERS[shared.id]


def write(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, a folder for each shard, in order of row; ``path`` is in a store that all executors reach."""
    rows.write.partitionBy("shard").parquet(path)


def digests(rows: DataFrame) -> DataFrame:
    """Packed rows with the ids' SHA-256 in place of the ids."""
    return rows.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids", "width")


def positions(resets: list[int], length: int) -> np.ndarray:
    """Position of every token of a packed row: it counts up and starts again at each reset."""
    starts = np.array([*resets, length])
    return np.arange(length) - np.repeat(starts[:-1], np.diff(starts))
