"""Best-two-fit packing of token sequences, planned on the histogram of lengths.

Documents are encoded once; only those longer than a sequence are cut, the remainder first, so that all later pieces
fill a sequence. What is left to pack is known by its length alone, of which there are at most `capacity` values: the
plan works on counts, not on documents, and its size doesn't grow with the corpus. A bin is filled greedily, the
longest length that fits first; then its smallest document is put back if two unpacked ones fill the gap that this
leaves more tightly. The finished pattern is used as often as the counts allow, so every pattern uses up a length.

Null text counts as empty: its only token is the end mark. Repeated rows are packed as often as they occur. An empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.bpe import codec
from quillon.llm.common import bounded_batches, materialize, number_within

CAPACITY, END = 1024, 2
#: Rows of one numbering task.
PER_CHUNK = 100_000


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece, and salt (a hash to deal by)."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            src, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array(c.encode(text or "") + [end], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    src.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(src, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class Pool:
    """Unpacked documents by length."""

    def __init__(self, counts: dict[int, int]):
        self.n = dict(counts)
        self.lengths = sorted(x for x, n in counts.items() if n)

    def take(self, x: int) -> None:
        self.n[x] -= 1
        if not self.n[x]:
            self.lengths.remove(x)

    def put(self, x: int) -> None:
        if not self.n.get(x):
            self.lengths.insert(bisect_right(self.lengths, x), x)
        self.n[x] = self.n.get(x, 0) + 1

    def best(self, gap: int) -> int:
        """The longest that fits, or 0."""
        i = bisect_right(self.lengths, gap)
        return self.lengths[i - 1] if i else 0

    def best_two(self, gap: int) -> tuple[int, int]:
        """The two that together fill the gap best, or zeros."""
        lo, hi, found = 0, bisect_right(self.lengths, gap) - 1, (0, 0)
        while lo <= hi:
            a, b = self.lengths[lo], self.lengths[hi]
            if a + b > gap or lo == hi and self.n[a] < 2:
                hi -= 1
            else:
                if a + b > sum(found):
                    found = (b, a)
                if a + b == gap:
                    break
                lo += 1
        return found


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins), for documents of at most `capacity`."""
    pool, out = Pool(counts), []
    while pool.lengths:
        bin_, gap = [], capacity
        while x := pool.best(gap):
            pool.take(x)
            bin_.append(x)
            gap -= x
        while gap and len(bin_) > 1:
            small = bin_[-1]
            two = pool.best_two(gap + small)
            if sum(two) <= small:
                break
            for x in two:
                pool.take(x)
            pool.put(bin_.pop())
            bin_ = sorted([*bin_, *two], reverse=True)
            gap += small - sum(two)
        need = {x: bin_.count(x) for x in bin_}
        more = min(pool.n[x] // k for x, k in need.items())
        for x, k in need.items():
            if more:
                pool.n[x] -= more * k
                if not pool.n[x]:
                    pool.lengths.remove(x)
        out.append((bin_, more + 1))
    return out


def placements(bins: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the runs of its ranks: first rank, first sequence, how many a sequence has, offset of the first."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in bins:
        for x in sorted(set(lengths), reverse=True):
            k = lengths.count(x)
            found.setdefault(x, []).append((used.get(x, 0), sequence, k, sum(y for y in lengths if y > x)))
            used[x] = used.get(x, 0) + k * times
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*runs)) for x, runs in found.items()}


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(df, path, capacity, end), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    runs = placements(plan(counts, capacity))
    ranked = number_within(cut, ["length"], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], F.xxhash64("doc_id", "piece"), PER_CHUNK, "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(length):
                at = length == x
                first, base, k, off = runs[int(x)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                inside = rank[at] - first[i]
                sequence[at], offset[at] = base[i] + inside // k[i], off[i] + inside % k[i] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
