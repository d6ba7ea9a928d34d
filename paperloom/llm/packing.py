"""Operator 4: best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so best-fit decreasing depends on their histogram alone: the count
of pieces of each length is at most `capacity` numbers, whatever the corpus. From it the driver plans all bins in
runs of equal ones, with a segment tree over the remaining capacities that finds the tightest open bin in
logarithmic time. A tightest bin stays the tightest until it can take no more of the same length, so a plan
row says: pieces of length L with ranks from a to b go to the bins from s on, q in each. Executors rank the
pieces within their length (pieces are sorted by ranges of length, then a hash, so a hot length fills as many partitions
as it needs, and the partitions' counts give the offsets) and look their place up. The result is that of placing the pieces one by one.

Results in special cases. Null or empty text: one piece with the end token alone. Empty table: no rows. Very long texts: whole; documents
longer than the capacity are cut so that all pieces but the first are full. Special tokens that a text spells out are single tokens, as the library has
them. Repeated rows, equal or null doc_ids: each row is packed like others. Ties: pieces of equal length are ranked by a hash, and of
equally tight bins the one opened or filled last is taken; neither changes how many sequences there are. Extra columns, also of names
used here, are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import file_encoder
from .shared import done_with, partitions, small, stored

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary"


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document's ids (4 bytes each)."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    starts = [0, *range(first, n, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n], strict=True)]


def encode_pieces(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its ids if asked for."""

    def run(batches):
        encoder, tail = file_encoder(path), np.array([end], "<u4").tobytes()
        for batch in small(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text or "") + tail
                for k, (s, n) in enumerate(pieces_of(ids, capacity)):
                    part = ids[4 * s : 4 * (s + n)]
                    rows.append((doc_id, k, s, n, zlib.crc32(part), part if with_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in PIECES.split(", ")])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities 0..n; tightest(x) is the least one of at least x with an open bin."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, runs: int) -> None:
        i = self.size + capacity
        while i:
            self.open[i] += runs
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = self.size + least
        while not self.open[i]:
            while i & 1:  # a right child: what is further right hangs from a parent
                i >>= 1
                if i <= 1:
                    return None
            i += 1  # the sibling on the right
            if i >= 2 * self.size:
                return None
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank + 1, first bin, pieces in a bin, offset in it)."""
    tree, open_bins, plan, bins = CapacityTree(capacity), {}, [], 0

    def put_back(left: int, first: int, count: int) -> None:
        if count and left:
            open_bins.setdefault(left, []).append((first, count))
            tree.add(left, 1)

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            left = tree.tightest(length)
            if left is None:
                left = capacity
                each = capacity // length
                first, count = bins, -(-rest // each)
                bins += count
            else:
                each = left // length
                first, count = open_bins[left].pop()
                tree.add(left, -1)
            used = min(count, -(-rest // each))
            put_back(left, first + used, count - used)
            taken = min(rest, used * each)
            plan.append((length, rank, rank + taken, first, each, capacity - left))
            partial = used * each - taken  # the last bin may lack some
            full = used - (partial > 0)
            put_back(left - each * length, first, full)
            if partial:
                put_back(left - (each - partial) * length, first + full, 1)
            rank, rest = rank + taken, rest - taken
    return plan


def place(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (which must not change when read again) with sequence_id and offset."""
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.repartitionByRange(partitions(pieces.sparkSession), F.col("length"), spread).sortWithinPartitions("length")
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "packing")
    part = F.shiftright("_at", 33).alias("_part")
    # a range of lengths for each partition, so these are at most capacity + partitions small rows
    blocks = dealt.groupBy("length", part).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-blocks")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = np.array(best_fit_plan(counts, capacity), np.int64).reshape(-1, 6)
    top = int(plan[:, 2].max(initial=0)) + 1
    by_length = {length: plan[plan[:, 0] == length] for length in counts}
    ranked = dealt.withColumn("_part", part).join(F.broadcast(blocks.drop("n")), ["length", "_part"])
    ranked = ranked.select(*pieces.columns, (F.col("_at") - F.col("_first") + F.col("_base")).alias("_rank"))
    assert top < 1 << 62
    schema = pieces.selectExpr("*", "0L sequence_id", "0L offset").schema

    def run(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine, rows = np.flatnonzero(length == n), by_length[n]
                row = rows[np.searchsorted(rows[:, 1], rank[mine], side="right") - 1]
                k = rank[mine] - row[:, 1]
                seq[mine] = row[:, 3] + k // row[:, 4]
                at[mine] = row[:, 5] + k % row[:, 4] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(at)], [*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece, with_ids also its ids."""
    pieces = encode_pieces(docs, path, capacity, end, with_ids)
    pieces = stored(pieces if with_ids else pieces.drop("ids"), "pieces")
    out = place(pieces, capacity)  # which has stored them anew
    done_with(pieces)
    return out
