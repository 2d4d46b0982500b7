"""Best-fit-decreasing packing of token sequences.

Pieces are no longer than a sequence, so all that best-fit decreasing needs is
how many pieces there are of each length: at most ``capacity`` numbers, however
large the corpus. From these the driver runs the global best-fit decreasing on
groups of equal bins; a segment tree over remaining capacities finds the
tightest open bin in logarithmic time. The result is a list of bin patterns.
Pieces then find their place by their rank among those of equal length: counted
in slices, summed over slices in groups and over groups, so no length is
gathered in one task; a binary search among the length's bins gives the place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .common import shuffle_partitions, staged
from .tokens import batched, encoder, vocabulary

CAPACITY = 2048
END = 0
#: Pieces of one length that a slice holds at most, on average.
SLICE = 1 << 18
#: Slices in a group of the prefix sum; bits of a rank.
GROUP = 256
RANKS = 50


class Capacities:
    """A segment tree over remaining capacities: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = bytearray(2 * self.size)

    def set(self, at: int, open_: bool) -> None:
        i = at + self.size
        self.tree[i] = open_
        while i > 1:
            i >>= 1
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of at least ``least``."""
        i = least + self.size
        if self.tree[i]:
            return least
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (lengths in order of placing) and how many bins have each.

    The same bins as best-fit decreasing makes piece by piece: a bin with the
    least remaining capacity that fits is as good as any other with that same
    capacity, so equal ones are filled together.
    """
    tree = Capacities(capacity)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        left = counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                each = capacity // length
                full, rest = divmod(left, each)
                new = [((length,) * each, full)] if full else []
                new += [((length,) * rest, 1)] if rest else []
                for p, n in new:
                    r = capacity - length * len(p)
                    open_.setdefault(r, []).append((p, n))
                    tree.set(r, True)
                break
            # a bin that took a piece is the tightest for the next, while it fits
            pattern, n = open_[room].pop()
            each = room // length
            used, rest = divmod(left, each)
            grown = [(each, min(n, used))] if used else []
            if rest and used < n:
                grown.append((rest, 1))
            spare = n - sum(k for _, k in grown)
            if spare:
                open_[room].append((pattern, spare))
            elif not open_[room]:
                tree.set(room, False)
            for k, m in grown:
                open_.setdefault(room - k * length, []).append((pattern + (length,) * k, m))
                tree.set(room - k * length, True)
                left -= k * m
    merged: dict[tuple[int, ...], int] = {}
    for group in open_.values():
        for p, n in group:
            merged[p] = merged.get(p, 0) + n
    return sorted(merged.items())


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """``length, first, n, base, offset`` by length and first: pieces of a length
    from rank ``first`` on go to ``n`` sequences from ``base`` on, in turn, at
    ``offset`` and then after each other.

    Packing a length leaves two more groups of equal bins than before at most,
    and a bin of 2,048 holds 63 different lengths at most: so 4,096 groups and
    258,048 slots (10 MB) are the bound, whatever the corpus holds."""
    out, base, seen = [], 0, {}
    for pattern, n in patterns:
        offset = 0
        for length, same in groupby(pattern):
            k, first = len(list(same)), seen.get(length, 0)
            out.append((length, first, n, base, offset))
            seen[length] = first + n * k
            offset += k * length
        base += n
    return np.array(sorted(out) or [(0, 0, 1, 0, 0)], np.int64)


def _before(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _schema(with_ids: bool) -> str:
    return "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    vocab = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocab, special=True), np.array([END], "<u4").tobytes()
        for b in batches:
            names, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for s in batched(texts):
                rows = []
                for doc, data in zip(names[s], encode(texts[s]), strict=True):
                    data += end
                    n = len(data) // 4
                    at, k = 0, 0
                    size = n if n <= capacity else n % capacity or capacity
                    while at < n:
                        part = data[4 * at : 4 * (at + size)]
                        rows.append((doc, k, at, size, zlib.crc32(part), part if with_ids else None))
                        at, k, size = at + size, k + 1, capacity
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                cut = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                    cut.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=cut)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _schema(with_ids))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id,
    offset`` (and ``ids``).

    A document is its ids and a closing 0; null and empty texts are the 0 alone.
    Ids have to be integers (or null). Documents longer than ``capacity`` are cut into pieces of that length, the
    first of which may be shorter; no piece is dropped. Pieces of one length are
    alike to the packing, so ties, repeated rows and null ids change nothing.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    parts = staged(pieces(docs, id_col, text_col, capacity, vocab, with_ids).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "op4-pieces")
    # rank among equal lengths: inside a slice of rows, plus what earlier slices hold
    slices = max(16 * shuffle_partitions(spark), -(-parts.count() // SLICE))
    part = F.pmod(F.xxhash64("_row"), F.lit(slices))
    cells = parts.select("_row", "length", part.alias("_slice"))
    counts = staged(cells.groupBy("length", "_slice").agg(F.count("*").alias("n")), "op4-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(best_fit(histogram, capacity))
    counts = counts.withColumn("_group", F.floor(F.col("_slice") / GROUP))
    of_groups = counts.groupBy(F.col("length").alias("gl"), F.col("_group").alias("gg")).agg(F.sum("n").alias("gn"))
    of_groups = of_groups.withColumn("earlier", F.coalesce(F.sum("gn").over(_before("gl").orderBy("gg")), F.lit(0)))
    inside = counts.withColumn("_in", F.coalesce(F.sum("n").over(_before("length", "_group").orderBy("_slice")), F.lit(0)))
    counts = inside.join(of_groups, (inside["length"] == of_groups["gl"]) & (inside["_group"] == of_groups["gg"])).select(
        F.col("length").alias("cl"), F.col("_slice").alias("cs"), (F.col("_in") + F.col("earlier")).alias("before"))
    inner = Window.partitionBy("length", "_slice").orderBy("_row")
    ranked = parts.withColumn("_slice", part).withColumn("_at", F.row_number().over(inner) - 1)
    ranked = ranked.join(counts, (ranked["length"] == counts["cl"]) & (ranked["_slice"] == counts["cs"]))
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*shown, (F.col("_at") + F.col("before")).alias("_rank"))
    table = spark.sparkContext.broadcast(slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, n, base, offset = table.value.T
        keys = lengths << RANKS | first
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, len(shown)))
            at = np.searchsorted(keys, length << RANKS | rank, "right") - 1
            ahead = rank - first[at]
            put = [pa.array(base[at] + ahead % n[at]), pa.array(offset[at] + ahead // n[at] * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *put], names=[*shown, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{_schema(with_ids)}, sequence_id long, offset long")
