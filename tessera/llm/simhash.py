"""SimHash near-dedup by segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its 16 four-bit segments.
The Manhattan distance of two such vectors is at most the Hamming distance of
the fingerprints, so fingerprints within 2 bits lie within 2 on the grid of
vectors. The range join over that grid meets in the middle: a vector goes to
its own cell, to the 16 above and the 16 below; two vectors within 2 then share
a cell in one of four ways (home-home, up-home, up-up, up-down). Members of a
cell are verified on the 64 bits themselves.

Work is done on distinct fingerprints, so copies count once. A cell emits the
links that span its groups, never all pairs, and a cell of more than ``CELL``
members looks up each member's neighbours (all 2,080 changes of one or two
bits) instead of comparing members, which stays linear. Only different
fingerprints share a cell, and the fullest home cell (two bits in each segment)
has (6/16)**16 of evenly spread ones, 1 in 6.6 million: 10**12 fingerprints put
some five million placements in it, so cells stay smaller than partitions. Components come from
links by repeated joins, written to the shared folder each round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ambiguous, dropped, shuffle_partitions, slices, staged

SHINGLE = 3
RADIUS = 2
SEED = 42
CELL = 4096
#: Placements (33 at most for a fingerprint) in one partition of the range join.
PLACED = 1 << 20
SEGMENTS = 16
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_FLIPS = np.array([1 << i for i in range(64)] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)], np.uint64)
_LIMIT = 1 << 16
#: Words that are hashed together.
_WORDS = 1 << 14


# Fixed values of XXH64: its five primes.
_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_P4, _P5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)
_ONES = np.uint64(0x0101010101010101)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def hashed_spans(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of ``data[s:e]`` for each span. Spans of under 32 bytes, as nearly
    all are, advance together by eight, four and one bytes; others are hashed
    one by one."""
    words = np.frombuffer(data + bytes(16 - len(data) % 8), "<u8")
    size = (ends - starts).astype(np.int64)

    def lane(at: np.ndarray) -> np.ndarray:
        """The eight bytes from each place on."""
        near, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        return (words[near] >> shift) | ((words[near + 1] << (np.uint64(63) - shift)) << np.uint64(1))

    h = np.uint64(seed) + _P5 + size.astype(np.uint64)
    at, left = starts.astype(np.int64), np.where(size < 32, size, 0)
    while (go := np.flatnonzero(left >= 8)).size:
        h[go] = _turned(h[go] ^ (_turned(lane(at[go]) * _P2, 31) * _P1), 27) * _P1 + _P4
        at[go] += 8
        left[go] -= 8
    go = np.flatnonzero(left >= 4)
    h[go] = _turned(h[go] ^ ((lane(at[go]) & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[go] += 4
    left[go] -= 4
    while (go := np.flatnonzero(left > 0)).size:
        h[go] = _turned(h[go] ^ ((lane(at[go]) & np.uint64(255)) * _P5), 11) * _P1
        at[go] += 1
        left[go] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(size >= 32)
    if long.size:
        pairs = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        h[long] = np.array([xxhash.xxh64_intdigest(data[s:e], seed) for s, e in pairs], np.uint64)
    return h


def _bit_counts(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """How many hashes of each group (from ``firsts`` on) have each bit: eight
    bits are counted in the bytes of one number, over 255 hashes at most."""
    sizes = np.diff(np.append(firsts, len(h)))
    parts = -(-sizes // 255)
    cuts = np.repeat(firsts - 255 * (np.cumsum(parts) - parts), parts) + 255 * np.arange(parts.sum())
    counts = np.empty((len(cuts), 8, 8), np.int64)
    for k in range(8):
        counts[:, :, k] = np.add.reduceat((h >> np.uint64(k)) & _ONES, cuts).view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts.reshape(-1, 64), np.cumsum(parts) - parts)


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """The SimHash of each text. Texts are hashed together up to a number of
    words; a longer one in runs of so many that overlap by a shingle less a word."""
    out, held, size = np.zeros((len(texts), 64), np.int64), [], 0
    total = np.zeros(len(texts), np.int64)

    def settle() -> None:
        nonlocal held, size
        if not held:
            return
        words = [w for _, run in held for w in run]
        data = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        n = np.array([len(run) for _, run in held])
        shingles = np.maximum(1, n - SHINGLE + 1)
        firsts = np.cumsum(shingles) - shingles
        # the word that each shingle opens with, and the one that it closes with
        opens = np.repeat(np.cumsum(n) - n - firsts, shingles) + np.arange(shingles.sum())
        h = hashed_spans(data, (ends - lengths)[opens], ends[opens + np.repeat(np.minimum(n, SHINGLE) - 1, shingles)])
        rows = np.array([r for r, _ in held])
        np.add.at(out, rows, _bit_counts(h, firsts))
        np.add.at(total, rows, shingles)
        held, size = [], 0

    for row, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        for at in range(0, max(1, len(words) - SHINGLE + 1) if words else 0, _WORDS):
            held.append((row, words[at : at + _WORDS + SHINGLE - 1]))
            size += len(held[-1][1])
            if size >= _WORDS:
                settle()
    settle()
    return np.packbits(2 * out > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: str | None) -> int:
    """The SimHash of one text."""
    return int(fingerprints_of([text])[0])


def _fingerprints(column) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(fingerprints_of(part) for part in slices(column))])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) for each row. Null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _fingerprints(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _cells(fp: np.ndarray) -> np.ndarray:
    """Each fingerprint's segment bit counts, as sixteen 4-bit digits."""
    two = (fp & np.uint64(0x5555555555555555)) + ((fp >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (two & np.uint64(0x3333333333333333)) + ((two >> np.uint64(2)) & np.uint64(0x3333333333333333))


def _placed(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, fingerprints and roles (0 home, 1 up, 2 down) of the range join."""
    home = _cells(fp)
    cell, who, role = [home], [fp], [np.zeros(len(fp), np.int8)]
    for s in range(SEGMENTS):
        digit = (home >> np.uint64(4 * s)) & np.uint64(15)
        one = np.uint64(1 << (4 * s))
        for ok, to, r in ((digit < 4, home + one, 1), (digit > 0, home - one, 2)):
            cell.append(to[ok])
            who.append(fp[ok])
            role.append(np.full(int(ok.sum()), r, np.int8))
    return np.concatenate(cell), np.concatenate(who), np.concatenate(role)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n points reaches over links (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _linked(cell: np.ndarray, fp: np.ndarray, role: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most RADIUS bits between members of a cell, as a forest over
    the fingerprints given."""
    points, index = np.unique(fp, return_inverse=True)
    order = np.argsort(cell, kind="stable")
    cell, index, role = cell[order], index[order], role[order]
    cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    size = np.diff(cuts)
    first = np.repeat(cuts[:-1], size)
    size = np.repeat(size, size)
    root = np.arange(len(points))

    held: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        nonlocal root
        if held:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            root = _roots(len(points), np.concatenate((np.arange(len(points)), a)), np.concatenate((root, b)))

    def join(a: np.ndarray, b: np.ndarray) -> None:
        ok = (root[a] != root[b]) & (np.bitwise_count(points[a] ^ points[b]) <= RADIUS)
        if ok.any():
            held.append((a[ok], b[ok]))
            if sum(len(x) for x, _ in held) > _LIMIT:
                settle()

    small = np.flatnonzero((size > 1) & (size <= limit))
    step = 1
    while len(small):
        small = small[small + step < first[small] + size[small]]
        a, b = small, small + step
        useful = (role[a] == 1) | (role[b] == 1) | ((role[a] == 0) & (role[b] == 0))
        join(index[a[useful]], index[b[useful]])
        step += 1
    large = np.unique(index[size > limit])
    for at in range(0, len(large), 512):
        own = large[at : at + 512]
        near = points[own][:, None] ^ _FLIPS
        to = np.searchsorted(points, near)
        to[to == len(points)] = 0
        ok = points[to] == near
        join(np.repeat(own, ok.sum(1)), to[ok])
    settle()
    moved = np.flatnonzero(root != np.arange(len(root)))
    return points[moved], points[root[moved]]


def links(fps: DataFrame, limit: int = CELL) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect the same
    groups as all links of at most RADIUS bits."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(fp), 20_000):
                c, w, r = _placed(fp[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)), pa.array(w.view(np.int64)), pa.array(r)], names=["cell", "fp", "role"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if got:
            c, w, r = (np.concatenate(x) for x in zip(*got, strict=True))
            a, b = _linked(c, w.view(np.uint64), r, limit)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    placed = fps.select("fp").mapInArrow(place, "cell long, fp long, role byte")
    # the partitions grow in number with the fingerprints, so that none grows in
    # size; members of one cell are distinct and have nearly the same counts
    parts = max(shuffle_partitions(fps.sparkSession), -(-fps.count() * (2 * SEGMENTS + 1) // PLACED))
    return placed.repartition(parts, "cell").mapInArrow(meet, "a long, b long")


def components(edges: DataFrame, name: str = "op6") -> DataFrame:
    """``node, root``: the least node reachable, for each node of ``edges`` (a, b).

    Alternately each node's larger neighbours, then its smaller ones, are hung
    on its least neighbour, until nothing changes: the number of rounds grows
    with the logarithm of the nodes. Only links move, by pre-aggregated joins.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = staged(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), f"{name}-links")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, f"{name}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        after = staged(small.distinct(), f"{name}-small")
        dropped(large)
        same = now.unionAll(after).groupBy("u", "v").count().where("count = 1").isEmpty()
        dropped(now)
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _named(rows: DataFrame, limit: int = CELL) -> DataFrame:
    """``f, root, component_id`` for each distinct ``fp`` of ``rows`` (doc_id, fp)."""
    best = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "op6-distinct")
    tree = components(links(best, limit))
    reached = best.join(tree, best["fp"] == tree["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = reached.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    return staged(reached.join(whole, reached["root"] == whole["r"]).select(F.col("fp").alias("f"), "root", "component_id"), "op6-components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = CELL) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest id reachable over links of at most 2
    differing bits, itself included; null ids sort last (a group of null ids
    only has null). Null and empty texts have the fingerprint 0 and link like
    any other. Repeated rows give repeated rows. Other columns are ignored.
    """
    rows = staged(fingerprints(docs, id_col, text_col), "op6-fingerprints")
    names = _named(rows, limit)
    return rows.join(names, rows["fp"] == names["f"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that are the smallest id of their
    group. Where ids are missing or repeated, one of the group's rows with that
    id stays (with a null id, if the group has no other)."""
    if ambiguous(docs, id_col):
        place = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                fp = _fingerprints(b.column(place))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=[*b.schema.names, "_fp"])

        rows = staged(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_fp", T.LongType())])), "op6-rows")
        names = _named(rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col("_fp").alias("fp")))
        names = names.select("f", F.col("root").alias("_root"), F.col("component_id").alias("_least"))
        firsts = rows.join(names, (rows["_fp"] == names["f"]) & rows[id_col].cast("long").eqNullSafe(names["_least"]))
        return firsts.dropDuplicates(["_root"]).select(*docs.columns)
    gone = near_groups(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
