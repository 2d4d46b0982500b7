"""Benchmark decontamination by q-gram lemma filtering.

If an item of m characters lies in a text with at most k edits, at least
m - q + 1 - k*q of its q-grams occur there, on diagonals (text position minus
item position) that differ by at most k. Shared q-grams are counted in
overlapping bands of diagonals; only regions that reach that count are kept and
verified by a banded alignment, which gives the least number of edits.

The benchmark is the small side: its grams are broadcast after a check of its
size. One that is larger than a block is first broadcast as a table of bits,
which the corpus is read with once; what that leaves is then compared with the
benchmark, a block of items at a time.

Items too short to count grams are sought by their pieces: an item with k edits
has one of k + 1 pieces as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged

Q = 8
ERROR = 0.1
#: Items shorter than this (normalised) have too few grams to count; they are
#: sought by pieces, of which one is without edits.
SHORTEST = 40
#: Characters of benchmark text in one broadcast block.
BLOCK = 8 << 20
#: Places of a text that are looked at together, and pairs of equal grams: a
#: window with more is compared with one half of the items after the other.
WINDOW = 1 << 16
PAIRS = 1 << 21
#: Bits of the largest table that tells whether any item has a gram (32 MB).
MOST_BITS = 28
_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str | None) -> str:
    """Lower-cased, white space squeezed to single spaces."""
    return " ".join((text or "").lower().split())


def _grams(codes: np.ndarray) -> np.ndarray:
    """The eight characters from each position on, as one integer."""
    v = codes.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | (v[step:] << np.uint64(8 * step)) if len(v) > step else v[:0]
    return v


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The characters, and a byte for each to make grams of (different
    characters may share a byte: that adds candidates and loses none)."""
    wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return wide, ((wide ^ (wide >> np.uint32(8)) ^ (wide >> np.uint32(16))) & np.uint32(255)).astype(np.uint8)


def aligned(item: np.ndarray, region: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int] | None:
    """The least edits of ``item`` against a substring of ``region`` on the
    diagonals low..high, and where it starts; None over the budget. One row of
    the band a character of the item; insertions are closed by a running
    minimum."""
    width = high - low + 1
    ramp = np.arange(width)
    big = 1 << 20
    place = np.arange(low, high + 1)
    row = np.where((place >= 0) & (place <= len(region)), 0, big)
    start = np.clip(place, 0, len(region))
    for i, c in enumerate(item):
        at = place + i
        ok = (at >= 0) & (at < len(region))
        change = np.where(ok, region[np.clip(at, 0, max(0, len(region) - 1))] != c, 1) if len(region) else np.ones(width, int)
        diagonal = np.where(ok, row + change, big)
        skipped = np.append(row[1:] + 1, big)
        take = skipped < diagonal
        best = np.where(take, skipped, diagonal)
        from_ = np.where(take, np.append(start[1:], 0), start)
        # an inserted character of the region moves one diagonal up
        key = best - ramp
        run = np.minimum.accumulate(key)
        source = np.maximum.accumulate(np.where(key == run, ramp, 0))
        row, start = run + ramp, from_[source]
        row = np.where(row > big, big, row)
        if row.min() > budget:
            return None
    end = place + len(item)
    row = np.where((end >= 0) & (end <= len(region)), row, big)
    j = int(row.argmin())
    return (int(row[j]), int(start[j])) if row[j] <= budget else None


def _pieces(size: int, budget: int) -> list[tuple[int, int]]:
    return [(k * size // (budget + 1), (k + 1) * size // (budget + 1)) for k in range(budget + 1)]


def _kind(size: int, error: float) -> tuple[int, int]:
    """Edits that an item may have, and grams that are left with that many (0:
    too few to count on)."""
    budget = min(int(error * size), max(0, size - 1))
    need = size - Q + 1 - budget * Q
    return budget, need if size >= SHORTEST and need > 0 else 0


def _marks(wide: np.ndarray, codes: np.ndarray, error: float) -> np.ndarray | None:
    """Grams of which a text that holds the item has one; None if there are none
    to tell (an item with pieces of under ``Q`` characters)."""
    budget, need = _kind(len(wide), error)
    grams = _grams(codes)
    if need:
        return grams
    parts = _pieces(len(wide), budget)
    return grams[[low for low, _ in parts]] if all(high - low >= Q for low, high in parts) else None


class Index:
    """The grams of a block of items, with a bit table to pass over the rest."""

    def __init__(self, items: list[tuple[int | None, str]], error: float):
        self.items, self.error, self.halves = [x for x in items if x[1]], error, None
        self.ids, self.texts, self.budget, self.need = [], [], [], []
        self.bare: list[int] = []  # items without a gram that tells
        grams, owner, place = [], [], []
        for item, text in self.items:
            wide, codes = _codes(text)
            k, need = _kind(len(wide), error)
            n = len(self.ids)
            self.ids.append(item)
            self.texts.append(wide)
            self.budget.append(k)
            self.need.append(need or 1)
            g = _marks(wide, codes, error)
            if g is None:
                self.bare.append(n)
                continue
            grams.append(g)
            owner.append(np.full(len(g), n, np.int32))
            place.append(np.arange(len(g), dtype=np.int32) if need else np.array([low for low, _ in _pieces(len(wide), k)], np.int32))
        self.longest = max((len(t) for t in self.texts), default=0)
        all_ = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(all_, kind="stable")
        self.grams = all_[order]
        self.owner = np.concatenate(owner)[order] if grams else np.empty(0, np.int32)
        self.place = np.concatenate(place)[order] if grams else np.empty(0, np.int32)
        self.need, self.budget = np.array(self.need, np.int64), np.array(self.budget, np.int64)
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.grams * _MIX) >> np.uint64(64 - _BITS)] = True
        # with fewer hits than this in the reach of any item, nothing is near
        self.least = int(self.need.min()) if len(self.need) else 0
        self.reach = self.longest + int(self.budget.max(initial=0))

    def found(self, wide: np.ndarray, codes: np.ndarray) -> list[tuple[int | None, int, int]]:
        """(item, edits, start) of the best region of each item in a text. It is
        looked at in windows that overlap by the longest item's reach."""
        best: dict[int, tuple[int, int]] = {}
        for begin in range(0, max(1, len(wide)), WINDOW):
            end = begin + WINDOW + self.reach + Q
            for n, edits, start in self._window(wide[begin:end], codes[begin:end]):
                got = (edits, start + begin)
                if n not in best or got < best[n]:
                    best[n] = got
        return [(self.ids[n], e, p) for n, (e, p) in sorted(best.items())]

    def _window(self, wide: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, int]]:
        return self._by_grams(wide, codes) + self._by_search(wide)

    def _by_search(self, wide: np.ndarray) -> list[tuple[int, int, int]]:
        """Bare items, by a search for each of their pieces."""
        out, data = [], wide.tobytes() if self.bare else b""
        for n in self.bare:
            text, k, diagonals = self.texts[n], int(self.budget[n]), set()
            for low, high in _pieces(len(text), k):
                part, at = text[low:high].tobytes(), -1
                while (at := data.find(part, at + 1)) >= 0:
                    if at % 4 == 0:
                        diagonals.add(at // 4 - low)
                        if not k:  # the first is the best
                            break
            near = [got for d in diagonals if (got := self._verified(n, wide, d, d))]
            if near:
                out.append((n, *min(near)))
        return out

    def _verified(self, n: int, wide: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
        """The least edits of an item on diagonals near low..high, and its start."""
        text, k = self.texts[n], int(self.budget[n])
        begin, end = max(0, low - k), min(len(wide), high + len(text) + k)
        whole = wide[begin:end].tobytes().find(text.tobytes())
        if whole >= 0 and whole % 4 == 0:  # no edits, so nothing is better
            return 0, whole // 4 + begin
        got = aligned(text, wide[begin:end], low - k - begin, high + k - begin, k) if k else None
        return (got[0], got[1] + begin) if got else None

    def _by_grams(self, wide: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, int]]:
        g = _grams(codes)
        if not len(g) or not len(self.grams):
            return []
        at = np.flatnonzero(self.bits[(g * _MIX) >> np.uint64(64 - _BITS)])
        if len(at) < self.least:
            return []
        # positions with enough hits within the longest item's reach
        near = np.searchsorted(at, at + self.reach, "right") - np.arange(len(at)) >= self.least
        if not near.any():
            return []
        cover = np.zeros(len(at) + 1, np.int64)
        first = np.flatnonzero(near)
        np.add.at(cover, first, 1)
        np.subtract.at(cover, np.searchsorted(at, at[first] + self.reach, "right"), 1)
        at = at[np.cumsum(cover[:-1]) > 0]
        low = np.searchsorted(self.grams, g[at], "left")
        times = np.searchsorted(self.grams, g[at], "right") - low
        total = int(times.sum())
        if not total:
            return []
        if total > PAIRS and len(self.items) > 1:
            return self._by_halves(wide, codes)
        entry = np.repeat(low - np.cumsum(times) + times, times) + np.arange(total)
        who, spot = self.owner[entry].astype(np.int64), self.place[entry].astype(np.int64)
        shift = np.repeat(at, times) - spot + self.longest
        # bands of twice the budget, each overlapping half of the next
        band = shift // np.maximum(1, self.budget[who])
        span = np.int64(len(wide) + 2 * self.longest + 4)
        # a gram counts once for a position of the item
        keys = np.concatenate((who * span + band, (who * span + band - 1)[band > 0]))
        spots = np.concatenate((spot, spot[band > 0]))
        order = np.lexsort((spots, keys))
        keys, spots = keys[order], spots[order]
        fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (spots[1:] != spots[:-1])))
        uniq, counts = np.unique(keys[fresh], return_counts=True)
        best: dict[int, tuple[int, int]] = {}
        for key in uniq[counts >= self.need[uniq // span]]:
            n, b = int(key // span), int(key % span)
            step = max(1, int(self.budget[n]))
            got = self._verified(n, wide, b * step - self.longest, (b + 2) * step - self.longest)
            if got and (n not in best or got < best[n]):
                best[n] = got
        return [(n, *x) for n, x in best.items()]

    def _by_halves(self, wide: np.ndarray, codes: np.ndarray) -> list[tuple[int, int, int]]:
        half = len(self.items) // 2
        if self.halves is None:
            self.halves = Index(self.items[:half], self.error), Index(self.items[half:], self.error)
        one, two = (x._by_grams(wide, codes) for x in self.halves)
        return one + [(n + half, e, p) for n, e, p in two]


class Sieve:
    """Bits of the grams of a whole benchmark: which texts may hold an item."""

    def __init__(self, size: int):
        """For ``size`` characters: some 16 bits each, up to ``MOST_BITS``."""
        self.bits = min(MOST_BITS, max(_BITS, (16 * size).bit_length()))
        self.table, self.every = np.zeros(1 << (self.bits - 3), np.uint8), False

    def _at(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (grams * _MIX) >> np.uint64(64 - self.bits)
        return at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def add(self, items: list[tuple[int | None, str]], error: float) -> None:
        for _, text in items:
            if text and not self.every:
                grams = _marks(*_codes(text), error)
                if grams is None:
                    self.every = True  # an item without a gram that tells
                else:
                    at, bit = self._at(grams)
                    np.bitwise_or.at(self.table, at, bit)

    def passes(self, text: str | None) -> bool:
        """Whether a gram of the text is one of an item."""
        if self.every:
            return True
        codes = _codes(normalised(text))[1]
        for begin in range(0, len(codes), WINDOW):
            at, bit = self._at(_grams(codes[begin : begin + WINDOW + Q - 1]))
            if (self.table[at] & bit).any():
                return True
        return False


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark in blocks of bounded size, streamed to the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = normalised(r[1])
        if block and size + len(text) > BLOCK:
            yield block
            block, size = [], 0
        block.append((r[0], text))
        size += len(text)
    if block:
        yield block


#: The indices that a worker holds: a block's is built once a worker, not once a task.
_held: dict[str, Index] = {}


def _index(name: str, block, error: float) -> Index:
    if name not in _held:
        _held.clear()  # one block at a time
        _held[name] = Index(block.value, error)
    return _held[name]


def _sieve(benchmark: DataFrame, item_col: str, item_text: str, error: float) -> Sieve | None:
    """The sieve of a benchmark of several blocks; one block needs none."""
    size = benchmark.agg(F.sum(F.length(item_text))).first()[0] or 0
    if size <= BLOCK:
        return None
    sieve = Sieve(size)
    for block in _blocks(benchmark, item_col, item_text):
        sieve.add(block, error)
    return sieve


def _sieved(docs: DataFrame, sieve: Sieve, text_col: str) -> DataFrame:
    """``docs`` with ``_may``: whether the text shares a gram with the benchmark;
    one pass, written to the shared folder."""
    shared, place = docs.sparkSession.sparkContext.broadcast(sieve), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            may = pa.array([shared.value.passes(t) for t in b.column(place).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, may], names=[*b.schema.names, "_may"])

    return staged(docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_may", T.BooleanType())])), "op8-sieved")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error: float = ERROR) -> DataFrame:
    """``doc_id, item_id, edits, start``: every item of the benchmark that lies
    in a document with at most ``error`` edits a character, with its best
    region (start: a position in the normalised text; the least of equals).

    Items of any length are sought, those without an id too. Null and empty
    texts or items give nothing; repeated rows are judged each; an item given
    twice is two. Ids have to be integers or null. Whole texts of any length are
    searched. Other columns are ignored; empty tables give no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    if sieve := _sieve(benchmark, item_col, item_text, error):
        rows = _sieved(rows, sieve, "text").where("_may").drop("_may")
    schema = "doc_id long, item_id long, edits int, start long"
    out = None
    for block in _blocks(benchmark, item_col, item_text):
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, error)
            for b in batches:
                found = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found += [(doc, *x) for x in index.found(*_codes(normalised(text)))]
                if found:
                    cols = zip(*found, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error: float = ERROR) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item (nor one without an
    id): judged without moving rows, a block of the benchmark at a time."""
    out, rest, place = docs, None, docs.columns.index(text_col)
    if sieve := _sieve(benchmark, item_col, item_text, error):
        marked = _sieved(docs, sieve, text_col)
        out, rest = marked.where("_may").drop("_may"), marked.where("NOT _may").drop("_may")
    for block in _blocks(benchmark, item_col, item_text):
        shared, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, error)
            for b in batches:
                keep = [not index.found(*_codes(normalised(t))) for part in slices(b.column(place)) for t in part]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(run, T.StructType(docs.schema.fields))
    return out.unionAll(rest) if rest is not None else out
