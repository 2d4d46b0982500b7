"""Toxicity: a factorization machine over hashed terms.

Terms are whole words, word beginnings of 4 to 7 bytes, and beginnings that a
document has in several different words (a stem in several forms says more than
one that occurs by chance), all lower-cased and hashed to ``BITS`` bits. Besides a weight for each term the machine learns a
vector, and the products of the vectors of terms that occur together; so it can
tell an insult that meets a mention of a group from either alone, which a sum
of weights can't.

It is fitted on the driver to a bounded sample (``SAMPLE`` labelled documents,
chosen by a hash of their ids), over the terms that tell the labels apart in
that sample. Scoring reads every whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, slices, staged
from .wordhash import BYTE_BASE, MASK, PIECE, U, grouped, mix, pieces, powers, spans

#: The documented bound of the sample that is fitted.
SAMPLE = 16_000
BITS = 20
PREFIXES = (4, 5, 6, 7)
#: Beginnings of which the number of different words counts.
STEMS = (5, 6, 7)
#: Documented bounds of the terms that are fitted: their number, the documents
#: that a term is in, and its G statistic (a chance of half a percent).
TERMS = 4096
LEAST = 2
STATISTIC = 8.0
FACTORS = 8
EPOCHS = 30
THRESHOLD = 0.3
_EDGES = np.zeros(256, bool)
_EDGES[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _several(beginning: np.ndarray) -> np.ndarray:
    """The term that a beginning is in several words; one to one."""
    return (beginning * 0x9E375 + 0x3C6EF) & ((1 << BITS) - 1)


def _terms(data: bytes, mask: np.ndarray | None, stems: np.ndarray | None) -> tuple[list, list]:
    """Hashed terms of one buffer with the byte where each one's word starts,
    and beginnings with that byte and the whole word's hash; with ``mask`` and
    ``stems`` only those that they hold. ASCII punctuation is cut off words."""
    a, s, e = spans(data)
    for _ in range(3):
        s = s + (_EDGES[a[np.minimum(s, len(a) - 1)]] & (s < e)) if len(s) else s
        e = e - (_EDGES[a[np.maximum(e - 1, 0)]] & (s < e)) if len(e) else e
    ok = s < e
    s, e = s[ok], e[ok]
    out, forms = [], []
    if not len(s):
        return out, forms
    p, inv = powers(BYTE_BASE[0], len(a) + 1)
    total = np.zeros(len(a) + 1, U)
    np.cumsum((a.astype(U) + U(1)) * p[: len(a)], out=total[1:])
    word = mix((total[e] - total[s]) * inv[s] + U(0x632BE59BD9B4E019))
    for kind, size in enumerate((0, *PREFIXES)):
        if size:
            long = np.flatnonzero(e - s > size)
            ss = s[long]
            h = mix((total[ss + size] - total[ss]) * inv[ss] + U((1 + kind) * 0x632BE59BD9B4E019 & MASK))
        else:
            ss, h = s, word
        h = (h >> U(64 - BITS)).astype(np.int64)
        if size in STEMS:
            keep = np.flatnonzero(stems[h]) if stems is not None else slice(None)
            forms.append((h[keep], ss[keep], word[long[keep]]))
        if mask is not None:
            keep = mask[h]
            h, ss = h[keep], ss[keep]
        out.append((h, ss))
    return out, forms


def hashed_terms(texts: list[bytes], mask: np.ndarray | None = None, stems: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``rows, terms``: the distinct terms of each text, by row then term."""
    rows, terms, forms = [], [], []
    for group, parts in grouped(texts):
        ids = np.asarray(group, np.int64)
        for data in pieces(parts[0]) if len(parts) == 1 else [b" ".join(parts)]:
            ends = np.cumsum([len(p) + 1 for p in parts]) if len(parts) > 1 else np.array([len(data) + 1])
            found, several = _terms(data, mask, stems)
            for h, at in found:
                rows.append(ids[np.searchsorted(ends, at, "right")])
                terms.append(h)
            forms += [(ids[np.searchsorted(ends, at, "right")], h, word) for h, at, word in several]
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = [(np.concatenate(rows) << BITS) | np.concatenate(terms)]
    if forms:
        row, stem, word = (np.concatenate(x) for x in zip(*forms, strict=True))
        stem = (row << BITS) | stem
        order = np.lexsort((word, stem))
        stem, word = stem[order], word[order]
        other = (stem[1:] == stem[:-1]) & (word[1:] != word[:-1])
        stem = np.unique(stem[1:][other])
        key.append((stem >> BITS << BITS) | _several(stem & ((1 << BITS) - 1)))
    key = np.unique(np.concatenate(key))
    return key >> BITS, key & ((1 << BITS) - 1)


def _bytes(text) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass") if text else b""


class Machine:
    """score = sigmoid(bias + sum w + sum of v_i . v_j over pairs of terms)."""

    def __init__(self, bias: float, terms: np.ndarray, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v
        self.mask = np.zeros(1 << BITS, bool)
        self.mask[terms] = True
        self.stems = self.mask[_several(np.arange(1 << BITS))]
        self.place = np.zeros(1 << BITS, np.int32)
        self.place[terms] = np.arange(len(terms))

    def raw(self, n: int, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(rows, self.w[cols], n)
        sums = np.stack([np.bincount(rows, self.v[cols, f], n) for f in range(self.v.shape[1])], 1)
        squares = np.bincount(rows, (self.v[cols] ** 2).sum(1), n)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, texts: list[bytes]) -> np.ndarray:
        rows, terms = hashed_terms(texts, self.mask, self.stems)
        raw, _ = self.raw(len(texts), rows, self.place[terms])
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def chosen_terms(sample: DataFrame, toxic: int, clean: int) -> DataFrame:
    """``term``: those whose presence tells the labels of ``sample`` (y, terms)
    apart, by the G statistic of the two-by-two table: at least ``STATISTIC``, in
    ``LEAST`` documents or more, and the first ``TERMS`` of these (the smaller
    term of equals). Counted and chosen on executors."""
    n1, n0 = max(1, toxic), max(1, clean)
    held = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("n"), F.sum("y").cast("double").alias("c1"))
    n, c1 = F.col("n"), F.col("c1")
    part = lambda c, among, size: F.when(c > 0, c * F.log(c * (n1 + n0) / (among * size))).otherwise(0.0)
    g = part(c1, n, n1) + part(n - c1, n, n0) + part(n1 - c1, n1 + n0 - n, n1) + part(n0 - (n - c1), n1 + n0 - n, n0)
    return held.where(n >= LEAST).withColumn("g", 2 * g).where(F.col("g") >= STATISTIC).orderBy(F.col("g").desc(), "term").limit(TERMS).select("term")


def fitted(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, keep: np.ndarray, seed: int = 7) -> Machine:
    """The machine for a sample (row, term, by row) with labels ``y`` over the
    terms ``keep`` (sorted); deterministic."""
    y = y.astype(np.float64)
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(rate / (1 - rate))), keep, np.zeros(len(keep)), rng.normal(0, 0.01, (len(keep), FACTORS)))
    if not len(keep):
        return m
    cols = m.place[terms].astype(np.int64)
    starts = np.searchsorted(rows, np.arange(len(y) + 1))
    seen_w, seen_v, seen_b = np.full(len(keep), 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        rate = 0.3 / (1 + 0.1 * epoch)
        for at in range(0, len(y), 256):
            batch = order[at : at + 256]
            sizes = starts[batch + 1] - starts[batch]
            r = np.repeat(np.arange(len(batch)), sizes)
            c = cols[np.repeat(starts[batch] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            raw, sums = m.raw(len(batch), r, c)
            d = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]) / len(batch)
            gw = np.bincount(c, d[r], len(keep)) + 1e-5 * m.w
            gv = np.zeros_like(m.v)
            np.add.at(gv, c, d[r][:, None] * (sums[r] - m.v[c]))
            gv += 1e-5 * m.v
            gb = d.sum()
            seen_w += gw**2
            seen_v += gv**2
            seen_b += gb**2
            m.w -= rate * gw / np.sqrt(seen_w)
            m.v -= 0.2 * rate * gv / np.sqrt(seen_v)
            m.bias -= 0.2 * rate * gb / np.sqrt(seen_b)
    return m


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit to at most ``sample`` labelled documents that aren't held out.

    Rows without an id or a label are left out; an id with several labels has
    the largest, one with several texts gives one of them (always the same). Ids
    have to be integers. Without any label the machine knows only the bias, and every
    score is the smoothed rate.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(label_id).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    picked = {r["_id"]: r["_y"] for r in known.collect()}  # at most `sample` rows
    wanted = spark.sparkContext.broadcast(picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array(sorted(wanted.value), np.int64)
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(ids, own)
            at[at == len(ids)] = 0
            hit = np.flatnonzero(ids[at] == own) if len(ids) else []
            for i in hit:
                text = _bytes(b.column(1)[int(i)].as_py())
                _, terms = hashed_terms([text])
                arrays = [pa.array([own[i]], pa.int64()), pa.array([zlib.crc32(text)], pa.int64()), pa.array([terms.astype(np.int32)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "mark", "terms"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")
    got = texts.mapInArrow(run, "doc long, mark long, terms array<int>").groupBy("doc").agg(F.min_by("terms", F.struct("mark", "terms")).alias("terms"))
    marked = spark.createDataFrame(sorted(picked.items()) or [(0, 0)], "id long, y int")
    got = staged(got.join(F.broadcast(marked), got["doc"] == marked["id"]).select("doc", (F.col("y") > 0).cast("int").alias("y"), "terms"), "op7-sample")
    labelled = got.select("doc", "y").orderBy("doc").toArrow()  # at most `sample` rows
    y = labelled.column("y").to_numpy().astype(np.float64)
    chosen = staged(chosen_terms(got, int(y.sum()), len(y) - int(y.sum())), "op7-terms")
    keep = np.sort(chosen.toArrow().column("term").to_numpy().astype(np.int64))  # at most TERMS
    # a document has TERMS of these at most
    pairs = got.select("doc", F.explode("terms").alias("term")).join(F.broadcast(chosen), "term").select("doc", "term").toArrow()
    docs_, terms = (pairs.column(k).to_numpy().astype(np.int64) for k in ("doc", "term"))
    order = np.lexsort((terms, docs_))
    rows = np.searchsorted(labelled.column("doc").to_numpy(), docs_[order])
    dropped(got)
    dropped(chosen)
    return fitted(rows, terms[order], y, keep)


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row; null and empty texts
    have the bias alone as a score. Repeated rows are scored each, null ids are
    kept (never held out), other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.scores(list(map(_bytes, part))) for part in slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.empty(0), *s]))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``; one
    pass, nothing is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shared.value.scores(list(map(_bytes, part))) for part in slices(b.column(place))]
            yield b.filter(pa.array(np.concatenate([np.empty(0), *s]) < threshold))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
