"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of ``block`` words; any
window of ``window`` >= 2 * block - 1 words contains a whole block of the place
where it starts. So a window that also starts elsewhere shares an anchor with
it: the blocks are the index, every rolling run of ``block`` words probes it,
and only windows over a hit are extended and compared. Shared windows that
follow each other add up to the exact repeats.

Documents are dealt into chunks of bounded size. A chunk sends each distinct
probe once, packed with the others of a bucket (so a passage in a third of all
documents is one key from a chunk, never a list of places), and gets back the
keys that are shared. Probes may collide and only pick candidates.

Candidate windows meet by the least of their probes, which equal windows have in
common: a run of windows with one least probe is sent as its words, once from a
chunk, and the windows of all runs of a probe are compared word for word. A chunk
gets back a bit for each window that it sent. Both exchanges grow with the text
and pair nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ambiguous, chunk_count, shuffle_partitions, staged
from .wordhash import U, hashed_texts, window_hashes

WINDOW = 35
#: Bits of a probe, whatever the size of the corpus.
KEY_BITS = 56
_SHIFT = U(64 - KEY_BITS)
#: Candidate windows of a text whose least probes are sought together.
STEP = 1 << 16


def _pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as the first and the gaps between them, in as many
    bytes as their mean takes; a gap that takes more is several entries."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    width = 1
    while width < 7 and 256**width < 4 * (int(keys[-1] - keys[0]) // len(keys) + 1):
        width += 1
    most = U(256**width - 1)
    more = (gaps // most).astype(np.int64)
    out = np.full(len(gaps) + int(more.sum()), most)
    out[np.cumsum(more + 1) - 1] = gaps % most
    return int(keys[0]).to_bytes(8, "little") + bytes([width]) + out.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, U)
    first, width = U(int.from_bytes(data[:8], "little")), data[8]
    wide = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    gaps = wide.view(U).ravel()
    keys = first + np.cumsum(gaps, dtype=U)
    return np.concatenate(([first], keys[gaps != U(256**width - 1)]))


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in pdf["text"]]


def _bucket(probes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by range, so that sorted probes are sorted by bucket."""
    return (((probes >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)


def _cuts(groups: np.ndarray) -> list[tuple[int, int]]:
    """The runs of equal values."""
    edge = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True]))) if len(groups) else [0]
    return list(zip(edge[:-1], edge[1:], strict=True))


def _asked(texts: list[bytes], block: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct probes of a chunk; and whether each occurs twice there, and
    whether once at the start of a block."""
    keys = [window_hashes(w, block) for w in hashed_texts(texts)]
    aligned = [np.arange(len(k)) % block == 0 for k in keys]
    keys, aligned = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, U), (aligned, bool)))
    order = np.argsort(keys >> _SHIFT, kind="stable")
    k = keys[order] >> _SHIFT
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
    if not len(new):
        return k, np.empty((0, 2), bool)
    return k[new], np.stack((np.diff(np.append(new, len(k))) > 1, np.maximum.reduceat(aligned[order], new)), 1)


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, which of its probes in this bucket occur twice at least,
    and once at a block's start."""
    keys = [_unpack(k) for k in pdf["data"]]
    sizes = np.array([len(k) for k in keys])
    flags = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=2 * n).reshape(2, n).T for f, n in zip(pdf["flags"], sizes, strict=True)])
    inverse = np.unique(np.concatenate(keys), return_inverse=True)[1]
    good = (np.bincount(inverse, weights=1 + flags[:, 0]) >= 2) & (np.bincount(inverse, weights=flags[:, 1]) > 0)
    parts = np.split(good[inverse], np.cumsum(sizes)[:-1])
    out = [(int(c), int(b), 0, _pack(k[g])) for c, b, k, g in zip(pdf["chunk"], pdf["bucket"], keys, parts, strict=True) if g.any()]
    return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "data"])


def _runs(texts: list[bytes], known: np.ndarray, block: int, window: int) -> tuple[list[tuple[int, bytes]], dict]:
    """The distinct runs of candidate windows of a chunk, as (least probe, words
    joined by one space), sorted; and where each one is: (text, first word)."""
    found: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    width = window - block + 1
    for n, w in enumerate(hashed_texts(texts)):
        if len(w) < window:
            continue
        probes = window_hashes(w, block)
        at = np.searchsorted(known, probes >> _SHIFT)
        at[at == len(known)] = 0
        hit = np.concatenate(([0], np.cumsum(known[at] == probes >> _SHIFT)))
        starts = np.flatnonzero(hit[width:] > hit[: len(hit) - width])
        if not len(starts):
            continue
        words = texts[n].split()
        joined, ends = b" ".join(words), np.cumsum([len(x) + 1 for x in words])
        views = np.lib.stride_tricks.sliding_window_view(probes, width)
        least = np.concatenate([views[starts[i : i + STEP]].argmin(1) for i in range(0, len(starts), STEP)]) + starts
        new = np.flatnonzero(np.concatenate(([True], (np.diff(starts) != 1) | (np.diff(least) != 0))))
        last = np.append(new[1:], len(starts)) - 1
        begins = np.where(starts[new] > 0, ends[starts[new] - 1], 0)
        rows = zip(probes[least[new]].tolist(), begins.tolist(), (ends[starts[last] + window - 1] - 1).tolist(), starts[new].tolist(), strict=True)
        for probe, b, e, first in rows:
            found.setdefault((probe, joined[b:e]), []).append((n, first))
    return sorted(found), found


def _windows(text: bytes, window: int) -> list[bytes]:
    """The windows of a run of words joined by one space."""
    gaps = [-1, *np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist(), len(text)]
    return [text[gaps[i] + 1 : gaps[i + window]] for i in range(len(gaps) - window)]


def _compared(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """For each chunk, a bit for each window that it sent to this bucket: whether
    the same words start anywhere else. Windows are compared as they are."""
    runs, probes, twice, counts = [], [], [], []
    for data, flags in zip(pdf["data"], pdf["flags"], strict=True):
        n = int.from_bytes(data[:8], "little")
        runs += data[8 + 8 * n :].split(b"\n")
        probes.append(np.frombuffer(data, U, n, 8))
        twice.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=n))
        counts.append(n)
    probes, twice = np.concatenate(probes), np.concatenate(twice)
    bits: list[np.ndarray | None] = [None] * len(runs)
    order = np.argsort(probes, kind="stable")
    for a, b in _cuts(probes[order]):
        group = order[a:b].tolist()
        first = runs[group[0]]
        if all(runs[i] == first for i in group):
            same = np.full(first.count(b" ") + 2 - window, len(group) > 1 or bool(twice[group[0]]))
            for i in group:
                bits[i] = same
            continue
        cut: dict[bytes, list[bytes]] = {}
        times: dict[bytes, int] = {}
        for i in group:
            if runs[i] not in cut:
                cut[runs[i]] = _windows(runs[i], window)
            for x in cut[runs[i]]:
                times[x] = times.get(x, 0) + 1 + int(twice[i])
        for i in group:
            bits[i] = np.array([times[x] > 1 for x in cut[runs[i]]])
    out, at = [], 0
    for r, (chunk, bucket) in enumerate(zip(pdf["chunk"], pdf["bucket"], strict=True)):
        n = counts[r]
        out.append((int(chunk), int(bucket), 1, np.packbits(np.concatenate(bits[at : at + n])).tobytes()))
        at += n
    return pd.DataFrame(out, columns=["chunk", "bucket", "kind", "data"])


def _known(answers: pd.DataFrame) -> np.ndarray:
    """The shared probes that a chunk was told."""
    parts = [_unpack(x) for x in answers.loc[answers["kind"] == 0, "data"]]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, U)


def _marked(texts: list[bytes], answers: pd.DataFrame, block: int, window: int, buckets: int) -> dict[int, list[np.ndarray]]:
    """The shared windows of each text of a chunk, by their first words."""
    known = _known(answers)
    if not len(known):
        return {}
    runs, places = _runs(texts, known, block, window)
    bits = {int(b): np.unpackbits(np.frombuffer(d, np.uint8)) for b, d in answers.loc[answers["kind"] == 1, ["bucket", "data"]].itertuples(index=False)}
    of = _bucket(np.array([p for p, _ in runs], U), buckets)
    out: dict[int, list[np.ndarray]] = {}
    at = dict.fromkeys(bits, 0)
    for run, b in zip(runs, of.tolist(), strict=True):
        n = run[1].count(b" ") + 2 - window
        good = np.flatnonzero(bits[b][at[b] : at[b] + n])
        at[b] += n
        for text, first in places[run]:
            out.setdefault(text, []).append(first + good)
    return out


def repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``
    ``n_repeats`` (runs of shared windows) and, unless ``with_text`` is off,
    ``kept_text`` (kept words joined by one space).

    A word goes if a window of ``window`` words covers it whose words also
    start anywhere else, in the same row too; all copies lose it, overlapping
    starts count as different ones, and windows are judged on the input. Null
    and empty texts have no words; null ids are kept as they are; repeated rows
    are different places, so both lose shared windows. Ids have to be integers
    or null. Other columns are ignored. An empty table gives no rows.
    """
    block = (window + 1) // 2
    chunks = chunk_count(docs)
    buckets = max(shuffle_partitions(docs.sparkSession), chunks // 4)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    salt = ["doc_id", F.length("text")]
    if ambiguous(base, "doc_id"):  # rows that an id doesn't tell apart are numbered once, and dealt by that
        base = staged(base.withColumn("salt", F.monotonically_increasing_id()), "op3-rows")
        salt.append("salt")
    base = base.select("doc_id", "text", F.pmod(F.xxhash64(*salt), F.lit(chunks)).cast("long").alias("chunk"))
    columns = ["bucket", "chunk", "data", "flags"]

    def probes(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys, flags = _asked(_texts(pdf), block)
        of = _bucket(keys << _SHIFT, buckets)
        rows = [(int(of[a]), int(key[0]), _pack(keys[a:b]), np.packbits(flags[a:b].T.ravel()).tobytes()) for a, b in _cuts(of)]
        return pd.DataFrame(rows, columns=columns)

    def candidates(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(answers):
            return pd.DataFrame([], columns=columns)
        runs, places = _runs(_texts(pdf), _known(answers), block, window)
        probes = np.array([p for p, _ in runs], U)
        of, rows = _bucket(probes, buckets), []
        for a, b in _cuts(of):
            data = (b - a).item().to_bytes(8, "little") + probes[a:b].tobytes() + b"\n".join(t for _, t in runs[a:b])
            rows.append((int(of[a]), int(key[0]), data, np.packbits([len(places[r]) > 1 for r in runs[a:b]]).tobytes()))
        return pd.DataFrame(rows, columns=columns)

    out_cols = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_repeats long" + ", kept_text string" * with_text

    def removed(key: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows, texts = [], _texts(pdf)
        marks = _marked(texts, answers, block, window, buckets) if len(answers) else {}
        for n, (doc, t) in enumerate(zip(pdf["doc_id"], texts, strict=True)):
            # bytes.split() also separates at no other byte than the six of the contract
            parts, repeats = t.split(), 0
            kept = parts
            if n in marks:
                at = np.unique(np.concatenate(marks[n]))
                repeats = 1 + int((np.diff(at) > 1).sum()) if len(at) else 0
                step = np.zeros(len(parts) + 1, np.int32)
                step[at] += 1
                np.subtract.at(step, at + window, 1)
                kept = [p for p, g in zip(parts, np.cumsum(step[:-1]) > 0, strict=True) if not g]
            data = b" ".join(kept)
            rows.append((doc, len(parts), len(parts) - len(kept), hashlib.sha256(data).hexdigest(), repeats, *([data.decode("utf-8", "surrogatepass")] if with_text else [])))
        out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "n_repeats", *(["kept_text"] if with_text else [])])
        return out.astype({"doc_id": "Int64"})

    sent, got = "bucket long, chunk long, data binary, flags binary", "chunk long, bucket long, kind int, data binary"
    by = base.groupBy("chunk")
    shared = by.applyInPandas(probes, sent).groupBy("bucket").applyInPandas(_shared, got)
    asked = by.cogroup(shared.groupBy("chunk")).applyInPandas(candidates, sent)
    told = asked.groupBy("bucket").applyInPandas(lambda pdf: _compared(pdf, window), got)
    return by.cogroup(shared.unionAll(told).groupBy("chunk")).applyInPandas(removed, out_cols)
