"""Token counts: separator scan over flat, unindexed token files.

A token file is little-endian ids one after another, each document closed by
an end-of-document id; nothing says where documents begin. A file is cut into
blocks without regard to them. Each block is searched at once for the
separator, which gives the tokens before its first one, the lengths between,
and the tokens after its last. A prefix scan over these summaries (block, then
groups of blocks, then back) stitches the documents that cross block
boundaries and numbers them, so neither a file nor a document must fit a task.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, staged

#: Tokens in a block; blocks in a group of the scan.
BLOCK = 1 << 20
GROUP = 1024
#: Different units whose ids a worker remembers; longer ones aren't kept.
CACHE = 400_000
LONGEST = 64
#: Places of the table that notes a unit's first batch. Most units of a corpus
#: come once, so a unit is remembered when it comes in a second batch.
SEEN = 1 << 22
EOD = 50256
#: Units that are encoded as one string.
JOINED = 512


class _Known(dict):
    """Ids by unit; a unit that it lacks is noted and given as None."""

    def __init__(self):
        self.new: set[str] = set()

    def __missing__(self, unit: str) -> None:
        self.new.add(unit)


class Encoder:
    """Ids of a public byte-level BPE vocabulary, by the ``tokenizers`` library.

    Text is encoded in units, what lies between single spaces: this
    pre-tokenizer always joins such a space to what follows, so units don't
    touch and their ids, with those of the space before, can be remembered. A
    text's first unit has no space before it and is told apart by a NUL. Texts
    with a NUL, or a space before other white space or at their end, are
    encoded whole. With ``special`` the names of added tokens in a text are
    those tokens, as in a plain call, and texts that hold one are encoded whole.
    """

    def __init__(self, path: str, dtype: str = "<u4", special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.whole = Tokenizer.from_file(path)
        self.names = [a.content for a in self.whole.get_added_tokens_decoder().values()] if special else []
        self.dtype, self.known, self.seen = dtype, _Known(), bytearray(SEEN)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose first byte is a space
        self.opens[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True

    def _encode(self, units: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(units, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def _joined(self, units: list[str]) -> list[bytes]:
        """The ids of units that open and close with a word. Many are encoded
        as one string, where an id that opens with a space opens a unit."""
        rows = [" " + " ".join(units[at : at + JOINED]) for at in range(0, len(units), JOINED)]
        out = []
        for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            cuts = (np.flatnonzero(self.opens[ids]) * ids.itemsize).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
        return out

    def _units(self, units: set[str]) -> dict[str, bytes]:
        """The ids of units but those that open with white space. A single mark
        after a letter is always a token run of its own, so a word is encoded
        once with and without it."""
        if not units:
            return {}
        ends = {u: (u[:-1], u[-1]) for u in units if len(u) > 1 and u[-1] in ".," and u[-2].isalpha() and not u[0].isspace()}
        plain, other = [], ["\0.", "\0,"]
        for u in {u for u in units if u not in ends} | {w for w, _ in ends.values() if w not in self.known}:
            if u[0] == "\0" or u[-1].isspace() and not u[0].isspace():
                other.append(u)
            elif not u[0].isspace():
                plain.append(u)
        got = dict(zip(plain, self._joined(plain), strict=True))
        got.update(zip(other, self._encode([u[1:] if u[0] == "\0" else " " + u for u in other]), strict=True))
        for u, (w, mark) in ends.items():
            got[u] = (self.known[w] if w in self.known else got[w]) + got["\0" + mark]
        return got

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        known, out, cut = self.known, [], []
        for t in texts:
            if any(name in t for name in self.names):
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, self.dtype).tobytes())
                continue
            if "  " in t or "\0" in t or t.endswith(" "):
                out.append(self._encode([t])[0])
                continue
            units = t.split(" ")
            units[0] = "\0" + units[0]
            parts = list(map(known.__getitem__, units))
            if None in parts:
                cut.append((len(out), units, parts))
                out.append(b"")
            else:
                out.append(b"".join(parts))
        extra = self._units(known.new)
        for at, units, parts in cut:
            i = -1
            for _ in range(parts.count(None)):
                i = parts.index(None, i + 1)
                if units[i] not in extra:
                    out[at] = self._encode([texts[at]])[0]
                    break
                parts[i] = extra[units[i]]
            else:
                out[at] = b"".join(parts)
        known.new = set()
        if len(known) < CACHE:  # the commonest units come early and stay
            for u, b in extra.items():
                at = hash(u) % SEEN
                if self.seen[at] and len(u) <= LONGEST:
                    known[u] = b
                self.seen[at] = 1
        return out


_encoders: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, dtype: str = "<u4", special: bool = False) -> Encoder:
    """This worker's encoder, kept from task to task."""
    if (path, dtype, special) not in _encoders:
        _encoders[path, dtype, special] = Encoder(path, dtype, special)
    return _encoders[path, dtype, special]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def batched(texts: list[str], size: int = 1 << 20) -> Iterator[slice]:
    """Slices of ``texts`` of about ``size`` characters."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield slice(at, i + 1)
            at, total = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, vocab: str | None = None) -> DataFrame:
    """Write ``docs`` as flat token files (16-bit ids, each document closed by
    EOD) and return the manifest: ``file, n_tokens, docs`` with the ids of the
    documents of each file in their order.

    A task writes its own file under a name of its attempt; the manifest, which
    is committed by Spark, names only files of successful attempts. Null and
    empty texts are documents without tokens; null ids stay null.
    """
    spark = docs.sparkSession
    folder = path or new_path(spark, "op10-tokens")
    vocab = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocab, "<u2"), np.array([EOD], "<u2").tobytes()
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        n = TaskContext.get().partitionId()
        name = f"part-{n:06d}-{uuid.uuid4().hex}.bin"
        ids, size, out = [], 0, None
        try:
            for b in batches:
                texts = [t or "" for t in b.column(1).to_pylist()]
                ids += b.column(0).to_pylist()
                for s in batched(texts):
                    data = end.join(encode(texts[s])) + end
                    out = out or store.open_output_stream(f"{root}/{name}")
                    out.write(data)
                    size += len(data) // 2
        finally:
            if out is not None:
                out.close()
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "n_tokens", "docs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, "file string, n_tokens long, docs array<long>"), "op10-manifest")


def token_files(spark: SparkSession, path: str, dtype: str = "<u2") -> DataFrame:
    """``file, n_tokens`` of the files in a folder, by name and length only."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select(F.col("path").alias("file"), F.floor(F.col("length") / np.dtype(dtype).itemsize).cast("long").alias("n_tokens"))


def scan_counts(files: DataFrame, eod: int = EOD, dtype: str = "<u2", block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """``file, ordinal, n_tokens``: the tokens of each document of flat token
    files, without the closing id; ``ordinal`` counts from 0 in a file.

    Tokens after the last separator of a file are a last, unclosed document
    unless there are none. An empty file has no documents. The same file given
    twice is scanned once.
    """
    cuts = files.select("file", "n_tokens").where("n_tokens > 0").distinct()
    cuts = cuts.select("file", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / block).cast("long"))).alias("block"))
    cuts = cuts.repartition("file", "block")
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, n, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, where = _filesystem(file)
                with store.open_input_file(where) as f:
                    size = min(block, n - k * block)
                    ids = np.frombuffer(f.read_at(size * width, k * block * width), dtype)
                at = np.flatnonzero(ids == eod)
                lengths = np.diff(at) - 1
                head = int(at[0]) if len(at) else size
                tail = size - int(at[-1]) - 1 if len(at) else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), *(pa.array([v], pa.int64()) for v in (k, len(at), head, tail)), pa.array([lengths.tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "seps", "head", "tail", "inner"])

    blocks = staged(cuts.mapInArrow(run, "file string, block long, seps long, head long, tail long, inner array<long>"), "op10-blocks")
    # the scan: each summary is (separators, open tokens at the end); a block
    # without a separator adds to the open tokens, any other restarts them
    def scanned(rows: DataFrame, part: list[str], by: str) -> DataFrame:
        before = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        last = F.max(F.when(F.col("seps") > 0, F.col(by))).over(before)
        run_ = F.sum("open").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("sep0", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("last", last).withColumn("cum", run_)
        # open tokens since the block after the last one with a separator, and that one's tail
        base = F.max(F.struct(F.when(F.col("seps") > 0, F.col(by)).alias("k"), (F.col("cum") - F.col("open")).alias("c"))).over(before)
        rows = rows.withColumn("base", base)
        return rows.withColumn("open0", F.col("cum") - F.col("open") - F.when(F.col("last").isNull(), F.lit(0)).otherwise(F.col("base")["c"])).drop("last", "cum", "base")

    summary = blocks.select("file", "block", F.floor(F.col("block") / group).alias("grp"), "seps", "head", "tail")
    summary = summary.withColumn("open", F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("head")))
    local = scanned(summary, ["file", "grp"], "block")
    # a group's own summary comes from its last block
    ends = local.groupBy("file", "grp").agg(
        F.sum("seps").alias("seps"),
        F.max_by(F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("open0") + F.col("head")), "block").alias("open"))
    high = scanned(ends, ["file"], "grp").select(F.col("file").alias("f"), F.col("grp").alias("g"), F.col("sep0").alias("gsep"), F.col("open0").alias("gopen"))
    local = local.join(high, (local["file"] == high["f"]) & (local["grp"] == high["g"])).select(
        "file", "block", (F.col("sep0") + F.col("gsep")).alias("sep0"),
        (F.col("open0") + F.when(F.col("sep0") == 0, F.col("gopen")).otherwise(F.lit(0))).alias("open0"))
    local = local.select(F.col("file").alias("f"), F.col("block").alias("k"), "sep0", "open0")
    placed = blocks.join(local, (blocks["file"] == local["f"]) & (blocks["block"] == local["k"])).where("seps > 0")
    closed = placed.select("file", "sep0", F.posexplode(F.concat(F.array(F.col("open0") + F.col("head")), "inner")).alias("i", "n_tokens"))
    closed = closed.select("file", (F.col("sep0") + F.col("i")).alias("ordinal"), "n_tokens")
    tails = high.join(ends, (high["f"] == ends["file"]) & (high["g"] == ends["grp"])).select(
        "file", "grp", (F.col("gsep") + F.col("seps")).alias("ordinal"), F.when(F.col("seps") > 0, F.col("open")).otherwise(F.col("open") + F.col("gopen")).alias("n_tokens"))
    tails = tails.groupBy("file").agg(F.max_by("ordinal", "grp").alias("ordinal"), F.max_by("n_tokens", "grp").alias("n_tokens")).where("n_tokens > 0")
    return closed.unionAll(tails.select("file", "ordinal", "n_tokens"))


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_tokens`` for each row: documents are written as token files
    and counted by scanning those. Null and empty texts count 0; repeated rows
    are counted each; null ids stay; other columns are ignored."""
    manifest = write_token_files(docs, id_col, text_col, vocab=vocab)
    counts = scan_counts(manifest.select("file", "n_tokens"), block=block)
    ids = manifest.select("file", F.posexplode("docs").alias("pos", "doc_id"))
    ids = ids.select(F.col("file").alias("mfile"), F.col("pos").cast("long").alias("pos"), "doc_id")
    return ids.join(counts, (ids["mfile"] == counts["file"]) & (ids["pos"] == counts["ordinal"])).select("doc_id", "n_tokens")
