"""Line dedup: a suffix array over line ids by distributed prefix doubling
(DataFrame operations only).

Each non-blank line is a 128-bit id (two 64-bit hashes; lines are equal if these
are). The rank of a suffix by its first line is the position of that id among
all ids; doubling then ranks pairs (rank at i, rank at i + k) by a global sort,
until no suffix shares its rank. Suffixes of one rank after ``d`` lines form an
interval of the suffix array whose longest common prefix is at least ``d``. A
suffix whose rank is its own is settled and leaves the work.

The ranks of a level that two neighbours in the suffix array share bound their
longest common prefix between two powers of two; the suffixes that follow these
lines tell the rest. A suffix whose longest common prefix isn't covered by that
of its predecessor starts a maximal repeated run. Of each interval of depth
``min_lines`` the earliest place stays, and the lines of all later copies go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ambiguous, dropped, joined, sha256, staged

MIN_LINES = 2
#: Characters from which on one repeated line is a run by itself.
ONE_LINE = 100
_ENDS = " \t\n\x0b\x0c\r"


def line_rows(docs: DataFrame) -> DataFrame:
    """``doc, pos, seq, chars, h1, h2``: each non-blank line with its place in the
    document (pos: among all lines, seq: among non-blank ones, from 1), its
    length without white space at its ends, and its id."""
    cut = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(_ENDS)).alias("line")))
    rows = docs.select("doc", F.posexplode(F.filter(cut, lambda x: x["line"] != "")).alias("place", "x"))
    line = F.col("x.line")
    return rows.select("doc", "x.pos", (F.col("place") + 1).alias("seq"), F.length(line).alias("chars"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def _keyed(rows: DataFrame, keys: list[str], least: int) -> tuple[DataFrame, int, int]:
    """For each key that ``least`` rows hold: its place in a global sort
    (``rank``), the earliest place in the corpus (``first``) and how many rows
    hold it (``c``, ``times``); how many rows these are, and how many of them
    share a key. Keys are counted on the map side; the sort is over distinct
    keys only."""
    out = rows.groupBy(*(F.col(k).alias(f"k_{k}") for k in keys)).agg(F.count("*").alias("c"), F.min(F.struct("doc", "seq")).alias("first")).where(F.col("c") >= least)
    out = out.orderBy(*(f"k_{k}" for k in keys)).withColumn("rank", F.monotonically_increasing_id()).withColumn("times", F.col("c"))
    out = staged(out, "op5-keys")
    total, shared = out.agg(F.sum("c"), F.sum(F.when(F.col("c") > 1, F.col("c")))).first()
    return out, total or 0, shared or 0


_SUFFIX = ("doc", "seq", "path", "first", "times")


def suffix_levels(lines: DataFrame) -> list[DataFrame]:
    """The suffix array of ``lines`` (staged) by prefix doubling, level by level.

    The j-th table has ``doc, seq, path, first, times`` for the suffixes that
    share 2**(j - 1) lines (the 0-th: one line, with ``pos, chars``): ``times`` of
    them share 2**j lines, ``first`` is the earliest of these, and ``path`` has
    the ranks of all levels so far. Paths sort as the suffixes do. Suffixes of which there is one
    are settled: the later tables don't have them, and the last has no other.
    """
    keys, total, shared = _keyed(lines, ["h1", "h2"], 2)
    table = joined(lines, keys, {"h1": "k_h1", "h2": "k_h2"}, total).withColumn("path", F.array("rank")).select("pos", "chars", *_SUFFIX)
    levels = [staged(table, "op5-suffixes")]
    dropped(keys)
    while shared:
        step = 1 << (len(levels) - 1)
        here = levels[-1].where("times > 1").select("doc", "seq", "path", F.element_at("path", -1).alias("rank0"))
        ahead = levels[-1].select(*_SUFFIX)
        for x in levels[1:-1]:
            ahead = ahead.unionAll(x.where("times = 1"))
        ahead = ahead.select(F.col("doc").alias("d"), (F.col("seq") - step).alias("s"), F.col("path").alias("next"))
        pairs = staged(here.join(ahead, (here["doc"] == ahead["d"]) & (here["seq"] == ahead["s"]), "left").drop("d", "s"), "op5-pairs")
        able = pairs.where("next IS NOT NULL")
        keys, total, shared = _keyed(able, ["rank0", "next"], 1)
        ranked = joined(able, keys, {"rank0": "k_rank0", "next": "k_next"}, total)
        # what follows is the end of the document or a line found nowhere else
        ends = pairs.where("next IS NULL").withColumn("rank", -1 - F.monotonically_increasing_id()).withColumn("first", F.struct("doc", "seq")).withColumn("times", F.lit(1).cast("long"))
        grown = F.concat("path", F.array("rank")).alias("path")
        cols = [grown if c == "path" else c for c in _SUFFIX]
        levels.append(staged(ranked.select(*cols).unionAll(ends.select(*cols)), "op5-suffixes"))
        dropped(keys)
        dropped(pairs)
    return levels


def prefix_lengths(levels: list[DataFrame]) -> DataFrame:
    """``doc, seq, lcp``: for each suffix that shares a line, the longest common
    prefix with its neighbours in the suffix array, so with any other suffix.

    Ranks that two neighbours have in common tell the largest power of two of
    lines that they share; what is left is told by the suffixes that follow
    these lines, and so on: what may be left halves with each round."""
    every = levels[0].where("false").select(*_SUFFIX)
    for x in levels[1:]:
        every = every.unionAll(x.where("times = 1"))
    part, row = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")
    every = staged(every.select("doc", "seq", "path").orderBy("path").select("doc", "seq", "path", part, row), "op5-array")
    # a number for each partition of the sort: the places before it
    sizes = {r["part"]: r["count"] for r in every.groupBy("part").count().collect()}
    bases = [0]
    for p in range(max(sizes, default=0)):
        bases.append(bases[-1] + sizes.get(p, 0))
    at = every.select("doc", "seq", "path", (F.get(F.lit(bases), "part") + F.col("row").bitwiseAND((1 << 33) - 1)).alias("at"))
    same = F.size(F.filter(F.zip_with("path", "path2", lambda x, y: x == y), lambda x: x))
    after = at.select(F.col("doc").alias("doc2"), F.col("seq").alias("seq2"), F.col("path").alias("path2"), (F.col("at") - 1).alias("before"))
    now = at.join(after, at["at"] == after["before"]).withColumn("m", same).where("m > 0").withColumn("lcp", F.lit(0))
    grown = (F.col("lcp") + F.expr("shiftleft(1, m - 1)")).alias("lcp")
    parts = [staged(now.select("doc", "seq", "doc2", "seq2", "m", grown), "op5-lcp")]
    one = every.select(F.col("doc").alias("d"), F.col("seq").alias("s"), "path")
    two = every.select(F.col("doc").alias("d2"), F.col("seq").alias("s2"), F.col("path").alias("path2"))
    while not (now := parts[-1].where("m > 1")).isEmpty():
        # a suffix without a row shares nothing, and its pair stays as it is
        now = now.drop("m").join(one, (F.col("doc") == one["d"]) & (F.col("seq") + F.col("lcp") == one["s"]))
        now = now.join(two, (F.col("doc2") == two["d2"]) & (F.col("seq2") + F.col("lcp") == two["s2"])).withColumn("m", same).where("m > 0")
        parts.append(staged(now.select("doc", "seq", "doc2", "seq2", "m", grown), "op5-lcp"))
    pairs = parts[0]
    for x in parts[1:]:
        pairs = pairs.unionAll(x)
    both = pairs.select("doc", "seq", "lcp").unionAll(pairs.select("doc2", "seq2", "lcp"))
    out = staged(both.groupBy("doc", "seq").agg(F.max("lcp").alias("lcp")), "op5-lengths")
    for x in [every, *parts]:
        dropped(x)
    return out


def maximal_runs(prefixes: DataFrame) -> DataFrame:
    """``doc, seq, lcp``: the maximal repeated runs, those of ``prefixes`` that
    the run of the line before doesn't reach to the end of."""
    before = prefixes.select(F.col("doc").alias("d"), (F.col("seq") + 1).alias("s"), (F.col("lcp") - 1).alias("least"))
    cond = (prefixes["doc"] == before["d"]) & (prefixes["seq"] == before["s"]) & (prefixes["lcp"] <= before["least"])
    return prefixes.join(before, cond, "left_anti")


def intervals(levels: list[DataFrame], depth: int) -> DataFrame:
    """``doc, seq, first`` of the suffixes in an interval of at least ``depth``
    lines, with the interval's earliest place. A depth between two powers of two
    takes the rank of two overlapping runs of the lesser one."""
    j = depth.bit_length() - 1
    if j >= len(levels):
        return levels[-1].select("doc", "seq", "first").where("false")
    here = levels[j].where("times > 1")
    if depth == 1 << j:
        return here.select("doc", "seq", "first")
    rank = F.element_at("path", j + 1)
    ahead = here.select(F.col("doc").alias("d"), (F.col("seq") - (depth - (1 << j))).alias("s"), rank.alias("b"))
    here = here.select("doc", "seq", rank.alias("a"))
    pairs = staged(here.join(ahead, (here["doc"] == ahead["d"]) & (here["seq"] == ahead["s"])).select("doc", "seq", "a", "b"), "op5-pairs")
    keys, total, _ = _keyed(pairs, ["a", "b"], 2)
    return joined(pairs, keys, {"a": "k_a", "b": "k_b"}, total).select("doc", "seq", "first")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, one_line: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, kept_text, n_runs,
    longest_run``.

    A line goes if it lies in a run of at least ``min_lines`` consecutive
    non-blank lines whose sequence also starts at an earlier place (smaller id,
    or earlier in the same document); with ``one_line``, also if it has that many
    characters and occurs at an earlier place by itself. ``n_runs`` counts the
    maximal repeated runs of ``min_lines`` or more that start in the document,
    earliest places included, and ``longest_run`` has the lines of the longest (0: none).

    Lines are compared by 128-bit hashes, without white space at
    their ends; blank lines count for nothing and always stay. Null text is
    empty and has no lines. Where ids are missing or repeated, a document is an
    id and a text: rows that repeat both are judged as one, rows of one id with
    different texts are judged each, null ids sort last. Other columns are
    ignored. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    unclear = ambiguous(base, "doc")
    if unclear:
        base = base.select(F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("id"), F.xxhash64("text").alias("hash")).alias("doc"), "text")
    places = staged(line_rows(base.dropDuplicates(["doc"]) if unclear else base), "op5-lines")
    levels = suffix_levels(places)
    prefixes = prefix_lengths(levels)
    found = maximal_runs(prefixes).where(F.col("lcp") >= min_lines).groupBy(F.col("doc").alias("fdoc")).agg(F.count("*").alias("n_runs"), F.max("lcp").cast("long").alias("longest_run"))
    found = staged(found, "op5-runs")
    later = intervals(levels, min_lines).where(F.struct("doc", "seq") > F.col("first"))
    marks = later.select("doc", F.explode(F.sequence("seq", F.col("seq") + (min_lines - 1))).alias("mseq"))
    if one_line is not None:
        marks = marks.unionAll(levels[0].where((F.struct("doc", "seq") > F.col("first")) & (F.col("chars") >= one_line)).select("doc", F.col("seq").alias("mseq")))
    # every line of a shared run starts a suffix of the first level
    pos = staged(levels[0].select("doc", "pos", "seq").alias("p").join(marks.distinct().alias("m"), F.expr("p.doc = m.doc AND p.seq = m.mseq")).select("p.doc", "p.pos"), "op5-marks")
    order = Window.partitionBy("doc").orderBy("pos")
    runs = pos.withColumn("run", F.col("pos") - F.row_number().over(order)).groupBy("doc", "run").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"))
    runs = runs.groupBy(F.col("doc").alias("rdoc")).agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"), F.sum(F.col("e") - F.col("s")).alias("gone"))
    runs = found.join(runs, found["fdoc"] == runs["rdoc"], "full").select(F.coalesce("fdoc", "rdoc").alias("rdoc"), "runs", "gone", "n_runs", "longest_run")
    for x in [places, prefixes, *levels]:
        dropped(x)
    lines = F.split("text", "\n")
    flags = F.concat(
        F.flatten(F.transform("runs", lambda r, i: F.concat(
            F.array_repeat(F.lit(0), r["s"] - F.coalesce(F.when(i > 0, F.get(F.col("runs"), i - 1)["e"]), F.lit(0))),
            F.array_repeat(F.lit(1), r["e"] - r["s"]),
        ))),
        F.array_repeat(F.lit(0), F.size(lines) - F.element_at("runs", -1)["e"]),
    )
    kept = F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("line"), flags.alias("flag")), lambda x: x["flag"] == 0), lambda x: x["line"]), "\n")
    joined = base.join(runs, base["doc"] == runs["rdoc"], "left")
    n = F.when(F.coalesce("text", F.lit("")) == "", F.lit(0)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return joined.select(
        F.col("doc.id" if unclear else "doc").alias("doc_id"), n.cast("long").alias("n_lines"), F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("runs").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept_text"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"), F.coalesce("longest_run", F.lit(0)).cast("long").alias("longest_run"),
    )


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_lines", "n_removed", sha256(F.col("kept_text")).alias("kept_sha256"), "n_runs", "longest_run")
