"""Exact dedup by deterministic block naming (DataFrame operations only).

A normalised text is cut into fixed-size blocks. The distinct blocks are sorted
into integer names; then adjacent pairs of names are named in turn, until each
document has a single integer. Two documents of the same length have the same
integer exactly if their texts are equal: names stand for contents, not for
hashes, so nothing can collide.

Blocks are dealt and sorted by a hash, and each hash carries the least and the
greatest block that has it. Where these are the same text, the hash stands for
that one block of the whole corpus, and rows get its name by the hash alone, so
texts move once. Blocks that share a hash are named, and joined, by content.
Each level of names is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ambiguous, dropped, joined, sha256, squeezed, staged

#: Characters in a block.
BLOCK = 4096


def _block_names(cut: DataFrame, total: int) -> DataFrame:
    """``row, left, idx, name`` for each block of ``cut`` (row, hashes, blocks)."""
    at = cut.select("row", F.size("hashes").alias("left"), F.posexplode("hashes").alias("idx", "h"))
    texts = cut.select(F.explode(F.arrays_zip("hashes", "blocks")).alias("x")).select(F.col("x.hashes").alias("h"), F.col("x.blocks").alias("block"))
    one = texts.groupBy("h").agg(F.count("*").alias("c"), F.min("block").alias("low"), F.max("block").alias("high"))
    one = one.sortWithinPartitions("h").select(F.col("h").alias("nh"), "c", (F.col("low") == F.col("high")).alias("alone"), F.monotonically_increasing_id().alias("name"))
    one = staged(one, "op1-names")
    level = joined(at, one.where("alone").drop("alone"), {"h": "nh"}, total).drop("nh", "h")
    odd = one.where("NOT alone").select("nh")
    if not odd.isEmpty():
        full = cut.select("row", F.size("hashes").alias("left"), F.posexplode(F.arrays_zip("hashes", "blocks")).alias("idx", "x"))
        full = full.select("row", "left", "idx", F.col("x.hashes").alias("h"), F.col("x.blocks").alias("block"))
        full = staged(full.join(odd, full["h"] == odd["nh"], "left_semi"), "op1-odd")
        more = full.groupBy("h", "block").agg(F.count("*").alias("c")).sortWithinPartitions("h", "block")
        # below zero, apart from the names of the others
        more = staged(more.select(F.col("h").alias("nh"), F.col("block").alias("nb"), "c", (-2 - F.monotonically_increasing_id()).alias("name")), "op1-names")
        level = level.unionAll(joined(full, more, {"h": "nh", "block": "nb"}, total).select("row", "left", "idx", "name"))
    return level


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, every_row: bool = False, hashed=F.xxhash64
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty. Of equal texts (after white-space squeezing) the
    smallest id stays; null ids sort last. Rows that repeat both id and text are
    one document, or with ``every_row`` one each. Ids may have any type that can
    be ordered. ``hashed`` deals out blocks; a poor one costs time, and changes
    no result. Other columns are ignored. An empty table gives no rows.
    """
    norm = F.col("norm")
    base = docs.select(F.col(id_col).alias("doc_id"), squeezed(F.col(text_col)).alias("norm"))
    blocks = F.when(norm == "", F.array(norm)).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    cut = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.length("norm").alias("n"), sha256(norm).alias("sha"), blocks.alias("blocks"))

    def each(b: Column) -> Column:
        return hashed(b).cast("long")

    cut = staged(cut.withColumn("hashes", F.transform("blocks", each)), "op1-blocks")
    size = cut.agg(F.max(F.size("hashes")), F.sum(F.size("hashes")), F.count("*")).first()
    width, total, n_rows = size[0] or 0, size[1] or 0, size[2]
    level = staged(_block_names(cut, total), "op1-level")
    done, old = [level.where("left = 1").select("row", "name")], [level]
    while width > 1:
        pairs = (
            level.where("left > 1")
            .groupBy("row", "left", F.floor(F.col("idx") / 2).cast("int").alias("idx"))
            .agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))).alias("b"))
            .withColumn("left", F.ceil(F.col("left") / 2).cast("int")).withColumn("b", F.coalesce("b", F.lit(-1)))
        )
        pairs = staged(pairs, "op1-pairs")
        names = pairs.groupBy("a", "b").agg(F.count("*").alias("c")).sortWithinPartitions("a", "b")
        names = staged(names.select(F.col("a").alias("na"), F.col("b").alias("nb"), "c", F.monotonically_increasing_id().alias("name")), "op1-names")
        level = staged(joined(pairs, names, {"a": "na", "b": "nb"}, pairs.count()).select("row", "left", "idx", "name"), "op1-level")
        old += [pairs, names, level]
        done.append(level.where("left = 1").select("row", "name"))
        width = -(-width // 2)
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionAll(x)
    same = cut.select("row", "doc_id", "n", "sha").join(whole, "row").select("doc_id", "n", "name", "sha")
    same = same if every_row else same.distinct()
    same = staged(same, "op1-ids")
    for x in [*old, cut]:
        dropped(x)
    groups = same.groupBy(F.col("n").alias("gn"), F.col("name").alias("gname")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.count("*").alias("c"))
    return joined(same, staged(groups, "op1-groups"), {"n": "gn", "name": "gname"}, n_rows).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the later copies of a text.

    Where ids are missing or repeated, a row is named by its id and text: rows
    of one id with different texts are judged each, null ids sort last, and of
    rows that repeat both id and text one stays. Empty tables stay empty.
    """
    gone = exact_groups(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha"))
    if not ambiguous(docs, id_col):
        return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    rows = docs.withColumn("_sha", sha256(squeezed(F.col(text_col))))
    left = rows.join(gone, rows[id_col].eqNullSafe(gone["_gone"]) & (rows["_sha"] == gone["_gone_sha"]), "left_anti")
    return left.dropDuplicates([id_col, "_sha"]).drop("_sha")
