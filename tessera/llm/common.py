"""What the corpus operators share: the shared folder, staged tables, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every contract of this subpackage (fixed value).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of compressed input that one Python chunk should hold.
CHUNK_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.
    Only where it is unset and all runs on one machine (tests in local mode) a
    temporary one is chosen; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again. This cuts the
    lineage: a lost executor costs only the reading of a file."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Texts of an Arrow batch that a worker holds as Python strings at a time.
ROWS = 512


def slices(column) -> Iterator[list[str | None]]:
    """The values of an Arrow column, some rows at a time."""
    for at in range(0, len(column), ROWS):
        yield column.slice(at, ROWS).to_pylist()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int | None:
    """Bytes that the sources of ``df`` hold (file sizes for a scan); None
    where one doesn't tell. What Catalyst guesses for a join is left out."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= 1 << 60 for s in sizes) else sum(sizes)


def chunk_count(df: DataFrame) -> int:
    """Chunks of bounded size for grouped Python work: it grows with the input,
    so that the memory of a chunk doesn't. A source of unknown size is taken to
    fill the session's shuffle partitions with some chunks each."""
    size, parts = input_bytes(df), shuffle_partitions(df.sparkSession)
    return 4 * parts if size is None else max(parts, -(-size // CHUNK_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ambiguous(docs: DataFrame, id_col: str) -> bool:
    """Whether an id is missing or occurs twice, so that it doesn't name a row.
    Ids alone are read, and counted on the map side first."""
    ids = docs.groupBy(F.col(id_col).alias("_id")).count()
    return not ids.where("count > 1 OR _id IS NULL").isEmpty()


def squeezed(text: Column) -> Column:
    """Null as empty, every run of separators as one space. A single space, by
    far the most frequent run, is one already and isn't touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: Keys that hold more than 1 / HOT of all rows (so HOT at most) are broadcast.
HOT = 1024


def joined(rows: DataFrame, names: DataFrame, keys: dict[str, str], total: int) -> DataFrame:
    """``rows`` with the columns of ``names``: an inner join on ``keys`` (column
    of rows: column of names) where ``names`` has one row a key, and its column
    ``c`` says how many of the ``total`` rows hold that key.

    The counts add up to ``total``, so fewer than ``HOT`` keys can exceed
    ``total / HOT``: these go to the rows by broadcast, whatever the size of the
    corpus. No other key fills a task of the shuffled join. ``rows`` is read
    twice and should be staged.
    """
    def meet(side: DataFrame) -> Column:
        return reduce(and_, [rows[a] == side[b] for a, b in keys.items()])

    hot = F.col("c") * HOT > total
    often, seldom = names.where(hot).drop("c"), names.where(~hot).drop("c")
    taken = rows.join(F.broadcast(often), meet(often))
    return taken.unionAll(rows.join(F.broadcast(often.select(*keys.values())), meet(often), "left_anti").join(seldom, meet(seldom)))
