"""What the operators of this subpackage share: shared folders, written tables, sizes, packed arrays."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by ``spark.checkpoint.dir``.

    Only a local session (as in tests) may leave it unset and gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="mnemospark-"))
    return path.rstrip("/")


#: Spark's setting that removes a query's shuffle files when the query ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: dict[str, list] = {}
_lock = threading.Lock()


@contextlib.contextmanager
def _cleaning_up(spark: SparkSession):
    """CLEAN_UP is on while any thread of the application writes, and afterwards as it was before the first."""
    app = spark.sparkContext.applicationId
    with _lock:
        state = _writing.setdefault(app, [0, None])
        if not state[0]:
            state[1] = spark.conf.get(CLEAN_UP, "false")
        state[0] += 1
        spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(CLEAN_UP, state[1])


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    What was written replaces the shuffle files that led to it, so these go when the write ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _cleaning_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``written``, in buckets by the key: joins on it later shuffle only their other side."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _cleaning_up(spark):
        df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out._folder, out._table = path, table
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``written`` and ``bucketed`` wrote, once all that reads it has been written itself."""
    for df in frames:
        spark = df.sparkSession
        if table := getattr(df, "_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def has_repeats(df: DataFrame, key: str) -> bool:
    """Whether a key is null or occurs twice."""
    return not df.groupBy(F.col(key).alias("key")).count().where("key is null or count > 1").isEmpty()


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, from file sizes where df reads files; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def text_bytes(df: DataFrame, text: str) -> int:
    """About the bytes of df: Catalyst's estimate, or the text's own sum where Catalyst has none."""
    found = input_bytes(df)
    return found if found < 1 << 50 else df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def crc_fold(key: str = "doc_id", folds: int = 5):
    """crc32 of the key as text, modulo folds."""
    return F.crc32(F.col(key).cast("string")) % F.lit(folds)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Groups of at least 1/HOT_GROUPS of the rows: there are at most so many of them.
HOT_GROUPS = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with the one row that groups has for each key; size: the column of rows for a key.

    Keys with at least 1/HOT_GROUPS of the total rows go by broadcast (at most HOT_GROUPS short rows); no
    other key has more than that share, so none fills a task of the shuffled join.
    """
    least = max(2, -(-total // HOT_GROUPS))
    hot = F.broadcast(groups.where(F.col(size) >= least))
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(groups.where(F.col(size) < least), on))


#: Stands for a null key inside an operator; it is larger than any other.
NO_KEY = (1 << 63) - 1


def keyed(key: str) -> Column:
    """A long key for packed columns."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))


def unkeyed(name: str) -> Column:
    """The key again, null where it was."""
    return F.when(F.col(name) != NO_KEY, F.col(name)).alias(name)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among gone, which has one row for each key.

    gone grows with the rows, so it is never broadcast, at no size: both sides are dealt by the key, and only the
    keys of gone are held in memory.
    """
    return rows.join(gone.hint("shuffle_hash"), key, "left_anti")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (its least node) for every node of the edges u, v: large-star and small-star rounds.

    Each round is written to the shared folder; degrees are folded by partial aggregation.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    before = last = None
    while True:
        e = written(e, name)
        if last is not None:
            discard(last)
        last = e
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u")
        e = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
