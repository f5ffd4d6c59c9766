"""Helpers shared by the training-data operators: scratch tables, splits and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BATCH_BYTES = 4 << 20
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a
    temporary folder is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(root)
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{root.rstrip('/')}/tickloom-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _roots[app])
    return _roots[app]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the session may be gone already
        pass


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of a staged table, wherever it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by ``BATCH_BYTES``, for good, as plans run after this returns.

    The default of 64 MB or 10,000 rows is held several times over by each JVM task and its Python worker.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Stage:
    """Tables written to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.base = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back; the plan starts anew from the files, and what was shuffled for them is deleted at once."""
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            if before is None:
                self.spark.conf.unset(FREE_SHUFFLES)
            else:
                self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has such a column (in any case)."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def split_words(text: Column) -> Column:
    """Array of the words of a text; empty for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def aggregate(df: DataFrame, keys: list[str], *values: Column) -> DataFrame:
    """df.groupBy(*keys).agg(*values), to be joined to other rows by the keys.

    A hash of the keys is grouped by as well, so that the result is not dealt by the keys alone. A
    join by them then has a plain exchange on both sides, and adaptive execution can split a hot
    key; after a groupBy by the keys it could not.
    """
    (extra,) = free_names(df, "_apart")
    return df.groupBy(*keys, (F.hash(*keys) % 2).alias(extra)).agg(*values).drop(extra)


def connected_components(stage: Stage, edges: DataFrame, tag: str, max_rounds: int = 40) -> DataFrame:
    """(id, comp) for all ids of ``edges`` (a, b longs): comp is the least id reachable.

    Alternating large-star and small-star steps (Kiveris et al., 2014): the number of rounds grows
    with the logarithm of the diameter. Least neighbours are aggregated map-side, and adaptive
    execution can split a hub where the edges are joined to them. Every round is a written table.
    """
    e = stage.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-0")
    last, before = f"{tag}-0", None
    for k in range(1, max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = aggregate(both, ["u"], F.least(F.min("v"), F.first("u")).alias("m"))
        large = stage.put(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{tag}-large")
        least = aggregate(large, ["u"], F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stage.put(small, f"{tag}-{k}")
        stage.drop(last, f"{tag}-large")
        last = f"{tag}-{k}"
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def long_schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])
