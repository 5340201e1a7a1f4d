"""What the training-data operators share: shared scratch tables, partition counts, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and U+0009..U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where it is unset (tests, local mode)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="lithograin-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


#: Scratch tables that still exist, with the session that wrote them.
_LIVE: dict[str, SparkSession] = {}


def stash(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df into the shared folder (in folders by a column) and reads it back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lithograin/{name}-{uuid.uuid4().hex}"
    _LIVE[path] = spark
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    context = spark.sparkContext._jsc
    at.getFileSystem(context.hadoopConfiguration() if context else spark._jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def unstash(*dfs: DataFrame, part: str = "") -> None:
    """Deletes scratch tables (or one folder of theirs) that no later plan reads."""
    for df in dfs:
        _delete(df.sparkSession, f"{df._stash_path}/{part}".rstrip("/"))
        if not part:
            _LIVE.pop(df._stash_path, None)


def scratch() -> frozenset[str]:
    """The scratch tables there are now, for sweep."""
    return frozenset(_LIVE)


def sweep(before: frozenset[str], *keep: DataFrame) -> None:
    """Deletes the scratch tables made since before, but for those that a returned plan still reads (keep)."""
    kept = {df._stash_path for df in keep}
    for path in [p for p in _LIVE if p not in before and p not in kept]:
        _delete(_LIVE.pop(path), path)


@atexit.register
def _sweep_all() -> None:
    """What returned plans read goes when the driver ends; a JVM that has ended already leaves it to the cluster's cleaning."""
    with contextlib.suppress(Exception):
        sweep(frozenset())


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files whose plans are no longer referenced. The listener bus may hold the last
    query until it has told of its end, so a second round follows."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def trim() -> None:
    """Gives memory that earlier tasks of this Python worker have freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def parts(spark: SparkSession) -> int:
    """Blocks, owners and buckets follow spark.sql.shuffle.partitions, which the cluster sets to fit the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, comp), comp the smallest node; nodes without edges are absent.

    Minimum-label propagation over both edge directions with pointer jumping; each round is written to the
    shared folder, so lineage stays short. Nothing but a count of changed labels reaches the driver.
    """
    both = stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")), name)
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        new = stash(
            labels.join(near, "node").join(jump, "comp", "left")
            .select("node", F.least("comp", "near", F.coalesce("root", "comp")).alias("comp"), F.col("comp").alias("was")),
            name,
        )
        changed = new.filter("comp <> was").limit(1).count()
        unstash(labels)
        labels = new
        if not changed:
            unstash(both)
            return labels.select("node", "comp")
