"""Where operators of this subpackage cut lineage, and connected components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it names none, a local session, as in tests, gets a folder of its own that goes when
    Python ends; on a cluster that is an error, as other machines wouldn't see the folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate rows, wherever it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder; an executor that is lost later takes nothing with it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the least node.

    Alternates large and small stars (Kiveris et al., 2014): the number of rounds grows with
    the logarithm of the longest path, and a hub costs one row for each neighbour.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = _mark(now)
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star = both.withColumn("m", F.least("u", F.min("v").over(W.partitionBy("u")))).filter("v > u")
        large = star.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.withColumn("m", F.min("v").over(W.partitionBy("u")))
        small = least.select("u", F.col("m").alias("v")).union(least.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v")
        now = saved(small.distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
