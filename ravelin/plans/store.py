"""Where plans cut their lineage, and how small inputs are spread."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame

#: An input of fewer bytes is spread over all cores: its file may have one row group, which one task reads.
SPREAD_BYTES = 256 << 20


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared folder that the session names in spark.checkpoint.dir.

    Where it names none, a local session gets a folder of its own that goes when Python ends;
    on a cluster that is an error, as other machines wouldn't see the folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, read: DataFrame | None = None) -> DataFrame:
    """The rows by hash of the keys over all cores, if what Spark reads for them (``read``, or themselves) is small; larger inputs have row groups enough and aren't shuffled."""
    size = int(str((read or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if size < SPREAD_BYTES else df
