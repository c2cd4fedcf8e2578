"""Scans of files as they arrive: the operators of a file keep no state, the counts of a package do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ravelin.operators.risk import rank
from ravelin.plans.scan import FINDING, content_findings
from ravelin.sources.config import ScanConfig
from ravelin.sources.rules import Rule, builtin_rules

FILES = "package_id string, relative_path string, content string, size bigint, arrived timestamp"


def read_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of rows of files from Parquet as it is written under a path; the schema is FILES."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_findings(files: DataFrame, rules: list[Rule] | tuple[Rule, ...] | None = None, config: ScanConfig | None = None) -> DataFrame:
    """The findings of each file, once; no state."""
    limit = (config or ScanConfig()).max_file_size
    return content_findings(files.filter(F.col("size") <= limit), list(rules or builtin_rules())).filter("NOT suppressed").select(*FINDING)


def stream_verdicts(findings: DataFrame) -> DataFrame:
    """(package_id, n, verdict) so far; for output mode update or complete. The state is a row for each package."""
    worst = findings.groupBy("package_id").agg(F.count("*").alias("n"), F.max(rank()).alias("worst"))
    return worst.select("package_id", "n", F.when(F.col("worst") >= 3, "block").when(F.col("worst") >= 1, "flag").otherwise("pass").alias("verdict"))


def stream_arrivals(files: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, package_id, files, bytes) by time of arrival; a window is given out when the watermark has passed it, and its state dropped."""
    kept = files.withWatermark("arrived", late)
    return kept.groupBy(F.window("arrived", every), "package_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def write_findings(files: DataFrame, to: str, checkpoint: str, rules: list[Rule] | tuple[Rule, ...] | None = None) -> StreamingQuery:
    """Appends findings to Parquet, exactly once; ends when what is there has been read."""
    return stream_findings(files, rules).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
