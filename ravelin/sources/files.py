"""Packages in folders, as rows of files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.text import unix


def _text(content) -> F.Column:
    """UTF-8 text with \\n only; null where it isn't UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), unix(content.cast("string")))


def read_packages(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """(package_id, relative_path, content, size) of every file under ``root/<package>/``; files over max_bytes aren't read.

    Any file system that Spark reads; links aren't told apart there. See read_package for a local folder.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    inner = F.regexp_extract(F.col("path"), r"^[a-z]+:/+(.*)$", 1)
    rest = F.substring(inner, F.instr(inner, base.split(":", 1)[-1].strip("/") + "/") + len(base.split(":", 1)[-1].strip("/")) + 1, 1 << 20)
    content = _text(F.col("content")) if max_bytes is None else F.when(F.col("length") <= max_bytes, _text(F.col("content")))
    placed = files.select(F.url_decode(F.regexp_replace(rest, r"\+", "%2B")).alias("rest"), content.alias("content"), F.col("length").alias("size"))
    return placed.select(F.substring_index("rest", "/", 1).alias("package_id"), F.regexp_replace("rest", "^[^/]*/", "").alias("relative_path"), "content", "size")


def read_package(spark: SparkSession, folder: str | Path) -> DataFrame:
    """(package_id, relative_path, content, size, outside) of one local folder, with its links: a link that leaves it is ``outside`` and not read.

    The listing is the driver's; the contents are read where the rows are.
    """
    root = Path(folder)
    if not root.is_dir():
        raise NotADirectoryError(f"no such folder: {root}")
    real = root.resolve()
    rows = []
    for path in sorted(p for p in root.rglob("*") if not p.is_dir()):
        to = path.resolve()
        inside = to.is_relative_to(real)
        if not inside and not path.is_symlink():
            continue
        try:
            size = path.stat().st_size
        except OSError:
            size = 0
        rows.append((root.name, path.relative_to(root).as_posix(), os.fspath(path), size, not inside))
    listed = spark.createDataFrame(rows, "package_id string, relative_path string, path string, size bigint, outside boolean")

    def load(batches):
        for frame in batches:
            frame["content"] = [None if out else _read(p) for p, out in zip(frame["path"], frame["outside"], strict=True)]
            yield frame.drop(columns="path")

    return listed.mapInPandas(load, "package_id string, relative_path string, size bigint, outside boolean, content string")


def _read(path: str) -> str | None:
    try:
        return Path(path).read_text("utf-8")
    except (OSError, UnicodeDecodeError):
        return None
