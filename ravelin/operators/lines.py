"""Lines of files, their fences, and sequences over them as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.functions.anchors import anchors
from ravelin.functions.stages import ANSWER, QUESTION, STAGE_PATTERNS, STAGES, WINDOW
from ravelin.functions.text import lines as split_lines
from ravelin.sources.rules import JAVA

FILE = ("package_id", "relative_path")


def explode_lines(files: DataFrame, text: str = "content", keys: tuple[str, ...] = FILE) -> DataFrame:
    """(keys, line_no, line), from 1; a null text has no lines, an empty one has one."""
    return files.select(*keys, F.posexplode(split_lines(text)).alias("pos", "line")).select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


def _by(keys: tuple[str, ...]):
    return W.partitionBy(*keys).orderBy("line_no")


def with_fences(lines: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """Adds fence (the line opens or closes one), in_fence and safe (in a fence, or a comment).

    What a line is by itself is known before the window, so that a plan that doesn't want the
    lines doesn't shuffle them.
    """
    bare = F.trim(F.regexp_replace("line", r"^\s+", ""))
    marked = lines.withColumn("fence", bare.startswith("```")).withColumn("comment", bare.startswith("#") | bare.startswith("//"))
    on = F.sum(F.col("fence").cast("int")).over(_by(keys)) % 2 == 1
    inside = marked.withColumn("in_fence", on & ~F.col("fence"))
    return inside.withColumn("safe", F.col("in_fence") | (~F.col("fence") & F.col("comment"))).drop("comment")


def exchanges(turns: DataFrame, kind: Column, keys: tuple[str, ...], order: str) -> DataFrame:
    """(keys, pairs, first): answers that follow a question, and the place of the first question; kind is Q, A or null."""
    said = turns.select(*keys, F.col(order).alias("at"), kind.alias("kind")).filter("kind IS NOT NULL")
    before = F.lag("kind").over(W.partitionBy(*keys).orderBy("at"))
    return (
        said.withColumn("before", before)
        .groupBy(*keys)
        .agg(F.sum(F.when((F.col("kind") == "A") & (F.col("before") == "Q"), 1).otherwise(0)).alias("pairs"), F.min(F.when(F.col("kind") == "Q", F.col("at"))).alias("first"))
    )


def line_kind() -> Column:
    return F.when(F.col("line").rlike(JAVA + "(?i)" + QUESTION), "Q").when(F.col("line").rlike(JAVA + "(?i)" + ANSWER), "A")


def stage_mask(line: Column | str = "line") -> Column:
    """Bit k for the stage STAGES[k] of a compound attack. A line meets a regular expression only if it holds a text that any match must."""
    line = F.col(line) if isinstance(line, str) else line
    mask = F.lit(0)
    for k, stage in enumerate(STAGES):
        told = line.rlike(JAVA + "(?i)(?:" + "|".join(STAGE_PATTERNS[stage]) + ")")
        texts = [anchors("(?i)" + p) for p in STAGE_PATTERNS[stage]]
        if None not in texts:
            near = F.lit(False)
            for t in sorted(set().union(*texts)):
                near = near | F.lower(line).contains(t)
            # letters whose lower case is beyond ASCII match some of the texts' letters too
            told = (near | line.rlike("[^\\x00-\\x7f]")) & told
        mask = mask + F.when(told, 1 << k).otherwise(0)
    return mask


def compound_windows(lines: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """(keys, line_no, mask) of each line at which a window of WINDOW lines begins that has two stages."""
    frame = _by(keys).rowsBetween(0, WINDOW - 1)
    masked = lines.withColumn("m", stage_mask())
    wide = masked.withColumn("mask", F.bit_or("m").over(frame))
    return wide.filter(F.bit_count("mask") >= 2).select(*keys, "line_no", "mask")


def compound_attacks(windows: DataFrame, keys: tuple[str, ...] = FILE) -> DataFrame:
    """(keys, line_no, stages): the windows that are left when a window near one with as many stages goes, in the order of lines."""
    listed = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "mask"))).alias("w"))
    kept = F.expr(f"""
        aggregate(w, cast(array() AS array<struct<line_no: int, mask: int>>), (acc, x) ->
          CASE WHEN exists(filter(acc, o -> NOT (o.mask & x.mask = o.mask AND o.mask <> x.mask AND x.line_no - o.line_no < {WINDOW})),
                           p -> p.mask & x.mask = x.mask AND x.line_no - p.line_no < {WINDOW})
               THEN filter(acc, o -> NOT (o.mask & x.mask = o.mask AND o.mask <> x.mask AND x.line_no - o.line_no < {WINDOW}))
               ELSE concat(filter(acc, o -> NOT (o.mask & x.mask = o.mask AND o.mask <> x.mask AND x.line_no - o.line_no < {WINDOW})), array(x)) END)""")
    names = F.array(*map(F.lit, STAGES))
    label = lambda mask: F.array_join(F.filter(names, lambda s, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1), " + ")
    return listed.select(*keys, F.inline(kept)).select(*keys, "line_no", label(F.col("mask")).alias("stages"))
