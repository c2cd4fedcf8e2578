"""The join of lines with patterns by regular expression."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ravelin.functions.anchors import candidate_lines, candidate_patterns
from ravelin.sources.rules import Rule, java, pattern_rows, patterns_frame

MATCHED = 200
#: Patterns whose rows are sent to every task; more are joined by their number.
BROADCAST_PATTERNS = 20_000


def _covered(line: Column, pid: Column, rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """Whether an exclusion lies over the first match of a pattern, by its number, in a line; a null line isn't tried.

    The patterns travel with the function, not with each row.
    """
    patterns = {r[0]: (r[7].removeprefix(java("")), [e.removeprefix(java("")) for e in r[8]]) for r in pattern_rows(rules) if r[5] == "strict"}

    @F.arrow_udf(BooleanType())
    def covered(texts: pa.Array, pids: pa.Array) -> pa.Array:
        out = []
        for t, k in zip(texts, pids, strict=True):
            hidden = False
            if t.is_valid:
                text, (p, xs) = t.as_py(), patterns[k.as_py()]
                m = re.search(p, text)
                hidden = m is not None and any(x.end() > m.start() and x.start() < m.end() for e in xs for x in re.finditer(e, text))
            out.append(hidden)
        return pa.array(out, pa.bool_())

    return covered(line, pid)


def match_lines(lines: DataFrame, rules: list[Rule] | tuple[Rule, ...], line: str = "line", path: str | None = "relative_path") -> DataFrame:
    """The columns of lines with rule_id, severity, category, ord (the pattern's place in its rule), matched_text: a row for each pattern that a line matches.

    Lines without the anchors of a pattern never meet its regular expression; what they meet is
    tried in the JVM. Neither step shuffles.
    """
    rules = [r for r in rules if r.scope == "line"]
    near = lines.withColumn("__rv_pid", F.explode(candidate_patterns(line, [(r[0], r[7]) for r in pattern_rows(rules)])))
    return _matched(near, lines.columns, rules, line, path)


def match_texts(files: DataFrame, rules: list[Rule] | tuple[Rule, ...], keys: tuple[str, ...], text: str = "content", path: str | None = "relative_path") -> DataFrame:
    """match_lines() over the lines of whole texts, as explode_lines(files, text, keys) has them; only the lines that are worth trying are ever rows."""
    rules = [r for r in rules if r.scope == "line"]
    found = files.select(*keys, F.inline(candidate_lines(text, [(r[0], r[7]) for r in pattern_rows(rules)])))
    near = found.select(*keys, "line_no", "line", F.explode("pids").alias("__rv_pid"))
    return _matched(near, [*keys, "line_no", "line"], rules, "line", path)


def _matched(near: DataFrame, columns: list[str], rules: list[Rule], line: str, path: str | None) -> DataFrame:
    """What is left of lines and numbers of patterns (__rv_pid) when the patterns are tried."""
    table = patterns_frame(near.sparkSession, rules)
    table = F.broadcast(table) if sum(len(r.patterns) for r in rules) <= BROADCAST_PATTERNS else table
    both = near.join(table, F.col("__rv_pid") == F.col("pid")).filter(F.expr(f"`{line}` rlike pattern"))
    if path:
        both = both.filter(F.expr(f"NOT exists(path_excludes, x -> `{path}` rlike x)"))
    strict = F.col("mode") == "strict"
    over = _covered(F.when(strict, F.col(line)), F.col("pid"), rules)
    both = both.filter(F.expr(f"mode = 'strict' OR NOT exists(excludes, x -> `{line}` rlike x)")).withColumn("__rv_over", over).filter("NOT __rv_over")
    return both.select(*columns, "rule_id", "severity", "category", "ord", F.expr(f"left(regexp_extract(`{line}`, pattern, 0), {MATCHED})").alias("matched_text"))


def match_normalized(lines: DataFrame, rules: list[Rule] | tuple[Rule, ...], keys: tuple[str, ...], line: str = "line", path: str | None = "relative_path") -> DataFrame:
    """Further matches (keys, rule_id, ord, matched_text) of the normalized lines: of rules that the line itself doesn't match."""
    from ravelin.functions.text import normalized

    other = lines.withColumn("__rv_norm", normalized(line)).filter(F.col("__rv_norm") != F.col(line))
    again = match_lines(other, rules, "__rv_norm", path)
    first = match_lines(other.drop("__rv_norm"), rules, line, path).select(*keys, "rule_id").distinct()
    return again.join(first, [*keys, "rule_id"], "left_anti").select(*keys, "rule_id", "ord", "matched_text")


def match_files(files: DataFrame, rules: list[Rule] | tuple[Rule, ...], keys: tuple[str, ...], content: str = "content") -> DataFrame:
    """(keys, rule_id, ord, line_no, matched_text) of rules over whole texts: every match, at the line where it begins."""
    out = None
    for rule in rules:
        if rule.scope != "file":
            continue
        for i, p in enumerate(rule.patterns):
            text = F.regexp_replace(content, "\r\n?", "\n")
            found = F.regexp_extract_all(text, F.lit(java(p)), F.lit(0))
            # what stands before each match: the text, split at the matches
            between = F.split(text, java(p), -1)
            hit = files.filter(F.col(content).rlike(java(p))).select(*keys, text.alias("__rv_t"), F.posexplode(found).alias("__rv_k", "matched_text"), between.alias("__rv_b"), found.alias("__rv_f"))
            newlines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
            before = F.expr("concat(array_join(slice(__rv_b, 1, __rv_k + 1), ''), array_join(slice(__rv_f, 1, __rv_k), ''))")
            hit = hit.withColumn("line_no", newlines(before) + 1)
            line = F.element_at(F.split("__rv_t", "\n", -1), F.col("line_no"))
            for x in rule.excludes:
                hit = hit.filter(~line.rlike(java(x)))
            part = hit.select(*keys, F.lit(rule.rule_id).alias("rule_id"), F.lit(i).alias("ord"), "line_no", F.left("matched_text", F.lit(MATCHED)).alias("matched_text"))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else files.limit(0).selectExpr(*keys, "'' AS rule_id", "0 AS ord", "0 AS line_no", "'' AS matched_text")
