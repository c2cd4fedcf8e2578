"""What files and packages are, before their contents are read: limits, kinds, front matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.sources.config import BINARY, ScanConfig

NOT_READ = ("FS-002", "FS-004", "FS-005")
SEVERITY = {"FS-001": "medium", "FS-002": "high", "FS-003": "medium", "FS-004": "high", "FS-005": "medium", "FS-006": "medium", "FS-007": "medium", "FS-008": "medium"}


def suffix_of(path: Column | str) -> Column:
    """The suffix with its dot; empty for names without one, or with one only at the front or the end."""
    name = F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def safety_rule(config: ScanConfig, columns: list[str]) -> Column:
    """The first of FS-004, 002, 003, 005 that holds for a file; null where none does."""
    suffix = suffix_of("relative_path")
    rule = F.when(F.col("outside"), "FS-004") if "outside" in columns else F.when(F.lit(False), "")
    return rule.when(suffix.isin(*BINARY), "FS-002").when((suffix != "") & ~suffix.isin(*sorted(config.extensions)), "FS-003").when(F.col("size") > config.max_file_size, "FS-005")


def _message(rule: Column) -> Column:
    said = {
        "FS-001": "not UTF-8", "FS-002": "a binary file", "FS-003": "a suffix that isn't known", "FS-004": "a link that leaves the package",
        "FS-005": "too large a file", "FS-006": "too large a package", "FS-007": "too many files", "FS-008": "can't be read",
    }
    return F.element_at(F.create_map(*(F.lit(x) for kv in said.items() for x in kv)), rule)


def _severity(rule: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), rule)


def safety_findings(files: DataFrame, config: ScanConfig) -> DataFrame:
    """Findings (package_id, file, rule_id, severity, category, line, matched_text, description, recommendation) of files and package limits.

    At most one for a file; every file counts for the limits, read or not.
    """
    placed = files.withColumn("rule_id", safety_rule(config, files.columns))
    each = placed.filter("rule_id IS NOT NULL").select("package_id", F.col("relative_path").alias("file"), "rule_id")
    total = files.groupBy("package_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    limits = F.filter(F.array(F.when(F.col("bytes") > config.max_total_size, "FS-006"), F.when(F.col("n") > config.max_file_count, "FS-007")), lambda x: x.isNotNull())
    packages = total.select("package_id", F.lit("<package>").alias("file"), F.explode(limits).alias("rule_id"))
    return as_findings(each.unionByName(packages))


def as_findings(found: DataFrame) -> DataFrame:
    rule = F.col("rule_id")
    return found.select(
        "package_id", "file", "rule_id", _severity(rule).alias("severity"), F.lit("file-safety").alias("category"), F.lit(None).cast("int").alias("line"),
        F.lit("").alias("matched_text"), F.concat(F.lit("This is "), _message(rule)).alias("description"), F.lit("Look at the file or change the limit").alias("recommendation"),
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once, wherever it stands."""
    return F.element_at(F.transform(F.array(value), then), 1)


def frontmatter(text: Column | str) -> Column:
    """struct<name, description, error> of the text of a SKILL.md; error is null if it is valid, else says what comes first."""
    text = F.col(text) if isinstance(text, str) else text
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    bare = lambda v: F.when(v.rlike(r"""^(?s)(?:".*"|'.*')$""") & (F.length(v) >= 2), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)

    def of_values(bars: Column, end: Column, used: Column, keys: Column, name: Column, description: Column) -> Column:
        length = F.length(strip(description))
        error = (
            F.when(text.isNull(), "missing file")
            .when(~F.element_at(bars, 1), "no front matter")
            .when(end == 0, "unterminated front matter")
            .when(F.exists(used, lambda x: F.instr(x, ":") == 0), "not key: value")
            .when(F.exists(used, lambda x: x.startswith(":")), "empty key")
            .when(~F.array_contains(keys, "name"), "missing name")
            .when(~F.array_contains(keys, "description"), "missing description")
            .when(name == "", "empty name")
            .when(F.length(name) > 64, "long name")
            .when(~name.rlike(r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"), "invalid name")
            .when(F.instr(name, "--") > 0, "double hyphen in name")
            .when(length == 0, "empty description")
            .when(length > 1024, "long description")
        )
        return F.struct(name.alias("name"), description.alias("description"), error.alias("error"))

    def of_lines(bars: Column, end: Column, used: Column) -> Column:
        def with_keys(keys: Column) -> Column:
            last = lambda k: F.element_at(F.filter(used, lambda x, i: F.element_at(keys, i + 1) == k), -1)
            value = lambda k: F.when(F.array_contains(keys, k), bare(strip(F.regexp_replace(last(k), r"^[^:]*:", ""))))
            return _let(value("name"), lambda name: _let(value("description"), lambda description: of_values(bars, end, used, keys, name, description)))

        return _let(F.transform(used, lambda x: strip(F.substring_index(x, ":", 1))), with_keys)

    def of_parts(parts: Column) -> Column:
        # few lines hold a bar, and only they are stripped; array_position is null where text is
        bars = F.transform(parts, lambda x: x.contains("---") & (strip(x) == "---"))

        def with_bars(bars: Column) -> Column:
            def with_end(end: Column) -> Column:
                inner = F.when(end > 1, F.slice(parts, 2, (end - 1).cast("int"))).otherwise(F.expr("cast(array() AS array<string>)"))
                return _let(F.filter(F.transform(inner, strip), lambda x: (x != "") & ~x.startswith("#")), lambda used: of_lines(bars, end, used))

            return _let(F.array_position(F.slice(bars, 2, F.greatest(F.size(bars) - 1, F.lit(1))), True), with_end)

        return _let(bars, with_bars)

    return _let(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1), of_parts)


def schema_findings(files: DataFrame, packages: DataFrame, strict: bool = False) -> DataFrame:
    """(package_id, name, error) with SV-001 where the front matter isn't valid; the name falls back to the package's. Files may have it as fm already."""
    skill = files.filter("relative_path = 'SKILL.md'").select("package_id", F.col("fm") if "fm" in files.columns else frontmatter("content").alias("fm"))
    joined = packages.select("package_id").distinct().join(skill, "package_id", "left")
    error = F.coalesce(F.when(F.col("fm").isNull(), F.lit("missing file")), F.col("fm.error"))
    return joined.select("package_id", F.when(error.isNull(), F.col("fm.name")).otherwise(F.col("package_id")).alias("name"), error.alias("error"))
