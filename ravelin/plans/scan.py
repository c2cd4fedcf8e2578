"""The scan of packages as one lazy plan."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.functions.roles import role
from ravelin.functions.scanner import scan_files
from ravelin.operators import filesafety, risk, signals
from ravelin.plans.store import kept
from ravelin.sources.config import ScanConfig
from ravelin.sources.rules import active_rules

FINDING = ("package_id", "file", "rule_id", "severity", "category", "line", "matched_text", "description", "recommendation")
#: Findings of syntax that no rule has to be active for.
ALWAYS = ("AST-PARSE", "AST-DEPTH")


class Scan:
    """findings: a row each; results: a row for each package; signals: those of texts; files: as classified.

    Findings of contents are computed once, when first asked for, as are signals, which only results need,
    and what is known of each file besides them (``known``, without contents): three passes over the contents
    in all, however often findings are used.
    """

    def __init__(self, files: DataFrame, config: ScanConfig):
        self.config = config
        builtin = active_rules(config.suppress_rules, [])
        self.rules = [*builtin, *(r for r in active_rules((), config.custom_rules) if not r.builtin and r.rule_id not in config.suppress_rules)]
        read = F.col("fs").isNull() | ~F.col("fs").isin(*filesafety.NOT_READ)
        closed = F.coalesce(F.col("unreadable"), F.lit(False)) if "unreadable" in files.columns else F.lit(False)
        # what turns out when a file is read; its size counts again then
        state = F.when(closed, "FS-008").when(F.col("content").isNull(), "FS-001")
        if config.max_file_size:
            state = state.when(F.octet_length("content") > config.max_file_size, "FS-005")
        self.every = files.withColumn("fs", filesafety.safety_rule(config, files.columns)).withColumn("read", read).withColumn("lost", F.when(F.col("read"), state))
        # a null content has no findings and no signals; a filter would be pushed down to the rows that are read, with all that contents are made of
        self.files = self.every.withColumn("content", F.when(F.col("read") & F.col("lost").isNull(), F.col("content")))

    @cached_property
    def known(self) -> DataFrame:
        outside = ["outside"] if "outside" in self.every.columns else []
        fm = F.when(F.col("relative_path") == "SKILL.md", filesafety.frontmatter("content")).alias("fm")
        return kept(self.every.select("package_id", "relative_path", "size", *outside, "fs", "read", "lost", F.octet_length("content").alias("bytes"), fm))

    @cached_property
    def names(self) -> DataFrame:
        return filesafety.schema_findings(self.known, self.known.select("package_id").distinct(), self.config.strict_schema)

    @cached_property
    def contents(self) -> DataFrame:
        return kept(content_findings(self.files, self.rules))

    @cached_property
    def signals(self) -> DataFrame:
        return kept(signals.text_signals(self.files))

    @cached_property
    def findings(self) -> DataFrame:
        config = self.config
        broken = filesafety.as_findings(self.known.filter("lost IS NOT NULL").select("package_id", F.col("relative_path").alias("file"), F.col("lost").alias("rule_id")))
        schema = self.names.filter("error IS NOT NULL").select(
            "package_id", F.lit("SKILL.md").alias("file"), F.lit("SV-001").alias("rule_id"), F.lit("medium" if config.strict_schema else "info").alias("severity"), F.lit("schema-validation").alias("category"),
            F.lit(None).cast("int").alias("line"), F.lit("").alias("matched_text"), F.concat(F.lit("The front matter isn't valid: "), "error").alias("description"), F.lit("Put it right").alias("recommendation"),
        )
        safety = filesafety.safety_findings(self.known, config)
        return schema.unionByName(safety).unionByName(broken).unionByName(self.contents.filter("NOT suppressed").select(*FINDING))

    @cached_property
    def results(self) -> DataFrame:
        totals = self.known.groupBy("package_id").agg(
            F.sum(F.when(F.col("read"), 1).otherwise(0)).alias("files_scanned"),
            F.sum(F.when((F.col("fs") == "FS-002"), 1).otherwise(0)).alias("binary"),
            F.sum(F.when(F.col("lost").isNotNull(), 1).otherwise(0)).alias("unread"),
            F.sum(F.when(F.col("read") & F.col("lost").isNull(), F.col("bytes")).otherwise(0)).cast("bigint").alias("bytes_scanned"),
        )
        suppressed = self.contents.filter("suppressed").groupBy("package_id").agg(F.count("*").alias("suppressed_count"))
        packages = totals.withColumn("files_skipped", F.col("binary") + F.col("unread"))
        judged = risk.verdicts(packages, self.findings)
        counts = risk.severity_counts(self.findings).groupBy("package_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", F.col("n").cast("int"))))).alias("counts"))
        reasons = F.filter(
            F.array(F.when(F.col("unread") > 0, F.concat("unread", F.lit(" files can't be read"))), F.when(F.col("binary") > 0, F.concat("binary", F.lit(" binary files left out")))), lambda x: x.isNotNull()
        )
        risks = risk.risks(packages, self.findings, self.signals, self.known.filter("read").select("package_id", role("relative_path").alias("role")))
        return (
            judged.withColumn("degraded_reasons", reasons)
            .join(counts, "package_id", "left")
            .join(suppressed, "package_id", "left")
            .join(self.names.select("package_id", F.col("name").alias("skill_name")), "package_id", "left")
            .join(risks, "package_id", "left")
            .withColumn("suppressed_count", F.coalesce("suppressed_count", F.lit(0)))
            .drop("binary", "unread", "n")
        )


def content_findings(files: DataFrame, rules: list) -> DataFrame:
    """The findings of the contents (package_id, file, ord, ..., suppressed) of files; no shuffle."""
    away = {r.rule_id for r in rules if r.path_excludes}
    assert not {"EXEC-002", "EXEC-006", "EXEC-007", "EXEC-011", "OBFS-001", "EXFIL-006", "EXFIL-008"} & away, "rules of syntax hold on every path"
    return scan_files(files, rules, ALWAYS)


def scan(files: DataFrame, config: ScanConfig | None = None) -> Scan:
    """Scan packages given as rows (package_id, relative_path, content, size).

    ``outside`` (bool), if there, marks links that leave the package, and ``unreadable`` files
    that couldn't be opened (FS-008). Another null content is a file that isn't UTF-8 (FS-001).
    A file over the limit isn't read, whatever its suffix. Packages without files don't appear.
    """
    return Scan(files, config or ScanConfig())
