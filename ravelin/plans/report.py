"""Reports: JSON, SARIF 2.1.0 and text, as columns and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.operators.risk import RANK, rank
from ravelin.plans.scan import FINDING, Scan

SAMPLES, SHOWN = 3, 80
LEVEL = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def report_groups(findings: DataFrame) -> DataFrame:
    """(package_id, rule_id, severity, occurrences, files): by rule, as a report lists them."""
    return findings.groupBy("package_id", "rule_id", "severity").agg(F.count("*").alias("occurrences"), F.countDistinct("file").alias("files"))


def samples(findings: DataFrame, n: int = SAMPLES) -> DataFrame:
    """The first n findings of each rule of a package, their text cut for show."""
    nth = F.row_number().over(W.partitionBy("package_id", "rule_id").orderBy(F.split("file", "/"), F.col("line").asc_nulls_first(), "matched_text"))
    return findings.withColumn("nth", nth).filter(F.col("nth") <= n).withColumn("matched_text", F.left("matched_text", F.lit(SHOWN)))


def _sorted(findings: DataFrame) -> DataFrame:
    order = F.struct((-rank()).alias("a"), F.split("file", "/").alias("b"), F.coalesce("line", F.lit(0)).alias("c"), F.col("rule_id").alias("d"), F.struct(*FINDING[1:]).alias("f"))
    return findings.groupBy("package_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["f"]).alias("findings"))


def json_reports(scan: Scan) -> DataFrame:
    """(package_id, json): one object for each package with its fields in alphabetical order; all five counts are there."""
    joined = scan.results.join(_sorted(scan.findings), "package_id", "left")
    counts = F.struct(*(F.coalesce(F.element_at("counts", s), F.lit(0)).alias(s) for s in sorted(RANK)))
    item = lambda f: F.struct(*(f[c].alias(c) for c in sorted(FINDING[1:])))
    fields = {
        "bytes_scanned": F.col("bytes_scanned"), "counts": counts, "degraded_reasons": F.col("degraded_reasons"), "files_scanned": F.col("files_scanned"), "files_skipped": F.col("files_skipped"),
        "findings": F.transform("findings", item),
        "package_risk": F.struct(*(F.col(c).alias(c) for c in ("band", "correlated_signal_count", "counts_by_role", "score", "suspicious_url_count", "top_drivers"))),
        "skill_name": F.col("skill_name"), "suppressed_count": F.col("suppressed_count"), "verdict": F.col("verdict"),
    }
    return joined.select("package_id", F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"}).alias("json"))


def sarif_rows(findings: DataFrame) -> DataFrame:
    """The results of a SARIF run as flat rows: package_id, rule_id, level, uri, start_line."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL.items() for x in kv)), F.col("severity"))
    return findings.select("package_id", "rule_id", level.alias("level"), F.col("file").alias("uri"), F.col("line").alias("start_line"), F.col("description").alias("message"))


def sarif_reports(scan: Scan) -> DataFrame:
    """(package_id, sarif): a log of one run for each package; a rule is listed once, a region only where there is a line."""
    level = F.element_at(F.create_map(*(F.lit(x) for kv in LEVEL.items() for x in kv)), F.col("severity"))
    where = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine"))).alias("region")).alias("physicalLocation"))
    each = scan.findings.withColumn("result", F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(where).alias("locations")))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"), F.struct(F.col("recommendation").alias("text")).alias("help"))
    first = F.row_number().over(W.partitionBy("package_id", "rule_id").orderBy("file", "line", "description"))
    order = F.struct(F.split("file", "/").alias("f"), F.coalesce("line", F.lit(0)).alias("l"), F.col("rule_id").alias("i"), "result")
    grouped = each.withColumn("rule", F.when(first == 1, rule)).groupBy("package_id").agg(
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["result"]).alias("results"), F.array_sort(F.collect_list("rule")).alias("rules")
    )
    joined = scan.results.join(grouped, "package_id", "left")
    tool = F.struct(F.struct(F.lit("ravelin").alias("name"), F.col("rules").alias("rules")).alias("driver"))
    properties = F.struct(F.col("verdict"), F.struct("score", "band", "top_drivers", "counts_by_role", "suspicious_url_count", "correlated_signal_count").alias("package_risk"))
    run = F.struct(tool.alias("tool"), F.col("results"), properties.alias("properties"))
    return joined.select("package_id", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def text_reports(scan: Scan, mode: str = "default") -> DataFrame:
    """(package_id, text): quiet is the verdict alone; default lists rules with SAMPLES places each; verbose lists every finding."""
    head = F.format_string("%s: %s, risk %s (%d)", "skill_name", F.upper("verdict"), "band", "score")
    if mode == "quiet":
        return scan.results.select("package_id", head.alias("text"))
    place = F.concat(F.lit("    "), "file", F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")), F.lit("  "), F.left("matched_text", F.lit(SHOWN)))
    shown = samples(scan.findings, SAMPLES if mode == "default" else 1 << 30)
    listed = shown.withColumn("place", place).groupBy("package_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "place"))), lambda x: x["place"]).alias("places"))
    groups = report_groups(scan.findings).join(listed, ["package_id", "rule_id"])
    more = F.when(F.col("occurrences") > F.size("places"), F.format_string("\n    ... and %d more", F.col("occurrences") - F.size("places"))).otherwise("")
    block = F.concat(F.format_string("  %s %s: %d in %d files\n", F.upper("severity"), "rule_id", "occurrences", "files"), F.array_join("places", "\n"), more)
    blocks = groups.withColumn("block", block).groupBy("package_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-rank()).alias("r"), "rule_id", "block"))), lambda x: x["block"]), "\n").alias("blocks"))
    return scan.results.join(blocks, "package_id", "left").select("package_id", F.concat_ws("\n", head, "blocks").alias("text"))
