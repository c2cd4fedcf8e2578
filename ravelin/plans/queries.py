"""Queries over whole tables, one for each operator or group of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as T
from ravelin.functions.roles import role
from ravelin.operators import filesafety, lines, match, risk, signals
from ravelin.plans import report
from ravelin.plans.corpus import planted_files
from ravelin.plans.scan import content_findings, scan
from ravelin.sources.config import ScanConfig
from ravelin.sources.remote import parse_source_column
from ravelin.sources.rules import active_rules, builtin_rules

Query = Callable[[SparkSession, str], DataFrame]
KEYS = ("doc_id", "relative_path")
#: Limits that some of the planted packages are beyond; for file_safety alone.
CONFIG = ScanConfig(max_file_size=20_000, max_total_size=60_000, max_file_count=15)
CATEGORIES = ("agent-manipulation", "credential-exposure", "data-exfiltration", "malicious-code", "obfuscation", "prompt-injection", "supply-chain", "tool-abuse")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.explode_lines(planted_files(spark, sf_dir), keys=KEYS)


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", "line")


def match_category(spark: SparkSession, sf_dir: str, category: str) -> DataFrame:
    rules = [r for r in builtin_rules() if r.category == category and r.mode == "default"]
    found = match.match_texts(planted_files(spark, sf_dir), rules, KEYS)
    return found.select("rule_id", "ord", "doc_id", "line_no", "matched_text")


def match_file_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_files(planted_files(spark, sf_dir), builtin_rules(), ("doc_id",)).select("doc_id", "rule_id", "ord", "line_no", "matched_text")


def match_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.match_texts(planted_files(spark, sf_dir), [r for r in builtin_rules() if r.mode == "strict"], KEYS)
    return found.select("rule_id", "ord", "doc_id", "line_no", "matched_text")


def normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = T.plain_spaces(T.visible("line"))
    return _lines(spark, sf_dir).filter(plain != F.col("line")).select("doc_id", "line_no", plain.alias("plain"))


def match_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_normalized(_lines(spark, sf_dir), builtin_rules(), ("doc_id", "line_no")).select("rule_id", "ord", "doc_id", "line_no", "matched_text")


def payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.inline(T.encoded("line")))


def payload_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_extract(spark, sf_dir).select("doc_id", "line_no", "kind", T.decoded("kind", "encoded").alias("decoded")).filter("decoded IS NOT NULL")


def fewshot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.when(F.col("role") == "user", "Q").when(F.col("role") == "assistant", "A")
    return lines.exchanges(turns, kind, ("conv_id",), "turn").select("conv_id", "pairs", F.col("first").alias("first_turn"))


def fewshot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.exchanges(_lines(spark, sf_dir), lines.line_kind(), ("doc_id",), "line_no")
    return found.filter("pairs >= 2").select("doc_id", "pairs", F.col("first").alias("line_no"))


def fence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.with_fences(_lines(spark, sf_dir), ("doc_id",)).filter("safe").select("doc_id", "line_no", "in_fence")


def compound_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.compound_windows(_lines(spark, sf_dir), ("doc_id",))


def compound_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.compound_attacks(lines.compound_windows(_lines(spark, sf_dir), ("doc_id",)), ("doc_id",))


def noqa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("doc_id", "line_no", F.explode(T.noqa_ids("line")).alias("rule_id"))


def rule_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.match_texts(planted_files(spark, sf_dir), active_rules({"PI-001", "EXEC-001"}, []), KEYS)
    return found.groupBy("rule_id").agg(F.count("*").alias("n"))


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ravelin.sources.rules import rules_from_toml

    own = rules_from_toml("[rules.OWN-1]\nseverity = 'low'\ncategory = 'house'\ndescription = 'scripts in pages'\npatterns = ['<script[^>]{0,40}>']\nexclude_patterns = ['<noscript']\nflags = 'IGNORECASE'\n")
    pages = lines.explode_lines(spark.read.parquet(f"{sf_dir}/pages.parquet"), "html", ("page_id",))
    return match.match_lines(pages, own, path=None).select("page_id", "line_no", "rule_id", "matched_text")


def file_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filesafety.safety_findings(planted_files(spark, sf_dir), CONFIG)
    return found.select("package_id", "file", "rule_id", "severity")


def frontmatter_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planted_files(spark, sf_dir)
    return filesafety.schema_findings(files, files).select("package_id", "name", "error")


def file_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_files(spark, sf_dir).select("doc_id", role("relative_path").alias("role"))


def role_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planted_files(spark, sf_dir).groupBy("package_id", role("relative_path").alias("role")).agg(F.count("*").alias("n"))


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.text_signals(planted_files(spark, sf_dir)).select("package_id", "file", "role", "rule_id", "severity", "driver", "suspicious_urls")


def operator_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of wording alone, without those of URLs."""
    return text_signals(spark, sf_dir).filter("rule_id IN ('PKG-001', 'PKG-002', 'PKG-003')").drop("suspicious_urls")


def risk_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = risk.risks(planted_files(spark, sf_dir).select("package_id"), _marked(spark, sf_dir), signals.text_signals(planted_files(spark, sf_dir)))
    return done.select("package_id", "score", "band", F.array_join("top_drivers", ",").alias("top_drivers"), "suspicious_url_count", "correlated_signal_count")


def command_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snippet of code or command, and whether it runs a tool."""
    every = planted_files(spark, sf_dir).select("doc_id", F.explode(signals.snippets("content")).alias("snippet"))
    return every.select("doc_id", "snippet", signals.hinted("snippet").alias("command"))


_HOSTILE = "CASE page_id % 7 WHEN 0 THEN 'https://bit.ly/' || page_id WHEN 1 THEN 'https://10.0.0.' || (page_id % 300) || '/a' WHEN 2 THEN url || '.sh' WHEN 3 THEN 'https://x.example.com/?api_token=' || page_id WHEN 4 THEN 'https://hooks.slack.com/services/' || page_id WHEN 5 THEN 'https://raw.githubusercontent.com/a/b' ELSE url END"


_AROUND = "CASE page_id % 4 WHEN 0 THEN 'see also the docs' WHEN 1 THEN 'Please download and RUN it' WHEN 2 THEN 'the callback goes there' ELSE '' END"


def url_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", f"{_HOSTILE} AS url", f"{_AROUND} AS around")
    return urls.withColumn("s", signals.url_signal("url", "around")).filter("s IS NOT NULL").select("page_id", "s.driver", "s.severity")


def remote_source_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "CASE page_id % 5 WHEN 0 THEN 'own/repo' || page_id WHEN 1 THEN 'own/repo@v1.' || page_id WHEN 2 THEN 'own' WHEN 3 THEN 'a/b/c' ELSE 'o_w/n@' END AS source")
    return made.select("page_id", parse_source_column("source").alias("p")).select("page_id", "p.owner", "p.repo", "p.ref", "p.error")


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all line rules over the planted files, in the form that aggregates take."""
    found = match.match_texts(planted_files(spark, sf_dir), builtin_rules(), ("package_id", "relative_path"))
    return found.select("package_id", F.col("relative_path").alias("file"), "rule_id", "severity", "category", F.col("line_no").alias("line"), "matched_text")


def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.severity_counts(_marked(spark, sf_dir))


def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = planted_files(spark, sf_dir)
    skipped = files.groupBy("package_id").agg(F.sum(F.col("relative_path").endswith(".exe").cast("int")).alias("files_skipped"))
    return risk.verdicts(skipped, _marked(spark, sf_dir)).select("package_id", "n", "verdict")


def fail_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.exit_codes(planted_files(spark, sf_dir).select("package_id").distinct(), _marked(spark, sf_dir), "critical")


def risk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = risk.scored(_marked(spark, sf_dir), text_signals(spark, sf_dir))
    return rows.groupBy("package_id", "driver").agg(F.sum("points").cast("double").alias("points"))


def report_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_groups(_marked(spark, sf_dir))


def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rows(_marked(spark, sf_dir).withColumn("description", F.lit(""))).select("package_id", "rule_id", "level", "uri", "start_line")


def scan_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of the planted packages, with normalization, decoding, windows, contexts, syntax and comments that suppress."""
    return scan(planted_files(spark, sf_dir)).findings.select("package_id", "file", "rule_id", "severity", "line", "matched_text")


def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, coverage and risk of every planted package."""
    return scan(planted_files(spark, sf_dir)).results.select(
        "package_id", "verdict", "files_scanned", "files_skipped", "bytes_scanned", "suppressed_count", "skill_name", "score", "band", F.array_join("top_drivers", ",").alias("top_drivers"), "suspicious_url_count", "correlated_signal_count"
    )


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_reports(scan(planted_files(spark, sf_dir)))


def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_reports(scan(planted_files(spark, sf_dir)))


def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_reports(scan(planted_files(spark, sf_dir)))


def python_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of syntax in all planted Python files, those that don't parse too."""
    from ravelin.functions.pysource import analyze_column

    made = planted_files(spark, sf_dir).filter("relative_path LIKE '%.py'")
    return made.select("doc_id", F.inline(analyze_column("content"))).select("doc_id", "ord", "rule_id", "severity", "line", "matched_text")


def content_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of all planted files against all rules, suppressed findings too."""
    return content_findings(planted_files(spark, sf_dir), list(builtin_rules())).select("package_id", "file", "ord", "rule_id", "line", "matched_text", "suppressed")


_PLAIN = (
    lines_explode, match_file_scope, match_strict, normalize_lines, match_normalized, payload_extract, payload_decode, fewshot_pairs, fewshot_lines, fence_lines, compound_windows,
    compound_attacks, noqa_lines, rule_suppression, custom_rules, file_safety, frontmatter_validate, file_roles, role_counts, text_signals, operator_signals, risk_bands, command_snippets, url_signals, remote_source_validate,
    severity_counts, verdict, fail_on, risk_points, report_groups, sarif_rows, scan_findings, scan_results, json_report, sarif_report, text_report, python_syntax, content_scan,
)
QUERIES: dict[str, Query] = {f"match_{c.replace('-', '_')}": partial(match_category, category=c) for c in CATEGORIES} | {f.__name__: f for f in _PLAIN}
