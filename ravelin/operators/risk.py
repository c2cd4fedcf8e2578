"""Verdicts, counts and the weighted risk of packages, as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.roles import role

RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
POINTS = {"critical": "10", "high": "7", "medium": "4", "low": "2", "info": "0.5"}
WEIGHT = {"entrypoint": "1.4", "script": "1.35", "config": "1.1", "support-doc": "0.8", "reference": "0.35"}
DRIVER = {
    "prompt-injection": "operator-manipulation", "agent-manipulation": "operator-manipulation", "malicious-code": "execution", "tool-abuse": "execution",
    "data-exfiltration": "exfiltration", "credential-exposure": "credential-access", "supply-chain": "remote-bootstrap", "obfuscation": "stealth/obfuscation",
}
IGNORED = ("analysis", "file-safety", "schema-validation")
DANGER = ("execution", "exfiltration", "operator-manipulation", "remote-bootstrap")


def _map(values: dict[str, object], key: Column | str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), F.col(key) if isinstance(key, str) else key)


def rank(severity: Column | str = "severity") -> Column:
    return _map(RANK, severity)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("package_id", "severity").agg(F.count("*").alias("n"))


def verdicts(packages: DataFrame, findings: DataFrame) -> DataFrame:
    """(package_id, n, verdict); files_skipped of packages, if there, turns a pass into a flag."""
    worst = findings.groupBy("package_id").agg(F.max(rank()).alias("worst"), F.count("*").alias("n"))
    skipped = F.col("files_skipped") > 0 if "files_skipped" in packages.columns else F.lit(False)
    verdict = F.when(F.col("worst") >= 3, "block").when(F.col("worst") >= 1, "flag").when(skipped, "flag").otherwise("pass")
    return packages.join(worst, "package_id", "left").select(*packages.columns, F.coalesce("n", F.lit(0)).alias("n"), verdict.alias("verdict"))


def exit_codes(packages: DataFrame, findings: DataFrame, threshold: str) -> DataFrame:
    """(package_id, code): 2 where a finding is as bad as the threshold, else 0."""
    hit = findings.groupBy("package_id").agg((F.max(rank()) >= RANK[threshold]).alias("hit"))
    return packages.select("package_id").join(hit, "package_id", "left").select("package_id", F.when(F.col("hit"), 2).otherwise(0).alias("code"))


def points(driver: Column | str, severity: Column | str, role: Column | str) -> Column:
    d = F.col(driver) if isinstance(driver, str) else driver
    r = F.col(role) if isinstance(role, str) else role
    decimal = lambda c: c.cast("decimal(10,4)")
    less = F.when((r == "reference") & d.isin("operator-manipulation", "remote-bootstrap"), decimal(F.lit("0.6"))).otherwise(decimal(F.lit("1")))
    return (decimal(_map(POINTS, severity)) * decimal(_map(WEIGHT, r)) * less).cast("decimal(18,4)")


def scored(findings: DataFrame, signals: DataFrame) -> DataFrame:
    """(package_id, source, role, driver, severity, points, suspicious_urls, category, script) of all that counts."""
    of = findings.filter(~F.col("category").isin(*IGNORED)).select("package_id", F.lit("finding").alias("source"), role("file").alias("role"), _map(DRIVER, "category").alias("driver"), "severity", F.lit(0).alias("suspicious_urls"))
    at = signals.select("package_id", F.lit("signal").alias("source"), "role", "driver", "severity", "suspicious_urls")
    return of.unionByName(at).withColumn("points", F.when(F.col("driver").isNotNull(), points("driver", "severity", "role")))


def risks(packages: DataFrame, findings: DataFrame, signals: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(package_id, score, band, top_drivers, suspicious_url_count, correlated_signal_count) of every package; two shuffles by package."""
    rows = scored(findings, signals)
    signal, finding = F.col("source") == "signal", F.col("source") == "finding"
    danger = F.col("role").isin("entrypoint", "script") & F.col("driver").isin(*DANGER) & (rank() >= 3)
    driver = F.col("driver")
    facts = rows.groupBy("package_id", "driver").agg(
        F.sum("points").alias("points"),
        F.sum("suspicious_urls").alias("urls"),
        F.bool_or(danger).alias("direct"),
        F.bool_or(danger & (rank() == 4)).alias("severe"),
        F.collect_set(F.when(rank() >= 2, F.col("role"))).alias("roles"),
        F.bool_or(signal & driver.isin("operator-manipulation", "remote-bootstrap") & F.col("role").isin("entrypoint", "support-doc")).alias("doc_bootstrap"),
        F.bool_or(signal & (driver == "remote-bootstrap") & (F.col("role") == "config")).alias("config_remote"),
        F.bool_or(signal & (driver == "credential-access")).alias("secret_request"),
        F.bool_or(finding & driver.isin("execution", "exfiltration") & (F.col("role") == "script")).alias("script_danger"),
        F.bool_or(finding & (driver == "exfiltration")).alias("outbound_danger"),
    )
    whole = facts.groupBy("package_id").agg(
        F.map_from_entries(F.collect_list(F.when(driver.isNotNull(), F.struct("driver", "points")))).alias("by"),
        F.sum("points").alias("base"),
        F.sum("urls").alias("urls"),
        F.size(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("n_roles"),
        *(F.bool_or(c).alias(c) for c in ("direct", "severe", "doc_bootstrap", "config_remote", "secret_request", "script_danger", "outbound_danger")),
    )
    all_ = packages.select("package_id").distinct().join(whole, "package_id", "left")
    yes = lambda *c: F.coalesce(F.expr(" AND ".join(c)), F.lit(False)).cast("int")
    c1, c2, c3 = yes("doc_bootstrap", "script_danger"), yes("config_remote", "script_danger"), yes("secret_request", "outbound_danger")
    many = (F.coalesce("n_roles", F.lit(0)) >= 2).cast("int")
    count = c1 + c2 + c3
    score = F.coalesce("base", F.lit(0).cast("decimal(28,4)")) + count * 6 + many * 6
    more = {
        "credential-access": c3 * 6, "execution": c1 * 6 + c2 * 4, "exfiltration": c3 * 6, "operator-manipulation": c1 * 6 + many * 3,
        "remote-bootstrap": c2 * 6 + many * 3, "stealth/obfuscation": F.lit(0),
    }
    entries = F.array(*(F.struct((-(F.coalesce(F.element_at("by", d), F.lit(0).cast("decimal(28,4)")) + extra)).alias("minus"), F.lit(d).alias("driver")) for d, extra in more.items()))
    top = F.transform(F.slice(F.filter(F.array_sort(entries), lambda x: x["minus"] < 0), 1, 3), lambda x: x["driver"])
    by_score = F.when(score >= 40, "severe").when(score >= 20, "high").when(score >= 8, "guarded").otherwise("low")
    band = F.when(F.coalesce("severe", F.lit(False)), "severe").when(F.coalesce("direct", F.lit(False)) & (score < 20), "high").otherwise(by_score)
    out = all_.select(
        "package_id", F.bround(score, 0).cast("int").alias("score"), band.alias("band"), top.alias("top_drivers"), F.coalesce("urls", F.lit(0)).cast("int").alias("suspicious_url_count"), count.alias("correlated_signal_count")
    )
    if roles is None:
        return out
    counted = roles.groupBy("package_id", "role").agg(F.count("*").alias("n")).groupBy("package_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", F.col("n").cast("int"))))).alias("counts_by_role"))
    return out.join(counted, "package_id", "left")
