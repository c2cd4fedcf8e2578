"""Scan a package from the command line: python -m ravelin.cli scan PATH."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ravelin.operators.filesafety import frontmatter
from ravelin.operators.risk import exit_codes
from ravelin.plans import report
from ravelin.plans.scan import scan
from ravelin.sources.config import ScanConfig, load_config
from ravelin.sources.files import read_package
from ravelin.sources.remote import RemotePackages, parse_source

CODES = {"pass": 0, "flag": 1, "block": 2}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ravelin")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("scan", help="scan a package")
    where = one.add_mutually_exclusive_group(required=True)
    where.add_argument("path", nargs="?")
    where.add_argument("--repo", help="owner/repo[@ref]")
    one.add_argument("--skill-path", default="", help="folder of the package within the repository")
    one.add_argument("--format", choices=("text", "json", "sarif"), default="text")
    one.add_argument("--fail-on", choices=("critical", "high", "medium", "low", "info"))
    one.add_argument("--config")
    one.add_argument("--strict-schema", action="store_true")
    loud = one.add_mutually_exclusive_group()
    loud.add_argument("--quiet", action="store_true")
    loud.add_argument("--verbose", action="store_true")
    check = commands.add_parser("validate", help="check the front matter of a package")
    check.add_argument("path")
    return top


def run(arguments: list[str], spark: SparkSession) -> tuple[int, str]:
    """(exit code, output)."""
    asked = parser().parse_args(arguments)
    if asked.command == "validate":
        made = read_package(spark, asked.path)
        row = made.filter("relative_path = 'SKILL.md'").select(frontmatter("content").alias("f")).first()
        error = row["f"]["error"] if row else "missing file"
        return (1, f"invalid: {error}") if error else (0, f"valid: {row['f']['name']}")
    config = load_config(asked.config) if asked.config else ScanConfig()
    if asked.strict_schema:
        config = ScanConfig(**{**vars(config), "strict_schema": True})
    if asked.repo:
        parse_source(asked.repo)
        spark.dataSource.register(RemotePackages)
        files = spark.read.format("remote_package").load(asked.repo)
        if asked.skill_path:
            base = asked.skill_path.strip("/") + "/"
            files = files.filter(files["relative_path"].startswith(base)).selectExpr("package_id", f"substring(relative_path, {len(base) + 1}) AS relative_path", "content", "size")
    else:
        files = read_package(spark, asked.path)
    done = scan(files, config)
    row = done.results.select("package_id", "verdict").first()
    if row is None:
        return 0, "no files"
    if asked.format == "json":
        out = report.json_reports(done).first()["json"]
    elif asked.format == "sarif":
        out = report.sarif_reports(done).first()["sarif"]
    else:
        out = report.text_reports(done, "quiet" if asked.quiet else "verbose" if asked.verbose else "default").first()["text"]
    code = exit_codes(done.results, done.findings, asked.fail_on).first()["code"] if asked.fail_on else CODES[row["verdict"]]
    return code, out


def main() -> None:
    spark = SparkSession.builder.appName("ravelin").config("spark.ui.enabled", "false").getOrCreate()
    try:
        code, out = run(sys.argv[1:], spark)
    except (ValueError, OSError) as e:
        code, out = 2, f"error: {e}"
    print(out)
    sys.exit(code)


if __name__ == "__main__":
    main()
