"""Rules: the built-in table, custom rules from TOML, and their form as a DataFrame of patterns."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SEVERITIES = ("critical", "high", "medium", "low", "info")
MAX_PATTERN = 1000
#: What every pattern begins with in Java: Unicode classes and case, and only \n ends a line, as in Python.
JAVA = "(?Uud)"

_SIGNS = {"¦": r"\b", "·": r"\s*", "…": ".*", "‥": ".{0,80}", "†": ".{0,200}?", "¶": r"\(", "•": r"\.", "ʺ": "['\"]"}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    category: str
    description: str = ""
    recommendation: str = ""
    patterns: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    path_excludes: tuple[str, ...] = ()
    confidence: str = "stable"
    scope: str = "line"
    mode: str = "default"
    builtin: bool = field(default=True, compare=False)


def spelled(short: str, lists: dict[str, str], literal: bool = False) -> str:
    """The regular expression of a line of the table, with its flags."""
    if literal:
        return re.escape(short).replace(r"\ ", " ")
    cased = short.startswith("=")
    text = short[1:] if cased else short
    text = re.sub("«(\\w+)»", lambda m: "(?:" + "|".join(lists[m[1]].split()) + ")", text)
    text = "".join(_SIGNS.get(c, r"\s+" if c == " " else c) for c in text)
    return text if cased else f"(?i){text}"


def parse_table(text: str) -> list[Rule]:
    lists: dict[str, str] = {}
    rules: list[Rule] = []
    for line in text.splitlines():
        kind, _, rest = line.partition(" ")
        if kind == "$":
            name, _, words = rest.partition(" = ")
            lists[name] = words
        elif kind == "@":
            rule_id, severity, category, *options = rest.split()
            literal = "literal" in options
            file = "file" in options
            now = {
                "rule_id": rule_id, "severity": severity, "category": category, "scope": "file" if file else "line",
                "mode": "strict" if "strict" in options else "default", "confidence": next((o for o in options if o in ("fuzzy", "beta")), "stable"),
            }
            lines = {"+": [], "-": [], "!": []}
            rules.append((now, lines, literal, file))
        elif kind == ":":
            now["description"], _, now["recommendation"] = rest.partition(" // ")
        elif kind in ("+", "-", "!"):
            lines[kind].append(rest)
    made = []
    for now, lines, literal, file in rules:
        patterns = tuple(spelled(p, lists, literal) for p in lines["+"])
        if file:
            patterns = tuple(p.replace("(?i)", "(?is)", 1) for p in patterns)
        made.append(Rule(**now, patterns=patterns, excludes=tuple(spelled(p, lists, literal) for p in lines["-"]), path_excludes=tuple(lines["!"])))
    return sorted(made, key=lambda r: r.rule_id)


@cache
def builtin_rules() -> tuple[Rule, ...]:
    return tuple(parse_table((Path(__file__).parent / "builtin.rules").read_text("utf-8")))


_FLAGS = {"IGNORECASE": "i", "MULTILINE": "m", "DOTALL": "s"}


def rule_from_mapping(rule_id: str, data: dict) -> Rule:
    """A custom rule of a TOML table; raises ValueError for what can't be one."""
    for name in ("severity", "category", "description", "patterns"):
        if name not in data:
            raise ValueError(f"{rule_id}: {name} is missing")
    if data["severity"] not in SEVERITIES:
        raise ValueError(f"{rule_id}: no such severity: {data['severity']}")
    scope, mode = data.get("match_scope", "line"), data.get("exclude_mode", "default")
    if scope not in ("line", "file"):
        raise ValueError(f"{rule_id}: match_scope must be line or file")
    if mode not in ("default", "strict"):
        raise ValueError(f"{rule_id}: exclude_mode must be default or strict")
    letters = ""
    for name in filter(None, (x.strip() for x in re.split(r"[|,]", data.get("flags", "")))):
        if name.upper() not in _FLAGS:
            raise ValueError(f"{rule_id}: no such flag: {name}")
        letters += _FLAGS[name.upper()]
    lists = {}
    for name in ("patterns", "exclude_patterns", "path_exclude_patterns"):
        found = data.get(name, [])
        if not isinstance(found, list) or not all(isinstance(p, str) for p in found):
            raise ValueError(f"{rule_id}: {name} must be a list of texts")
        for p in found:
            if len(p) > MAX_PATTERN:
                raise ValueError(f"{rule_id}: a pattern has over {MAX_PATTERN} characters")
            try:
                re.compile(p)
            except re.error as e:
                raise ValueError(f"{rule_id}: {p!r}: {e}") from e
        # flags don't hold for paths
        lists[name] = tuple(f"(?{letters}){p}" if letters and name != "path_exclude_patterns" else p for p in found)
    return Rule(
        rule_id, data["severity"], data["category"], data["description"], data.get("recommendation", ""), lists["patterns"], lists["exclude_patterns"],
        lists["path_exclude_patterns"], data.get("confidence", "stable"), scope, mode, builtin=False,
    )


def rules_from_toml(text: str) -> list[Rule]:
    """The rules of a TOML text, by id."""
    tables = tomllib.loads(text).get("rules", {})
    return [rule_from_mapping(k, tables[k]) for k in sorted(tables)]


def load_rules(*folders: str) -> list[Rule]:
    """The built-in rules and those of the TOML files of some folders, by id; an id may stand once."""
    found = {r.rule_id: r for r in builtin_rules()}
    for folder in folders:
        for path in sorted(Path(folder).glob("*.toml")):
            for rule in rules_from_toml(path.read_text("utf-8")):
                if rule.rule_id in found:
                    raise ValueError(f"{rule.rule_id} is there already")
                found[rule.rule_id] = rule
    return [found[k] for k in sorted(found)]


def active_rules(suppress: frozenset[str] | set[str] | tuple = (), custom: list[Rule] | tuple = ()) -> list[Rule]:
    """Built-in rules without the suppressed ones, and custom rules; a custom rule may not have a built-in id, suppressed or not."""
    taken = {r.rule_id for r in builtin_rules()}
    if clash := sorted(r.rule_id for r in custom if r.rule_id in taken):
        raise ValueError(f"built-in rules have the ids {', '.join(clash)}")
    return sorted((r for r in (*builtin_rules(), *custom) if r.rule_id not in set(suppress)), key=lambda r: r.rule_id)


def java(pattern: str) -> str:
    return JAVA + pattern


PATTERNS_SCHEMA = (
    "pid int, rule_id string, severity string, category string, scope string, mode string, ord int, pattern string, "
    "excludes array<string>, path_excludes array<string>"
)


def pattern_rows(rules: list[Rule] | tuple[Rule, ...]) -> list[tuple]:
    """One row for each pattern; its number is its place."""
    out = []
    for r in rules:
        for i, p in enumerate(r.patterns):
            out.append((len(out), r.rule_id, r.severity, r.category, r.scope, r.mode, i, java(p), [java(x) for x in r.excludes], [java(x) for x in r.path_excludes]))
    return out


def patterns_frame(spark: SparkSession, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame(pattern_rows(rules), PATTERNS_SCHEMA)


def rules_frame(spark: SparkSession, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    rows = [(r.rule_id, r.severity, r.category, r.description, r.recommendation, r.confidence, r.scope, r.mode, [java(x) for x in r.path_excludes]) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, severity string, category string, description string, recommendation string, confidence string, scope string, mode string, path_excludes array<string>")
