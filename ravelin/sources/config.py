"""Settings of a scan."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

from ravelin.sources.rules import Rule, rule_from_mapping

TEXT = frozenset("." + s for s in "jinja2 json md py sh toml txt yaml yml".split())
BINARY = tuple("." + s for s in "a bin dll dylib exe lib o pyc pyo so wasm".split())


@dataclass(frozen=True)
class ScanConfig:
    extensions: frozenset[str] = field(default_factory=lambda: TEXT)
    max_file_size: int = 500_000
    max_total_size: int = 5_000_000
    max_file_count: int = 100
    strict_schema: bool = False
    suppress_rules: frozenset[str] = frozenset()
    custom_rules: tuple[Rule, ...] = ()


def parse_config(text: str) -> ScanConfig:
    """Settings from TOML: [scan], [suppress], [rules.*]; keys that aren't known are passed over."""
    data = tomllib.loads(text)
    config, scan = ScanConfig(), data.get("scan", {})
    for name in ("max_file_size", "max_total_size", "max_file_count"):
        if name in scan:
            if isinstance(scan[name], bool) or not isinstance(scan[name], int):
                raise ValueError(f"scan.{name} must be a whole number")
            config = replace(config, **{name: scan[name]})
    if "strict_schema" in scan:
        if not isinstance(scan["strict_schema"], bool):
            raise ValueError("scan.strict_schema must be true or false")
        config = replace(config, strict_schema=scan["strict_schema"])
    if "extensions" in scan:
        if not isinstance(scan["extensions"], list) or not all(isinstance(x, str) for x in scan["extensions"]):
            raise ValueError("scan.extensions must be a list of texts")
        config = replace(config, extensions=frozenset(scan["extensions"]))
    ids = data.get("suppress", {}).get("rules", [])
    if not isinstance(ids, list) or not all(isinstance(x, str) for x in ids):
        raise ValueError("suppress.rules must be a list of texts")
    rules = data.get("rules", {})
    return replace(config, suppress_rules=frozenset(ids), custom_rules=tuple(rule_from_mapping(k, rules[k]) for k in sorted(rules)))


def load_config(path: str | Path) -> ScanConfig:
    return parse_config(Path(path).read_text("utf-8"))
