"""What a file is for, by its path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPT = ("bash", "js", "ps1", "py", "sh", "ts", "zsh")
CONFIG = ("cfg", "env", "ini", "jinja2", "json", "toml", "yaml", "yml")
MARKERS = tuple(w + s for w in ("example", "fixture", "reference", "sample") for s in ("", "s"))
ROLES = ("entrypoint", "script", "config", "support-doc", "reference")


def role_of(path: str) -> str:
    path = path.lower()
    if path == "skill.md":
        return "entrypoint"
    *folders, name = path.split("/")
    if name.rpartition(".")[0] in MARKERS or ("." not in name and name in MARKERS) or any(f in MARKERS for f in folders):
        return "reference"
    suffix = path.rpartition(".")[2] if "." in path else ""
    return "script" if suffix in SCRIPT else "config" if suffix in CONFIG else "support-doc"


def role(path: Column | str) -> Column:
    """The same as a column."""
    p = F.lower(F.col(path) if isinstance(path, str) else path)
    parts = F.split(p, "/")
    name = F.element_at(parts, -1)
    stem = F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    folders = F.slice(parts, 1, F.size(parts) - 1)
    suffix = F.when(F.instr(p, ".") > 0, F.substring_index(p, ".", -1)).otherwise("")
    return (
        F.when(p == "skill.md", "entrypoint")
        .when(stem.isin(*MARKERS) | F.arrays_overlap(folders, F.array(*map(F.lit, MARKERS))), "reference")
        .when(suffix.isin(*SCRIPT), "script")
        .when(suffix.isin(*CONFIG), "config")
        .otherwise("support-doc")
    )
