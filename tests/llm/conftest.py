import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def make(spark):
    """documents from (doc_id, text) or (doc_id, text, lang)."""

    def of(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return of


@pytest.fixture
def odd(spark, make):
    """Null and empty texts, null and repeated ids, a repeated row, a very long text, signs only, and clashing extra columns."""
    from pyspark.sql import functions as F

    rows = [(1, None), (2, ""), (None, "one two three"), (3, "same text here"), (3, "same text here"), (4, "x " * 60_000), (5, "?!... \n\n"), (6, "straße ÀÉ 日本語"), (None, None)]
    docs = make(rows)
    for name in ("token_ids", "n_tokens", "fp", "item", "predicted", "shard", "parts", "id", "h", "begin", "group_id", "accepted"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.fixture
def none(odd):
    return odd.limit(0)
