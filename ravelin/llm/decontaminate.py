"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so whole documents would have almost no
Jaccard similarity with an item. Items are therefore partitioned by size (distinct
shingles, by powers of two), and for each partition a document is a sequence of
sliding windows of the partition's size: the MinHash of such a window equals one of
the item's with the probability of *their* similarity. Minima of consecutive windows
are mostly the same, so a document has about 2 / size of them a word. Every pair of
a document and an item that share a minimum is verified by the exact share of the
item's shingles that the whole document has.

The index of a benchmark of up to BROADCAST_BYTES of text is broadcast and documents
are read once without a shuffle. A larger benchmark is joined by minima instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.text import FOLD_FROM, FOLD_TO, WORD_RE2, Words, grams, lean, lists, mix, raw, sliding_min, steps

SHINGLE, THRESHOLD, PERMUTATIONS = 5, 0.7, 6
BROADCAST_BYTES = 32 << 20

_ODD = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)


def size_class(n: int) -> int:
    return max(0, n.bit_length() - 1)


def tuples(words: pa.Array) -> set[tuple[bytes, ...]]:
    w = words.to_pylist()
    return set(zip(*(w[i:] for i in range(SHINGLE)), strict=False))


def minima(words: Words, sizes: list[int]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(size class, permutation, minima, their rows), without repeats of consecutive windows."""
    shingles = grams(words.hashes, SHINGLE)
    n = len(shingles)
    rows = np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))
    if not n:
        return []
    counts = np.maximum(np.diff(words.rows) - SHINGLE + 1, 0)
    found = []
    for p in range(PERMUTATIONS):
        permuted = shingles * _ODD[p]
        permuted ^= permuted >> np.uint64(32)
        for c in sizes:
            u = 1 << c
            low = sliding_min(permuted, u)
            # a window lies in one row with all its words
            inside = rows[: len(low)] == rows[u + SHINGLE - 2 : u + SHINGLE - 2 + len(low)] if len(low) else np.zeros(0, bool)
            keep = inside.copy()
            if len(low) > 1:
                keep[1:] &= (low[1:] != low[:-1]) | (rows[1 : len(low)] != rows[: len(low) - 1]) | ~inside[:-1]
            at = np.flatnonzero(keep)
            found.append((c, p, low[at], rows[at]))
            # a row of fewer shingles than a window is a window itself
            short = np.flatnonzero((counts > 0) & (counts < u))
            if len(short):
                found.append((c, p, np.array([permuted[words.rows[r] : words.rows[r] + counts[r]].min() for r in short]), short))
    return found


class Index:
    """Items of a benchmark by the minima of their windows."""

    def __init__(self, texts: list[str | None]):
        self.sets: list[set[tuple[bytes, ...]]] = []
        by: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, text in enumerate(texts):
            words = one(text)
            self.sets.append(tuples(words.array()))
            if self.sets[i]:
                c = size_class(len(self.sets[i]))
                for _, p, low, _ in minima(words, [c]):
                    by.setdefault((c, p), []).extend((int(v), i) for v in low)
        self.sizes = sorted({c for c, _ in by})
        self.tables = {k: (np.array([v for v, _ in sorted(x)], np.uint64), np.array([i for _, i in sorted(x)], np.int64)) for k, x in by.items()}

    def candidates(self, words: Words) -> np.ndarray:
        """Distinct (row, item) that share a minimum."""
        pairs = [np.zeros((0, 2), np.int64)]
        for c, p, low, rows in minima(words, self.sizes):
            values, items = self.tables.get((c, p), (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            first, last = np.searchsorted(values, low, "left"), np.searchsorted(values, low, "right")
            hit = np.flatnonzero(last > first)
            for h in hit:
                pairs.append(np.stack([np.full(last[h] - first[h], rows[h]), items[first[h] : last[h]]], 1))
        return np.unique(np.concatenate(pairs), axis=0)


def one(text: str | None) -> Words:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Words(data, np.array([0, len(data)]))


def containments(column: pa.Array, index: Index) -> pa.Array:
    """list<struct<item, containment>> of every row: the items that it has enough of."""
    data, offsets = raw(column)
    item, share, ends = [], [], np.zeros(len(column) + 1, np.int64)
    for lo, hi in steps(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        found = index.candidates(words)
        spelled = words.array() if len(found) else None
        row, has = -1, set()
        for r, i in found.tolist():
            if r != row:
                row, has = r, tuples(spelled[words.rows[r] : words.rows[r + 1]])
            part = len(index.sets[i] & has) / len(index.sets[i])
            if part >= THRESHOLD:
                item.append(i)
                share.append(round(part, 6))
                ends[lo + r + 1] += 1
    values = pa.StructArray.from_arrays([pa.array(item, pa.int32()), pa.array(share, pa.float64())], ["item", "containment"])
    return lists(values, np.cumsum(ends))


def _search(text: Column | str, index: Index, spark) -> Column:
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("array<struct<item: int, containment: double>>")
    @lean
    def search(column: pa.Array) -> pa.Array:
        return containments(column, shared.value)

    return search(text)


def _small(benchmark: DataFrame, limit: int) -> bool:
    return (benchmark.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) <= limit


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The items that a document has at least THRESHOLD of, by distinct shingles of SHINGLE words.

    Returns doc_id, item_id, containment: a row for each row of documents and row of the
    benchmark, so that repeated rows and ids are found each by themselves. Null and empty texts,
    and items of fewer words than a shingle, are never found. An empty table on either side
    gives an empty result. Null ids are carried as they are, other columns aren't.
    """
    spark = docs.sparkSession
    if not _small(benchmark, broadcast_bytes):
        return _joined(docs, benchmark)
    items = benchmark.select("item_id", "text").collect()
    index = Index([r["text"] for r in items])
    kind = benchmark.schema["item_id"].dataType
    hits = docs.select("doc_id", F.explode(_search("text", index, spark)).alias("__rv_hit")).select("doc_id", "__rv_hit.item", "__rv_hit.containment")
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)], f"item int, item_id {kind.simpleString()}")
    return hits.join(F.broadcast(names), "item").select("doc_id", "item_id", "containment")


def clean_only(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows without any item, with all their columns."""
    if _small(benchmark, broadcast_bytes):
        index = Index([r["text"] for r in benchmark.select("text").collect()])
        return docs.withColumn("__rv_hits", _search("text", index, docs.sparkSession)).filter(F.size("__rv_hits") == 0).drop("__rv_hits")
    hit = _pairs(docs, benchmark).select(F.col("h").alias("__rv_h"), F.col("id").alias("__rv_id")).distinct()
    same = (F.xxhash64("text") == F.col("__rv_h")) & F.col("doc_id").eqNullSafe(F.col("__rv_id"))
    return docs.join(hit, same, "left_anti")


def _minima_column(text: Column | str, sizes: list[int] | None) -> Column:
    """array<struct<size, permutation, low>>; without ``sizes``, for the text's own size only."""

    @F.arrow_udf("array<struct<c: int, p: int, low: bigint>>")
    def spread(column: pa.Array) -> pa.Array:
        data, offsets = raw(column)
        parts, ends = [], [0]
        for r in range(len(column)):
            text = data[offsets[r] : offsets[r + 1]]
            words = Words(text, np.array([0, len(text)]))
            own = sizes if sizes is not None else [size_class(len(tuples(words.array())))]
            got = minima(words, own)
            parts += got
            ends.append(ends[-1] + sum(len(low) for _, _, low, _ in got))
        of = lambda k: np.concatenate([np.zeros(0, np.int32), *(np.full(len(x[2]), x[k], np.int32) for x in parts)])
        low = np.concatenate([np.zeros(0, np.uint64), *(x[2] for x in parts)]).view(np.int64)
        return lists(pa.StructArray.from_arrays([pa.array(of(0)), pa.array(of(1)), pa.array(low)], ["c", "p", "low"]), np.array(ends))

    return spread(text)


def _pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(h, id, b, item_id, containment) of verified pairs, by a join on minima and joins to both texts."""
    items = benchmark.select("item_id", "text", F.xxhash64("item_id", "text").alias("b"))
    signed = items.select("b", F.inline(_minima_column("text", None)))
    sizes = sorted(r["c"] for r in signed.select("c").distinct().collect())
    keyed = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h"))
    found = keyed.select("id", "h", F.inline(_minima_column("text", sizes))).join(signed, ["c", "p", "low"]).select("id", "h", "b").distinct()
    both = found.join(keyed.dropDuplicates(["id", "h"]), (found["h"] == keyed["h"]) & found["id"].eqNullSafe(keyed["id"])).select(found["id"], found["h"], "b", "text")
    both = both.join(items.select("b", "item_id", F.col("text").alias("item_text")).distinct(), "b")

    @F.arrow_udf("double")
    def share(texts: pa.Array, wanted: pa.Array) -> pa.Array:
        out = []
        for t, w in zip(texts.to_pylist(), wanted.to_pylist(), strict=True):
            want = tuples(one(w).array())
            out.append(round(len(want & tuples(one(t).array())) / len(want), 6) if want else 0.0)
        return pa.array(out, pa.float64())

    return both.select("id", "h", "b", "item_id", share("text", "item_text").alias("containment")).filter(F.col("containment") >= THRESHOLD)


def _joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    pairs = _pairs(docs, benchmark)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h2"))
    times = benchmark.groupBy(F.xxhash64("item_id", "text").alias("b2")).agg(F.count("*").alias("n"))
    hits = rows.join(pairs, (rows["h2"] == pairs["h"]) & rows["doc_id"].eqNullSafe(pairs["id"])).join(times, F.col("b") == F.col("b2"))
    return hits.withColumn("n", F.explode(F.expr("sequence(1, n)"))).select("doc_id", "item_id", "containment")


def _shingles_sql(table: str, key: str) -> str:
    words = f"regexp_extract_all(translate(text, '{FOLD_FROM}', '{FOLD_TO}'), '{WORD_RE2}')"
    return f"""
  SELECT DISTINCT r, {key}, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - {SHINGLE - 2})) AS i
        FROM (SELECT row_number() OVER () AS r, {key}, {words} AS w FROM {table}))"""


CONTAMINATED_SQL = f"""
WITH d AS ({_shingles_sql("documents", "doc_id")}),
b AS ({_shingles_sql("benchmark", "item_id")}),
n AS (SELECT r, count(*) AS n FROM b GROUP BY r),
hits AS (SELECT d.r AS dr, b.r AS br, any_value(d.doc_id) AS doc_id, any_value(b.item_id) AS item_id, count(*) AS m
         FROM d JOIN b USING (s) GROUP BY d.r, b.r)
SELECT doc_id, item_id, round(m / n.n, 6) AS containment
FROM hits JOIN n ON n.r = hits.br WHERE m / n.n >= {THRESHOLD}
"""
