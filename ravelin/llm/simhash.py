"""Operator 1: SimHash near-dedup with BK-trees.

The fingerprint of a document has 128 bits, by majority over its distinct words.
Two documents are near copies if their fingerprints differ in at most RADIUS bits;
groups are the connected components of near copies.

Distances of unrelated fingerprints crowd around 64, where a BK-tree over all of them
would prune next to nothing. They are therefore put into shards by BANDS fixed samples
of BAND_BITS bits, and every shard has a BK-tree of its own (children keyed by their
integer Hamming distance to the parent). Every fingerprint queries its tree in each
shard and follows only edges within the radius. A pair at distance d shares a shard
with probability 1 - (1 - C(128 - d, BAND_BITS) / C(128, BAND_BITS))^BANDS: over 0.99 up
to d = 12, 0.986 at 13, 0.972 at 14, 0.949 at 15, 0.917 at the radius. Up to BROADCAST_FINGERPRINTS distinct fingerprints, the trees of all
shards are built once and broadcast; beyond, shards are shuffled and every task builds
the trees of its own. Both find the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import components, saved
from ravelin.llm.text import Words, lean, mix, raw, steps

RADIUS, BANDS, BAND_BITS = 16, 32, 18
BROADCAST_FINGERPRINTS = 20_000
#: Pairs of a query and a node that one vectorised step compares at most.
FRONTIER = 1 << 20
#: Nodes that search at first, before what they find is known to the next ones, twice as many each time.
FIRST_ASKED = 256
#: What a text has a word by, as the words of ``text.Words`` are.
HAS_WORD = r"[0-9A-Za-z_]|[^\x00-\x7F]"

_HALVES = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_SAMPLES = np.stack([np.random.default_rng(b).choice(128, BAND_BITS, replace=False) for b in range(BANDS)])


# --- fingerprints -----------------------------------------------------------


def fingerprints(column: pa.Array) -> pa.Array:
    """binary(16) of every row; null where a text has no words."""
    data, offsets = raw(column)
    out = np.zeros((len(column), 16), np.uint8)
    has = np.zeros(len(column), dtype=bool)
    for lo, hi in steps(offsets, 1 << 20):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not len(words.hashes):
            continue
        rows = np.repeat(np.arange(hi - lo), np.diff(words.rows))
        _, first = np.unique(words.hashes ^ mix(rows.astype(np.uint64) + np.uint64(1)), return_index=True)
        first.sort()
        rows, hashes = rows[first], words.hashes[first]
        bits = np.unpackbits(np.stack([mix(hashes ^ h) for h in _HALVES], 1).view(np.uint8), axis=1)
        present, starts, many = np.unique(rows, return_index=True, return_counts=True)
        for row, at, n in zip(present.tolist(), starts.tolist(), many.tolist(), strict=True):
            out[lo + row] = np.packbits(2 * bits[at : at + n].sum(0, dtype=np.int32) > n)
        has[lo + present] = True
    return pa.array([bytes(f) if h else None for f, h in zip(out, has, strict=True)], pa.binary())


def fingerprint(text: Column | str) -> Column:
    return F.arrow_udf(lean(fingerprints), "binary")(text)


def shard_keys(prints: np.ndarray) -> np.ndarray:
    """(n, BANDS) shard of each of n fingerprints (n, 16) in each band."""
    bits = np.unpackbits(prints, axis=1)
    weights = (1 << np.arange(BAND_BITS)).astype(np.int64)
    keys = np.empty((len(prints), BANDS), np.int64)
    for b in range(BANDS):
        keys[:, b] = bits[:, _SAMPLES[b]].astype(np.int64) @ weights + (b << BAND_BITS)
    return keys


def as_rows(column: pa.Array) -> np.ndarray:
    """(n, 16) bytes of a column of fingerprints without nulls."""
    if not len(column):
        return np.zeros((0, 16), np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between (n, 2) and (n, 2) words."""
    return np.bitwise_count(a ^ b).sum(1).astype(np.int64)


# --- BK-trees ---------------------------------------------------------------


class Forest:
    """BK-trees of many shards in flat arrays. Node i is row i; ``edges`` are parent * 129 + distance, sorted; the first row of a shard is its root.

    ``label`` is the least node of each node's component, as far as nodes are within the radius
    of what they met on their way down: most of a ball of near copies is one before any search.
    """

    def __init__(self, keys: np.ndarray, prints: np.ndarray):
        """keys: sorted shard of each row."""
        self.prints = np.ascontiguousarray(prints).view(np.uint64)
        self.keys, self.roots, sizes = np.unique(keys, return_index=True, return_counts=True)
        self.tree = np.repeat(np.arange(len(self.keys)), sizes)
        at = np.repeat(self.roots, sizes)
        todo = np.arange(len(keys))
        self.label = np.arange(len(keys))
        at, todo = at[todo != at], todo[todo != at]
        edges, self.levels = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(todo):
            # all rows descend together; the first at a free edge becomes the child there
            d = hamming(self.prints[todo], self.prints[at])
            merge(self.label, todo[d <= RADIUS], at[d <= RADIUS])
            edge = at * 129 + d
            taken, first, which = np.unique(edge, return_index=True, return_inverse=True)
            child = todo[first]
            edges.append(taken)
            self.levels.append(child)
            at = child[which]
            down = todo != at
            at, todo = at[down], todo[down]
        self.parents = [e // 129 for e in edges]
        edges, children = np.concatenate(edges), np.concatenate(self.levels)
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def _uniform(self, label: np.ndarray) -> np.ndarray:
        """Whether all nodes under a node, and it, have one label."""
        low, high = label.copy(), label.copy()
        for parent, child in zip(self.parents[::-1], self.levels[::-1], strict=True):
            np.minimum.at(low, parent, low[child])
            np.maximum.at(high, parent, high[child])
        return low == high

    def link(self, ask: np.ndarray | None = None) -> np.ndarray:
        """Least node of the component of each node, as far as the nodes ``ask`` (all, if None) find what is within the radius.

        A search follows only edges within the radius of its distance, and no edge to a part of
        the tree that is all of its own component; nodes of the largest component of a tree
        needn't search, as the others find them. So the pairs within a group of near copies
        are neither compared nor given out one by one, and no link to another group is lost.
        """
        label = self.label.copy()
        ask = np.arange(len(label)) if ask is None else ask
        if not len(ask):
            return label
        sizes = np.bincount(label, minlength=len(label))
        most = np.maximum.reduceat(sizes, self.roots)[self.tree]
        largest = np.full(len(self.roots), len(label))
        np.minimum.at(largest, self.tree[sizes == most], np.flatnonzero(sizes == most))
        ask = ask[label[ask] != largest[self.tree[ask]]]
        lo, many = 0, FIRST_ASKED
        while lo < len(ask):
            uniform = self._uniform(label)
            query = ask[lo : lo + many]
            stack = [(query, self.roots[self.tree[query]])]
            lo, many = lo + many, many * 2
            while stack:
                query, node = stack.pop()
                if len(query) > FRONTIER:
                    stack.append((query[FRONTIER:], node[FRONTIER:]))
                    query, node = query[:FRONTIER], node[:FRONTIER]
                other = ~(uniform[node] & (label[node] == label[query]))
                query, node = query[other], node[other]
                if not len(query):
                    continue
                d = hamming(self.prints[query], self.prints[node])
                near = d <= RADIUS
                merge(label, query[near], node[near])
                first = np.searchsorted(self.edges, node * 129 + np.maximum(d - RADIUS, 0), "left")
                last = np.searchsorted(self.edges, node * 129 + np.minimum(d + RADIUS, 128), "right")
                n = last - first
                if n.any():
                    stack.append((np.repeat(query, n), self.children[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]))
        return label


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i], in place; every label is the least node of its component before and after."""
    while len(a):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return
        low = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, label[side], low)
        while (jump := label[label] != label).any():
            label[jump] = label[label[jump]]


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    of = lambda x: pa.array([bytes(r) for r in x], pa.binary())
    return pa.RecordBatch.from_arrays([of(a), of(b)], ["a", "b"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each shard, from rows (shard, fingerprint) sorted by shard."""
    kept_keys, kept = [], []

    def flush() -> Iterator[pa.RecordBatch]:
        keys, prints = np.concatenate(kept_keys), np.concatenate(kept)
        many = np.zeros(len(keys), dtype=bool)
        same = keys[1:] == keys[:-1]
        many[1:] = same
        many[:-1] |= same
        keys, prints = keys[many], prints[many]
        if len(keys):
            label = Forest(keys, prints).link()
            joined = np.flatnonzero(label != np.arange(len(label)))
            if len(joined):
                yield _batch(prints[joined], prints[label[joined]])

    for batch in batches:
        keys, prints = np.asarray(batch.column(0)), as_rows(batch.column(1))
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            kept_keys.append(keys[:cut])
            kept.append(prints[:cut])
            if sum(map(len, kept_keys)) >= 1 << 16:
                yield from flush()
                kept_keys, kept = [], []
        kept_keys.append(keys[cut:])
        kept.append(prints[cut:])
    if kept_keys:
        yield from flush()


def near_edges(prints: DataFrame, broadcast_limit: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """Edges (a, b) that join all near copies among the distinct fingerprints ``fp``."""
    spark = prints.sparkSession
    if prints.limit(broadcast_limit + 1).count() <= broadcast_limit:
        all_prints = as_rows(pa.array([bytes(r["fp"]) for r in prints.collect()], pa.binary()))
        keys = shard_keys(all_prints)
        order = np.argsort(keys, axis=None, kind="stable")
        # where the node of print i in band b is
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        number = {p.tobytes(): i for i, p in enumerate(all_prints)}
        trees = spark.sparkContext.broadcast((Forest(keys.ravel()[order], np.repeat(all_prints, BANDS, 0)[order]), place.reshape(-1, BANDS), number))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, places, number = trees.value
            nodes = forest.prints.view(np.uint8).reshape(-1, 16)
            for batch in batches:
                ask = places[[number[p] for p in batch.column(0).to_pylist()]].ravel()
                label = forest.link(ask)
                # what the search joined, and what its own nodes hang on by the trees
                joined = np.unique(np.concatenate([np.flatnonzero(label != forest.label), ask]))
                joined = joined[label[joined] != joined]
                if len(joined):
                    yield _batch(nodes[joined], nodes[label[joined]])

        return prints.select("fp").mapInArrow(probe, "a binary, b binary").filter("a <> b").distinct()

    @F.arrow_udf("array<bigint>")
    def shards(column: pa.Array) -> pa.Array:
        keys = shard_keys(as_rows(column))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))

    placed = prints.select(F.explode(shards("fp")).alias("shard"), "fp").repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(_shards, "a binary, b binary").distinct()


# --- groups -----------------------------------------------------------------


def _groups(docs: DataFrame, broadcast_limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, h, fp) of every document, and for each fp the row that stays of its group (id, h, row) and the size of the group."""
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"), fingerprint("text").alias("fp"))
    keyed = saved(numbered)
    # the least doc_id stays, null last; the text decides between rows of one doc_id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h", "row"))
    prints = saved(keyed.filter("fp IS NOT NULL").groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    roots = components(near_edges(prints.select("fp"), broadcast_limit))
    rooted = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    sized = rooted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("size"))
    return keyed, rooted.select("fp", "root").join(sized, "root").select("fp", "stays", "size")


def near_duplicates(docs: DataFrame, broadcast_limit: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """The group of near copies that every document is in.

    Returns doc_id, group_id (the least doc_id of the group, null if it has none), group_size,
    duplicate (whether another row of the group stays instead): one row of each group isn't,
    that of the least doc_id. A text that is null or has no words is a group by itself with
    group_id its doc_id. Repeated rows are copies of each other, also with one doc_id, and all
    but one are duplicates. Of rows with one doc_id and other texts the hash of the text
    decides. An empty table gives an empty one; other columns aren't carried along.
    """
    keyed, groups = _groups(docs, broadcast_limit)
    alone = F.col("g.fp").isNull()
    joined = keyed.alias("k").join(groups.alias("g"), "fp", "left")
    return joined.select(
        F.col("k.doc_id").alias("doc_id"),
        F.when(alone, F.col("k.doc_id")).otherwise(F.col("stays.id")).alias("group_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
        F.when(alone, False).otherwise(F.col("k.row") != F.col("stays.row")).alias("duplicate"),
    )


def one_of_each(docs: DataFrame, broadcast_limit: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """The documents with one row of each group of near copies, with all their columns.

    The row of the least doc_id stays (null last), then that of the least hash of its text. Rows
    of one doc_id and one text are copies too, whatever their other columns: of them the one
    whose columns (but maps) have the least hash stays, so that the choice never depends on the
    order of rows. Rows whose text is null or has no words all stay. An empty table gives an empty one.
    """
    _, groups = _groups(docs, broadcast_limit)
    stay = groups.select(F.col("stays.id").alias("__rv_id"), F.col("stays.h").alias("__rv_h")).distinct()
    marked = docs.withColumn("__rv_hash", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(HAS_WORD), F.lit(False))
    # by the id too, so that copies of one text don't go to one task
    some = marked.filter(worded).join(stay, (F.col("__rv_hash") == F.col("__rv_h")) & F.col("doc_id").eqNullSafe(F.col("__rv_id")), "left_semi")
    others = [c for c, kind in docs.dtypes if "map<" not in kind]
    row = F.struct(*(F.col(c) for c in docs.columns))
    kept = some.groupBy("__rv_hash", "doc_id").agg(F.min_by(row, F.xxhash64(*others)).alias("__rv_row"))
    return kept.select("__rv_row.*").unionByName(docs.filter(~worded))
