"""Operator 2: substring dedup by seed and extend.

A repeat is a run of at least MIN_WORDS words that stands in two places, in two
documents or twice in one. Anchors are winnowed from the hashes of runs of SEED
words: the least of every REACH consecutive hashes, so that each run of MIN_WORDS
words holds an anchor that its own words choose. Documents are joined on anchors,
and the places of an anchor are extended both ways as far as its REACH, in three steps:

1. Places whose whole surroundings (an anchor with REACH - 1 words on each side) are
   the same match over all of it. They are one class, and its first place stands for it.
2. An anchor with one class is done. Where there are several, the first places of the
   classes are compared run by run: for each of the REACH runs of MIN_WORDS words
   around the anchor, who else has it?
3. What matches around neighbouring anchors overlaps; its union is the maximal repeats.

The result is what comparing all pairs of places would give, yet a passage that is in
a million documents costs a million rows, not their square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.llm.shared import saved
from ravelin.llm.text import Words, grams, lean, lists, mix, raw, sliding_min, steps

MIN_WORDS, SEED = 50, 24
#: Seeds among which one is an anchor; also the number of runs of MIN_WORDS words that hold a given seed.
REACH = MIN_WORDS - SEED + 1

#: Anchors with more surroundings than this are too many for one task.
HOT_CLASSES = 1 << 16
#: Places whose runs one vectorised step merges.
STEP_PLACES = 1 << 14

_AROUND = np.arange(-(REACH - 1), SEED + REACH - 1)
_WEIGHTS = mix(np.arange(1, len(_AROUND) + 1, dtype=np.uint64)) | np.uint64(1)
_EDGE = np.uint64(0x452821E638D01377)
_LOW = np.uint64((1 << 28) - 1)


def anchor_places(words: Words) -> np.ndarray:
    """Word positions of the anchors, within all rows together."""
    seeds = grams(words.hashes, SEED)
    if len(seeds) < REACH:
        return np.zeros(0, np.int64)
    marked = (seeds & ~_LOW) | (np.arange(len(seeds), dtype=np.uint64) & _LOW)
    least = sliding_min(marked, REACH)
    row = np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))
    within = row[: len(least)] == row[MIN_WORDS - 1 : MIN_WORDS - 1 + len(least)]
    at = np.arange(len(least)) + ((least & _LOW).astype(np.int64) - np.arange(len(least))) % (1 << 28)
    at = at[within]
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def anchors(column: pa.Array) -> pa.Array:
    """array<struct<a, c, p, v>>: seed hash, hash of the surroundings, word position, mask of the runs that the document has room for."""
    data, offsets = raw(column)
    parts, ends = [], np.zeros(len(column) + 1, np.int64)
    for lo, hi in steps(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        at = anchor_places(words)
        if not len(at):
            continue
        row = np.searchsorted(words.rows, at, "right") - 1
        begin, end = words.rows[row], words.rows[row + 1]
        around = np.zeros(len(at), np.uint64)
        for weight, step in zip(_WEIGHTS, _AROUND.tolist(), strict=True):
            where = at + step
            inside = (where >= begin) & (where < end)
            around += np.where(inside, words.hashes[np.where(inside, where, 0)], _EDGE) * weight
        mask = np.zeros(len(at), np.int64)
        for k in range(REACH):
            mask |= ((at - k >= begin) & (at - k + MIN_WORDS <= end)).astype(np.int64) << k
        seeds = grams(words.hashes, SEED)[at]
        parts.append((seeds.view(np.int64), mix(around).view(np.int64), (at - begin).astype(np.int32), mask))
        ends[lo + 1 : hi + 1] = np.bincount(row, minlength=hi - lo)
    kinds = (np.int64, np.int64, np.int32, np.int64)
    fields = [pa.array(np.concatenate([np.zeros(0, k), *(x[i] for x in parts)])) for i, k in enumerate(kinds)]
    return lists(pa.StructArray.from_arrays(fields, ["a", "c", "p", "v"]), np.cumsum(ends))


def runs_around(texts: pa.Array, places: pa.Array) -> pa.Array:
    """array<array<bigint>>: for each place its runs' hashes, by how far before the place they begin; 0 where there's no room."""
    data, offsets = raw(texts)
    at_rows = np.concatenate([[0], np.cumsum(np.asarray(places.value_lengths().fill_null(0)))])
    at_all = np.asarray(places.flatten()).astype(np.int64)
    out = np.zeros((len(at_all), REACH), np.uint64)
    for lo, hi in steps(offsets):
        words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        runs = grams(words.hashes, MIN_WORDS)
        many = np.diff(at_rows[lo : hi + 1])
        mine = slice(at_rows[lo], at_rows[hi])
        begin, end = np.repeat(words.rows[:-1], many), np.repeat(words.rows[1:], many)
        at = at_all[mine] + begin
        for k in range(REACH):
            room = (at - k >= begin) & (at - k + MIN_WORDS <= end)
            if room.any():
                out[mine, k] = np.where(room, runs[np.where(room, at - k, 0)], 0)
    inner = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * REACH, pa.int32()), pa.array(out.ravel().view(np.int64)))
    return lists(inner, at_rows)


def merged(found: pa.Array) -> pa.Array:
    """array<struct<begin, end, first>> of each row's list<struct<p, cov, own>>: maximal repeats, and within them the parts that stand here first.

    cov and own are masks of runs; bit k is the run that begins k words before p. A part is
    ``first`` if no run that is elsewhere first covers it.
    """
    many = np.asarray(found.value_lengths().fill_null(0))
    values = [_merged(found.slice(lo, hi - lo), many[lo:hi]) for lo, hi in steps(np.concatenate([[0], np.cumsum(many)]), STEP_PLACES)]
    kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("first", pa.bool_())])
    sizes = np.concatenate([[0], *(n for _, n in values)])
    return lists(pa.concat_arrays([pa.array([], kind), *(v for v, _ in values)]), np.cumsum(sizes))


def _merged(found: pa.Array, many: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of some rows, and how many each row has."""
    items, item_row = found.flatten(), np.repeat(np.arange(len(found)), many)
    p, cov, own = (np.asarray(items.field(name)).astype(np.int64) for name in ("p", "cov", "own"))
    rows, starts, mine = [], [], []
    for k in range(REACH):
        has = np.flatnonzero(cov >> k & 1)
        rows.append(item_row[has])
        starts.append(p[has] - k)
        mine.append(own[has] >> k & 1)
    row, start, first = np.concatenate(rows), np.concatenate(starts), np.concatenate(mine)
    order = np.lexsort((start, row))
    row, start, first = row[order], start[order], first[order]
    if len(row):
        # a run is first if it is by every anchor that covers it
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1])]))
        row, start, first = row[new], start[new], np.minimum.reduceat(first, new)
    out_row, begin, end, kind = parts_of(row, start, first.astype(bool))
    values = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(kind)], ["begin", "end", "first"])
    return values, np.bincount(out_row, minlength=len(found))


def spans(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, end) of the union of runs, given in order."""
    if not len(row):
        return row, start, start
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + MIN_WORDS)])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], start[at], start[last] + MIN_WORDS


def parts_of(row: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts (row, begin, end, first) of runs in order: what a later run covers isn't first; the rest of the union is."""
    u_row, u_begin, u_end = spans(row, start)
    l_row, l_begin, l_end = spans(row[~first], start[~first])
    # the union that each later span lies in, and what of it is before that span and after the last one
    wide = np.int64(1) << 40
    inside = np.searchsorted(u_row * wide + u_begin, l_row * wide + l_begin, "right") - 1
    before = u_begin[inside]
    follows = np.flatnonzero(inside[1:] == inside[:-1]) + 1
    before[follows] = l_end[follows - 1]
    rest = u_begin.copy()
    np.maximum.at(rest, inside, l_end)
    out_row = np.concatenate([l_row, l_row, u_row])
    begin = np.concatenate([before, l_begin, rest])
    end = np.concatenate([l_begin, l_end, u_end])
    kind = np.repeat([True, False, True], [len(l_row), len(l_row), len(u_row)])
    keep = np.flatnonzero(begin < end)
    keep = keep[np.lexsort((begin[keep], out_row[keep]))]
    return out_row[keep], begin[keep], end[keep], kind[keep]


def _arrow(function, kind: str):
    return F.arrow_udf(lean(function), kind)


#: The order of places: by document (null last), text and position.
_PLACE = ("id", "h", "p")


def _place():
    return F.struct(F.col("id").isNull().alias("none"), *_PLACE)


def _partial(rows: DataFrame) -> DataFrame:
    """(a, id, h, p, cov, own) from rows (a, id, h, p, k, heads): the runs of each place that others have, and those that it has first."""
    bit = F.expr("shiftleft(1L, k)")
    return rows.groupBy("a", *_PLACE).agg(F.sum(bit).alias("cov"), F.sum(F.when(F.col("heads"), bit).otherwise(0)).alias("own"))


def _by_window(around: DataFrame) -> DataFrame:
    """Who else has each run around an anchor: one shuffle of runs in arrays, and one task for all places of an anchor."""
    each = around.repartition("a").select("a", *_PLACE, "size", F.posexplode("runs").alias("k", "run")).filter("run <> 0")
    same = W.partitionBy("a", "k", "run")
    each = each.withColumn("total", F.sum("size").over(same)).filter("total > 1")
    return _partial(each.withColumn("heads", F.row_number().over(same.orderBy(F.col("id").isNull(), *_PLACE)) == 1))


def _by_sums(around: DataFrame) -> DataFrame:
    """The same for anchors with very many places: sums and least places, combined before the shuffle, and a join that AQE can split."""
    each = around.select("a", *_PLACE, "size", F.posexplode("runs").alias("k", "run")).filter("run <> 0")
    said = each.groupBy("a", "k", "run").agg(F.sum("size").alias("total"), F.min(_place()).alias("least")).filter("total > 1")
    return _partial(each.join(said, ["a", "k", "run"]).withColumn("heads", _place() == F.col("least")))


def _spans(docs: DataFrame, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """(id, h, parts): for each document with a repeat, its parts; h is the hash of its text."""
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), "text")
    seeds = keyed.select("id", "h", F.inline(_arrow(anchors, "array<struct<a: bigint, c: bigint, p: int, v: bigint>>")("text")))
    place = _place()
    # an anchor may be in a third of all documents: what is asked of its places are sums and least
    # places, which tasks combine before anything is shuffled; joins on it AQE can split
    often = seeds.groupBy("a").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).filter("n > 1")
    shared = saved(seeds.join(often.select("a", (F.col("c0") != F.col("c1")).alias("several")), "a"))
    classes = shared.groupBy("a", "c").agg(F.min(place).alias("least"), F.max(place).alias("last"))
    classes = classes.select("a", "c", "least", F.when(F.col("least") == F.col("last"), 1).otherwise(2).alias("size"))
    sized = shared.join(classes, ["a", "c"]).filter("several OR size > 1").withColumn("heads", place == F.col("least"))
    # whole surroundings are elsewhere; the first place of a class stands for it where there are other classes
    whole = sized.filter("NOT heads OR NOT several").select("id", "h", "p", F.col("v").alias("cov"), F.when(F.col("heads"), F.col("v")).otherwise(0).alias("own"))
    open_ = sized.filter("heads AND several")
    wanted = open_.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("p", "a", "size"))).alias("at"))
    wanted = wanted.withColumn("places", F.col("at.p"))
    texts = keyed.join(wanted.withColumnsRenamed({"id": "id2", "h": "h2"}), (F.col("h") == F.col("h2")) & F.col("id").eqNullSafe(F.col("id2")))
    texts = texts.dropDuplicates(["id", "h"])
    around = texts.select("id", "h", F.explode(F.arrays_zip("at", _arrow(runs_around, "array<array<bigint>>")("text", "places").alias("runs"))).alias("x"))
    around = around.select("x.at.a", "id", "h", "x.at.p", "x.at.size", "x.runs")
    hot = classes.groupBy("a").count().filter(F.col("count") > hot_classes).select("a")
    if hot.isEmpty():
        partial = _by_window(around)
    else:
        around, hot = saved(around), saved(hot)
        partial = _by_window(around.join(hot, "a", "left_anti")).unionByName(_by_sums(around.join(hot, "a", "left_semi")))
    found = whole.unionByName(partial.select("id", "h", "p", "cov", "own"))
    listed = found.groupBy("id", "h").agg(F.collect_set(F.struct("p", "cov", "own")).alias("found"))
    return listed.select("id", "h", _arrow(merged, "array<struct<begin: int, end: int, first: boolean>>")("found").alias("parts"))


def repeats(docs: DataFrame) -> DataFrame:
    """The maximal repeats of every document, in words from 0, cut where a part stands here first.

    Returns doc_id, begin, end (exclusive), n_words, first: the parts of each maximal repeat;
    ``first`` parts are those that no earlier place has, in the order of doc_id (null last), text
    hash and position. A document of fewer than MIN_WORDS words has none, as have null and
    empty texts. Rows that repeat (one doc_id, one text) are one document. Runs that overlap
    themselves, as in a word said a thousand times, are first only at their first place. An
    empty table gives an empty one; other columns aren't carried along.
    """
    spans = _spans(docs).select(F.col("id").alias("doc_id"), F.inline("parts"))
    return spans.select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"), "first")


def cut(texts: pa.Array, parts: pa.Array) -> pa.Array:
    """The texts without the parts that stand elsewhere first."""
    data, offsets = raw(texts)
    many = np.asarray(parts.value_lengths().fill_null(0))
    items, item_row = parts.flatten(), np.repeat(np.arange(len(parts)), many)
    drop = np.flatnonzero(~np.asarray(items.field("first")))
    row, begin, end = item_row[drop], np.asarray(items.field("begin"))[drop].astype(np.int64), np.asarray(items.field("end"))[drop].astype(np.int64)
    out, sizes = [], np.diff(offsets)
    for lo, hi in steps(offsets):
        part = data[offsets[lo] : offsets[hi]]
        mine = slice(*np.searchsorted(row, [lo, hi]))
        if row[mine].size:
            at = offsets[lo : hi + 1] - offsets[lo]
            words = Words(part, at)
            r = row[mine] - lo
            first, last = words.rows[r] + begin[mine], words.rows[r] + end[mine]
            # up to where the next word begins, or the text ends
            begins = words.starts[first]
            ends = np.where(last < words.rows[r + 1], words.starts[np.minimum(last, len(words.starts) - 1)], at[r + 1])
            gone = np.zeros(len(part) + 1, np.int32)
            np.add.at(gone, begins, 1)
            np.add.at(gone, ends, -1)
            keep = np.cumsum(gone[:-1]) == 0
            kept = np.concatenate([[0], np.cumsum(keep)])
            sizes[lo:hi] = np.diff(kept[at])
            part = part[keep]
        out.append(part)
    made = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(np.concatenate([np.zeros(0, np.uint8), *out]))])
    return pc.if_else(texts.is_valid(), made, pa.scalar(None, pa.large_string())).cast(pa.string())


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with each repeated passage left only where it stands first; all columns, n_chars counted anew.

    A document that is nothing but repeats keeps its row, with what is left of its text. Null,
    empty and short texts stay as they are; rows that repeat are one document and all stay as
    they are cut. An empty table gives an empty one.
    """
    spans = _spans(docs).select(F.col("id").alias("__rv_id"), F.col("h").alias("__rv_h"), F.col("parts").alias("__rv_parts"))
    joined = docs.withColumn("__rv_hash", F.xxhash64("text")).join(spans, (F.col("__rv_hash") == F.col("__rv_h")) & F.col("doc_id").eqNullSafe(F.col("__rv_id")), "left")
    shorter = joined.withColumn("text", F.when(F.col("__rv_parts").isNull(), F.col("text")).otherwise(_arrow(cut, "string")("text", "__rv_parts")))
    if "n_chars" in docs.columns:
        shorter = shorter.withColumn("n_chars", F.when(F.col("__rv_parts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return shorter.select(*docs.columns)
