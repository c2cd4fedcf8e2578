"""Operator 7: quality rules by distribution divergence.

Every document has two histograms: of character classes, and of common words (one
slot a word, one for all other words). The common words of a language are its COMMON
most frequent ones, counted over all documents that carry it, so any language has its
own. The histograms are held against the references of the document's language, which
are the pooled histograms of these documents, by Jensen-Shannon distance (the root of
the divergence to base 2).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ravelin.llm.text import FOLD_FROM, FOLD_TO, WORD_RE2, HashTable, Words, lean, mix, raw, steps

#: Character classes by byte; a non-ASCII character counts once, by its first byte.
CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "sign", "control", "other")
_STOPS = b".,;:?'\"()-"
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[32] = _CLASS[9] = 3
_CLASS[10] = _CLASS[13] = 4
_CLASS[list(_STOPS)] = 5
_CLASS[:9] = _CLASS[[11, 12, *range(14, 32), 127]] = 7
_CLASS[192:] = 8
_CLASS[128:192] = 9

#: Words of a language that have slots of their own; the last slot is for all others.
COMMON = 64
SLOTS = COMMON + 1
#: A document of n words is rejected beyond base + spread / sqrt(n): the spread allows for what chance does to a short text.
CLASS_BASE, CLASS_SPREAD = 0.2, 0.8
WORD_BASE, WORD_SPREAD = 0.12, 2.6
#: Fewer words than this are too few to judge: such a document is accepted.
MIN_WORDS = 30


class Reference(NamedTuple):
    """Of one language: its common words, and the pooled characters by class and words by slot."""

    words: list[bytes]
    classes: list[int]
    slots: list[int]


def class_counts(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, classes) of rows that begin at ``at``."""
    kind = _CLASS[part]
    out = np.zeros((len(at) - 1, len(CLASSES)), np.int64)
    for c in range(len(CLASSES)):
        out[:, c] = np.diff(np.concatenate([[0], np.cumsum(kind == c)])[at])
    return out


class Slots:
    """Common words of all languages in one table, by the hashes of word and language."""

    def __init__(self, reference: dict[str | None, Reference]):
        self.langs = {name: i for i, name in enumerate(reference)}
        hashes, slot = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, one in enumerate(reference.values()):
            if one.words:
                own = Words(np.frombuffer(b" ".join(one.words), np.uint8), np.array([0, sum(map(len, one.words)) + len(one.words) - 1]))
                hashes.append(own.hashes ^ self._mark(np.full(len(one.words), i)))
                slot.append(np.arange(len(one.words)))
        self.table, self.slot = HashTable(np.concatenate(hashes)), np.append(np.concatenate(slot), SLOTS - 1)

    @staticmethod
    def _mark(lang: np.ndarray) -> np.ndarray:
        return mix(lang.astype(np.uint64) + np.uint64(2))

    def of(self, hashes: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return self.slot[self.table.find(hashes ^ self._mark(lang))]


def histograms(column: pa.Array, langs: pa.Array, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """(characters by class, words by slot) of every row."""
    data, offsets = raw(column)
    coded = langs.dictionary_encode(null_encoding="encode")
    lang = np.array([slots.langs.get(name, -1) for name in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    classes = np.zeros((len(column), len(CLASSES)), np.int64)
    words_by = np.zeros((len(column), SLOTS), np.int64)
    for lo, hi in steps(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(part):
            continue
        classes[lo:hi] = class_counts(part, at)
        words = Words(part, at)
        row = np.repeat(np.arange(hi - lo), np.diff(words.rows))
        index = slots.of(words.hashes, lang[lo + row])
        words_by[lo:hi] = np.bincount(row * SLOTS + index, minlength=(hi - lo) * SLOTS).reshape(hi - lo, SLOTS)
    return classes, words_by


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from the counts q; nan where either is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = p / p.sum(-1, keepdims=True)
        q = q / q.sum(-1, keepdims=True)
        m = (p + q) / 2
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
        return np.sqrt(np.maximum((a + b) / 2, 0)) + 0 * p.sum(-1) * q.sum(-1)


def references(docs: DataFrame) -> dict[str | None, Reference]:
    """Of each language over all its documents; a null language is one of its own.

    Tasks add up their documents, and words are summed by (language, word). Of those, each task
    passes on the most frequent COMMON of a language alone; words of equal counts are taken in
    their order. What reaches the driver is bounded for each language.
    """

    def add(batches):
        for batch in batches:
            data, offsets = raw(batch.column(1))
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            lang, names = coded.indices.to_numpy(), coded.dictionary
            totals = np.zeros((len(names), len(CLASSES) + 1), np.int64)
            for lo, hi in steps(offsets, 1 << 24):
                tables = []
                for a, b in steps(offsets[lo : hi + 1] - offsets[lo]):
                    a, b = lo + a, lo + b
                    part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    words = Words(part, at)
                    np.add.at(totals[:, 1:], lang[a:b], class_counts(part, at))
                    np.add.at(totals[:, 0], lang[a:b], np.diff(words.rows))
                    tables.append(pa.table({"lang": pa.array(np.repeat(lang[a:b], np.diff(words.rows))), "word": words.array()}).group_by(["lang", "word"]).aggregate([([], "count_all")]))
                summed = pa.concat_tables(tables).group_by(["lang", "word"]).aggregate([("count_all", "sum")])
                named = names.take(summed["lang"].combine_chunks())
                size = len(named)
                yield pa.RecordBatch.from_arrays([named.cast(pa.string()), pa.nulls(size, pa.int32()), summed["word"].combine_chunks().cast(pa.binary()), summed["count_all_sum"].combine_chunks()], ["lang", "kind", "word", "n"])
            if len(names):
                kinds = pa.array(np.tile(np.arange(totals.shape[1]), len(names)), pa.int32())
                each = names.take(pa.array(np.repeat(np.arange(len(names)), totals.shape[1])))
                yield pa.RecordBatch.from_arrays([each.cast(pa.string()), kinds, pa.nulls(len(kinds), pa.binary()), pa.array(totals.ravel())], ["lang", "kind", "word", "n"])

    summed = docs.select("lang", "text").mapInArrow(add, "lang string, kind int, word binary, n bigint").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang", F.col("kind").isNull()).orderBy(F.col("n").desc(), "word")
    top = summed.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= COMMON)
    words: dict[str | None, list] = {}
    totals: dict[str | None, list[int]] = {}
    for row in sorted(top.collect(), key=lambda r: r["nth"]):
        if row["kind"] is None:
            words.setdefault(row["lang"], []).append((bytes(row["word"]), row["n"]))
        else:
            totals.setdefault(row["lang"], [0] * (len(CLASSES) + 1))[row["kind"]] = row["n"]
    made = {}
    for name, (many, *classes) in totals.items():
        own = words.get(name, [])
        counts = [n for _, n in own]
        made[name] = Reference([w for w, _ in own], classes, [*counts, *[0] * (COMMON - len(own)), many - sum(counts)])
    return made


def judged(text: Column | str, lang: Column | str, reference: dict[str | None, Reference]) -> Column:
    """struct<n_words, class_distance, word_distance, accepted> of a text in its language."""
    keep = {k: (np.array(r.classes), np.array(r.slots)) for k, r in reference.items()}
    table = Slots(reference)

    @F.arrow_udf("struct<n_words: bigint, class_distance: double, word_distance: double, accepted: boolean>")
    @lean
    def judge(texts: pa.Array, langs: pa.Array) -> pa.Array:
        classes, slots = histograms(texts, langs, table)
        n = slots.sum(1)
        far = np.full((2, len(texts)), np.nan)
        coded = langs.dictionary_encode(null_encoding="encode")
        index = coded.indices.to_numpy()
        for i, name in enumerate(coded.dictionary.to_pylist()):
            if name in keep:
                for k, counts in enumerate((classes, slots)):
                    far[k, index == i] = distance(counts[index == i], keep[name][k])
        with np.errstate(divide="ignore", invalid="ignore"):
            wrong = (far[0] > CLASS_BASE + CLASS_SPREAD / np.sqrt(n)) | (far[1] > WORD_BASE + WORD_SPREAD / np.sqrt(n))
        accepted = ~wrong | (n < MIN_WORDS)
        distances = [pa.array(np.round(x, 6), mask=np.isnan(x)) for x in far]
        return pa.StructArray.from_arrays([pa.array(n), *distances, pa.array(accepted)], ["n_words", "class_distance", "word_distance", "accepted"])

    return judge(text, lang)


def quality(docs: DataFrame) -> DataFrame:
    """How far every document is from its language, and whether it is accepted.

    Returns doc_id, n_words, class_distance, word_distance, accepted. A null or empty text has
    no words and null distances and is accepted, as is any text of fewer than MIN_WORDS words;
    a text of signs only has a null word distance. A null language is a language. Rows are
    judged by themselves, so repeated rows and doc_ids get the same answer each, and count as
    often in the reference. An empty table gives an empty one; other columns aren't carried.
    """
    scored = docs.select("doc_id", judged("text", "lang", references(docs)).alias("__rv_judged"))
    return scored.select("doc_id", *(f"__rv_judged.{c}" for c in ("n_words", "class_distance", "word_distance", "accepted")))


def accepted_only(docs: DataFrame) -> DataFrame:
    """The rows that quality() accepts, with all their columns, each by itself: rows that repeat stay or go together.

    Null, empty and short texts stay, as do rows with a null language or doc_id if they are like
    the rest of their language. An empty table gives an empty one.
    """
    ok = judged("text", "lang", references(docs))
    return docs.withColumn("__rv_judged", ok).filter("__rv_judged.accepted").drop("__rv_judged")


_COUNT = "length(regexp_replace(text, '[^{}]', '', 'g'))"
_SETS = {"lower": "a-z", "upper": "A-Z", "digit": "0-9", "blank": r" \t", "line": r"\n\r", "stop": r".,;:?''\"()\-", "control": r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f", "other": r"\x{80}-\x{10FFFF}"}
_PARTS = ", ".join(f"{_COUNT.format(_SETS[c])} AS {c}" for c in CLASSES if c != "sign")
_SHARES = """
  shares AS (
    SELECT r, lang, slot, n, n / sum(n) OVER (PARTITION BY r) AS p FROM {counts}),
  pooled AS (
    SELECT lang, slot, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM {counts} GROUP BY lang, slot),
  apart AS (
    SELECT r, sqrt(greatest(sum(coalesce(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) END, 0)
                              + coalesce(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) END, 0)) / 2, 0)) AS far
    FROM (SELECT s.r, coalesce(s.p, 0) AS p, coalesce(o.q, 0) AS q
          FROM shares s JOIN pooled o USING (lang, slot) WHERE s.p IS NOT NULL)
    GROUP BY r)
  SELECT * FROM apart"""

QUALITY_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS lang, coalesce(text, '') AS text FROM documents),
raw_classes AS (SELECT r, lang, {_PARTS}, length(text) AS n_all FROM d),
classes AS (
  SELECT r, lang, slot, n FROM (
    SELECT *, n_all - lower - upper - digit - blank - line - stop - control - other AS sign FROM raw_classes)
  UNPIVOT (n FOR slot IN (lower, upper, digit, blank, line, stop, sign, control, other))),
tokens AS (SELECT r, lang, unnest(regexp_extract_all(translate(text, '{FOLD_FROM}', '{FOLD_TO}'), '{WORD_RE2}')) AS w FROM d),
common AS (
  SELECT lang, w AS slot FROM (SELECT lang, w, count(*) AS n FROM tokens GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= {COMMON}),
slots AS (SELECT lang, slot FROM common UNION ALL SELECT DISTINCT lang, '' FROM d),
said AS (
  SELECT t.r, coalesce(c.slot, '') AS slot, count(*) AS n
  FROM tokens t LEFT JOIN common c ON c.lang = t.lang AND c.slot = t.w GROUP BY ALL),
words AS (
  SELECT d.r, d.lang, s.slot, coalesce(said.n, 0) AS n FROM d JOIN slots s USING (lang) LEFT JOIN said ON said.r = d.r AND said.slot = s.slot),
class_far AS (WITH {_SHARES.format(counts="classes")}),
word_far AS (WITH {_SHARES.format(counts="words")}),
totals AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_words FROM words GROUP BY r),
j AS (
  SELECT d.doc_id, t.n_words, c.far AS cf, w.far AS wf
  FROM d JOIN totals t USING (r) LEFT JOIN class_far c USING (r) LEFT JOIN word_far w USING (r))
SELECT doc_id, n_words, round(cf, 6) AS class_distance, round(wf, 6) AS word_distance,
       n_words < {MIN_WORDS} OR NOT (coalesce(cf > {CLASS_BASE} + {CLASS_SPREAD} / sqrt(n_words), false)
                                     OR coalesce(wf > {WORD_BASE} + {WORD_SPREAD} / sqrt(n_words), false)) AS accepted
FROM j
"""
