"""Operators 5 and 9: token counts, BPE encoding and decoding.

Pre-tokens are those of the byte-level pattern of public 50k vocabularies
(contractions, letters, digits, other signs, each with an optional space before
it, and white space). They are cut here by character class, in whole batches.

Encoding is by prefix-sharing trie traversal. For every prefix of a word the
*last token* of its encoding is the one vocabulary entry that ends the prefix,
and that may follow the last token of what stands before it. The distinct words
of a batch, sorted, are the depth-first order of their trie: the stack of last
tokens is kept down to the prefix that a word shares with the one before, so a
shared prefix is encoded once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.text import HashTable, hashes_of, lean, lists, raw, steps

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words that a worker remembers between batches; beyond it, it starts anew. Words over the length aren't kept.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: Pairs of tokens of which a worker remembers whether one may follow the other.
CACHE_PAIRS = 400_000
#: Bytes of text whose distinct words make one trie.
TRIE_BYTES = 1 << 23
REPLACEMENT = "�".encode()

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


# --- pre-tokens -------------------------------------------------------------


@cache
def _classes() -> np.ndarray:
    import regex

    everything = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    table = np.zeros(0x110000, np.uint8)
    for name, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            table[m.start() : m.end()] = name
    return table


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of the pre-tokens, pre-token offsets of the rows); together they are the whole text."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    kind = _classes()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[np.searchsorted(at, offsets[:-1])] = True
    edge[n] = True
    begin = np.empty(n, dtype=bool)
    begin[0] = True
    begin[1:] = kind[1:] != kind[:-1]
    begin |= edge[:-1]
    # white space: its last character stands by itself or goes before what follows, unless the text ends there
    space = kind == SPACE
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~edge[1:]
    begin |= last
    joined = np.flatnonzero(last & (points == 32))
    begin[joined + 1] = False
    # an apostrophe by itself, without a space before it, and the letters of a contraction
    quotes = np.flatnonzero(begin & (points == 39))
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kind[quotes + 1] == LETTER) & ~edge[quotes + 1]]
    for c in CONTRACTIONS:
        if not len(quotes):
            break
        end = quotes + len(c)
        fits = end < n
        for i, letter in enumerate(c):
            where = np.minimum(quotes + 1 + i, n - 1)
            fits &= (points[where] == ord(letter)) & (~edge[where])
        hit = quotes[fits]
        begin[hit + 1] = False
        rest = hit + 1 + len(c)
        rest = rest[rest < n]
        begin[rest[kind[rest] == LETTER]] = True
        quotes = quotes[~fits]
    starts = np.flatnonzero(begin)
    tokens = np.append(at[starts], len(data))
    return tokens, np.searchsorted(tokens[:-1], offsets)


def pieces(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The byte ranges as a binary array, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


# --- vocabulary -------------------------------------------------------------


def load_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Token bytes by id, from a file of ranks."""
    lines = [line.split() for line in Path(path).read_bytes().splitlines() if line]
    tokens = [b""] * (max(int(r) for _, r in lines) + 1)
    for text, rank in lines:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


def merge(word: bytes, rank: dict[bytes, int], below: int) -> list[bytes]:
    """Merge by rank, over ranks under ``below``: the definition of BPE."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, i = min((rank.get(parts[j] + parts[j + 1], below), j) for j in range(len(parts) - 1))
        if best >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Bpe:
    """A vocabulary as a table of which token may follow which."""

    def __init__(self, tokens: list[bytes], left: list[int] | None = None, right: list[int] | None = None):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        if left is None or right is None:
            left, right = [], []
            for i, t in enumerate(tokens):
                parts = merge(t, self.rank, i) if len(t) > 1 else []
                a, b = (self.rank[parts[0]], self.rank[parts[1]]) if len(parts) == 2 else (i, i)
                left.append(a)
                right.append(b)
        self.left, self.right = left, right
        self.pair = {(a, b): i for i, (a, b) in enumerate(zip(left, right, strict=True)) if a != i}
        # what merging never makes can't be the last token of anything
        self.ends = {t: i for t, i in self.rank.items() if len(t) == 1 or left[i] != i}
        self.longest = max(map(len, self.rank), default=1)
        self.known: dict[int, bool] = {}
        self.words: dict[bytes, bytes] = {}

    def __reduce__(self):
        return (Bpe, (self.tokens, self.left, self.right))

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of their joined bytes is a, b: no merge crosses the border."""
        key = a << 32 | b
        if (hit := self.known.get(key)) is not None:
            return hit
        if len(self.known) > CACHE_PAIRS:
            self.known.clear()
        pair, left, right, limit = self.pair.get, self.left, self.right, 1 << 60
        while True:
            made = pair((a, b))
            if made is not None and made < limit:
                fits = False
                break
            # undo the later of the two merges that touch the border
            if a > b:
                limit = a
                a = right[a]
                if a == limit:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        fits = True
                        break
            else:
                limit = b + 1
                b = left[b]
                if b + 1 == limit:
                    limit = a
                    a = right[a]
                    if a == limit:
                        fits = True
                        break
        self.known[key] = fits
        return fits

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """Encodings of sorted words, depth first through their trie."""
        ends, follows, longest = self.ends.get, self.follows, self.longest
        before, last, start = b"", [-1], [0]
        for word in words:
            keep, top = 0, min(len(word), len(before))
            while keep < top and word[keep] == before[keep]:
                keep += 1
            del last[keep + 1 :]
            del start[keep + 1 :]
            for i in range(keep + 1, len(word) + 1):
                # exactly one entry fits: likeliest first, the last token grown by this byte or the byte alone
                j = start[i - 1]
                t = ends(word[j:i])
                if t is None or (j and not follows(last[j], t)):
                    j = i - 1
                    t = ends(word[j:i])
                    if j and not follows(last[j], t):
                        for j in range(max(0, i - longest), i - 1):
                            t = ends(word[j:i])
                            if t is not None and (j == 0 or follows(last[j], t)):
                                break
                last.append(t)
                start.append(j)
            before = word
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i = start[i]
            out.reverse()
            yield out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Encodings of distinct words as bytes of 32-bit ids, through the worker's cache."""
        found = [self.words.get(w) for w in words]
        missing = sorted(w for w, ids in zip(words, found, strict=True) if ids is None)
        if missing:
            fresh = {w: np.array(ids, np.int32).tobytes() for w, ids in zip(missing, self.encode_sorted(missing), strict=True)}
            if len(self.words) + len(fresh) > CACHE_WORDS:
                self.words.clear()
            self.words.update((w, ids) for w, ids in fresh.items() if len(w) <= CACHE_LENGTH)
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return found


@cache
def load(path: str = VOCABULARY) -> Bpe:
    return Bpe(load_ranks(path))


# --- encoding and decoding of columns ---------------------------------------


def words_by_step(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], pa.Array]:
    """(index of each pre-token, pre-token offsets of the rows) for each step, and the distinct pre-tokens of all."""
    found, ends = [], []
    for lo, hi in steps(offsets):
        part = data[offsets[lo] : offsets[hi]]
        at, rows = pretokens(part, offsets[lo : hi + 1] - offsets[lo])
        found.append(pieces(part, at).dictionary_encode())
        ends.append(rows)
    if not found:
        return [], [], pa.array([], pa.large_binary())
    one = pa.chunked_array(found).unify_dictionaries()
    return [c.indices.to_numpy() for c in one.chunks], ends, one.chunk(0).dictionary


def encode_column(column: pa.Array, bpe: Bpe) -> pa.Array:
    data, offsets = raw(column)
    values, ends = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for lo, hi in steps(offsets, TRIE_BYTES):
        indices, rows, distinct = words_by_step(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        words = bpe.encode_words(distinct.to_pylist())
        flat = np.frombuffer(b"".join(words), np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) >> 2
        begins = np.cumsum(sizes) - sizes
        for index, row in zip(indices, rows, strict=True):
            each = sizes[index]
            upto = np.concatenate([[0], np.cumsum(each)])
            values.append(flat[np.arange(upto[-1]) + np.repeat(begins[index] - upto[:-1], each)])
            ends.append(ends[-1][-1] + upto[row[1:]])
    valid = np.asarray(column.is_valid()) if column.null_count else None
    return lists(pa.array(np.concatenate(values)), np.concatenate(ends), valid)


def decode_column(column: pa.Array, tokens: list[bytes]) -> pa.Array:
    table = pa.array([*tokens, REPLACEMENT], pa.large_binary())
    out = []
    for lo in range(0, len(column), 512):
        part = column[lo : lo + 512]
        ids, rows = part.flatten(), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(part).fill_null(0)))])
        drop = np.asarray(ids.is_null()) if ids.null_count else None
        ids = np.asarray(ids.fill_null(0)).astype(np.int64)
        ids[(ids < 0) | (ids >= len(tokens))] = len(tokens)
        if drop is not None:
            rows = np.concatenate([[0], np.cumsum(~drop)])[rows]
            ids = ids[~drop]
        spelled = table.take(pa.array(ids))
        at = np.frombuffer(spelled.buffers()[1], np.int64, len(ids) + 1)[rows] if len(ids) else np.zeros(len(part) + 1, np.int64)
        data = spelled.buffers()[2] or pa.py_buffer(b"")
        made = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(np.ascontiguousarray(at)), data])
        try:
            made = made.cast(pa.string())
        except pa.ArrowInvalid:
            made = pa.array([b.decode("utf-8", "replace") for b in made.to_pylist()], pa.string())
        out.append(pc.if_else(part.is_valid(), made, pa.scalar(None, pa.string())))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


_WORKER: dict[str, Bpe] = {}


def encode(spark: SparkSession, text: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """array<int> of token ids of a text column; null for null, empty for an empty text.

    The table of the vocabulary (its size is the vocabulary's, not the data's) is made on the driver and broadcast.
    """
    shared = spark.sparkContext.broadcast(load(vocabulary))

    @F.arrow_udf("array<int>")
    @lean
    def encoder(column: pa.Array) -> pa.Array:
        bpe = _WORKER.setdefault(vocabulary, shared.value)
        return encode_column(column, bpe)

    return encoder(text)


def decode(spark: SparkSession, ids: Column | str, vocabulary: str = VOCABULARY) -> Column:
    """The text of an array<int> column; ids outside the vocabulary and bytes that aren't UTF-8 become U+FFFD, null ids are left out."""
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))

    @F.arrow_udf("string")
    @lean
    def decoder(column: pa.Array) -> pa.Array:
        return decode_column(column, shared.value)

    return decoder(ids)


def bpe_encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token ids of every document, and whether decoding gives back its text.

    Returns doc_id, token_ids, n_tokens, round_trip. A null text has null ids, count and
    round_trip; an empty one has no ids and true. Rows are independent: null or repeated
    doc_id and repeated rows stay as they are, an empty table gives an empty one, and
    columns of other names, or of the names made here, are not carried along.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id", "text", encode(spark, "text", vocabulary).alias("token_ids"))
    return ids.select(
        "doc_id",
        "token_ids",
        F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"),
        (decode(spark, "token_ids", vocabulary) == F.col("text")).alias("round_trip"),
    )


# --- token counts -----------------------------------------------------------

#: Entries of the table of frequent pre-tokens, and of the summary that one task makes for it.
FREQUENT, SUMMARY = 32_768, 8_192


def _thin(counts: dict[bytes, int], keep: int) -> dict[bytes, int]:
    """The Misra-Gries step: lower all counts by the first that doesn't fit, drop what isn't positive."""
    if len(counts) <= keep:
        return counts
    cut = sorted(counts.values(), reverse=True)[keep]
    return {w: c - cut for w, c in counts.items() if c > cut}


def frequent_pretokens(docs: DataFrame, size: int = FREQUENT, summary: int = SUMMARY) -> list[bytes]:
    """The most frequent pre-tokens of all documents, by mergeable summaries of bounded size.

    Every task reads its whole documents and keeps one Misra-Gries summary; summaries are
    merged pairwise in tasks, 32 at a time, so that no pre-token is ever shuffled and the
    driver gets one summary, whatever the input. The choice affects speed, never counts.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            data, offsets = raw(batch.column(0))
            for lo, hi in steps(offsets):
                part = data[offsets[lo] : offsets[hi]]
                at, _ = pretokens(part, offsets[lo : hi + 1] - offsets[lo])
                if len(at) > 1:
                    seen = pieces(part, at).value_counts()
                    often = np.asarray(seen.field(1))
                    top = np.argsort(-often, kind="stable")
                    cut = int(often[top[summary * 4]]) if len(top) > summary * 4 else 0
                    top = top[often[top] > cut]
                    for w, c in zip(seen.field(0).take(pa.array(top)).to_pylist(), often[top].tolist(), strict=True):
                        if len(w) <= CACHE_LENGTH:
                            counts[w] = counts.get(w, 0) + c - cut
            counts = _thin(counts, summary * 4)
        counts = _thin(counts, summary)
        yield pa.RecordBatch.from_pydict({"words": pa.array([list(counts)], pa.list_(pa.binary())), "counts": pa.array([list(counts.values())], pa.list_(pa.int64()))})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for words, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w, c in zip(words, many, strict=True):
                    counts[w] = counts.get(w, 0) + c
                counts = _thin(counts, size)
        yield pa.RecordBatch.from_pydict({"words": pa.array([list(counts)], pa.list_(pa.binary())), "counts": pa.array([list(counts.values())], pa.list_(pa.int64()))})

    schema = "words array<binary>, counts array<bigint>"
    text = docs.select("text")
    found, width = text.mapInArrow(summarise, schema), text.rdd.getNumPartitions()
    while width > 32:
        width = -(-width // 32)
        found = found.repartition(width).mapInArrow(merged, schema)
    (row,) = found.repartition(1).mapInArrow(merged, schema).collect() or [None]
    if row is None:
        return []
    ranked = sorted(zip(row["counts"], map(bytes, row["words"]), strict=True), key=lambda x: (-x[0], x[1]))
    return [w for _, w in ranked[:size]]


class LengthTable:
    """How many tokens each frequent pre-token has, by its 64-bit hash in flat arrays; the broadcast form, of some 12 bytes a slot."""

    def __init__(self, words: list[bytes], lengths: list[int]):
        self.table = HashTable(self._hashes(pa.array(words, pa.large_binary())))
        self.lengths = np.array([*lengths, -1], np.int32)

    @staticmethod
    def _hashes(words: pa.Array) -> np.ndarray:
        if not len(words):
            return np.zeros(0, np.uint64)
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        return hashes_of(data, offsets[:-1] - offsets[0], np.diff(offsets))

    def count(self, found: pa.Array) -> np.ndarray:
        """Tokens of each pre-token; -1 where the table hasn't it."""
        return self.lengths[self.table.find(self._hashes(found))].astype(np.int64)


class Counter:
    """The second tier: a worker's cache of the lengths of pre-tokens that the table hasn't."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.cache = bpe, {}

    def lengths(self, words: list[bytes]) -> list[int]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        missing = sorted(w for w in words if w not in self.cache)
        fresh = dict(zip(missing, map(len, self.bpe.encode_sorted(missing)), strict=True))
        got = [fresh[w] if w in fresh else self.cache[w] for w in words]
        self.cache.update((w, n) for w, n in fresh.items() if len(w) <= CACHE_LENGTH)
        return got


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, size: int = FREQUENT) -> DataFrame:
    """Tokens of every document, without encoding what is frequent.

    Returns doc_id, n_pretokens, n_tokens, n_looked_up (pre-tokens answered by the broadcast
    table). A null text has nulls, an empty one zeros; repeated rows and null or repeated
    doc_id are counted row by row; an empty table gives an empty one; other columns aren't
    carried along.
    """
    spark = docs.sparkSession
    bpe = load(vocabulary)
    words = sorted(frequent_pretokens(docs, size))
    table = spark.sparkContext.broadcast(LengthTable(words, [len(ids) for ids in bpe.encode_sorted(words)]))
    shared = spark.sparkContext.broadcast(bpe)

    @F.arrow_udf("struct<n_pretokens: bigint, n_tokens: bigint, n_looked_up: bigint>")
    @lean
    def counter(column: pa.Array) -> pa.Array:
        second = _COUNTERS.setdefault(vocabulary, Counter(shared.value))
        data, offsets = raw(column)
        out = np.zeros((3, len(column)), np.int64)
        for lo, hi in steps(offsets, TRIE_BYTES):
            indices, ends, distinct = words_by_step(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lengths = table.value.count(distinct)
            missed = lengths < 0
            if missed.any():
                lengths[missed] = second.lengths(distinct.filter(pa.array(missed)).to_pylist())
            for index, rows in zip(indices, ends, strict=True):
                row = slice(lo, lo := lo + len(rows) - 1)
                out[0, row] = np.diff(rows)
                for k, each in ((1, lengths), (2, ~missed)):
                    out[k, row] = np.diff(np.concatenate([[0], np.cumsum(each[index])])[rows])
        mask = pa.array(~np.asarray(column.is_valid()))
        return pa.StructArray.from_arrays([pa.array(x, mask=np.asarray(mask)) for x in out], ["n_pretokens", "n_tokens", "n_looked_up"])

    counted = docs.select("doc_id", counter("text").alias("__rv_counts"))
    return counted.select("doc_id", "__rv_counts.n_pretokens", "__rv_counts.n_tokens", "__rv_counts.n_looked_up")
