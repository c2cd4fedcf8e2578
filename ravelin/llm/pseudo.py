"""Operator 4: masked pseudo-likelihood by a bidirectional window network.

Every token is predicted from the tokens on both sides of it; the sum of the log
conditional probabilities scores a document. Tokens are words: the VOCABULARY most
frequent of all documents, other words by hash in OTHERS buckets; a word's share of its
bucket is by its count or spelling (Rest). The network adds
one vector for each neighbour by its place, takes tanh, and has a two-level softmax
(a token's block of BLOCK ids, then the token in its block). Words are told apart by
hashes of 64 bits.

The counts of all words of all documents give the vocabulary, the first biases and the
shares in buckets.
The network is trained in numpy where the documents are: every task takes one pass
over all tokens of its documents, from the same start, and the results are
averaged by the number of tokens, so what is gathered grows with the input. A task's
steps begin small and grow, so that short and long passes both learn (``ranges``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.shared import saved
from ravelin.llm.text import HashTable, Words, raw, steps

BLOCK, OTHERS, VOCABULARY = 64, 32, 2016
IDS = OTHERS + VOCABULARY
NEIGHBOURS, HIDDEN = (-2, -1, 1, 2), 32
#: Words of a step: FIRST_BATCH, twice as many after every GROW steps, BATCH in the end.
FIRST_BATCH, BATCH, GROW = 256, 8192, 32
#: Words that are put in random order together.
MIXED = 1 << 18
#: Adagrad's rate, and what the sums of squares begin with.
RATE, SQUARE = 0.2, 1e-8
#: Logits are held within these, so that no exponential overflows.
LOGIT = 60.0
#: Words beyond the vocabulary that keep counts of their own; all others go by spelling.
LISTED = 1 << 16
#: The bytes of words, and 0 for the edges of a word.
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[*range(48, 58), 95, *range(97, 123), *range(128, 256)]] = range(1, 166)
SYMBOLS = 166
#: Words of which one step scores as many.
STEP_WORDS = 1 << 12
#: Pieces in which weights travel, so that averaging is spread over tasks.
PIECES = 64


class Rest:
    """P(word | bucket) of the words outside the vocabulary, so that each has a probability of its own.

    ``words`` have theirs by ``counts``, out of what their bucket has (``shares``). All others, unseen
    ones too, divide what is left of a bucket by their spelling: a chain over bytes given the two
    before, from ``spelt``, the trigrams of all distinct words outside the vocabulary. As buckets are
    by hash, 1 / OTHERS of all spellings is taken to be in each.
    """

    def __init__(self, words: list[bytes], counts: list[int], shares: np.ndarray, spelt: np.ndarray):
        each, bucket = buckets(pa.array(words, pa.large_binary()))
        left = np.array(shares, np.float64)
        own = np.array(counts, np.float64)
        left -= np.bincount(bucket, own, OTHERS)
        self.words = HashTable(each.hashes)
        self.listed = (np.log(own) - np.log(np.asarray(shares)[bucket] + 1)).astype(np.float32)
        # one more word than there are, for those that are unseen
        self.left = np.log(np.maximum(left, 0) + 1) - np.log(np.asarray(shares) + 1) + np.log(OTHERS)
        three = np.asarray(spelt, np.float64).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two = three.sum(0)
        two = (two + 1 / SYMBOLS) / (two.sum(1, keepdims=True) + 1)
        self.spelling = np.log((three + two) / (three.sum(2, keepdims=True) + 1)).astype(np.float32).ravel()

    def log_probabilities(self, words: Words, ids: np.ndarray) -> np.ndarray:
        """Of each word given its bucket; 0 for the words of the vocabulary."""
        out = np.zeros(len(ids))
        rare = np.flatnonzero(ids < OTHERS)
        at = self.words.find(words.hashes[rare])
        out[rare[at >= 0]] = self.listed[at[at >= 0]]
        if len(rest := rare[at < 0]):
            lengths = words.lengths[rest]
            begin = np.cumsum(lengths) - lengths
            data = words.bytes[np.arange(lengths.sum()) + np.repeat(words.at[rest] - begin, lengths)]
            inner, last = spellings(data, begin, lengths)
            out[rest] = self.left[ids[rest]] + np.add.reduceat(self.spelling[inner].astype(np.float64), begin) + self.spelling[last]
        return out


class Vocabulary:
    def __init__(self, words: list[bytes], counts: list[int], total: int, rest: Rest | None = None):
        self.words = words
        self.table = HashTable(buckets(pa.array(words, pa.large_binary()))[0].hashes)
        others = max(0, total - sum(counts)) / OTHERS
        self.counts = np.array([others] * OTHERS + list(counts) + [0] * (VOCABULARY - len(counts)), np.float64)
        self.rest = rest or Rest([], [], self.counts[:OTHERS], np.zeros(SYMBOLS**3))

    def ids(self, words: Words) -> np.ndarray:
        known = self.table.find(words.hashes)
        return np.where(known < 0, (words.hashes % np.uint64(OTHERS)).astype(np.int64), known + OTHERS)


def vocabulary(docs: DataFrame) -> Vocabulary:
    """The most frequent words of all documents; ties go to the word that sorts first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw(batch.column(0))
            for lo, hi in steps(offsets, 1 << 24):
                found, many = [], []
                for a, b in steps(offsets[lo : hi + 1] - offsets[lo]):
                    words = Words(data[offsets[lo + a] : offsets[lo + b]], offsets[lo + a : lo + b + 1] - offsets[lo + a]).array()
                    seen = words.value_counts()
                    found.append(seen.field(0))
                    many.append(seen.field(1))
                summed = pa.table({"word": pa.chunked_array(found, pa.large_binary()), "n": pa.chunked_array(many, pa.int64())}).group_by("word").aggregate([("n", "sum")])
                summed = pa.table({"word": pa.concat_arrays([summed["word"].combine_chunks(), pa.array([b""], pa.large_binary())]).cast(pa.binary()), "n": pa.concat_arrays([summed["n_sum"].combine_chunks(), pa.array([pc.sum(summed["n_sum"]).as_py() or 0])])})
                yield from summed.to_batches()

    # the empty word stands for all words together
    counted = saved(docs.select("text").mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    top = counted.orderBy(F.col("word") != F.lit(b""), F.col("n").desc(), "word").limit(VOCABULARY + 1).collect()
    total = sum(r["n"] for r in top if not r["word"])
    kept = [r for r in top if r["word"]][:VOCABULARY]
    known = [bytes(r["word"]) for r in kept]
    return Vocabulary(known, [r["n"] for r in kept], total, the_rest(counted.filter("word <> X''"), known))


def the_rest(counted: DataFrame, known: list[bytes]) -> Rest:
    """Of the counts (word, n) of all words, what the words outside ``known`` are told apart by."""
    at_least, listed = 0, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.col("n").desc()).limit(LISTED + len(known) + 1).collect():
        listed += r["words"]
        if listed > LISTED + len(known):
            at_least = r["n"] + 1
            break
    vocabulary = pa.array(known, pa.large_binary())

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt, shares = np.zeros(SYMBOLS**3, np.int64), np.zeros(OTHERS, np.int64)
        for batch in batches:
            mine = batch.filter(pc.invert(pc.is_in(batch.column(0).cast(pa.large_binary()), value_set=vocabulary)))
            if not len(mine):
                continue
            each, bucket = buckets(mine.column(0))
            shares += np.bincount(bucket, np.asarray(mine.column(1)), OTHERS).astype(np.int64)
            inner, last = spellings(each.bytes, each.at, each.lengths)
            spelt += np.bincount(np.concatenate([inner, last]), minlength=SYMBOLS**3)
        keys = np.flatnonzero(spelt)
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate([keys, -1 - np.arange(OTHERS)])), "n": pa.array(np.concatenate([spelt[keys], shares]))})

    spelt, shares = np.zeros(SYMBOLS**3), np.zeros(OTHERS)
    for r in counted.mapInArrow(spell, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["key"] < 0:
            shares[-1 - r["key"]] = r["n"]
        else:
            spelt[r["key"]] = r["n"]
    inside = set(known)
    own = [(bytes(r["word"]), r["n"]) for r in counted.filter(F.col("n") >= at_least).toLocalIterator() if bytes(r["word"]) not in inside]
    return Rest([w for w, _ in own], [n for _, n in own], shares, spelt)


def buckets(words: pa.Array) -> tuple[Words, np.ndarray]:
    """Words given one by one, and their buckets."""
    if not len(words):
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, np.int64)
    column = words.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    each = Words(data, offsets - offsets[0])
    return each, (each.hashes % np.uint64(OTHERS)).astype(np.int64)


def spellings(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte, and for the end of every word, the number of (byte two before, byte before, byte); words begin at ``at``."""
    now = _SYMBOL[data]
    before = np.zeros_like(now)
    before[1:] = now[:-1]
    before[at] = 0
    first = np.zeros_like(now)
    first[1:] = before[:-1]
    first[at] = 0
    last = at + lengths - 1
    return (first * SYMBOLS + before) * SYMBOLS + now, (before[last] * SYMBOLS + now[last]) * SYMBOLS


class Network:
    """Weights: neighbours (4 * (IDS + 1), H), bias (H), blocks (H + 1, B), tokens (B, H + 1, BLOCK); the last row of the last two is for a constant 1."""

    def __init__(self, counts: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        blocks = counts.reshape(-1, BLOCK) + 0.5
        near = rng.normal(0, 0.1, (len(NEIGHBOURS), IDS + 1, HIDDEN))
        near[:, IDS] = 0
        to_blocks = rng.normal(0, 0.05, (HIDDEN, len(blocks)))
        to_tokens = rng.normal(0, 0.05, (len(blocks), HIDDEN, BLOCK))
        shares = np.log(blocks / blocks.sum(1, keepdims=True))
        self.weights = [
            near.reshape(-1, HIDDEN).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            np.concatenate([to_blocks, np.log(blocks.sum(1) / blocks.sum())[None]]).astype(np.float32),
            np.concatenate([to_tokens, shares[:, None]], 1).astype(np.float32),
        ]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for i, w in enumerate(self.weights):
            self.weights[i] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def hidden(self, places: np.ndarray) -> np.ndarray:
        """(n, H + 1) of rows of neighbours; the last column is 1."""
        near, bias = self.weights[:2]
        total = np.take(near, places[:, 0], axis=0)
        for j in range(1, len(NEIGHBOURS)):
            total += np.take(near, places[:, j], axis=0)
        total += bias
        out = np.ones((len(places), HIDDEN + 1), near.dtype)
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def _by_block(self, context: np.ndarray, token: np.ndarray):
        """In the order of blocks: that order, rows of neighbours, block and place in it of each token, and (block, begin, end) of those that occur."""
        order = np.argsort((token // BLOCK).astype(np.uint8), kind="stable")
        token = token[order]
        block = token // BLOCK
        edges = np.searchsorted(block, np.arange(IDS // BLOCK + 1)).tolist()
        used = [(b, edges[b], edges[b + 1]) for b in range(IDS // BLOCK) if edges[b] < edges[b + 1]]
        return order, context[order] + _TABLES, block, token % BLOCK, used

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of each token given its neighbours (n, 4)."""
        blocks, tokens = self.weights[2:]
        order, places, block, within, used = self._by_block(context, token)
        h, rows = self.hidden(places), np.arange(len(token))
        logits = held(h @ blocks)
        found = logits[rows, block] - log_sum(logits)
        logits = np.empty((len(token), BLOCK), h.dtype)
        for b, lo, hi in used:
            np.matmul(h[lo:hi], tokens[b], out=logits[lo:hi])
        held(logits)
        found += logits[rows, within]
        found -= log_sum(logits)
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(rows of neighbours that occur, gradients) of the mean loss; those of neighbours are of these rows alone."""
        blocks, tokens = self.weights[2:]
        n = len(token)
        _, places, block, within, used = self._by_block(context, token)
        h, rows = self.hidden(places), np.arange(n)
        outer = softmax(held(h @ blocks))
        outer[rows, block] -= 1
        inner = np.empty((n, BLOCK), h.dtype)
        for b, lo, hi in used:
            np.matmul(h[lo:hi], tokens[b], out=inner[lo:hi])
        softmax(held(inner))
        inner[rows, within] -= 1
        back = outer @ blocks[:HIDDEN].T
        to_tokens = np.zeros_like(tokens)
        for b, lo, hi in used:
            back[lo:hi] += inner[lo:hi] @ tokens[b, :HIDDEN].T
            np.matmul(h[lo:hi].T, inner[lo:hi], out=to_tokens[b])
        to_tokens /= n
        back *= 1 - h[:, :HIDDEN] ** 2
        back /= n
        ids, near = sums_by(places.ravel(), back, len(NEIGHBOURS))
        return ids, [near, back.sum(0), h.T @ outer / n, to_tokens]

    def step(self, context: np.ndarray, token: np.ndarray, squares: list[np.ndarray]) -> None:
        """One step of Adagrad on a batch; ``squares`` has the sums of squared gradients."""
        ids, grads = self.gradients(context, token)
        near = self.weights[0]
        part, square = near[ids], squares[0][ids]
        adagrad(part, grads[0], square)
        near[ids], squares[0][ids] = part, square
        near[IDS :: IDS + 1] = 0
        for w, g, s in zip(self.weights[1:], grads[1:], squares[1:], strict=True):
            adagrad(w, g, s)

    def squares(self) -> list[np.ndarray]:
        return [np.full(w.shape, SQUARE, np.float32) for w in self.weights]


#: Where the table of each place begins among the rows of neighbours.
_TABLES = np.arange(len(NEIGHBOURS)) * (IDS + 1)


def adagrad(weight: np.ndarray, grad: np.ndarray, square: np.ndarray) -> None:
    by = grad * grad
    square += by
    np.sqrt(square, out=by)
    np.divide(grad, by, out=by)
    by *= RATE
    weight -= by


def held(logits: np.ndarray) -> np.ndarray:
    return np.clip(logits, -LOGIT, LOGIT, out=logits)


def softmax(logits: np.ndarray) -> np.ndarray:
    """In place, of held logits."""
    np.exp(logits, out=logits)
    logits /= (logits @ np.ones(logits.shape[1], logits.dtype))[:, None]
    return logits


def log_sum(logits: np.ndarray) -> np.ndarray:
    """Of held logits, which are lost."""
    np.exp(logits, out=logits)
    return np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def sums_by(keys: np.ndarray, rows: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys under 65,536, sums of rows[i // each] over the i of each key): rows of one key lie together and are added in pairs, again and again."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.diff(keys, prepend=-1))
    ids, many = keys[begin], np.diff(begin, append=len(keys))
    part, out, todo = np.take(rows, order // each, axis=0), np.empty((len(ids), rows.shape[1]), rows.dtype), np.arange(len(ids))
    while True:
        done = many == 1
        out[todo[done]] = part[begin[done]]
        todo, begin, many = todo[~done], begin[~done], many[~done]
        if not len(todo):
            return ids, out
        half = (many + 1) // 2
        at = np.cumsum(half) - half
        first = np.repeat(begin - 2 * at, half) + 2 * np.arange(half.sum())
        alone = (at + half - 1)[many % 2 == 1]
        summed = np.take(part, first, axis=0)
        first += 1
        first[alone] -= 1
        other = np.take(part, first, axis=0)
        other[alone] = 0
        summed += other
        part, begin, many = summed, at, half


def ranges(n: int, done: int) -> Iterator[tuple[int, int]]:
    """Ranges of the next steps within n words, after ``done`` steps; what is left is less than a step."""
    at = 0
    while at + (size := min(BATCH, FIRST_BATCH << min(done // GROW, 16))) <= n:
        yield at, at + size
        at, done = at + size, done + 1


def contexts(ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(len(at), 4) neighbours of the words at ``at``; IDS where the document has none."""
    row = np.searchsorted(rows, at, "right") - 1
    begin, end = rows[row], rows[row + 1]
    out = np.empty((len(at), len(NEIGHBOURS)), np.int64)
    for j, d in enumerate(NEIGHBOURS):
        where = at + d
        inside = (where >= begin) & (where < end)
        out[:, j] = np.where(inside, ids[np.where(inside, where, 0)], IDS)
    return out


def train(docs: DataFrame, words: Vocabulary) -> Network:
    """The average of what every task learns from its documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(words)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        network = Network(own.counts)
        squares = network.squares()
        seen, done, waiting = 0, 0, []

        def go() -> None:
            nonlocal done, waiting
            context, token = (np.concatenate(x) for x in zip(*waiting, strict=True))
            # neighbours in the text go to different steps
            order = np.random.default_rng(seen).permutation(len(token))
            at = 0
            for lo, at in ranges(len(token), done):
                network.step(context[order[lo:at]], token[order[lo:at]], squares)
                done += 1
            waiting = [(context[order[at:]], token[order[at:]])]

        for batch in batches:
            data, offsets = raw(batch.column(0))
            for lo, hi in steps(offsets):
                found = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids = own.ids(found)
                waiting.append((contexts(ids, found.rows, np.arange(len(ids))), ids))
                seen += len(ids)
                if sum(len(token) for _, token in waiting) >= MIXED:
                    go()
        if seen:
            go()
            if len(waiting[0][1]):
                network.step(*waiting[0], squares)
        if seen:
            pieces = np.array_split(network.flat(), PIECES)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(PIECES), pa.int32()), "tokens": pa.array([seen] * PIECES, pa.int64()), "weights": pa.array([p.tobytes() for p in pieces], pa.binary())})

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        tokens: dict[int, int] = {}
        for batch in batches:
            for piece, n, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[piece] = sums.get(piece, 0) + n * np.frombuffer(weights, np.float32).astype(np.float64)
                tokens[piece] = tokens.get(piece, 0) + n
        for piece, total in sums.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "tokens": pa.array([tokens[piece]], pa.int64()), "weights": pa.array([(total / tokens[piece]).astype(np.float32).tobytes()], pa.binary())})

    schema = "piece int, tokens bigint, weights binary"
    rows = docs.select("text").mapInArrow(learn, schema).repartition("piece").mapInArrow(average, schema).collect()
    network = Network(words.counts)
    if rows:
        network.load(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])]))
    return network


def score_column(column: pa.Array, words: Vocabulary, network: Network) -> tuple[np.ndarray, np.ndarray]:
    """(words, sum of log conditional probabilities) of every row."""
    data, offsets = raw(column)
    many, total = np.zeros(len(column), np.int64), np.zeros(len(column))
    for lo, hi in steps(offsets):
        found = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        many[lo:hi] = np.diff(found.rows)
        ids = words.ids(found)
        sums = np.zeros(len(ids) + 1)
        for a in range(0, len(ids), STEP_WORDS):
            at = np.arange(a, min(a + STEP_WORDS, len(ids)))
            sums[at + 1] = network.log_probabilities(contexts(ids, found.rows, at), ids[at])
        sums[1:] += words.rest.log_probabilities(found, ids)
        total[lo:hi] = np.diff(np.cumsum(sums)[found.rows])
    return many, total


def score(docs: DataFrame, words: Vocabulary | None = None, network: Network | None = None) -> DataFrame:
    """The pseudo-likelihood of every document under a network trained on all of them, or a given one.

    Returns doc_id, n_words, log_likelihood, per_word (nats). A text without words has 0 words
    and likelihood 0 and a null per_word; a null text has nulls. Repeated rows are scored, and
    learnt from, as often as they are there. An empty table gives an empty one; other columns
    aren't carried along. Sums are rounded to 2 places, as averages of floats depend on order.
    """
    words = words or vocabulary(docs)
    network = network or train(docs, words)
    shared = docs.sparkSession.sparkContext.broadcast((words, network))

    @F.arrow_udf("struct<n_words: bigint, log_likelihood: double>")
    def scorer(column: pa.Array) -> pa.Array:
        many, total = score_column(column, *shared.value)
        null = ~np.asarray(column.is_valid())
        return pa.StructArray.from_arrays([pa.array(many, mask=null), pa.array(np.round(total, 2), mask=null)], ["n_words", "log_likelihood"])

    scored = docs.select("doc_id", scorer("text").alias("__rv_scored")).select("doc_id", "__rv_scored.n_words", "__rv_scored.log_likelihood")
    return scored.withColumn("per_word", F.when(F.col("n_words") > 0, F.round(F.col("log_likelihood") / F.col("n_words"), 4)))
