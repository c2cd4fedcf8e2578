import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ravelin.llm import bpe

TEXTS = [
    "", "a", " ", "   ", "a  b", "don't we'll 's'sword ''s \n\n x", "it's\nhe'd 've'", "\t\tx  y z  ", "日本語 テキスト123", "é" * 300 + "'re", "x" * 5000,
    "a\x1cb \x1c c", "'", "a'", " 's", "'s", "he'll's", "\U0001f600\U0001f600'm", "#" * 3000, "   x", "I'LL 'Re",
]


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=bpe.load().rank, special_tokens={})


def random_texts(n):
    rng = random.Random(4)
    parts = [*"ab 'sstrevmld\n\t 1é,  ", "'re", "'ll", "　", "the", "tion"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_are_those_of_a_tokenizer_library(library):
    texts = TEXTS + random_texts(2000)
    assert bpe.encode_column(pa.array(texts), bpe.load()).to_pylist() == [library.encode_ordinary(t) for t in texts]


def test_trie_traversal_is_merging_by_rank():
    vocabulary = bpe.load()
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abcdethion ") for _ in range(rng.randint(1, 14))) for _ in range(500)})
    for word, ids in zip(words, vocabulary.encode_sorted(words), strict=True):
        assert [vocabulary.tokens[i] for i in ids] == bpe.merge(word, vocabulary.rank, 1 << 60)


def test_decode_is_exact_and_defined_for_any_ids():
    vocabulary = bpe.load()
    texts = TEXTS + random_texts(200) + [None]
    assert bpe.decode_column(bpe.encode_column(pa.array(texts), vocabulary), vocabulary.tokens).to_pylist() == texts
    odd = pa.array([[-1, 10**6], [None, 64], [128], None, []], pa.list_(pa.int32()))
    assert bpe.decode_column(odd, vocabulary.tokens).to_pylist() == ["��", "a", vocabulary.tokens[128].decode("utf-8", "replace"), None, ""]


def test_query_on_odd_rows(odd, none):
    rows = bpe.bpe_encode_decode(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.round_trip for r in rows if r.n_tokens is not None)
    assert sorted(r.n_tokens is None for r in rows) == [False] * 7 + [True] * 2
    assert [r.token_ids for r in rows if r.doc_id == 2] == [[]]
    assert bpe.bpe_encode_decode(none).count() == 0


def test_counts_are_lengths_of_encodings(spark, make, odd, none, library):
    texts = TEXTS + random_texts(300)
    docs = make(list(enumerate(texts))).repartition(3)
    got = {r.doc_id: (r.n_pretokens, r.n_tokens, r.n_looked_up) for r in bpe.token_counts(docs, size=40).collect()}
    assert {i: n for i, (_, n, _) in got.items()} == {i: len(library.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(0 <= looked <= pre for pre, _, looked in got.values()) and any(looked for _, _, looked in got.values())
    rows = bpe.token_counts(odd).collect()
    assert len(rows) == 9 and [r.n_tokens for r in rows if r.doc_id == 2] == [0] and [r.n_tokens for r in rows if r.doc_id == 1] == [None]
    assert bpe.token_counts(none).count() == 0


def test_frequent_pretokens_are_the_frequent_ones(make):
    docs = make([(i, "the cat " * 20 + f"w{i}") for i in range(50)]).repartition(40)
    top = bpe.frequent_pretokens(docs, size=4, summary=8)
    assert {b" cat", b" the"} <= set(top)
    assert docs.select(F.count("*")).first()[0] == 50
