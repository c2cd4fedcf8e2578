"""Language identification and pseudo-likelihood."""

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import langid, pseudo
from ravelin.llm.text import Words

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_gradients_are_slopes():
    rng = np.random.default_rng(3)
    model = langid.ByteCnn(["a", "b", "c"])
    model.weights = [w.astype(np.float64) for w in model.weights]
    windows, answers = rng.integers(1, 256, (5, langid.WINDOW)), np.array([0, 1, 2, 0, 1])
    _, grads = model.gradients(windows, answers)
    for w, g in zip(model.weights, grads, strict=True):
        for at in [np.unravel_index(i, w.shape) for i in np.argsort(-np.abs(g), axis=None)[:3]]:
            keep = w[at]
            w[at] = keep + 1e-6
            up, _ = model.gradients(windows, answers)
            w[at] = keep - 1e-6
            down, _ = model.gradients(windows, answers)
            w[at] = keep
            assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-2, abs=1e-6)


def test_look_ups_are_the_network():
    model = langid.ByteCnn(["a", "b"])
    windows = np.random.default_rng(1).integers(0, 256, (9, langid.WINDOW))
    responses, _ = model.responses(windows)
    hidden = np.maximum(responses.max(1) + model.weights[2], 0)
    want = langid.log_softmax(hidden @ model.weights[3] + model.weights[4])
    assert model.prepare().log_probabilities(windows) == pytest.approx(want, abs=1e-4)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(DOCS)
    model = langid.train(docs.filter("pmod(xxhash64(doc_id), 2) = 0"))
    held = docs.filter("pmod(xxhash64(doc_id), 2) = 1 AND length(text) >= 100")
    right = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").selectExpr("avg(CAST(predicted = lang AS INT)) a").first()["a"]
    assert right >= 0.9


def test_identification_on_odd_rows(odd, none, make):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count() and all(r.predicted is None and r.probability is None for r in got if not r.n_windows)
    assert all(r.predicted == "en" for r in got if r.n_windows)
    assert langid.identify(none).count() == 0
    unlabelled = make([(1, "text", None)])
    assert [r.predicted for r in langid.identify(unlabelled).collect()] == [None]


def test_every_byte_is_in_one_window():
    texts = ["", "x" * 127, "y" * 128, "z" * 300]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    begins, rows, lengths = langid.windows_of(data, offsets)
    assert np.bincount(rows, lengths, 4).tolist() == [0, 127, 128, 300] and sorted(zip(begins, lengths, strict=True))[-1] == (127 + 128 + 256, 44)


# --- pseudo-likelihood ---------------------------------------------------------


def ready(texts):
    words, many = np.unique(" ".join(texts).split(), return_counts=True)
    return pseudo.Vocabulary([w.encode() for w in words], many.tolist(), int(many.sum()))


def test_conditionals_add_up_to_one():
    network = pseudo.Network(np.random.default_rng(2).integers(1, 50, pseudo.IDS).astype(float))
    context = np.array([[1, 2, pseudo.IDS, 40]])
    every = network.log_probabilities(np.repeat(context, pseudo.IDS, 0), np.arange(pseudo.IDS))
    assert np.exp(every.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)


def test_scores_are_sums_over_tokens_with_both_sides():
    texts = ["a b c d e a b", "c", "", None, "b a " * 50]
    words = ready([t for t in texts if t])
    network = pseudo.Network(words.counts)
    many, total = pseudo.score_column(pa.array(texts), words, network)
    for text, n, got in zip(texts, many, total, strict=True):
        data = np.frombuffer((text or "").encode(), np.uint8)
        ids = words.ids(Words(data, np.array([0, len(data)]))).tolist()
        near = [[ids[i + d] if 0 <= i + d < len(ids) else pseudo.IDS for d in pseudo.NEIGHBOURS] for i in range(len(ids))]
        want = sum(float(network.log_probabilities(np.array([c]), np.array([t]))[0]) for c, t in zip(near, ids, strict=True))
        assert n == len(ids) and got == pytest.approx(want, abs=1e-2)


def test_training_lowers_the_loss_and_order_matters():
    rng = np.random.default_rng(4)
    cycle = [f"w{i}" for i in range(40)]
    text = " ".join(cycle[(s + i) % 40] for s in rng.integers(0, 40, 200).tolist() for i in range(20))
    words = ready([text])
    network, squares = pseudo.Network(words.counts), None
    data = np.frombuffer(text.encode(), np.uint8)
    found = Words(data, np.array([0, len(data)]))
    ids = words.ids(found)
    at = np.arange(len(ids))
    context = pseudo.contexts(ids, found.rows, at)
    before = network.log_probabilities(context, ids).mean()
    squares = network.squares()
    for _ in range(4):
        for i in range(0, len(at), 512):
            network.step(context[i : i + 512], ids[i : i + 512], squares)
    assert network.log_probabilities(context, ids).mean() > before + 1
    mixed = rng.permutation(ids)
    assert network.log_probabilities(pseudo.contexts(mixed, found.rows, at), mixed).mean() < network.log_probabilities(context, ids).mean() - 1


def test_gradients_of_the_window_network_are_slopes():
    rng = np.random.default_rng(8)
    network = pseudo.Network(rng.integers(1, 50, pseudo.IDS).astype(float))
    network.weights = [w.astype(np.float64) + rng.normal(0, 0.02, w.shape) for w in network.weights]
    context, token = rng.integers(0, pseudo.IDS + 1, (70, 4)), rng.integers(0, pseudo.IDS, 70)
    context[:40, 0], token[:30] = 7, 9
    ids, grads = network.gradients(context, token)
    near = np.zeros_like(network.weights[0])
    near[ids] = grads[0]
    for w, g in zip(network.weights, [near, *grads[1:]], strict=True):
        for at in [np.unravel_index(i, w.shape) for i in [*np.argsort(-np.abs(g), axis=None)[:4], *rng.integers(0, w.size, 2)]]:
            keep, losses = w[at], []
            for by in (1e-5, -1e-5):
                w[at] = keep + by
                losses.append(-network.log_probabilities(context, token).mean())
            w[at] = keep
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-7)


def test_sums_by_key_are_sums():
    rng = np.random.default_rng(9)
    keys, rows = rng.integers(0, 12, 400) ** 2, rng.normal(size=(100, 3))
    ids, sums = pseudo.sums_by(keys, rows, 4)
    assert ids.tolist() == sorted(set(keys.tolist()))
    for k, s in zip(ids, sums, strict=True):
        assert s == pytest.approx(sum(rows[i // 4] for i in np.flatnonzero(keys == k)))


def test_steps_cover_all_words_and_grow():
    done, sizes = 0, []
    for n in (100, 5000, 1 << 18):
        at = 0
        for lo, hi in pseudo.ranges(n, done):
            assert lo == at
            at, done = hi, done + 1
            sizes.append(hi - lo)
        assert n - at < pseudo.BATCH
    assert sizes == sorted(sizes) and sizes[0] == pseudo.FIRST_BATCH and sizes[-1] == pseudo.BATCH


def test_hash_tables_find_what_they_hold():
    from ravelin.llm.text import HashTable

    rng = np.random.default_rng(10)
    hashes = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64) & ~np.uint64(0xF0))
    table = HashTable(hashes[::2])
    assert table.find(hashes[::2]).tolist() == list(range(len(hashes[::2]))) and (table.find(hashes[1::2]) == -1).all()
    assert HashTable(hashes[:0]).find(hashes[:3]).tolist() == [-1] * 3


def plainly(texts):
    """Scores of texts by one process: counts, ids, contexts and sums a word at a time; the steps of training are the module's."""
    import re

    said = [re.findall(r"[a-z0-9_]+", (t or "").lower()) for t in texts]
    counts = {}
    for w in (w for s in said for w in s):
        counts[w] = counts.get(w, 0) + 1
    known = sorted(counts, key=lambda w: (-counts[w], w))[: pseudo.VOCABULARY]
    assert len(known) == len(counts), "small texts only: no word is outside the vocabulary"
    ids = {w: pseudo.OTHERS + i for i, w in enumerate(known)}
    pairs = []
    for s in said:
        for i, w in enumerate(s):
            pairs.append(([ids[s[i + d]] if 0 <= i + d < len(s) else pseudo.IDS for d in (-2, -1, 1, 2)], ids[w]))
    network = pseudo.Network(np.array([0] * pseudo.OTHERS + [counts[w] for w in known] + [0] * (pseudo.VOCABULARY - len(known)), float))
    context, token = np.array([c for c, _ in pairs]), np.array([t for _, t in pairs])
    order, squares, at = np.random.default_rng(len(token)).permutation(len(token)), network.squares(), 0
    for lo, at in pseudo.ranges(len(token), 0):
        network.step(context[order[lo:at]], token[order[lo:at]], squares)
    if at < len(token):
        network.step(context[order[at:]], token[order[at:]], squares)
    near, bias, blocks, tokens = (w.astype(np.float64) for w in network.weights)
    out, k = [], 0
    for s in said:
        total = 0.0
        for _ in s:
            c, t = pairs[k]
            k += 1
            h = np.append(np.tanh(bias + sum(near[j * (pseudo.IDS + 1) + x] for j, x in enumerate(c))), 1)
            for logits, mine in ((h @ blocks, t // pseudo.BLOCK), (h @ tokens[t // pseudo.BLOCK], t % pseudo.BLOCK)):
                total += logits[mine] - np.log(np.exp(logits).sum())
        out.append((len(s), total))
    return out


def test_the_query_against_one_plain_process(make):
    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, n) % 300) for n in rng.integers(1, 400, 60)] + ["", None, "one two", "one two"]
    docs = make([(i, t) for i, t in enumerate(texts)]).coalesce(1)
    got = {r.doc_id: r for r in pseudo.score(docs).collect()}
    for i, (n, total) in enumerate(plainly(texts)):
        if texts[i] is None:
            assert got[i].n_words is None and got[i].log_likelihood is None
        else:
            assert got[i].n_words == n and got[i].log_likelihood == pytest.approx(total, abs=0.02 + 1e-4 * n)


def test_training_predicts_every_word(make):
    docs = make([(i, "a b " * 2000) for i in range(4)])
    words = pseudo.vocabulary(docs)
    network = pseudo.train(docs, words)
    data = np.frombuffer(b"a b " * 20, np.uint8)
    found = Words(data, np.array([0, len(data)]))
    ids = words.ids(found)
    got = network.log_probabilities(pseudo.contexts(ids, found.rows, np.arange(len(ids))), ids)
    assert got[0::2].mean() > -0.3 and got[1::2].mean() > -0.3


def test_words_of_a_bucket_have_their_own_share(make, monkeypatch):
    monkeypatch.setattr(pseudo, "VOCABULARY", 8)
    common = " ".join(f"the{i} " * 50 for i in range(8))
    docs = make([(1, common), (2, "garden " * 30), (3, " ".join(f"garden{c}" for c in "abcdefghijklmnopqrstuvwxyz"))])
    words = pseudo.vocabulary(docs)

    def share(word):
        data = np.frombuffer(word.encode(), np.uint8)
        found = Words(data, np.array([0, len(data)]))
        return words.rest.log_probabilities(found, words.ids(found))[0]

    assert share("the3") == 0
    assert share("gardenq") < share("garden") < 0
    assert share("xqzjvkwpfy") < share("gardens") - 10
    every = {}
    for w in ["garden", *(f"garden{c}" for c in "abcdefghijklmnopqrstuvwxyz")]:
        data = np.frombuffer(w.encode(), np.uint8)
        bucket = int(words.ids(Words(data, np.array([0, len(data)])))[0])
        every[bucket] = every.get(bucket, 0) + np.exp(share(w))
    assert all(x < 1 for x in every.values())


def test_spellings_add_up_to_one():
    spelt = np.random.default_rng(6).integers(0, 3, pseudo.SYMBOLS**3)
    table = pseudo.Rest([], [], np.ones(pseudo.OTHERS), spelt).spelling.reshape(-1, pseudo.SYMBOLS)
    assert np.exp(table.astype(np.float64)).sum(1) == pytest.approx(1, abs=1e-4)


def test_vocabulary_counts_all_words(make):
    got = pseudo.vocabulary(make([(1, "a a b"), (2, "b c a"), (3, None), (4, "")]))
    assert got.words == [b"a", b"b", b"c"] and got.counts[pseudo.OTHERS : pseudo.OTHERS + 3].tolist() == [3, 2, 1]


def test_scoring_on_odd_rows(odd, none):
    got = pseudo.score(odd).collect()
    assert len(got) == odd.count()
    assert all((r.n_words is None) == (r.log_likelihood is None) and (r.per_word is None) == (not r.n_words) for r in got)
    assert len({(r.n_words, r.log_likelihood) for r in got if r.doc_id == 3}) == 1
    assert pseudo.score(none).count() == 0
