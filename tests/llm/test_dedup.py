import collections
import random
import re
import time

import numpy as np
import pyarrow as pa

from ravelin.llm import simhash, substring
from ravelin.llm.shared import components


def vocabulary(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def near_copies(seed=2, groups=25):
    rng, words, docs = random.Random(seed), vocabulary(3000), []
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for c in range(rng.randint(1, 4)):
            copy = [rng.choice(words) if c and rng.random() < 0.03 else w for w in base]
            docs.append((len(docs), " ".join(copy), g))
    return docs


def brute_groups(prints):
    bits = np.unpackbits(simhash.as_rows(prints), axis=1)
    label = list(range(len(bits)))
    for i in range(len(bits)):
        for j in range(i):
            if (bits[i] != bits[j]).sum() <= simhash.RADIUS:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def together(labels):
    return {(i, j) for i in range(len(labels)) for j in range(i) if labels[i] == labels[j]}


def test_pairs_in_groups_are_those_of_all_pairs_by_either_way(make):
    rows = near_copies()
    docs = make([(i, t) for i, t, _ in rows])
    want = brute_groups(simhash.fingerprints(pa.array([t for _, t, _ in rows])))
    found = []
    for limit in (0, 10_000):
        got = {r.doc_id: r.group_id for r in simhash.near_duplicates(docs, broadcast_limit=limit).collect()}
        found.append([got[i] for i in range(len(rows))])
    assert found[0] == found[1]
    assert together(found[0]) <= together(want)
    assert len(together(found[0])) >= 0.9 * len(together(want))
    planted = collections.defaultdict(set)
    for i, _, g in rows:
        planted[g].add(want[i])
    assert sum(len(x) == 1 for x in planted.values()) >= 0.9 * len(planted)
    assert len({x for s in planted.values() for x in s}) >= len(planted)


def flipped(rng, prints, most):
    bits = np.unpackbits(prints, axis=1)
    for i, n in enumerate(rng.integers(0, most + 1, len(bits))):
        bits[i, rng.choice(128, n, replace=False)] ^= 1
    return np.packbits(bits, axis=1)


def brute_labels(keys, prints):
    bits = np.unpackbits(prints, axis=1).astype(int)
    near = ((bits[:, None] != bits[None]).sum(2) <= simhash.RADIUS) & (keys[:, None] == keys[None])
    label = np.arange(len(bits))
    while True:
        low = np.where(near, label[None], len(bits)).min(1)
        if (low == label).all():
            return label
        label = low


def test_forest_links_what_is_within_the_radius():
    for seed in range(6):
        rng = np.random.default_rng(seed)
        # balls, chains of balls, and single ones
        centres = rng.integers(0, 256, (25, 16), np.uint8)
        steps = [centres]
        for _ in range(3):
            steps.append(flipped(rng, steps[-1], 18))
        prints = flipped(rng, np.repeat(np.concatenate(steps), 6, 0), (2, 12)[seed % 2])
        prints = np.unique(prints, axis=0)[rng.permutation(len(np.unique(prints, axis=0)))]
        keys = np.sort(rng.integers(0, 1 + seed, len(prints)))
        forest = simhash.Forest(keys, prints)
        want = brute_labels(keys, prints)
        assert forest.link().tolist() == want.tolist()
        # searches of a part each, as tasks make them, find the same together
        label = forest.label.copy()
        for part in np.array_split(rng.permutation(len(prints)), 4):
            got = forest.link(part)
            simhash.merge(label, np.arange(len(label)), got)
        assert label.tolist() == want.tolist()


def test_links_whatever_the_sizes_of_steps(monkeypatch):
    rng = np.random.default_rng(5)
    prints = np.unique(flipped(rng, np.repeat(rng.integers(0, 256, (30, 16), np.uint8), 20, 0), 10), axis=0)
    keys = np.zeros(len(prints), np.int64)
    want = brute_labels(keys, prints)
    monkeypatch.setattr(simhash, "FIRST_ASKED", 3)
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    assert simhash.Forest(keys, prints).link().tolist() == want.tolist()


def test_a_shard_of_near_copies_takes_no_square_of_time():
    rng, took = np.random.default_rng(6), []
    for n in (8_000, 32_000):
        prints = np.unique(flipped(rng, np.repeat(rng.integers(0, 256, (1, 16), np.uint8), n, 0), 14), axis=0)
        began = time.process_time()
        label = simhash.Forest(np.zeros(len(prints), np.int64), prints).link()
        took.append(time.process_time() - began)
        assert len(np.unique(label)) == 1
    assert took[1] < 8 * took[0] + 1


def test_repeated_rows_leave_one(spark, make):
    text = "some words that are said in a document of its own kind"
    docs = make([(1, text), (1, text), (1, text), (2, text), (3, "other things altogether are said here and there"), (3, "nothing alike at all in this one, not a word of it")])
    got = sorted((r.doc_id, r.duplicate) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, False), (1, True), (1, True), (2, True), (3, False), (3, False)]
    assert [r.doc_id for r in simhash.one_of_each(docs).orderBy("doc_id").collect()] == [1, 3, 3]
    differ = docs.limit(0).union(spark.createDataFrame([(1, text, "en", s, len(text)) for s in "abcdef"], docs.schema))
    kept = {tuple(simhash.one_of_each(differ.repartition(n)).collect()) for n in (1, 3, 6)}
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_recall_over_all_distances():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (400, 128)).astype(np.uint8)
    other = base.copy()
    for i in range(400):
        other[i, rng.choice(128, i % (simhash.RADIUS + 1), replace=False)] ^= 1
    a, b = simhash.shard_keys(np.packbits(base, axis=1)), simhash.shard_keys(np.packbits(other, axis=1))
    assert (a == b).any(1).mean() >= 0.9


def test_recall_at_the_last_distances_is_as_stated():
    rng = np.random.default_rng(8)
    for distance, stated in ((13, 0.986), (14, 0.972), (15, 0.949), (16, 0.917)):
        base = rng.integers(0, 2, (20_000, 128)).astype(np.uint8)
        flips = np.argsort(rng.random(base.shape), axis=1) < distance
        a, b = (simhash.shard_keys(np.packbits(x, axis=1)) for x in (base, base ^ flips))
        assert abs((a == b).any(1).mean() - stated) < 0.01


def test_near_duplicates_on_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    by = {(r.doc_id, r.group_size): (r.group_id, r.duplicate) for r in rows}
    assert sorted(r.duplicate for r in rows if r.doc_id == 3) == [False, True]
    assert len(rows) == 9 and by[(3, 2)][0] == 3 and by[(1, 1)] == (1, False) and by[(5, 1)] == (5, False)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None", "None"]
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_the_least_id_stays_and_null_ids_come_last(make):
    text = " ".join(vocabulary(80))
    kept = simhash.one_of_each(make([(None, text), (9, text + " more"), (7, text)])).collect()
    assert [r.doc_id for r in kept] == [7]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(100 + i, 100) for i in range(1, 30)}


# --- substring dedup --------------------------------------------------------


def brute_repeats(rows):
    """By definition: every run of MIN_WORDS words that stands in two places, and where each stands first."""
    size, places = substring.MIN_WORDS, collections.defaultdict(list)
    for doc_id, text, h in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        words = [w.lower() for w in re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", text or "")]
        for s in range(len(words) - size + 1):
            places[tuple(words[s : s + size])].append(((doc_id, h), s))
    at = collections.defaultdict(dict)
    for found in places.values():
        for n, (key, s) in enumerate(found if len(found) > 1 else []):
            for p in range(s, s + size):
                at[key][p] = at[key].get(p, True) and n == 0
    out = set()
    for (doc_id, _), first in at.items():
        begin = None
        for p in sorted(first):
            begin = p if begin is None else begin
            if first.get(p + 1) != first[p]:
                out.add((doc_id, begin, p + 1, first[p]))
                begin = None
    return out


def passages(seed=3, n=120):
    rng, words = random.Random(seed), [f"w{i}" for i in range(400)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    shared, docs = [some(rng.randint(40, 130)) for _ in range(6)], []
    for i in range(n):
        text = some(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(shared))
            if rng.random() < 0.4:
                p = p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "zz"
            k = rng.randint(0, len(text))
            text[k:k] = p
        docs.append((i, " ".join(text)))
    return docs + [(500, "a " * 300), (501, "B a, " * 200), (502, None), (503, ""), (None, " ".join(shared[0])), (504, docs[3][1]), (504, docs[3][1]), (505, " ".join(docs[5][1].split()[:49]))]


def test_repeats_are_those_of_brute_force(make):
    docs = make(passages())
    hashed = [(r.doc_id, r.text, r.h) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()]
    got = [(r.doc_id, r.begin, r.end, r.first) for r in substring.repeats(docs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_repeats(hashed)


def test_anchors_of_many_places_are_split(make):
    docs = make(passages(seed=4, n=80))
    inlined = lambda hot: sorted(map(str, substring._spans(docs, hot).selectExpr("id", "inline(parts)").collect()))
    want = inlined(1 << 16)
    assert len(want) > 50 and inlined(0) == want and inlined(3) == want


def test_cut_leaves_each_passage_once(make):
    rows = [r for r in passages(seed=8, n=60) if r[0] not in (500, 501)]
    docs = make(rows)
    after = substring.without_repeats(docs)
    assert after.columns == docs.columns and after.count() == docs.count()
    left = {(r.doc_id, r.text): r for r in after.collect()}
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left.values())
    hashed = [(i, t, hash(t)) for i, t in {(r.doc_id, r.text) for r in docs.collect()}]
    later = [x for x in brute_repeats([(r.doc_id, r.text, r.h) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()]) if not x[3]]
    before = sum(len((t or "").split()) for _, t, _ in hashed)
    now = sum(len((r.text or "").split()) for r in left.values())
    assert before - now == sum(e - b for _, b, e, _ in later)


def test_repeats_on_odd_rows(odd, none):
    got = [(r.doc_id, r.begin, r.end, r.first) for r in substring.repeats(odd).collect()]
    assert sorted(got) == sorted((d, b, e, f) for d, b, e, f in brute_repeats([(4, "x " * 60_000, 0)]))
    after = substring.without_repeats(odd)
    assert after.columns == odd.columns and after.count() == 9
    assert substring.repeats(none).count() == 0 and substring.without_repeats(none).count() == 0
