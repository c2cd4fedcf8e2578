"""The pipeline against a version that compares everything with everything."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import bpe, decontaminate, quality, simhash, substring


def rows_and_items():
    rng = random.Random(9)
    words = "the of and to in is that it was for on with as be at".split() + [f"w{i}" for i in range(500)]
    some = lambda n: [rng.choice(words[:15]) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, " ".join(some(30))) for i in range(5)]
    shared = some(80)
    rows = [(i, " ".join(some(rng.randint(60, 250)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " tail"), (102, " ".join([*some(60), *shared, *some(40)])), (103, " ".join([*some(50), *shared, *some(70)]))]
    rows += [(104, " ".join([*some(50), *items[2][1].split(), *some(40)])), (105, "$$%% ##!! xyz " * 90), (106, None), (107, "")]
    return rows, items


@pytest.fixture
def folder(spark, make, tmp_path):
    rows, items = rows_and_items()
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def plain_histograms(texts):
    """Characters by class and words by slot, a character and a word at a time; one language."""
    said = [[w.lower() for w in re.findall(r"[0-9A-Za-z_\x80-\U0010ffff]+", t or "")] for t in texts]
    count = collections.Counter(w for s in said for w in s)
    common = sorted(count, key=lambda w: (-count[w], w))[: quality.COMMON]
    slots = np.array([[s.count(w) for w in common] + [0] * (quality.COMMON - len(common)) + [sum(w not in common for w in s)] for s in said])

    def kind(c):
        for name, holds in (("lower", "a" <= c <= "z"), ("upper", "A" <= c <= "Z"), ("digit", "0" <= c <= "9"), ("blank", c in " \t"), ("line", c in "\n\r"), ("stop", c in ".,;:?'\"()-"), ("other", ord(c) > 127), ("control", ord(c) < 32 or ord(c) == 127)):
            if holds:
                return quality.CLASSES.index(name)
        return quality.CLASSES.index("sign")

    classes = np.array([np.bincount([kind(c) for c in t or ""], minlength=len(quality.CLASSES)) for t in texts])
    return classes, slots


def brute(rows, items):
    classes, slots = plain_histograms([t for _, t in rows])
    n = slots.sum(1)
    with np.errstate(all="ignore"):
        bad = (quality.distance(classes, classes.sum(0)) > quality.CLASS_BASE + quality.CLASS_SPREAD / np.sqrt(n)) | (quality.distance(slots, slots.sum(0)) > quality.WORD_BASE + quality.WORD_SPREAD / np.sqrt(n))
    rows = [r for r, b, k in zip(rows, bad, n, strict=True) if not b or k < quality.MIN_WORDS]
    prints = simhash.fingerprints(pa.array([t for _, t in rows], pa.string()))
    bits = [None if p is None else np.unpackbits(np.frombuffer(p, np.uint8)) for p in prints.to_pylist()]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bits[i] is not None and bits[j] is not None and (bits[i] != bits[j]).sum() <= simhash.RADIUS:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    rows = [min(r for r, x in zip(rows, label, strict=True) if x == g) for g in dict.fromkeys(label)]
    runs: dict[tuple, list] = {}
    size = substring.MIN_WORDS
    for i, t in rows:
        w = (t or "").split()
        for s in range(len(w) - size + 1):
            runs.setdefault(tuple(x.lower() for x in w[s : s + size]), []).append((i, s))
    drop: dict[int, set] = {}
    for places in runs.values():
        for i, s in sorted(places)[1:]:
            drop.setdefault(i, set()).update(range(s, s + size))
    cut = []
    for i, t in rows:
        out, at = "", 0
        for k, w in enumerate((t or "").split()):
            begin = t.index(w, at)
            end = begin + len(w)
            nxt = begin + len(w) + (1 if end < len(t) else 0)
            out += "" if k in drop.get(i, ()) else t[begin:nxt]
            at = end
        cut.append((i, t if i not in drop else out))
    wants = [decontaminate.tuples(decontaminate.one(t).array()) for _, t in items]
    kept = []
    for i, t in cut:
        has = decontaminate.tuples(decontaminate.one(t).array())
        if not any(len(w & has) / len(w) >= decontaminate.THRESHOLD for w in wants):
            kept.append((i, t))
    return kept


def test_pipeline_is_its_brute_force_version(spark, folder):
    import corpus_pipeline

    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=bpe.load().rank, special_tokens={})
    want = {i: None if t is None else library.encode_ordinary(t) for i, t in brute(*rows_and_items())}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(want) and {100, 101, 104, 105}.isdisjoint(got) and {102, 103, 106, 107} <= set(got)
    assert {i: r.token_ids for i, r in got.items()} == want
    assert all(r.round_trip for r in got.values() if r.token_ids is not None)


def test_stages_keep_the_columns_and_bear_odd_rows(spark, odd, none, folder):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encode_decode"]
    docs, empty = odd, none
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, empty = stage(spark, docs, folder), stage(spark, empty, folder)
        rows = docs.collect()
        assert docs.columns == odd.columns and empty.columns == odd.columns and not empty.collect()
        assert sum(r.text is None for r in rows) == 2 and sum(r.text == "" for r in rows) == 1
        assert sum(r.doc_id == 3 for r in rows) == (2 if name == "quality_rules" else 1) and all(r.fp == "clash" for r in rows)
        docs = spark.createDataFrame(rows, odd.schema)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len(got) == docs.count() and all((r.token_ids is None) == (r.round_trip is None) for r in got)


def test_run_on_odd_and_empty_tables(spark, odd, none, folder, tmp_path):
    import corpus_pipeline

    for name, rows in (("odd", odd), ("none", none)):
        at = tmp_path / name
        rows.write.parquet(str(at / "documents.parquet"))
        spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(str(at / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(at)).collect()
        assert len(got) == (8 if name == "odd" else 0)
        assert got == [] or sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "4", "5", "6", "None", "None"]


def test_no_benchmark_leaves_all(spark, odd, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert decontaminate.clean_only(odd, items.limit(0)).count() == odd.count()
    twice = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, "")], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, "say one two three four five six seven now"), (7, "say one two three four five six seven now")], "doc_id bigint, text string")
    for limit in (0, 1 << 20):
        assert sorted((r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(docs, twice, limit).collect()) == [(7, 1, 1.0)] * 4
        assert decontaminate.clean_only(docs, twice, limit).count() == 0
