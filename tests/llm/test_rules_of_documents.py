"""Quality rules, decontamination, sharding."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import decontaminate, quality, sharding

# --- quality rules ------------------------------------------------------------


def jensen_shannon(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * np.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
    return float(np.sqrt((half(p, q) + half(q, p)) / 2))


def test_distance_is_by_definition():
    rng = np.random.default_rng(1)
    p, q = rng.integers(0, 9, (20, 7)) + np.eye(20, 7, dtype=int), rng.integers(1, 9, 7)
    assert quality.distance(p, q).tolist() == pytest.approx([jensen_shannon(r.tolist(), q.tolist()) for r in p])
    assert np.isnan(quality.distance(np.zeros((1, 3)), np.ones(3))).all()


def prose(rng, n):
    return " ".join(rng.choice("the of and to in river stone light under walked slowly house green".split()) for _ in range(n)) + "."


def test_junk_is_rejected_and_prose_kept(make):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(40, 200)), "en") for i in range(60)]
    rows += [(100, "$$%% ##!! " * 60 + "word " * 40, "en"), (101, "ZYX!! " * 200, "en"), (102, "short $$$ %%%", "en"), (103, prose(rng, 80), None)]
    got = {r.doc_id: r for r in quality.quality(make(rows)).collect()}
    assert all(got[i].accepted for i in range(60)) and not got[100].accepted and not got[101].accepted
    assert got[102].accepted and got[103].accepted and got[103].class_distance == 0
    kept = quality.accepted_only(make(rows))
    assert kept.columns == make(rows).columns and kept.count() == len(rows) - 2


def test_quality_on_odd_rows(odd, none):
    got = quality.quality(odd).collect()
    assert len(got) == odd.count() and all(r.accepted for r in got if not r.n_words)
    assert all(r.word_distance is None for r in got if not r.n_words)
    assert quality.accepted_only(odd).columns == odd.columns
    assert quality.quality(none).count() == 0 and quality.accepted_only(none).count() == 0


# --- decontamination ------------------------------------------------------------


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        has = decontaminate.tuples(decontaminate.one(text).array())
        for item_id, t in items:
            want = decontaminate.tuples(decontaminate.one(t).array())
            if want and len(want & has) / len(want) >= decontaminate.THRESHOLD:
                out.append((doc_id, item_id, round(len(want & has) / len(want), 6)))
    return sorted(out, key=str)


def leaks(seed=5):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 60)))) for i in range(40)] + [(90, "too few words"), (91, None), (92, "")]
    docs = []
    for i in range(150):
        text = [word() for _ in range(rng.randint(0, 400))]
        if i % 2:
            part = rng.choice(items[:40])[1].split()
            for _ in range(rng.randint(0, len(part) // 25)):
                part[rng.randrange(len(part))] = "changed"
            k = rng.randint(0, len(text))
            text[k:k] = part
        docs.append((i, " ".join(text)))
    return docs + [(700, items[3][1]), (700, items[3][1]), (None, items[4][1]), (701, None), (702, "")], items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_items_are_found_by_either_way(spark, make, limit):
    docs, items = leaks()
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("clash"))
    want = brute(docs, items)
    got = sorted(((r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(make(docs), bench, limit).collect()), key=str)
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want)
    assert [g for g in got if g[0] in (700, None)] == [w for w in want if w[0] in (700, None)]
    kept = decontaminate.clean_only(make(docs), bench, limit)
    assert kept.columns == make(docs).columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {g[0] for g in got}


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 0])
def test_decontamination_on_odd_rows(spark, odd, none, limit):
    bench = spark.createDataFrame([(None, "x x x x x x"), (1, None), (2, ""), (2, "a b c d e f g")], "item_id bigint, text string")
    got = decontaminate.contaminated(odd, bench, limit).collect()
    assert [(r.doc_id, r.item_id, r.containment) for r in got] == [(4, None, 1.0)]
    assert decontaminate.contaminated(none, bench, limit).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0), limit).count() == 0
    assert decontaminate.clean_only(odd, bench.limit(0), limit).count() == odd.count()


# --- sharding ------------------------------------------------------------------


def one_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jumps_are_those_of_the_paper():
    keys = np.random.default_rng(0).integers(0, 1 << 64, 2000, np.uint64)
    for shards in (1, 2, 7, 64, 1000):
        assert sharding.jump(keys, shards).tolist() == [one_jump(int(k), shards) for k in keys]


def test_only_the_necessary_fraction_moves(spark):
    docs = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = sharding.assign_shards(docs, 64, 80).toPandas()
    assert abs(got.moved.mean() - 16 / 80) < 0.02 and (got.grown_shard[got.moved] >= 64).all()
    assert got.groupby("shard").size().between(200, 440).all()
    assert sharding.moved_rows(docs, 64, 80).count() == got.moved.sum()


def test_sharding_on_odd_rows(odd, none, tmp_path, spark):
    got = sharding.assign_shards(odd).collect()
    assert len(got) == odd.count() and len({r.shard for r in got if r.doc_id is None}) == 1 and len({r.shard for r in got if r.doc_id == 3}) == 1
    assert sharding.assign_shards(none).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.count()
    with pytest.raises(ValueError):
        sharding.jump(np.zeros(1, np.uint64), 0)
    assert sharding.jump(np.zeros(0, np.uint64), 3).tolist() == []
