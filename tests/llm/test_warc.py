import random

from pyspark.sql import functions as F

from ravelin.llm import warc

SCHEMA = "record_id string, url string, warc_type string, captured_at bigint, status int, etag string, last_modified bigint, digest string, headers array<struct<name: string, value: string>>"


def brute(rows, canonical):
    out = {}
    for rec, url, kind, at, status, etag, modified, _, headers in rows:
        if kind != "revisit" or status != 304:
            continue
        full = [r for r in rows if r[2] == "response" and r[4] == 200 and url is not None and at is not None and r[3] is not None and r[3] <= at and r[1] is not None and canonical[r[1]] == canonical[url]]
        own = sorted((n.lower(), v) for n, v in headers or [] if n.lower() in warc.PERMITTED)
        if not full:
            out.setdefault(rec, []).append((None, "missing", own))
            continue
        r = max(full, key=lambda x: (x[3], x[0]))
        bare = lambda t: t[2:] if t and t.startswith("W/") else t
        same = bare(etag) == bare(r[5]) if etag and r[5] else modified == r[6] if modified is not None and r[6] is not None else None
        state = "unvalidated" if same is None else "resolved" if same else "mismatch"
        names = {n for n, _ in own}
        merged = sorted([(n.lower(), v) for n, v in r[8] or [] if n.lower() not in names] + own) if state == "resolved" else own
        out.setdefault(rec, []).append((r[0], state, merged))
    return out


def test_revisits_are_resolved_as_by_brute_force(spark):
    rng, rows = random.Random(6), []
    urls = ["http://A.example/x", "https://www.a.example/x/", "a.example/x#f", "http://b.example/?b=1&a=2", "http://b.example/?a=2&b=1&utm_source=q", None]
    for i in range(300):
        revisit = rng.random() < 0.5
        tag = rng.choice([None, '"1"', 'W/"1"', '"2"'])
        heads = rng.choice([None, [], [("ETag", '"9"'), ("Content-Type", "t"), ("Date", str(i))]])
        at = rng.choice([None, *range(40)])
        rows.append((f"r{i:03}", rng.choice(urls), "revisit" if revisit else rng.choice(["response", "response", "request"]), at, 304 if revisit else rng.choice([200, 200, 404]), tag, rng.choice([None, 5, 6]), f"d{i}", heads))
    records = spark.createDataFrame(rows, SCHEMA).withColumn("resolution", F.lit("clash")).withColumn("full", F.lit(1))
    canonical = {r.url: r.c for r in spark.createDataFrame([(u,) for u in urls if u], "url string").select("url", warc.canonical_url("url").alias("c")).collect()}
    assert len(set(canonical.values())) == 2
    want = brute(rows, canonical)
    got = warc.resolve_revisits(records).collect()
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        assert (r.response_id, r.resolution, sorted((h["name"], h["value"]) for h in r.headers)) in want[r.record_id]
        assert (r.response_digest is not None) == (r.resolution == "resolved")


def test_repeated_records_and_empty_tables(spark):
    one = ("r", "http://a.example", "response", 1, 200, '"t"', None, "d", None)
    two = ("v", "http://a.example", "revisit", 1, 304, '"t"', None, None, None)
    got = warc.resolve_revisits(spark.createDataFrame([one, two, two], SCHEMA)).collect()
    assert [(r.record_id, r.response_id, r.resolution) for r in got] == [("v", "r", "resolved")] * 2
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.resolve_revisits(warc.records_of_pages(pages)).count() == 0
