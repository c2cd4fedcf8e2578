"""Operator 10: resolution of not-modified revisit records of WARC archives.

A record is a row (record_id, url, warc_type, captured_at, status, etag, last_modified,
digest, headers). A ``revisit`` of the server-not-modified profile has status 304 and no
payload. It is joined as of its time to the latest earlier full response (type
``response``, status 200) of its canonical URL, their validators are compared, and the
headers that a 304 may update are merged into those of the response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Headers that a 304 carries for the stored response (RFC 9110, 15.4.5); all others are the response's.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't choose what a server sends.
IGNORED_PARAMETERS = ("ref", "fbclid", "gclid", "sessionid")


def canonical_url(url: Column | str) -> Column:
    """Scheme, www. prefix, default port, fragment, ignored parameters and a last slash are left out; the host is in lower case, parameters are sorted."""
    u = F.regexp_replace(F.trim(F.col(url) if isinstance(url, str) else url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?]*)", 1)), r"^www\d*\.|:(?:80|443)$", "")
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(u, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*IGNORED_PARAMETERS) & ~F.lower(p).startswith("utm_")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every not-modified revisit with the response that it stands for.

    Returns record_id, canonical_url, captured_at, response_id, response_digest, resolution,
    headers (array of struct name, value by name, names in lower case). ``resolution`` is
    ``resolved`` where a validator of both is the same (entity tags are compared weakly, and
    decide alone where both have one; else the modification times), ``mismatch`` where it
    differs, ``unvalidated`` where they have none in common, ``missing`` where no response is
    earlier. Only ``resolved`` has the response's digest and headers; others keep the revisit's
    own permitted headers. A response of the same time counts as earlier; of several at one time
    the greatest record_id is taken. Null URLs or times are ``missing``. Repeated records are
    resolved each. An empty table gives an empty one; other columns aren't carried along.
    One shuffle, by URL, which doesn't carry payloads.
    """
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    revisit = (F.col("warc_type") == "revisit") & (F.col("status") == 304)
    wanted = records.filter(full | revisit).select(
        "record_id", canonical_url("url").alias("canonical_url"), "captured_at", "etag", "last_modified", "digest",
        F.transform(F.coalesce("headers", F.expr("cast(array() as array<struct<name: string, value: string>>)")), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))).alias("headers"),
        full.alias("full"),
    )
    response = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    timed = "canonical_url IS NOT NULL AND captured_at IS NOT NULL"
    order = W.partitionBy("canonical_url").orderBy(F.col("captured_at"), F.col("full").desc(), "record_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = wanted.filter(timed).withColumn("r", F.last(F.when(F.col("full"), response), ignorenulls=True).over(order)).filter("NOT full")
    # what has no URL or no time meets no window, as all of it would be one group
    lost = wanted.filter(f"NOT full AND NOT ({timed})").withColumn("r", F.when(F.lit(False), response))
    seen = seen.unionByName(lost)
    known = F.col("r").isNotNull()
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    by_tag = weak(F.col("etag")) == weak(F.col("r.etag"))
    by_time = F.col("last_modified") == F.col("r.last_modified")
    same = F.coalesce(by_tag, by_time)
    state = F.when(~known, "missing").when(same.isNull(), "unvalidated").when(same, "resolved").otherwise("mismatch")
    own = F.filter("headers", lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(own, lambda h: h["name"])
    stored = F.filter("r.headers", lambda h: ~F.array_contains(F.col("names"), h["name"]))
    done = seen.withColumn("state", state).withColumn("own", own).withColumn("names", names)
    resolved = F.col("state") == "resolved"
    return done.select(
        "record_id", "canonical_url", "captured_at",
        F.when(known, F.col("r.record_id")).alias("response_id"),
        F.when(resolved, F.col("r.digest")).alias("response_digest"),
        F.col("state").alias("resolution"),
        F.array_sort(F.when(resolved, F.concat(stored, "own")).otherwise(F.col("own"))).alias("headers"),
    )


# --- records from the table of pages ----------------------------------------


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Each page as two records: the response that it is, and a not-modified revisit of its URL a week later.

    The revisit asks by another spelling of the URL and has the validators of the page: as they
    are, weak, by time only, those of other content, or none, by the remainder of its page_id.
    """
    digest, how = F.md5("html"), F.pmod("page_id", F.lit(5))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 12), F.lit('"'))
    at = F.expr("1700000000 + page_id * 60")
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    response = pages.select(
        F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), "url", F.lit("response").alias("warc_type"), at.alias("captured_at"), F.lit(200).alias("status"),
        F.when(how != 2, tag).alias("etag"), (at - 86400).alias("last_modified"), digest.alias("digest"),
        F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.octet_length("html")), header("Date", at), header("ETag", F.when(how != 2, tag)), header("Cache-Control", F.lit("max-age=60"))).alias("headers"),
    )
    revisit = pages.select(
        F.concat(F.lit("v"), F.col("page_id")).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), F.lit("revisit").alias("warc_type"), (at + 604800).alias("captured_at"), F.lit(304).alias("status"),
        F.when(how == 0, tag).when(how == 1, F.concat(F.lit("W/"), tag)).when(how == 3, F.lit('"changed"')).alias("etag"),
        F.when(how != 4, at - 86400).alias("last_modified"), F.lit(None).cast("string").alias("digest"),
        F.array(header("Date", at + 604800), header("Cache-Control", F.lit("max-age=600")), header("Content-Length", F.lit(0))).alias("headers"),
    )
    return response.unionByName(revisit)


_U = "regexp_replace(trim(url), '#.*$', '')"
_SCHEME = "(?:[A-Za-z][A-Za-z0-9+.-]*://)?"
_HOST = rf"regexp_replace(regexp_replace(lower(regexp_extract({_U}, '^{_SCHEME}([^/?]*)', 1)), '^www\d*\.|:(?:80|443)$', ''), ':(?:80|443)$', '')"
_PATH = f"regexp_replace(regexp_extract({_U}, '^{_SCHEME}[^/?]*([^?]*)', 1), '/+$', '')"
_KEPT = f"list_sort(list_filter(string_split(regexp_extract({_U}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {IGNORED_PARAMETERS} AND NOT starts_with(lower(p), 'utm_')))"
_TAG = "'\"' || substr(md5(html), 1, 12) || '\"'"

WARC_SQL = f"""
WITH p AS (
  SELECT *, {_HOST} || {_PATH} || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END AS canonical_url,
         1700000000 + page_id * 60 AS t, ((page_id % 5) + 5) % 5 AS how, {_TAG} AS tag
  FROM pages),
r AS (
  SELECT 'r' || page_id AS response_id, canonical_url, t, how, CASE WHEN how <> 2 THEN tag END AS etag, t - 86400 AS modified, md5(html) AS digest,
         octet_length(encode(html)) AS size
  FROM p),
v AS (
  SELECT 'v' || page_id AS record_id, canonical_url, t + 604800 AS t,
         CASE WHEN how IN (0, 1) THEN tag WHEN how = 3 THEN '"changed"' END AS etag, CASE WHEN how <> 4 THEN t - 86400 END AS modified
  FROM p),
found AS (
  SELECT v.record_id, v.canonical_url, v.t, v.etag AS vtag, v.modified AS vmodified, r.response_id, r.etag, r.modified, r.digest, r.size
  FROM v LEFT JOIN r ON r.canonical_url = v.canonical_url AND r.t <= v.t
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY r.t DESC NULLS LAST, r.response_id DESC) = 1),
s AS (SELECT *, coalesce(vtag = etag, vmodified = modified) AS same FROM found),
g AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN same IS NULL THEN 'unvalidated' WHEN same THEN 'resolved' ELSE 'mismatch' END AS resolution FROM s)
SELECT record_id, canonical_url, CAST(t AS BIGINT) AS captured_at, response_id, CASE WHEN resolution = 'resolved' THEN digest END AS response_digest, resolution,
       CASE WHEN resolution = 'resolved' THEN
         array_to_string(['cache-control=max-age=600', 'content-length=' || size, 'content-type=text/html', 'date=' || t, 'etag=' || coalesce(etag, '')], chr(10))
       ELSE array_to_string(['cache-control=max-age=600', 'date=' || t], chr(10)) END AS headers
FROM g
"""


def flat_headers(resolved: DataFrame) -> DataFrame:
    """The headers as one text, a line each, for comparison across engines."""
    return resolved.withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit("="), F.coalesce(h["value"], F.lit("")))), "\n"))
