"""WARC: resolve not-modified revisits against the latest earlier full response of their URL.

Records of one canonical URL and hour are ordered by capture time and the last full
response is carried forward; what was last before the hour comes from a table with a row
for each URL and hour.  So a URL that holds a large part of all records is spread over
its hours, each record is shuffled once, and bodies are not shuffled at all (results
point to the record that holds the body).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS = 1.0
#: Query parameters that do not select content.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid"
#: Headers of the stored response that a 304 must not replace: they describe the body or the connection.
KEPT = "connection content-encoding content-length content-md5 content-range content-type keep-alive proxy-authenticate te trailer transfer-encoding upgrade".split()


def canonical_url(url: Column) -> Column:
    """Scheme, fragment, default port, ``www.``, tracking parameters and trailing slashes removed; host in lower case; null for null."""
    u = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    u = F.regexp_replace(u, rf"([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+", "$1")
    u = F.regexp_replace(u, r"[?&/]+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^([^/?]*)", 1)), r"^www\.|:(?:80|443)$", "")
    return F.concat(host, F.regexp_replace(u, r"^[^/?]*", ""))


def resolve(records: DataFrame, hours: float = HOURS) -> DataFrame:
    """Each not-modified revisit with the full response that it stands for.

    ``records``: record_id, url, ts, status (200, 304, ...), headers (map of lower-case
    names).  A full response has status 200; a revisit has 304.  Result: record_id,
    target_id (null unless resolved), outcome, headers (merged; null unless resolved).

    outcome is ``resolved``, ``no_response`` (none of this canonical URL was captured
    before it) or ``changed`` (a validator of the revisit, ``etag`` compared weakly or
    ``last-modified``, differs from the response's).  A strong or weak etag in both decides
    alone; else last-modified in both; a revisit with neither counts as resolved by time.
    Headers are the response's, replaced and extended by the revisit's save those in
    ``KEPT``.  Equal times are ordered by record_id, a response before a revisit.
    Records with a null record_id, url or ts are left out; a null status is neither kind,
    null headers are none.  Empty and very long URLs are keys like others.  Repeated
    revisits give a row each; an empty table gives an empty result; other columns are
    ignored.  ``hours`` is the span of capture times that one task orders.
    """
    r = records.where("record_id is not null and url is not null and ts is not null").select(
        "record_id", canonical_url(F.col("url")).alias("key"), "ts", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / int(hours * 3_600_000_000)).alias("span"), F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")
    )
    full = F.when(F.col("status") == 200, F.struct("record_id", "headers"))
    r = r.where("status in (200, 304)")
    spans = r.groupBy("key", "span").agg(F.max_by(full, F.when(F.col("status") == 200, F.struct("ts", "record_id"))).alias("full"))
    sooner = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "span", F.last("full", ignorenulls=True).over(sooner).alias("carried"))
    past = Window.partitionBy("key", "span").orderBy("ts", F.when(F.col("status") == 200, 0).otherwise(1), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    got = r.withColumn("inside", F.last(full, ignorenulls=True).over(past)).where("status = 304").join(carried, ["key", "span"]).withColumn("full", F.coalesce("inside", "carried"))
    mine, its = F.col("headers"), F.col("full.headers")
    weak = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    same = F.coalesce(weak(mine) == weak(its), F.element_at(mine, "last-modified") == F.element_at(its, "last-modified"), F.lit(True))
    outcome = F.when(F.col("full").isNull(), "no_response").when(same, "resolved").otherwise("changed")
    merged = F.map_concat(
        F.map_filter(its, lambda k, _: k.isin(KEPT) | ~F.map_contains_key(mine, k)),
        F.map_filter(mine, lambda k, _: ~k.isin(KEPT)),
    )
    ok = F.col("outcome") == "resolved"
    return got.withColumn("outcome", outcome).select("record_id", F.when(ok, F.col("full.record_id")).alias("target_id"), "outcome", F.when(ok, merged).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history for the table of pages, which has no headers of its own.

    Every page is a full response, a minute after the page before it, whose etag is the
    digest of its body; and is asked for again a day later, under the URL as it then
    stands, with a 304 that repeats the etag and brings new caching headers.
    """
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    both = pages.where("page_id is not null and url is not null").select("page_id", "url", at.alias("at"), F.md5(F.coalesce("html", F.lit(""))).alias("etag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("n"))
    text = F.lit
    first = F.map_from_arrays(F.array(*map(text, ("etag", "content-type", "content-length", "cache-control", "date"))), F.array("etag", text("text/html"), "n", text("max-age=60"), stamp(F.col("at"))))
    later = F.map_from_arrays(F.array(*map(text, ("etag", "content-length", "cache-control", "date", "age"))), F.array(F.concat(text("W/"), "etag"), text("0"), text("max-age=3600"), stamp(F.col("at") + F.expr("interval 1 day")), text("0")))
    kinds = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("at").alias("ts"), F.lit(200).alias("status"), first.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (F.col("at") + F.expr("interval 1 day")).alias("ts"), F.lit(304).alias("status"), later.alias("headers")),
    )
    return both.select("url", F.explode(kinds).alias("r")).select("url", "r.*")


def op1(spark, sf_dir: str) -> DataFrame:
    out = resolve(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.withColumn("headers", F.when(F.col("headers").isNotNull(), F.array_join(lines, "\n")))


CANONICAL = rf"""concat(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\.|:(?:80|443)$', ''), regexp_replace(u, '^[^/?]*', ''))"""
CLEANED = rf"""regexp_replace(regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g'), '([?&])(?:(?:{TRACKING})=[^&]*(?:&|$))+', '\1', 'g'), '[?&/]+$', '')"""
ORACLE = rf"""
WITH p AS (SELECT page_id, {CLEANED} AS u, md5(coalesce(html, '')) AS etag, length(coalesce(html, '')) AS n, to_timestamp(1704067200 + page_id * 60)::TIMESTAMP AS t
           FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
r AS (SELECT *, {CANONICAL} AS key FROM p),
j AS (SELECT a.page_id, a.etag, a.t, b.page_id AS b_id, b.etag AS b_etag, b.n AS b_n
      FROM r a JOIN r b ON a.key = b.key AND b.t <= a.t + INTERVAL 1 DAY
      QUALIFY row_number() OVER (PARTITION BY a.page_id ORDER BY b.t DESC, b.page_id DESC) = 1)
SELECT page_id * 2 + 1 AS record_id, CASE WHEN etag = b_etag THEN b_id * 2 END AS target_id, CASE WHEN etag = b_etag THEN 'resolved' ELSE 'changed' END AS outcome,
       CASE WHEN etag = b_etag THEN concat('age: 0', chr(10), 'cache-control: max-age=3600', chr(10), 'content-length: ', b_n, chr(10), 'content-type: text/html', chr(10),
            'date: ', strftime(t + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S'), chr(10), 'etag: W/', etag) END AS headers
FROM j
"""
