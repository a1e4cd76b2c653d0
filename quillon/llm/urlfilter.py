"""URL filters: prefix rules as intervals of reversed-host keys, matched by a sorted sweep.

A key is the host's labels from the top down, each followed by a comma, then the path:
``com,example,www,/a/b``.  All keys under a prefix are neighbours in byte order, so a
rule is an interval, intervals nest or are apart, and one pass over rules and URLs in
key order needs only a stack of the rules now open; its top is the most specific.
URLs are range-partitioned by key; a rule goes to every partition that its interval meets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import even_slots, type_of

ROWS = 2_000_000


def url_key(url: Column) -> Column:
    """Reversed-host key; scheme, credentials, port, fragment and query are not part of it; null for null."""
    u = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://|[#?].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(u, r"^([^/]*)", 1), r"^.*@|:[0-9]*$|\.$", ""))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(","), F.regexp_replace(u, r"^[^/]*", ""))


def apply_rules(urls: DataFrame, rules: DataFrame, rows: int = ROWS) -> DataFrame:
    """(page_id, url, rule_id, action, depth) of every URL under a rule: the most specific rule, and how many hold.

    ``urls``: page_id, url; ``rules``: rule_id, prefix (a key prefix, as ``url_key`` makes
    them), action.  Rules whose prefix is a byte prefix of the key hold; of rules with the
    same prefix only that of the smallest rule_id does.  An empty prefix holds for all.
    Rows with a null id, url or prefix match nothing; a null action stays null; an empty URL
    has the key ``,``; keys of any length are compared whole; repeated rows give a row each;
    without rules or URLs the result is empty; other columns are ignored.  Ids may be of any
    type that can be ordered.  ``rows`` is the aim for the URLs of a partition; the rules
    over one key, which nest, are the stack of its sweep.
    """
    spark, page_type, rule_type = urls.sparkSession, type_of(urls, "page_id"), type_of(rules, "rule_id")
    u = urls.where("page_id is not null and url is not null").select(F.col("page_id").alias("page"), F.lit(None).cast(type_of(rules, "rule_id")).alias("rule"), "url", url_key(F.col("url")).alias("key"))
    r = rules.where("rule_id is not null and prefix is not null").select(F.lit(None).cast(type_of(urls, "page_id")).alias("page"), F.col("rule_id").alias("rule"), F.col("prefix").alias("key"), F.col("action").cast("string").alias("action"))
    n = u.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows))
    cuts: list[bytes] = []  # parts - 1 keys, of a sample: they set balance, never the result
    if parts > 1 and n:
        sample = u.select("key").sample(min(1.0, 50 * parts / n), seed=7).collect()  # about 50 keys a partition
        keys = sorted(x["key"].encode() for x in sample)
        cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    slots = even_slots(spark, len(cuts) + 1)
    held = spark.sparkContext.broadcast((cuts, slots))  # a key and a number a partition

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, slots = held.value
        for b in batches:
            keys = [k.encode() for k in b.column("key").to_pylist()]
            first = [bisect_right(cuts, k) for k in keys]
            kinds = b.column("kind").to_pylist()
            last = [f if kind else max(f, bisect_left(cuts, k + b"\xff") if k else len(cuts)) for f, k, kind in zip(first, keys, kinds, strict=True)]
            at = [i for i, (f, e) in enumerate(zip(first, last, strict=True)) for _ in range(f, e + 1)]
            part = [slots[p] for f, e in zip(first, last, strict=True) for p in range(f, e + 1)]
            t = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *t.columns], ["part", *t.schema.names])

    events = u.select(F.lit(1).alias("kind"), "page", "rule", "url", "key", F.lit(None).cast("string").alias("action")).union(r.select(F.lit(0).alias("kind"), "page", "rule", F.lit(None).cast("string").alias("url"), "key", "action"))
    placed = events.mapInArrow(place, f"part long, kind int, page {page_type}, rule {rule_type}, url string, key string, action string")
    item = to_arrow_type(urls.schema["page_id"].dataType), to_arrow_type(rules.schema["rule_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[tuple[bytes, object, str]] = []
        part = None
        for b in batches:
            out: list[tuple] = []
            for p, key, kind, page, rule, url, action in zip(*(b.column(c).to_pylist() for c in ("part", "key", "kind", "page", "rule", "url", "action")), strict=True):
                if p != part:
                    part, state = p, []
                k = key.encode()
                while state and not k.startswith(state[-1][0]):
                    state.pop()
                if kind == 0:
                    if not state or state[-1][0] != k:
                        state.append((k, rule, action))
                elif state:
                    out.append((page, url, state[-1][1], state[-1][2], len(state)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (item[0], pa.string(), item[1], pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "url", "rule_id", "action", "depth"])

    return placed.repartition(len(cuts) + 1, "part").sortWithinPartitions("part", "key", "kind", "rule").mapInArrow(run, f"page_id {page_type}, url string, rule_id {rule_type}, action string, depth int")


def rules_of_pages(pages: DataFrame) -> DataFrame:
    """Nested rules from the hosts of a crawl: each registered domain is reviewed, its ``m`` host blocked, its Spanish pages and those below /en/1 allowed."""
    key = pages.where("url is not null").select(url_key(F.col("url")).alias("k"))
    domain = key.select(F.regexp_extract("k", r"^([^,/]*,[^,/]*,[^,/]*,)", 1).alias("d"), F.regexp_extract("k", r"^([^/]*)", 1).alias("h")).where("d <> ''").distinct()
    forms = F.array(
        F.struct(F.col("d").alias("prefix"), F.lit("review").alias("action")),
        F.when(F.col("h") == F.concat("d", F.lit("m,")), F.struct(F.col("h").alias("prefix"), F.lit("block").alias("action"))),
        F.struct(F.concat("h", F.lit("/es/")).alias("prefix"), F.lit("allow").alias("action")),
        F.struct(F.concat("h", F.lit("/en/1")).alias("prefix"), F.lit("allow").alias("action")),
    )
    flat = domain.select(F.explode(forms).alias("f")).where("f is not null").select("f.*").distinct()
    return flat.select(F.conv(F.substring(F.md5(F.concat("prefix", F.lit(" "), "action")), 1, 12), 16, 10).cast("long").alias("rule_id"), "prefix", "action")


def op2(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return apply_rules(pages, rules_of_pages(pages))


KEY = r"""concat(array_to_string(list_reverse(string_split(lower(regexp_replace(regexp_extract(u, '^([^/]*)', 1), '^.*@|:[0-9]*$|\.$', '', 'g')), '.')), ','), ',', regexp_replace(u, '^[^/]*', ''))"""
ORACLE = rf"""
WITH p AS (SELECT page_id, url, regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://|[#?].*$', '', 'g') AS u FROM pages WHERE page_id IS NOT NULL AND url IS NOT NULL),
k AS (SELECT page_id, url, {KEY} AS key FROM p),
d AS (SELECT DISTINCT regexp_extract(key, '^([^,/]*,[^,/]*,[^,/]*,)', 1) AS d, regexp_extract(key, '^([^/]*)', 1) AS h FROM k),
f AS (SELECT d AS prefix, 'review' AS action FROM d WHERE d <> '' UNION SELECT h, 'block' FROM d WHERE d <> '' AND h = d || 'm,'
      UNION SELECT h || '/es/', 'allow' FROM d WHERE d <> '' UNION SELECT h || '/en/1', 'allow' FROM d WHERE d <> ''),
r AS (SELECT CAST(('0x' || substr(md5(prefix || ' ' || action), 1, 12)) AS BIGINT) AS rule_id, prefix, action FROM f),
m AS (SELECT page_id, url, rule_id, action, length(prefix) AS n FROM k JOIN r ON starts_with(key, prefix))
SELECT page_id, url, rule_id, action, CAST(depth AS INTEGER) AS depth
FROM (SELECT *, count(*) OVER (PARTITION BY page_id) AS depth, row_number() OVER (PARTITION BY page_id ORDER BY n DESC) AS k FROM m) WHERE k = 1
"""
