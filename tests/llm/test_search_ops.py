import datetime as dt
import random
import unicodedata
from collections import Counter
from math import log

import numpy as np
import pytest
import tiktoken

from quillon.llm import bpe, decontam, topk, urlfilter, warc
from quillon.llm.queries import ORACLES, QUERIES

from ..oracle import same
from .conftest import SCHEMA, prose, row

FOLDER = "/root/testdata/sf0.001"


def test_queries_equal_sql(spark):
    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, FOLDER), sql, FOLDER)


def test_search_by_force(spark):
    rnd = random.Random(6)
    docs = [(i, prose(rnd, rnd.randrange(0, 80))) for i in range(300)] + [(1000 + i, "same words here") for i in range(15)]
    asks = [(i, prose(rnd, rnd.randrange(1, 12))) for i in range(20)] + [(50, "same here"), (51, ""), (52, "unknownword")]
    split = lambda t: t.lower().replace(".", " ").replace(",", " ").split()
    tf = {i: Counter(split(t)) for i, t in docs}
    dl = {i: sum(c.values()) for i, c in tf.items()}
    n, avg = len(docs), sum(dl.values()) / len(docs)
    df = Counter(w for c in tf.values() for w in c)
    want = set()
    for item, t in asks:
        score = {}
        for w, m in Counter(split(t)).items():
            for i, c in tf.items():
                if c[w]:
                    score[i] = score.get(i, 0) + m * log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * dl[i] / avg))
        best = sorted((-round(s, 6), i) for i, s in score.items())[:10]
        want |= {(item, i, k) for k, (_, i) in enumerate(best, 1)}
    got = topk.search(spark.createDataFrame([row(*d) for d in docs], SCHEMA), spark.createDataFrame(asks, "item_id long, text string"))
    assert {(r["item_id"], r["doc_id"], r["rank"]) for r in got.collect()} == want
    sharded = topk.search(spark.createDataFrame([row(*d) for d in docs], SCHEMA), spark.createDataFrame(asks, "item_id long, text string"), shard_bytes=300)
    assert {(r["item_id"], r["doc_id"], r["rank"]) for r in sharded.collect()} == want


def items_and_docs():
    rnd = random.Random(9)
    items = [(i, prose(rnd, rnd.choice([6, 12, 30, 60])) + ". " + prose(rnd, 8)) for i in range(40)]
    docs = []
    for i in range(80):
        t = prose(rnd, rnd.randrange(0, 300))
        docs.append((i, t + " " + items[i % 40][1].upper() + " " + prose(rnd, 40) if i % 2 else t))
    return items, docs


def test_leaks_are_found_by_any_sharding(spark):
    items, docs = items_and_docs()
    d = spark.createDataFrame([row(*x) for x in docs], SCHEMA)
    for size in (1 << 24, 2000):
        got = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(d, spark.createDataFrame(items, "item_id long, text string"), shard_bytes=size).collect()}
        assert got == {(i, i % 40) for i in range(80) if i % 2}


def test_scores_do_not_depend_on_the_sharding(spark):
    rnd = random.Random(13)
    items = []
    for i in range(30):
        twice = prose(rnd, 4)
        items.append((i, f"{twice} {prose(rnd, rnd.choice([2, 10, 80]))} {twice}? {prose(rnd, 9)} {twice}"))
    items += [(100, "!!"), (101, "...")]  # without a word
    docs = [(i, " ".join([prose(rnd, 20), *t.split()[:-6], *t.split()[-5:], prose(rnd, 20)])) for i, t in items[:30]]  # one word less
    d, b = spark.createDataFrame([row(*x) for x in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({tuple(r) for r in decontam.leaks(d, b, shard_bytes=size).collect()} for size in (1 << 24, 2000))
    assert len(one) >= 25 and one == many


def test_leaks_with_one_edited_word(spark):
    rnd = random.Random(12)
    items = [(i, f"{prose(rnd, 12)}? {prose(rnd, 7)}") for i in range(20)]
    docs, want = [], set()
    for i, t in items:
        words = t.split()
        for k in range(len(words)):
            docs.append((len(docs), " ".join([prose(rnd, 30), *words[:k], "replaced", *words[k + 1 :], prose(rnd, 30)])))
            want.add((docs[-1][0], i))
        docs.append((len(docs), " ".join([prose(rnd, 30), *words[:12], prose(rnd, 30)])))  # the question alone is no leak
    got = decontam.leaks(spark.createDataFrame([row(*x) for x in docs], SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_block_max_bounds_lose_nothing():
    items, docs = items_and_docs()
    ix = decontam.build(items)
    for _, t in docs[:40]:
        h = np.unique(decontam.hash_words([t])[0])
        at = decontam.member(h, ix.terms, ix.sieve)
        terms = at[at >= 0]
        full = np.zeros(len(ix.ids))
        for k in terms:
            full[ix.item[ix.ptr[k] : ix.ptr[k + 1]]] += ix.impact[ix.ptr[k] : ix.ptr[k + 1]]
        for theta in (0.2, 0.4, 0.6):
            assert {i for i, _ in decontam.retrieve(ix, terms, theta)} == set(np.flatnonzero(full >= theta))


def test_wand_reads_few_postings(monkeypatch):
    """Blocks that cannot reach the threshold are passed over, and the result stays whole."""
    rnd = random.Random(31)
    items = [(i, prose(rnd, 12)) for i in range(3000)]
    ix = decontam.build(items)
    scored = []

    class Seen(np.ndarray):
        def __getitem__(self, k):
            if isinstance(k, int):
                scored.append(k)
            return np.asarray(self)[k]

    ix.impact = ix.impact.view(Seen)
    h = np.unique(decontam.hash_words([items[5][1] + " " + prose(rnd, 60)])[0])
    at = decontam.member(h, ix.terms, ix.sieve)
    terms = at[at >= 0]
    full = np.zeros(len(ix.ids))
    for k in terms:
        full[ix.item[ix.ptr[k] : ix.ptr[k + 1]]] += np.asarray(ix.impact)[ix.ptr[k] : ix.ptr[k + 1]]
    got = decontam.retrieve(ix, terms, 0.6)
    assert {i for i, _ in got} == set(np.flatnonzero(full >= 0.6)) and all(abs(s - full[i]) < 1e-9 for i, s in got)
    assert 0 < len(scored) < (ix.ptr[terms + 1] - ix.ptr[terms]).sum() / 4


def test_best_match_is_one_match(spark):
    """The overlaps of a row belong to the match of its score."""
    rnd = random.Random(33)
    q, a = prose(rnd, 20).split(), prose(rnd, 10).split()
    items = spark.createDataFrame([(1, " ".join(q) + "? " + " ".join(a))], "item_id long, text string")
    half = [" ".join([*q[:14], *["x"] * 6, *a]), " ".join([*q, *a[:7], "y", "y", "y"])]
    rows = [row(1, half[0]), row(1, half[1])]
    one = {tuple(r)[2:] for k in (0, 1) for r in decontam.leaks(spark.createDataFrame(rows[k : k + 1], SCHEMA), items).collect()}
    both = decontam.leaks(spark.createDataFrame(rows, SCHEMA), items).collect()
    assert len(one) == 2 and [tuple(r)[2:] for r in both] == [max(one)]


def test_leaks_of_awkward_rows(spark, awkward, nothing):
    base = awkward.where("doc_id = 1").collect()[0]["text"]
    items = spark.createDataFrame([(1, " ".join(base.split()[10:50])), (2, ""), (3, None), (None, "x"), (4, "!!")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(awkward, items).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert decontam.leaks(nothing, items).count() == 0 and decontam.leaks(awkward, items.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in decontam.without_leaks(awkward, items).collect()) == [4, 5, 6, 7, 8, 9, 10]
    assert decontam.without_leaks(awkward, items, shard_bytes=10).count() == 7 and decontam.without_leaks(nothing, items).count() == 0
    assert topk.search(awkward, items).count() > 0 and topk.search(nothing, items).count() == 0


def test_bpe_equals_the_library(spark, awkward, nothing):
    import public_tokenizers as p

    ranks = bpe.read_ranks(bpe.default_vocabulary())
    own, lib = bpe.Bpe(ranks), tiktoken.Encoding("x", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    old = [chr(c) for c in range(0x20, 0x2FFF) if unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]  # newer signs: the libraries' Unicode versions differ
    signs = rnd.choices(old, k=150) + list(" \n\t'aeinst .") * 30
    texts = ["".join(rnd.choices(signs, k=rnd.randrange(60))) for _ in range(1500)] + ["", "a" * 3000, " " * 500, "it's  we'll\n\n x"]
    for t in texts:
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t) and own.decode(ids) == t
    got = {r["doc_id"]: r for r in bpe.encode(awkward).collect()}
    assert bpe.encode(awkward).count() == awkward.count() == bpe.decode(bpe.encode(awkward)).count()
    assert got[6]["ids"] is None and got[5]["ids"] == [] and all(r["exact"] for i, r in got.items() if i != 6)
    back = bpe.decode(bpe.encode(awkward))
    assert Counter((r[0], r[1]) for r in back.collect()) == Counter((r[0], r[1]) for r in awkward.select("doc_id", "text").collect())
    assert bpe.encode(nothing).count() == 0 and bpe.decode(bpe.encode(nothing)).count() == 0
    odd = spark.createDataFrame([(1, [own.encode("a")[0], 10**9, None]), (2, []), (3, None), (4, own.encode("é")[:1]), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, bpe.decode(odd).collect())) == [(1, "a\ufffd\ufffd"), (2, ""), (2, ""), (3, None), (4, "é" if len(own.encode("é")) == 1 else "\ufffd")]


def test_vocabularies_of_one_name(spark, tmp_path):
    import base64

    for k, extra in enumerate((b"ab", b"bc")):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "v.tiktoken").write_text("".join(f"{base64.b64encode(b).decode()} {i}\n" for i, b in enumerate([*(bytes([x]) for x in range(256)), extra])))
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [bpe.encode(docs, str(tmp_path / k / "v.tiktoken")).collect()[0]["ids"] for k in "01"] == [[256, 99], [97, 256]]
    with pytest.raises(ValueError, match="1 single bytes"):
        bpe.Bpe({bytes([x]): x for x in range(255)})


def test_merges_equal_a_merge_loop():
    """Any vocabulary made by merging: the dynamic program against merging by rank."""
    for seed in range(8):
        rnd = random.Random(seed)
        ranks = {bytes([x]): x for x in range(256)}
        pool = [b"a", b"b", b"c"]
        while len(pool) < 40:
            new = rnd.choice(pool) + rnd.choice(pool)
            if new not in ranks and len(new) < 9 and len(bpe.Bpe._merge_below(new, len(ranks), ranks)) == 2:  # what training could have made
                ranks[new] = len(ranks)
                pool.append(new)
        own = bpe.Bpe(ranks, r"(?s).+")
        for _ in range(300):
            text = "".join(rnd.choices("abc", k=rnd.randrange(1, 14)))
            parts = [bytes([x]) for x in text.encode()]
            while len(parts) > 1:
                r, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 40), k) for k in range(len(parts) - 1))
                if r == 1 << 40:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert own.encode(text) == [ranks[p] for p in parts]


def test_revisits(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [
        (1, "http://www.a.com/x?utm_source=f", t(1), 200, {"etag": '"1"', "content-length": "9", "date": "d1"}),
        (2, "https://a.com/x/", t(2), 304, {"etag": 'W/"1"', "content-length": "0", "date": "d2", "age": "5"}),
        (3, "a.com/x#top", t(3), 200, {"etag": '"2"'}),
        (4, "http://a.com/x", t(4), 304, {"etag": '"1"'}),
        (5, "http://b.com/", t(5), 304, {"etag": '"1"'}),
        (6, "http://a.com/x", t(6), 304, None),
        (7, "http://a.com/x", None, 304, {}),
        (8, None, t(6), 304, {}),
        (9, "http://a.com/x", t(7), None, None),
        (10, "http://a.com/x", t(0), 304, {"etag": '"1"'}),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "record_id long, url string, ts timestamp, status int, headers map<string,string>, key string")
    got = {r["record_id"]: r for r in warc.resolve(df).collect()}
    assert {i: (r["target_id"], r["outcome"]) for i, r in got.items()} == {2: (1, "resolved"), 4: (None, "changed"), 5: (None, "no_response"), 6: (3, "resolved"), 10: (None, "no_response")}
    assert got[2]["headers"] == {"etag": 'W/"1"', "content-length": "9", "date": "d2", "age": "5"} and got[6]["headers"] == {"etag": '"2"'}
    assert warc.resolve(df.limit(0)).count() == 0


@pytest.mark.parametrize("hours", [0.5, 1.0, 1e6])
def test_revisits_by_force(spark, hours):
    """A URL that holds most records, over spans of any length."""
    rnd = random.Random(17)
    rows = []
    for i in range(400):
        url = "http://hot.com/" if rnd.random() < 0.7 else f"http://h{rnd.randrange(9)}.com/" + "x" * rnd.choice([0, 5000])
        rows.append((i, url, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(0, 2000)), rnd.choice([200, 304, 304, 404, None]), {"etag": f'"{rnd.randrange(3)}"'}))
    rows.append((900, "", dt.datetime(2024, 1, 1), 304, {}))
    want = {}
    for i, url, t, status, h in rows:
        if status == 304:
            past = [(o[2], o[0], o) for o in rows if o[3] == 200 and o[1] == url and o[2] <= t]
            full = max(past, key=lambda x: x[:2])[2] if past else None
            outcome = "no_response" if full is None else "resolved" if full[4].get("etag") == h.get("etag") or "etag" not in h else "changed"
            want[i] = (full[0] if outcome == "resolved" else None, outcome)
    df = spark.createDataFrame(rows, "record_id long, url string, ts timestamp, status int, headers map<string,string>")
    got = warc.resolve(df, hours).collect()
    assert {r["record_id"]: (r["target_id"], r["outcome"]) for r in got} == want and len(got) == len(want)


def test_url_rules_by_force(spark):
    rnd = random.Random(11)
    hosts = ["com,a,", "com,a,m,", "com,b,", "org,a,"]
    paths = ["", "/", "/x", "/x/y", "/xy", "/x/y/z"]
    rules = [(i, rnd.choice(hosts) + rnd.choice(paths), rnd.choice(["allow", "block", None])) for i in range(14)] + [(90, "com,", "review"), (91, None, "x"), (None, "com", "x")]
    urls = [(i, "http://" + ".".join(reversed(rnd.choice(hosts)[:-1].split(","))) + rnd.choice(paths) + rnd.choice(["", "?q", "#f"]), 5) for i in range(300)] + [(400, None, 1), (None, "http://a.com/", 1), (401, "", 1), (402, "http://a.com/x/" + "y" * 50_000, 1), (7, "http://a.com/x", 1)]
    got = urlfilter.apply_rules(spark.createDataFrame(urls, "page_id long, url string, depth int"), spark.createDataFrame(rules, "rule_id long, prefix string, action string"), rows=20)
    want = Counter()
    key = lambda u: ",".join(reversed(u.split("//")[-1].split("?")[0].split("#")[0].split("/")[0].split("."))) + "," + "".join("/" + x for x in u.split("//")[-1].split("?")[0].split("#")[0].split("/")[1:])
    first = {}
    for i, p, act in sorted((r for r in rules if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        first.setdefault(p, (i, act))
    for i, u, _ in urls:
        if i is None or u is None:
            continue
        on = [(len(p), *v) for p, v in first.items() if key(u).startswith(p)]
        if on:
            best = max(on, key=lambda x: x[0])
            want[i, best[1], best[2], len(on)] += 1
    assert Counter((r["page_id"], r["rule_id"], r["action"], r["depth"]) for r in got.collect()) == want
    assert urlfilter.apply_rules(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(rules, "rule_id long, prefix string, action string")).count() == 0
