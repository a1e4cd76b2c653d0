"""The trained operators' queries against plain Python over every row."""

import ipaddress
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import pii, quality, toxicity
from quillon.llm.queries import QUERIES

from .conftest import SCHEMA, prose, row

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[0-9A-Za-z_\u00c0-\u1fff\u2c00-\u2fff\u3040-\U0010ffff]+")


def rows_of(spark, table):
    return [r.asDict() for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").collect()]


def statistics(text):
    """What the classifier sees of one text, in plain Python."""
    w = WORD.findall(text.lower())
    raw, n = text.encode(), max(1, len(w))
    size = [len(x.encode()) for x in w]
    pairs = list(zip(w, w[1:], strict=False))
    kinds = [
        lambda c: 65 <= c <= 90, lambda c: 97 <= c <= 122, lambda c: 48 <= c <= 57, lambda c: c in b" \t", lambda c: c == 10, lambda c: c in b".?",
        lambda c: c in b",;", lambda c: c == 124, lambda c: c == 33, None, lambda c: c >= 128,
    ]
    count = [0 if k is None else sum(map(k, raw)) for k in kinds]
    count[9] = len(raw) - sum(count)
    head = [
        math.log1p(len(w)), sum(size) / n, sum(s <= 3 for s in size) / n, sum(s >= 12 for s in size) / n, len(set(w)) / n, max(Counter(w).values(), default=0) / n,
        sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(1, len(pairs)), len(w) / max(1, count[5]),
    ]
    return head + [c / max(1, len(raw)) for c in count]


def boosted(x, y, trees, depth, bins, rate, least, ridge):
    """Trees as nested tuples, each split found by trying every feature and cut."""
    cuts = [sorted({np.float32(v) for v in np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")}) for f in range(x.shape[1])]
    total = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    out = [total[0]]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)

        def grow(at, left, g=g, h=h):
            best = (1e-9, None)
            if left:
                ga, ha = g[at].sum(), h[at].sum()
                for f, each in enumerate(cuts):
                    for cut in each:
                        low = at[x[at, f] <= cut]
                        if len(low) >= least and len(at) - len(low) >= least:
                            gl, hl = g[low].sum(), h[low].sum()
                            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                            if gain > best[0] + 1e-9:
                                best = (gain, (f, cut))
            if best[1] is None:
                return rate * g[at].sum() / (h[at].sum() + ridge)
            f, cut = best[1]
            return (f, cut, grow(at[x[at, f] <= cut], left - 1), grow(at[x[at, f] > cut], left - 1))

        tree = grow(np.arange(len(y)), depth)
        out.append(tree)
        total = total + np.array([walk(tree, r) for r in x])
    return out


def walk(tree, r):
    while isinstance(tree, tuple):
        tree = tree[2] if r[tree[0]] <= tree[1] else tree[3]
    return tree


def test_quality_query_by_force(spark, monkeypatch):
    monkeypatch.setattr(quality.fit, "__defaults__", (4, 3))
    docs, labels = rows_of(spark, "documents"), rows_of(spark, "labels")
    x = {d["doc_id"]: np.array(statistics(d["text"]), np.float32) for d in docs}
    have = {r["doc_id"]: float(r["quality"]) for r in labels if r["doc_id"] in x and r["quality"] is not None}
    ids = sorted(have)
    base, *trees = boosted(np.array([x[i] for i in ids]), np.array([have[i] for i in ids]), 4, 3, quality.BINS, quality.RATE, quality.LEAST, quality.RIDGE)
    want = {i: 1 / (1 + math.exp(-(base + sum(walk(t, v) for t in trees)))) for i, v in x.items()}
    got = QUERIES["op4_quality"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    near = [abs(r["quality"] - want[r["doc_id"]]) < 1e-4 for r in got]
    assert sum(near) >= 0.99 * len(near)  # splits of equal gain may fall differently
    assert all(r["kept"] == (r["quality"] >= 0.5) for r in got)


def test_toxicity_query_by_force(spark):
    docs, labels = rows_of(spark, "documents"), rows_of(spark, "labels")

    def features(text):
        w = WORD.findall(text.lower())
        return {("w", x) for x in w} | {(n, x.encode()[:n]) for x in w for n in (4, 5) if len(x.encode()) > n}

    seen = {d["doc_id"]: features(d["text"]) for d in docs}
    y = {r["doc_id"]: float(r["toxic"]) for r in labels if r["doc_id"] in seen and r["toxic"] is not None}
    ids = sorted(y)
    place = {f: k for k, f in enumerate(sorted({f for i in ids for f in seen[i]}, key=str))}
    assert not any(toxicity.swaps(d["text"]) for d in docs if d["doc_id"] in y)  # these tables name no group
    x, t = np.zeros((len(ids), len(place))), np.array([y[i] for i in ids])
    for k, i in enumerate(ids):
        x[k, [place[f] for f in seen[i]]] = 1
    share = np.where(t > 0, 0.5 / t.sum(), 0.5 / (len(t) - t.sum()))
    n1, n0 = t.sum(), len(t) - t.sum()
    p = x.mean(0)
    z = (x[t == 1].sum(0) / n1 - x[t == 0].sum(0) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    scale = np.minimum(1, (z / toxicity.SURE) ** 2)
    w, bias, m1, m2 = np.zeros(len(place)), 0.0, 0.0, 0.0
    for k in range(1, toxicity.STEPS + 1):
        r = (1 / (1 + np.exp(-(bias + x @ (scale * w)).clip(-50, 50))) - t) * share
        g = np.append(scale * (x.T @ r) + toxicity.RIDGE * w, r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    w = w * scale
    got = QUERIES["op6_toxicity"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        want = 1 / (1 + math.exp(-(bias + sum(w[place[f]] for f in seen[r["doc_id"]] if f in place))))
        assert abs(r["toxicity"] - want) < 2e-3 and (abs(want - 0.5) < 2e-3 or r["toxic"] == (want >= 0.5))


def test_pii_query_by_force(spark):
    """Candidates one by one, EM over every candidate rather than over counted patterns."""
    found = []
    for d in rows_of(spark, "documents"):
        found += [(d["doc_id"], s, e, pii.votes(d["text"], s, e)) for s, e in pii.find(d["text"])]
    n, k = len(pii.LABELERS), len(pii.KINDS)
    post = []
    for *_, p in found:
        s = [0.01 + sum(v == c for v in p[:n]) * (1 if c else 0.4 / (1 + sum(v > 0 for v in p[:n]))) for c in range(k)]
        post.append([v / sum(s) for v in s])
    for _ in range(50):
        prior = [(sum(q[c] for q in post) + 1) / (len(post) + k) for c in range(k)]
        conf = [[[0.1 + pii.RIGHT * (v == c and any(p[j] == c for *_, p in found)) for v in range(k)] + [0.1] for c in range(k)] for j in range(n)]
        for (*_, p), q in zip(found, post, strict=True):
            for j in range(n):
                for c in range(k):
                    conf[j][c][p[j]] += q[c]
        conf = [[[v / sum(r) for v in r] for r in each] for each in conf]
        new = []
        for *_, p in found:
            s = [math.log(prior[c]) + sum(math.log(conf[j][c][p[j]]) for j in range(n)) for c in range(k)]
            s = [math.exp(v - max(s)) for v in s]
            new.append([v / sum(s) for v in s])
        done = max(abs(a - b) for x, y in zip(new, post, strict=True) for a, b in zip(x, y, strict=True)) < 1e-6
        post = new
        if done:
            break
    counted = Counter(tuple(p) for *_, p in found)
    patterns = sorted(counted)
    own = {tuple(p): q for (*_, p), q in zip(found, post, strict=True)}
    _, _, lib = pii.reliabilities(np.array(patterns)[:, :n], np.array([counted[p] for p in patterns], float))
    assert np.abs(lib - np.array([own[p] for p in patterns])).max() < 1e-4
    theta = pii.train(np.array(patterns), np.array([own[p] for p in patterns]), np.array([counted[p] for p in patterns], float))
    kind = dict(zip(patterns, (pii._design(np.array(patterns)) @ theta).argmax(1), strict=True))
    want = {(i, s, e, pii.KINDS[kind[tuple(p)]]) for i, s, e, p in found if kind[tuple(p)]}
    got = QUERIES["op8_pii"](spark, FOLDER).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want) > 0
    agree = [kind[p] == int(np.argmax(own[p])) for p in patterns for _ in range(counted[p])]
    assert sum(agree) >= 0.98 * len(agree)  # the classifier follows the estimates


@pytest.mark.parametrize("text,want", [
    ("mail bob.ray@example.org now", ["bob.ray@example.org"]),
    ('password = "hunter2abc", done', ["hunter2abc"]),
    ("api_key: ab/cd+ef=12.", ["ab/cd+ef=12"]),
    ("the token: " + "x" * 90 + "1", ["x" * 90 + "1"]),
    ("at 2001:db8::8a2e:370:7334 or ::1", ["2001:db8::8a2e:370:7334", "::1"]),
    ("to DE89 3704 0044 0532 0130 00 please", ["DE89 3704 0044 0532 0130 00"]),
    ("call \u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669", ["\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669"]),
    ("nothing here, a: b", []),
])
def test_candidates(spark, text, want):
    assert [text[s:e] for s, e in pii.find(text)] == want
    docs = spark.createDataFrame([row(1, text)], SCHEMA)
    assert [text[r["begin"] : r["end"]] for r in pii.candidates(docs).orderBy("begin").collect()] == want


def test_context_reaches_any_distance():
    far = "password =" + " " * 500 + "'swordfish99'"
    s, e = pii.find(far + " card")[0] if pii.find(far + " card") else (far.index("sword"), len(far) - 1)
    v = dict(zip(pii.LABELERS, pii.votes(far, s, e), strict=False))
    assert v["ctx_cue"] == pii.SECRET and v["ctx_assign"] == pii.SECRET
    assert bool(ipaddress.ip_address("2001:db8::1")) and dict(zip(pii.LABELERS, pii.votes("2001:db8::1", 0, 11), strict=False))["rx_ip"] == pii.IP


def test_gazetteers_from_tables(spark):
    g = pii.Gazetteers.of({"names": spark.createDataFrame([("Zebedee",), (None,)], "n string")})
    assert g.names == {"zebedee"} and "com" in g.domains
    at = pii.LABELERS.index("gaz_name")
    assert pii.votes("zebedee.x@a.com", 0, 15, g)[at] == pii.EMAIL and pii.votes("zebedee.x@a.com", 0, 15)[at] == pii.ABSTAIN
    with pytest.raises(ValueError, match="over 1 rows"):
        pii.Gazetteers.of({"names": spark.createDataFrame([("a",), ("b",)], "n string")}, most=1)


@pytest.mark.parametrize("column,train", [("quality", quality.train), ("toxic", toxicity.train)])
def test_training_rows_are_bounded_after_the_join(spark, monkeypatch, column, train):
    rnd = random.Random(3)
    texts = [prose(rnd, 30) for _ in range(12)]
    rows = [row(i, t) for i, t in enumerate(texts)] + [row(0, texts[0])] * 300 + [row(1, "another text of the same id")] * 5
    labels = [(i, i % 2) for i in range(12)] + [(i, 1) for i in range(100, 160)] + [(3, 1 - 3 % 2), (None, 1), (4, None)]
    docs, given = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, f"doc_id long, {column} int")
    seen = []
    module = quality if column == "quality" else toxicity
    real = module.fit
    monkeypatch.setattr(module, "fit", lambda *a, **k: seen.append(a[1] if column == "quality" else a[2]) or real(*a, **k))
    for most, want in ((5, 5), (12, 12), (1000, 12)):
        train(docs, given, max_train=most)
        assert len(seen[-1]) == want
    with pytest.warns(UserWarning, match="constant"):
        train(docs, given.where("doc_id >= 100"))
    assert len(seen[-1]) == 0


def test_string_ids_in_every_operator(spark):
    from quillon.llm import bpe, decontam, simhash, substring, topk, urlfilter, warc

    rnd = random.Random(8)
    base = prose(rnd, 90)
    docs = spark.createDataFrame([("a", base), ("b", base), ("c", prose(rnd, 60) + " write to ann@example.com"), (None, base)], "doc_id string, text string")
    items = spark.createDataFrame([("i1", " ".join(base.split()[5:40]))], "item_id string, text string")
    labels = spark.createDataFrame([("a", 1, 0), ("c", 0, 1)], "doc_id string, quality int, toxic int")
    assert {(r["doc_id"], r["group_id"]) for r in simhash.near_duplicates(docs).collect()} == {("a", "a"), ("b", "a"), (None, "a")}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, items).collect()} == {("a", "i1"), ("b", "i1")}
    assert [r["doc_id"] for r in decontam.without_leaks(docs, items).collect()] == ["c"]
    assert {r["doc_id"] for r in quality.score(docs, quality.train(docs, labels)).collect()} == {"a", "b", "c", None}
    assert {r["doc_id"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {"a", "b", "c", None}
    assert [(r["item_id"], r["doc_id"], r["rank"]) for r in topk.search(docs, items).orderBy("rank").collect()][:2] == [("i1", "a", 1), ("i1", "b", 2)]
    assert {r["doc_id"] for r in substring.repeats(docs).collect()} == {"a", "b"}
    assert {r["doc_id"] for r in pii.candidates(docs).collect()} == {"c"}
    tokens = bpe.encode(docs)
    assert {tuple(r) for r in bpe.decode(tokens).collect()} == {tuple(r) for r in docs.collect()}
    urls = spark.createDataFrame([("p", "http://a.com/x"), ("q", "")], "page_id string, url string")
    rules = spark.createDataFrame([("r", "com,a,", "block")], "rule_id string, prefix string, action string")
    assert [tuple(r) for r in urlfilter.apply_rules(urls, rules).collect()] == [("p", "http://a.com/x", "r", "block", 1)]
    assert urlfilter.apply_rules(urls, rules.limit(0)).count() == 0
    records = spark.createDataFrame([("r1", "a.com", 1, 200), ("r2", "a.com", 2, 304)], "record_id string, url string, t int, status int").selectExpr("record_id", "url", "timestamp_seconds(t) AS ts", "status", "CAST(NULL AS map<string,string>) AS headers")
    assert [(r["record_id"], r["target_id"]) for r in warc.resolve(records).collect()] == [("r2", "r1")]


def test_decontamination_query_by_force(spark):
    """Every passage against every item: BM25, shared word sequences and edits, without an index."""
    from quillon.llm import decontam

    items = {r["item_id"]: r["text"] for r in rows_of(spark, "benchmark")}
    split = lambda t: WORD.findall(t.lower())
    tf = {i: Counter(split(t)) for i, t in items.items()}
    size = {i: sum(c.values()) for i, c in tf.items()}
    n, avg = len(items), sum(size.values()) / len(items)
    df = Counter(w for c in tf.values() for w in c)
    gain = {i: {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c * (decontam.K1 + 1) / (c + decontam.K1 * (1 - decontam.B + decontam.B * size[i] / avg)) for w, c in tf[i].items()} for i in items}
    whole = {i: sum(g.values()) for i, g in gain.items()}
    half = max(decontam.PASSAGE, *size.values())

    def edits(want, passage):
        row = [0] * (len(passage) + 1)
        for x in want:
            new = [row[0] + 1]
            for k, y in enumerate(passage):
                new.append(min(row[k] + (x != y), row[k + 1] + 1, new[k] + 1))
            row = new
        return min(row)

    def share(part, passage):
        if not part:
            return 1.0
        m = min(decontam.GRAM, len(part))
        have = {tuple(passage[k : k + m]) for k in range(len(passage) - m + 1)}
        want = {tuple(part[k : k + m]) for k in range(len(part) - m + 1)}
        kept = len(want & have) / len(want)
        return kept if kept == 1 else max(kept, 1 - edits(part, passage) / len(part))

    best = {}
    for d in rows_of(spark, "documents"):
        w = split(d["text"])
        for k in range(max(1, -(-len(w) // half))):
            passage = w[k * half : (k + 2) * half]
            seen = set(passage)
            for i in items:
                score = sum(g for x, g in gain[i].items() if x in seen) / whole[i]
                if score >= decontam.THRESHOLD - 1e-9:
                    parts = [share(split(p), passage) for p in decontam.split_item(items[i])]
                    if min(parts) >= decontam.OVERLAP:
                        best[d["doc_id"], i] = max(best.get((d["doc_id"], i), (0, 0, 0)), (score, *parts))
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in QUERIES["op3_decontamination"](spark, FOLDER).collect()}
    assert set(got) == set(best) and len(got) >= 3
    assert all(abs(a - b) < 1e-5 for k in got for a, b in zip(got[k], best[k], strict=True))
