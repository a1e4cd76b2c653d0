import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import simhash, substring

from .conftest import SCHEMA, prose, row


def groups_by_force(rows, radius):
    """(id, text) -> (group, links, kept) of every document that has a near copy; a document is an id with a text."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    fp, ok = simhash.fingerprints(pa.array([t for _, t in docs], pa.string()))
    docs, fp = [d for d, k in zip(docs, ok, strict=True) if k], fp[ok]
    near = [[b for b in range(len(docs)) if b != a and np.bitwise_count(fp[a] ^ fp[b]).sum() <= radius] for a in range(len(docs))]
    out, seen = {}, set()
    for a in range(len(docs)):
        if a in seen or not near[a]:
            continue
        group, todo = {a}, [a]
        while todo:
            todo = [y for x in todo for y in near[x] if y not in group and not group.add(y)]
        seen |= group
        out |= {docs[x]: (docs[a][0], len(near[x]), docs[x][0] == docs[a][0]) for x in group}
    return out


def corpus(seed=5):
    rnd = random.Random(seed)
    out = []
    for _ in range(60):
        text = prose(rnd, rnd.randrange(20, 200))
        for _ in range(rnd.choice([1, 1, 1, 2, 6])):
            words = text.split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = "edited"
            out.append(" ".join(words))
    rnd.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("partitions", [1 << 14, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, partitions):
    monkeypatch.setattr(simhash, "TILE", 16)  # many tiles, cells that are split among them
    monkeypatch.setattr(simhash, "MAX_TILE", 16)
    monkeypatch.setattr(simhash.tile_pairs, "__defaults__", (partitions,))
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)).collect()
    want = groups_by_force(rows, simhash.RADIUS)
    assert {r["doc_id"]: (r["group_id"], r["links"], r["kept"]) for r in got} == {i: v for (i, _), v in want.items()} and len(got) == len(want) > 50


@pytest.mark.parametrize("part", [1 << 17, 40])
def test_blocks_find_every_link(spark, monkeypatch, part):
    rows = corpus()
    want = groups_by_force(rows, simhash.RADIUS)
    monkeypatch.setattr(simhash, "DIRECT", 0)
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "MAX_PART", part)
    monkeypatch.setattr(simhash, "_near", None)  # all by blocks
    got = simhash.near_duplicates(spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA)).collect()
    assert {r["doc_id"]: (r["group_id"], r["links"], r["kept"]) for r in got} == {i: v for (i, _), v in want.items()} and len(got) == len(want) > 50


@pytest.mark.parametrize("radius", [0, 3, 7, 22, 40])
@pytest.mark.parametrize("bits", [3, 16])
def test_blocks_lose_no_link(monkeypatch, radius, bits):
    """Against brute force, links at every distance up to the radius and a little over."""
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, (300, 2), dtype=np.uint64)
    flips = np.zeros((300, 128), np.uint8)
    for k, f in enumerate(flips):
        f[rng.choice(128, k % (radius + 3), replace=False)] = 1
    h = np.unique(np.concatenate([base, base ^ np.packbits(flips, axis=1).view(np.uint64)]), axis=0)
    docs = rng.integers(1, 5, len(h))
    near = np.bitwise_count(h[:, None] ^ h[None]).sum(2) <= radius
    np.fill_diagonal(near, False)
    monkeypatch.setattr(simhash, "SIFT", 64)  # several slices a cell
    monkeypatch.setattr(simhash, "SETTLE", 10)
    own, cross = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
    tile = lambda s: (h[s, 0].copy(), h[s, 1].copy(), docs[s])
    half = len(h) // 2
    for block in range(simhash.BLOCKS):
        label, links = simhash.compare_block(tile(slice(None)), None, block, bits, radius)
        assert (label[label] == label).all() and ((label != np.arange(len(h))) <= (links > 0)).all()
        own += links
        for s in (slice(0, half), slice(half, None)):
            cross[s] += simhash.compare_block(tile(s), None, block, bits, radius)[1]
        cross += simhash.compare_block(tile(slice(0, half)), tile(slice(half, None)), block, bits, radius)[1]
    assert own.tolist() == cross.tolist() == (near * docs).sum(1).tolist()
    assert (own > 0).any() or radius == 0


def test_blocks_pass_over_most_pairs(monkeypatch):
    compared = []
    whole = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x, **k: compared.append(x.size) or whole(x, **k))
    h = np.random.default_rng(4).integers(0, 1 << 63, (20000, 2), dtype=np.uint64) * np.uint64(2)
    docs = np.ones(len(h), np.int64)
    for block in range(simhash.BLOCKS):
        simhash.compare_block((h[:, 0].copy(), h[:, 1].copy(), docs), None, block, 16, 22)
    assert sum(compared) < 0.1 * len(h) ** 2 / 2


def test_tile_pairs_fill_their_partitions(spark):
    tiles = spark.createDataFrame([(k, 60, 68, 20, 40) for k in range(12)], "tile long, lo int, hi int, lo1 int, hi1 int")
    pairs, n = simhash.tile_pairs(tiles, 22)
    rows = pairs.repartition(n, "slot").select(F.spark_partition_id(), "i", "j").collect()
    assert n == 78 and {(i, j) for _, i, j in rows} == {(i, j) for i in range(12) for j in range(i, 12)} and len({p for p, _, _ in rows}) == 78
    far = spark.createDataFrame([(0, 10, 20, 5, 10), (1, 43, 50, 5, 10)], "tile long, lo int, hi int, lo1 int, hi1 int")
    assert {(r["i"], r["j"]) for r in simhash.tile_pairs(far, 22)[0].collect()} == {(0, 0), (1, 1)}


def test_ids_with_several_texts_lose_none(spark):
    rnd = random.Random(21)
    a, b, c = (prose(rnd, 80) for _ in range(3))
    rows = [(1, a), (5, a), (5, b), (7, b), (8, c), (8, c), (None, c), (None, prose(rnd, 60)), (9, None), (9, None), (10, "!!"), (10, "!!")]
    docs = spark.createDataFrame([row(*x) for x in rows], SCHEMA)
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs).where("doc_id is not null and doc_id < 9").collect())
    assert got == sorted([(1, a), (5, b), (8, c)])
    assert simhash.keep_one(docs).where("doc_id is null or doc_id >= 9").count() == 5
    text = docs.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    assert sorted(r["doc_id"] for r in simhash.keep_one(text).where("doc_id < 'doc-9' and doc_id <> 'doc-10'").collect()) == ["doc-1", "doc-5", "doc-8"]
    assert {r["group_id"] for r in simhash.near_duplicates(text).collect()} == {"doc-1", "doc-5", "doc-8"}


def test_every_word_counts():
    rnd = random.Random(22)
    words = prose(rnd, 60).split()
    base = " ".join([*words[:20], "it is not so in 2019", *words[20:]])
    others = [base.replace(" not ", " now "), base.replace("2019", "1754"), " ".join(reversed(base.split())), base + " it is it is it is", base.replace(" so ", " ")]
    fp, _ = simhash.fingerprints(pa.array([base, *others, base.upper()]))
    assert all((fp[0] != x).any() for x in fp[1:-1]) and (fp[0] == fp[-1]).all()


def test_edited_copies_share_a_group(spark):
    """Recall against brute-force Jaccard of 3-word shingles, with 3 to 5 % of the words of each copy replaced."""
    rnd = random.Random(11)
    texts = []
    for _ in range(80):
        base = prose(rnd, rnd.randrange(60, 300)).split()
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for k in rnd.sample(range(len(base)), round(len(base) * rnd.uniform(0.03, 0.05))):
                copy[k] = prose(rnd, 1)
            texts.append(copy)
    sets = [{tuple(x.strip(".,") for x in t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
    got = simhash.near_duplicates(spark.createDataFrame([row(i, " ".join(t)) for i, t in enumerate(texts)], SCHEMA)).collect()
    group = {r["doc_id"]: r["group_id"] for r in got}
    fp, _ = simhash.fingerprints(pa.array([" ".join(t) for t in texts]))
    assert len(near) > 200
    assert sum(np.bitwise_count(fp[a] ^ fp[b]).sum() <= simhash.RADIUS for a, b in near) >= 0.97 * len(near)
    assert sum(a in group and group[a] == group.get(b) for a, b in near) >= 0.99 * len(near)
    assert all(x // 4 == g // 4 for x, g in group.items())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)], "u long, v long")
    assert {(r["u"], r["v"]) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100), (103, 100)}


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    got = [(r["doc_id"], r["group_id"], r["links"], r["kept"]) for r in simhash.near_duplicates(awkward).collect()]
    assert sorted(got, key=str) == [(1, 1, 3, True), (2, 1, 3, False), (3, 1, 3, False), (None, 1, 3, False)]
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9, 10]
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_one(nothing).count() == 0


def repeats_by_force(rows, n):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t.lower().replace(".", "").replace(",", "").split())
    where = {}
    for i, many in texts.items():
        for w in many:
            for k in range(len(w) - n + 1):
                where.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for i, many in texts.items():
        spans = sorted({(k, k + n) for w in many for k in range(len(w) - n + 1) if len(where[tuple(w[k : k + n])]) > 1})
        merged = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = b
            else:
                merged.append([a, b])
        out |= {(i, a, b) for a, b in merged}
    return out


def repeating():
    rnd = random.Random(8)
    passages = [prose(rnd, rnd.choice([49, 50, 51, 75, 130])) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [prose(rnd, rnd.randrange(0, 60)) or "a"]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages), prose(rnd, rnd.randrange(1, 60))]
        rows.append((i, " ".join(parts)))
    return rows + [(100, "same " * 200), (101, "same " * 120), (102, passages[0] + " " + passages[0])]


@pytest.mark.parametrize("hot", [100_000, 2, 0])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    """With few rows a shard, so that anchors are salted, and with some or all anchors hot."""
    monkeypatch.setattr(substring, "SHARD_ROWS", 3 if hot == 2 else 40)
    monkeypatch.setattr(substring, "HOT", hot)
    rows = repeating()
    got = substring.repeats(spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA))
    assert {tuple(r) for r in got.select("doc_id", "begin", "end").collect()} == repeats_by_force(rows, 50)


def test_occurrences_come_from_the_automata(spark, monkeypatch):
    class Deaf:
        def __init__(self, *_):
            pass

        def __len__(self):
            return 1

        def add_word(self, *_):
            pass

        def make_automaton(self):
            pass

        def iter(self, *_):
            return []

    rows = [(k, np.arange(60, dtype=np.int32) + 100 * (k == 2)) for k in range(3)]
    lists = pa.array([w.tolist() for _, w in rows], pa.list_(pa.int32()))
    table = pa.table({"anchor": pa.array([5, 5, 5]), "lo": pa.array([0, 1, 2]), "hi": pa.array([0, 1, 2]), "words": lists, "doc_id": pa.array([0, 1, 2]), "begin": pa.array([7, 0, 0])})
    phrases = substring.confirm(table, 50)
    assert phrases.num_rows == 2 and substring.locate(phrases, table, 50).to_pydict() == {"doc_id": [0, 0, 1, 1], "begin": [7, 17, 0, 10], "end": [57, 67, 50, 60]}
    monkeypatch.setattr(substring.ahocorasick, "Automaton", Deaf)
    assert substring.locate(phrases, table, 50).num_rows == 0


def test_repeats_of_awkward_rows(awkward, nothing):
    got = {(r["doc_id"], r["begin"], r["end"]) for r in substring.repeats(awkward).collect()}
    assert {(1, 0, 120), (2, 0, 120)} <= got and {d for d, _, _ in got} == {1, 2, 3}
    assert substring.repeats(nothing).count() == 0
