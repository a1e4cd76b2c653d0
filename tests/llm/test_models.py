import random

import numpy as np
import pyarrow as pa

from quillon.llm import pii, quality, toxicity

from .conftest import SCHEMA, prose, row


def test_trees_learn_and_walk_like_a_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < -0.2)).astype(float)
    m = quality.fit(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    inner = m.feature.shape[1]
    for r in x[:20]:
        total = m.base
        for t in range(len(m.feature)):
            i = 0
            while i < inner:
                i = 2 * i + 1 + int(r[m.feature[t, i]] > m.cut[t, i])
            total += m.leaf[t, i - inner]
        assert abs(1 / (1 + np.exp(-total)) - m.score(r[None])[0]) < 1e-9


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = quality.train(docs, labels.where("doc_id % 2 = 0"))
    got = quality.score(docs, m).join(labels.where("doc_id % 2 = 1").withColumnRenamed("quality", "y"), "doc_id")
    assert got.where("kept = (y = 1)").count() >= 0.97 * got.count()


def test_quality_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int")
    m = quality.train(awkward, labels)
    assert quality.score(awkward, m).count() == awkward.count()
    assert quality.good_only(awkward, labels).columns == awkward.columns
    assert quality.good_only(nothing, labels).count() == 0
    none = labels.limit(0)
    assert quality.good_only(awkward, none).count() == awkward.count()  # without labels all stay


def test_swaps_lower_false_positives():
    """Toxic training sentences often name a group; neutral mentions of it must not be flagged."""
    rnd = random.Random(2)
    texts, y = [], []
    for _ in range(2000):
        bad = rnd.random() < 0.5
        named = rnd.random() < (0.9 if bad else 0.05)
        texts.append(prose(rnd, 12) + (" the muslim " if named else " ") + ("vile scum" if bad and rnd.random() < 0.8 else "fine day"))
        y.append(float(bad))
    d, h = toxicity.features(toxicity.words(pa.array(texts)))
    pairs = [p for t in texts for p in toxicity.swaps(t)]
    mentions = pa.array([prose(rnd, 12) + " a muslim family fine day" for _ in range(100)])
    flagged = {}
    for s in (0.0, 30.0):
        m = toxicity.fit(d, h, np.array(y), toxicity.effects(pairs), s)
        flagged[s] = (m.score(mentions) > 0.5).mean()
        assert (m.score(pa.array(["vile scum " + prose(rnd, 8) for _ in range(50)])) > 0.5).mean() > 0.9
    assert flagged[0.0] > 0.3 and flagged[30.0] < flagged[0.0] / 4


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet").withColumnRenamed("toxic", "y")
    m = toxicity.train(docs, labels.where("doc_id % 4 > 0").withColumnRenamed("y", "toxic"))
    got = toxicity.score(docs, m).join(labels.where("doc_id % 4 = 0"), "doc_id")
    assert got.where("toxic = (y = 1)").count() >= 0.98 * got.count()


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    m = toxicity.train(awkward, labels)
    assert toxicity.score(awkward, m).count() == awkward.count() and toxicity.score(nothing, m).count() == 0
    assert toxicity.score(awkward, toxicity.train(nothing, labels)).where("toxic").count() == 0


TEXTS = {
    1: "write to anna.b@mail.example.com or call +1 (017) 555-7713 today",
    2: "ip 97.51.17.173 and card 4845168114407329, version 4.0 of 2024",
    3: 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" thx, 12 apples',
    4: "nothing to see, page 12",
}


def test_pii_spans_and_redaction(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(200):
        k = i % 4 + 1
        rows.append(row(i, prose(rnd, 10) + " " + TEXTS[k].replace("7713", f"{rnd.randrange(1000, 9999)}").replace("17.173", f"17.{rnd.randrange(1, 255)}") + " " + prose(rnd, 5)))
    docs = spark.createDataFrame(rows, SCHEMA)
    text = {r[0]: r[1] for r in rows}
    found = {}
    for r in pii.spans(docs).collect():
        found.setdefault(r["doc_id"], set()).add((r["kind"], text[r["doc_id"]][r["begin"] : r["end"]].split(".")[0][:3]))
    for i in range(200):
        want = [{("email", "ann"), ("phone", "+1 ")}, {("ip", "97"), ("card", "484")}, {("secret", "04d")}, set()][i % 4]
        assert found.get(i, set()) == want
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert "[email] or call [phone] today" in out[0]["text"] and out[0]["n_chars"] == len(out[0]["text"])
    assert out[3]["text"] == text[3] and 'token = "[secret]" thx' in out[2]["text"]


def test_rows_are_redacted_by_their_own_text(spark):
    rnd = random.Random(5)
    rows = [row(i, f"{prose(rnd, 8)} write to bob{i}@mail.example.com today") for i in range(40)]
    rows += [row(None, "mine is carol@mail.example.com here"), row(7, "quite clean, nothing to hide in this longer text, which shares the id of another row")]
    out = [(r["doc_id"], r["text"], r["n_chars"]) for r in pii.redact(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert (None, "mine is [email] here", 20) in out
    assert (7, rows[-1][1], len(rows[-1][1])) in out
    assert len(out) == 42 and not any("@" in t for _, t, _ in out)


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 4000)
    votes = np.full((4000, 4), pii.ABSTAIN)
    for j, right in enumerate((0.95, 0.9, 0.9, 0.6)):
        ok = rng.random(4000) < right
        votes[:, j] = np.where(ok, truth, 1 - truth)
    p, count = np.unique(votes, axis=0, return_counts=True)
    _, conf, post = pii.reliabilities(p, count.astype(float))
    right = [conf[j, [0, 1], [0, 1]].mean() for j in range(4)]
    assert right[0] > 0.9 and right[3] < 0.7


def test_pii_of_awkward_rows(awkward, nothing):
    assert pii.spans(awkward).count() == 0 and pii.spans(nothing).count() == 0
    assert sorted(map(str, pii.redact(awkward).collect())) == sorted(map(str, awkward.collect()))
    assert pii.redact(nothing).columns == nothing.columns


def test_toxicity_fit_in_blocks(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["woman", "man", "idiot", "kind", *(f"word{i}" for i in range(40))], rng.integers(0, 30))) for _ in range(80)]
    y, (d, h) = (rng.random(80) < 0.4).astype(float), toxicity.features(toxicity.words(pa.array(texts)))
    touched = toxicity.effects([p for t in texts for p in toxicity.swaps(t)])
    whole = toxicity.fit(d, h, y, touched)
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    parts = toxicity.fit(d, h, y, touched)
    assert (parts.terms == whole.terms).all() and np.allclose(parts.weight, whole.weight) and abs(parts.bias - whole.bias) < 1e-9
    values, at = rng.random(9), rng.integers(0, 9, 50)
    heads = np.array([0, 3, 20, 49])
    assert np.allclose(toxicity.run_sums(values, at, heads), [values[x].sum() for x in np.split(at, heads[1:])])
