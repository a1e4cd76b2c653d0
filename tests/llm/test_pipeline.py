import pyarrow as pa

import corpus_pipeline
from quillon.llm import bpe, decontam, pii, quality, simhash

from .test_dedup import groups_by_force


def test_pipeline_by_force(spark, tmp_path):
    """Each stage against plain Python over the rows that the stage before it kept."""
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    sf = str(tmp_path)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    ids = sorted(rows)
    keep = model.score(quality.statistics(pa.array([rows[i] for i in ids]))) >= 0.5
    left = [(i, rows[i]) for i, k in zip(ids, keep, strict=True) if k]
    gone = {i for (i, _), (_, _, kept) in groups_by_force(left, simhash.RADIUS).items() if not kept}
    left = [(i, t) for i, t in left if i not in gone]
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    plain = lambda w: " " + " ".join(w) + " "
    left = [(i, t) for i, t in left if not any(plain(x) in plain(t.lower().split()) for x in items)]
    own = spark.createDataFrame(left, "doc_id long, text string")
    cut = {}
    for r in pii.spans(own).collect():
        cut.setdefault(r["doc_id"], []).append((r["begin"], r["end"], r["kind"]))
    encoder = bpe.Bpe(bpe.read_ranks(bpe.default_vocabulary()))
    want = {}
    for i, t in left:
        for a, b, k in sorted(cut.get(i, []), reverse=True):
            t = f"{t[:a]}[{k}]{t[b:]}"
        want[i] = encoder.encode(t)
    assert got == want and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]
    assert decontam.THRESHOLD < 1


def test_stages_take_awkward_rows(spark, awkward, nothing):
    folder = "/root/testdata/sf0.001"
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        rows = out.collect()
        assert stage(spark, nothing, folder).count() == 0
        if name != "bpe":
            assert out.columns == awkward.columns
            docs = spark.createDataFrame(rows, awkward.schema)
