import os
import time

import pytest
from pyspark.sql import functions as F

from quillon import query as q
from quillon.index import SearchIndex
from quillon.plans.compiler import compile_query
from quillon.sources.files import MAX_SIZE, file_mapping, id_path, language_of, path_id, read_directory, safe_embed
from quillon.sources.json import json_rows
from quillon.sources.listing import list_tree
from quillon.streaming.watcher import Watcher, stream_new_files


@pytest.fixture
def tree(tmp_path):
    for d in ("sub/deep", ".git/x", "__tests__", "empty", "sub/.hidden"):
        (tmp_path / d).mkdir(parents=True)
    texts = {
        "a.txt": "hello world", "sub/b.go": "package b\nfunc Run() {\n}\n", "sub/deep/c.md": "deep", "__init__.py": "", "_helpers.py": "def help():\n  pass\n", ".env": "A=1",
        "__tests__/t.py": "x = 1\n", ".git/x/config": "hidden", "sub/.hidden/y.txt": "hidden", "späß.txt": "ünï",
    }
    for k, v in texts.items():
        (tmp_path / k).write_text(v)
    (tmp_path / "c.bin").write_bytes(b"a\x00b")
    (tmp_path / "late.bin").write_bytes(b"a" * 600 + b"\x00")
    (tmp_path / "big.txt").write_bytes(b"x" * (MAX_SIZE + 1))
    return tmp_path


ALL = {"a.txt", "sub/b.go", "sub/deep/c.md", "__init__.py", "_helpers.py", ".env", "__tests__/t.py", "späß.txt", "late.bin"}


def test_directory(spark, tree):
    docs = read_directory(spark, str(tree), code=True)
    rows = {r["path"]: r for r in docs.collect()}
    assert set(rows) == ALL
    assert rows["sub/b.go"]["_lang"] == "go" and rows["_helpers.py"]["_lang"] == "python" and rows["a.txt"]["_lang"] is None
    assert rows["sub/deep/c.md"]["doc_id"] == "sub:deep:c.md" and rows["_helpers.py"]["filename_text"] == " helpers py" and rows["späß.txt"]["content"] == "ünï"
    assert rows["a.txt"]["size"] == 11.0 and rows["a.txt"]["ext"] == ".txt" and abs(rows["a.txt"]["modified"].timestamp() - (tree / "a.txt").stat().st_mtime) < 90_000
    ix = SearchIndex.of(docs, file_mapping(code=True))
    assert {r[0] for r in compile_query(ix, q.Term("run", "source.sym")).collect()} == {"sub:b.go"}
    assert {r[0] for r in compile_query(ix, q.Match("hello", "content")).collect()} == {"a.txt"}
    small = read_directory(spark, str(tree), max_size=5, keep=lambda p: F.when(p == "c.bin", None).otherwise(~p.startswith("sub")))
    assert {r["path"] for r in small.collect()} == {"__init__.py", ".env"} - {"späß.txt"} | ({"späß.txt"} if (tree / "späß.txt").stat().st_size <= 5 else set())


def test_listing(spark, tree, tmp_path_factory):
    got = {r["path"]: r["size"] for r in list_tree(spark, str(tree) + "/").collect()}
    assert set(got) == ALL | {"c.bin", "big.txt"} and got["big.txt"] == MAX_SIZE + 1
    assert list_tree(spark, f"file://{tree}").count() == len(got)
    assert list_tree(spark, str(tmp_path_factory.mktemp("none"))).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        list_tree(spark, str(tree / "nowhere")).count()


def test_ids_and_languages(spark):
    row = spark.createDataFrame([("a/b/c.PY",)], "p string").select(path_id(F.col("p")).alias("i"), id_path(path_id(F.col("p"))).alias("p"), language_of(F.lit("PY")).alias("l"), language_of(F.lit("zzz")).alias("n")).collect()[0]
    assert tuple(row) == ("a:b:c.PY", "a/b/c.PY", "python", None)


def test_embeddings_that_fail_are_null(spark, tree):
    def embed(texts):
        if any("hello" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    rows = {r["path"]: r["embedding"] for r in read_directory(spark, str(tree), embed=safe_embed(embed)).collect()}
    assert rows["a.txt"] is None and rows["sub/deep/c.md"] == [4.0, 1.0]


def watch(spark, root, **options):
    seen = []
    return seen, Watcher(spark, str(root), lambda up, gone: seen.append(({r["path"] for r in up.collect()}, {r["doc_id"] for r in gone.collect()})), **options)


def test_watcher_rounds(spark, tree):
    seen, w = watch(spark, tree)
    assert w.scan() == (len(ALL) + 1, 0) and w.scan() == (0, 0)  # one of them is no text
    assert seen == [(ALL, set())]
    (tree / "a.txt").unlink()
    (tree / "new.txt").write_text("n")
    (tree / "sub" / "b.go").write_text("package changed\n")
    w.scan()
    assert seen[-1] == ({"new.txt", "sub/b.go"}, {"a.txt"})
    os.utime(tree / "new.txt", (1, 1))
    assert w.scan() == (1, 0) and seen[-1] == ({"new.txt"}, set())
    (tree / "new.txt").write_bytes(b"x" * (MAX_SIZE + 1))  # grown too large: gone
    assert w.scan() == (0, 1) and seen[-1] == (set(), {"new.txt"})


def test_watcher_steps_and_failures(spark, tree):
    seen, w = watch(spark, tree, batch=4, max_size=1000)
    n, _ = w.scan()
    assert len(seen) == -(-n // 4) and set().union(*(up for up, _ in seen)) == ALL and all(len(up) <= 4 for up, _ in seen)
    (tree / "more.txt").write_text("m")
    (tree / "a.txt").unlink()
    good, w.consume = w.consume, lambda up, gone: 1 / 0
    with pytest.raises(ZeroDivisionError):
        w.scan()
    w.consume = good
    assert w.scan() == (1, 1) and seen[-1] == ({"more.txt"}, {"a.txt"})  # nothing was lost by the failure
    w.root = str(tree / "nowhere")
    with pytest.raises(Exception, match="nowhere"):
        w.scan()
    w.root = str(tree)
    assert w.scan() == (0, 0)  # and nothing deleted by a failed listing


def test_watcher_thread(spark, tree):
    said = []
    seen, w = watch(spark, tree, seconds=0.2, logger=said.append)
    w.start()
    try:
        assert len(seen) == 1
        (tree / "late.txt").write_text("late")
        end = time.time() + 60
        while len(seen) < 2 and time.time() < end:
            time.sleep(0.2)
        assert seen[1] == ({"late.txt"}, set())
        w.root = str(tree / "nowhere")
        while not said and time.time() < end:
            time.sleep(0.2)
        assert "nowhere" in said[0]
    finally:
        w.stop()
    n = len(seen)
    (tree / "after.txt").write_text("x")
    time.sleep(1)
    assert len(seen) == n
    w.stop()


def test_stream_of_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one")
    seen = []
    run = stream_new_files(spark, str(tmp_path / "in"), lambda docs, n: seen.extend(r["doc_id"] for r in docs.collect()), str(tmp_path / "check"), seconds=1)
    try:
        run.processAllAvailable()
        (tmp_path / "in" / "b.txt").write_text("two")
        (tmp_path / "in" / "b.bin").write_bytes(b"\x00")
        run.processAllAvailable()
    finally:
        run.stop()
    assert seen == ["a.txt", "b.txt"]


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": "x"}}'), (2, "{}"), (3, None)], "id int, j string")
    assert [tuple(r) for r in json_rows(df, "j", "a int, b struct<c:string>", ("id",)).orderBy("id").collect()] == [(1, 1, ("x",)), (2, None, None), (3, None, None)]
    with pytest.raises(Exception, match="[Mm]alformed"):
        json_rows(spark.createDataFrame([("{",)], "j string"), "j", "a int").collect()
