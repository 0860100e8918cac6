"""Reading files by their beginnings, and one file a row."""

import json
import os
import pickle
import tracemalloc

import pytest
from pyspark.sql import functions as F

from paperloom.operators import classify
from paperloom.sources import archive, files


def made(folder, names):
    for name, content in names.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)


def test_listing(spark, tmp_path):
    made(tmp_path, {"a.ws": b"one", "_b.ws": b"two", ".hidden": b"x", "sub/c.ws": b"three", "sub/.d": b"y", ".dir/e": b"z", "sub/deep/f": b"", "empty/g": b"g"})
    name = F.regexp_replace("path", ".*" + os.path.basename(tmp_path) + "/", "")
    flat = archive.read_archive(spark, [str(tmp_path)])
    assert {r[0] for r in flat.select(name).collect()} == {"a.ws", "_b.ws"}
    deep = archive.read_archive(spark, [f"file://{tmp_path}", str(tmp_path), f"{tmp_path}/sub/c.ws", f"{tmp_path}/none"], recursive=True)
    got = {r[0]: (bytes(r[1]), r[2]) for r in deep.select(name, "content", "length").collect()}
    assert deep.count() == 5
    assert got == {"a.ws": (b"one", 3), "_b.ws": (b"two", 3), "sub/c.ws": (b"three", 5), "sub/deep/f": (b"", 0), "empty/g": (b"g", 1)}
    listed = archive.read_archive(spark, [str(tmp_path)], recursive=True, content=False)
    assert listed.filter("content is null and length >= 0").count() == 5
    assert archive.read_archive(spark, [f"{tmp_path}/none"]).count() == 0


def test_no_more_is_read_than_asked(spark, tmp_path, monkeypatch):
    made(tmp_path, {f"f{k}": bytes([65 + k]) * 100_000 for k in range(3)})
    reader = files.ArchiveReader({"addresses": f'["{tmp_path}"]', "prefix": "1000"})
    asked = []
    real = files._opened

    class Watched:
        def __init__(self, system):
            self.system = system

        def get_file_info(self, x):
            return self.system.get_file_info(x)

        def open_input_stream(self, path):
            stream = self.system.open_input_stream(path)

            class Stream:
                def __enter__(self):
                    return self

                def __exit__(self, *a):
                    stream.close()

                def read(self, n=None):
                    got = stream.read(n)
                    asked.append(len(got))
                    return got

            return Stream()

    monkeypatch.setattr(files, "_opened", lambda a: (Watched(real(a)[0]), *real(a)[1:]))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert asked == [1000] * 3 and [len(r["content"]) for r in rows] == [1000] * 3 and {r["length"] for r in rows} == {100_000}


def test_unreadable_files_do_not_stop_the_run(tmp_path):
    made(tmp_path, {"a": b"1", "b": b"2", "c": b"3"})
    reader = files.ArchiveReader({"addresses": f'["{tmp_path}"]'})
    parts = reader.partitions()
    os.remove(f"{tmp_path}/b")
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [r["content"] for r in rows] == [b"1", None, b"3"] and rows[1]["error"]


def test_binary_files_are_skipped(spark, tmp_path):
    made(tmp_path, {"text": b"plain words here " * 50, "binary": bytes(range(1, 9)) * 500, "binary after": b"words and words " * 100 + b"\x01" * 5000, "ws": b"soft\x8d\n" * 40, "nothing": b""})
    seen = classify.convertible(archive.read_archive(spark, [str(tmp_path)], prefix=1000), 1000)
    got = {r.path.rsplit("/", 1)[1]: (r.variant, r.is_convertible) for r in seen.collect()}
    assert not got["binary"][1] and got["text"] == ("text", True) and got["binary after"][1] and got["ws"][1]


def test_one_file_a_row(spark, tmp_path):
    rows = [("text", f"n{k}.txt", b"body %d" % k) for k in range(40)]
    rows += [("text", "x" * 400, b"too long a name"), ("text", None, b"x"), ("text", "a/b", b"x"), ("text", "..", b"x"), ("html", "n1.txt", b""), ("html", "n2.txt", None), (None, "n3", b"x"), ("text", "n0.txt", b"zzz second"), (".staging-x", "n", b"x")]
    df = spark.createDataFrame(rows, "format string, name string, body binary").repartition(3)
    out = str(tmp_path / "out")
    failed = sorted((str(r.format), str(r.name)[:3], r.reason) for r in archive.write_files(df, out).collect())
    reasons = [("text", "xxx", "not written: File name too long"), ("text", "Non", "no name"), ("text", "a/b", "the name is a path"), ("text", "..", "the name is a path"), ("html", "n2.", "nothing to write"), ("None", "n3", "no format"), ("text", "n0.", "the name was given twice"), (".staging-x", "n", "the format is a path")]
    assert failed == sorted(reasons)
    assert sorted(os.listdir(f"{out}/text")) == sorted(f"n{k}.txt" for k in range(40))
    assert open(f"{out}/text/n0.txt").read() == "body 0" and os.listdir(f"{out}/html") == ["n1.txt"]
    assert sorted(n for n in os.listdir(out)) == ["_failures", "html", "text"]
    again = archive.write_files(df.filter("name = 'n1.txt'").withColumn("body", F.lit(b"new")), out, run="1")
    assert [r.reason for r in again.collect()] == ["already exists"] * 2 and open(f"{out}/text/n1.txt").read() == "body 1"
    for _ in range(2):  # a repeated run gives the same
        assert archive.write_files(df.filter("name = 'n1.txt'").withColumn("body", F.lit(b"new")), out, "replace", run="2").count() == 0
        assert open(f"{out}/text/n1.txt").read() == "new"


def test_a_failed_run_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    bad = spark.range(20).select(F.lit("text").alias("format"), F.col("id").cast("string").alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("planted"))).otherwise(F.lit("x")).alias("body"))
    with pytest.raises(Exception, match="planted"):
        archive.write_files(bad, out).count()
    assert not os.path.exists(out) or os.listdir(out) == []
    assert archive.write_files(bad.filter("id < 0"), out).count() == 0


def _most(do):
    """Bytes of Python objects that it holds at most, and what it returns."""
    tracemalloc.start()
    try:
        out = do()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_the_driver_holds_a_few_bytes_a_file(tmp_path):
    names = [f"a/{k}.ws" if k % 2 else f"b/_{k}.ws" for k in range(20_000)]
    made(tmp_path, {n: b"x" for n in names})
    reader = files.ArchiveReader({"addresses": json.dumps([str(tmp_path)]), "recursive": "true"})
    most, parts = _most(reader.partitions)
    assert most < 4_000_000 and sum(len(pickle.dumps(p)) for p in parts) < 20 * len(names)
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["path"] for r in rows) == sorted(f"file:{tmp_path}/{n}" for n in names) and {r["content"] for r in rows} == {b"x"}


def test_a_commit_does_not_grow_with_the_files(tmp_path):
    made(tmp_path, {f".staging-x/0-1/text/{k}.txt": b"x" for k in range(5_000)})
    writer = files.ExportsWriter({"path": str(tmp_path), "staging": ".staging-x"})
    writer.staging = ".staging-x"
    most, _ = _most(lambda: writer.commit([files.FilesWritten(f"{tmp_path}/.staging-x/0-1", 5_000, 0), None]))
    assert most < 500_000


def test_files_are_placed_once_by_any_number_of_calls(tmp_path):
    made(tmp_path, {f".staging-x/0-1/text/{k}.txt": b"new" for k in range(3_000)} | {"text/7.txt": b"old", ".staging-x/0-1/_failures/part-0.json": b"{}", ".staging-x/0-2/text/lost.txt": b"x", ".staging-x/0-1/.failures/.n": b"n"})
    writer = files.ExportsWriter({"path": str(tmp_path), "staging": ".staging-x"})
    writer.commit([files.FilesWritten(f"{tmp_path}/.staging-x/0-1", 3_001, 0), None])
    assert files.attempts(str(tmp_path), ".staging-x") == ["0-1"]
    for _ in range(2):
        files.place(str(tmp_path), ".staging-x", "r", "0-1")
    files.clear(str(tmp_path), ".staging-x")
    assert sorted(os.listdir(tmp_path)) == [".failures", "_failures", "text"] and os.listdir(f"{tmp_path}/.failures") == [".n"]
    assert len(os.listdir(f"{tmp_path}/text")) == 3_000 and open(f"{tmp_path}/text/7.txt").read() == "new"


def test_addresses_that_overlap(spark, tmp_path):
    made(tmp_path, {"a.ws": b"1", "s/b.ws": b"2", "s/t/c.ws": b"3", "s/t/d.ws": b"4"})
    os.symlink(f"{tmp_path}/none", f"{tmp_path}/s/broken")
    with open(os.fsencode(str(tmp_path)) + b"/s/\xff.ws", "wb") as f:
        f.write(b"5")
    for addresses in (["s/t/d.ws", "s/t", "", "s/b.ws", "s"], ["", "s/t/d.ws"], ["s", "s/t/c.ws", ""]):
        rows = archive.read_archive(spark, [f"{tmp_path}/{a}" for a in addresses], recursive=True).collect()
        assert sorted((r.path.removeprefix(f"file:{tmp_path}/"), r.content and bytes(r.content), r.length, r.error is None) for r in rows) == [("a.ws", b"1", 1, True), ("s/b.ws", b"2", 1, True), ("s/t/c.ws", b"3", 1, True), ("s/t/d.ws", b"4", 1, True), ("s/\ufffd.ws", None, 1, False)]


def test_tasks_move_what_was_staged(spark, tmp_path):
    """The files get to their places in Spark jobs of their own; a run whose move fails clears its staging."""
    out, sc = str(tmp_path), spark.sparkContext
    rows = spark.range(2_000).select(F.lit("text").alias("format"), F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.lit("x").alias("body"))
    sc.setJobGroup("moved by tasks", "")
    assert archive.write_files(rows, out).count() == 0
    stages = [s for j in sc.statusTracker().getJobIdsForGroup("moved by tasks") for s in sc.statusTracker().getJobInfo(j).stageIds]
    names = [i.name for i in map(sc.statusTracker().getStageInfo, stages) if i]
    assert any("foreach" in n for n in names) and sorted(os.listdir(out)) == ["_failures", "text"] and len(os.listdir(f"{out}/text")) == 2_000
    open(f"{out}/_failures/run=bad", "w").close()
    with pytest.raises(Exception, match="run=bad"):
        archive.write_files(rows, out, "replace", run="bad")
    assert sorted(os.listdir(out)) == ["_failures", "text"]
    sc.setJobGroup("done", "")
