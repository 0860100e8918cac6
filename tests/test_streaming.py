"""The stateful throttle over several batches equals its batch twin, and its state expires."""

import datetime
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from paperloom.plans import stream_queries
from paperloom.sources import files
from paperloom.streaming import ingest, paced


def test_stream_equals_batch_twin(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [("p9" if k < 9 else f"p{k % 3}", start + datetime.timedelta(minutes=7 * k + k % 5), k) for k in range(120)]
    schema = "path string, ts timestamp, seq long"
    folder = tmp_path / "in"
    for part in range(4):  # four files, one a batch
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    with stream_queries._rocksdb(spark):
        query = ingest.throttle_stream(stream, 3600).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.path, r.seq) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect()}
    twin = {(r.path, r.seq) for r in ingest.throttle(spark.createDataFrame(rows, schema), 3600).collect()}
    assert got == twin and 0 < len(got) < len(rows)
    assert len(glob.glob(f"{tmp_path}/check/commits/[0-9]*")) >= 4
    progress = [json.loads(p.json) for p in query.recentProgress]
    assert any(p.get("eventTime", {}).get("watermark", "1970") > "2024" for p in progress)


def plain_queue(rows, most):
    """Requests (path, seq, action) one by one, written as the rules are told."""
    queue, out = [], []
    for path, seq, action in sorted(rows, key=lambda r: r[1]):
        if action == "drain":
            out += [(p, s, "drained", seq) for p, s in queue] + [(None, seq, "drain", seq)]
            queue = []
        elif action == "remove":
            out += [(p, s, "drained", seq) for p, s in queue if p == path]
            queue = [(p, s) for p, s in queue if p != path]
        elif not path:
            out.append((path, seq, "ignored", seq))
        elif any(p == path for p, _ in queue):
            out.append((path, seq, "skipped", seq))
        else:
            queue.append((path, seq))
            if len(queue) > most:
                out.append((*queue.pop(0), "evicted", seq))
    return out + [(p, s, "queued", None) for p, s in queue]


def test_queue_forgets_what_it_pushed_out(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4), ("c", 5)], "path string, seq long")
    assert {(r.path, r.seq) for r in ingest.bounded_queue(df, 2).collect()} == {("c", 3), ("a", 4)}
    history = {r.seq: (r.path, r.state, r.decided) for r in ingest.queue_history(df, 2).collect()}
    assert history == {1: ("a", "evicted", 3), 2: ("b", "evicted", 4), 3: ("c", "queued", None), 4: ("a", "queued", None), 5: ("c", "skipped", 5)}


def test_queues_equal_requests_taken_one_by_one(spark):
    rng = random.Random(4)
    rows = [(f"k{rng.randrange(4)}", rng.choice([None, "", *"abcdefghij"]), n, rng.choice(["add"] * 12 + [None, "remove", "drain"])) for n in range(1500)]
    df = spark.createDataFrame(rows, "kind string, path string, seq long, does string").repartition(5)
    got = ingest.queue_history(df, 4, ["kind"], action="does")
    expect = sorted(str((k, *x)) for k in {r[0] for r in rows} for x in plain_queue([r[1:] for r in rows if r[0] == k], 4))
    assert sorted(str(tuple(r)) for r in got.collect()) == expect
    assert ingest.queue_history(df.limit(0), 4, ["kind"]).count() == 0


def test_queue_of_a_stream_whatever_the_batches(spark, tmp_path):
    """A path pushed out or drained in one batch is queued again in a later one."""
    rng = random.Random(8)
    rows = [("one", rng.choice("abcdefgh"), n, "drain" if n % 50 == 49 else "add") for n in range(200)]
    schema = "by string, path string, seq long, action string"
    expect = plain_queue([r[1:] for r in rows], 3)
    with stream_queries._rocksdb(spark):
        for cuts in ([0, 200], [0, 3, 4, 90, 200]):
            folder = tmp_path / f"in{len(cuts)}"
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                spark.createDataFrame(rows[lo:hi], schema).coalesce(1).write.parquet(f"{folder}/{k}")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
            out = f"{folder}-out"
            query = ingest.queue_stream(stream, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}-check").trigger(availableNow=True).start()
            query.awaitTermination()
            changes = spark.read.parquet(out)
            assert {(r.path, r.seq) for r in ingest.queued_now(changes).collect()} == {x[:2] for x in expect if x[2] == "queued"}
            decided = sorted(str((r.path, r.seq, r.state, r.decided)) for r in changes.filter("state <> 'queued'").collect())
            assert decided == sorted(str(x) for x in expect if x[2] != "queued")


def test_ring_kept_over_batches(spark, tmp_path):
    for part, rows in enumerate(([("a", 1), ("b", 2)], [("a", 3), ("c", 4)], [("d", 5), ("b", 6)])):
        spark.createDataFrame(rows, "path string, seq long").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("path string, seq long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    ingest.folded_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", lambda r: ingest.trace_ring(r, 3, ["seq"], "path", 1)).awaitTermination()
    ring = ingest.folded_table(spark, f"{tmp_path}/out", "path string, seq long")
    assert {(r.path, r.seq) for r in ring.collect()} == {("c", 4), ("d", 5), ("b", 6)}


def test_paced_run_is_cancelled_between_batches_and_goes_on(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(90)], "seq long, path string")
    batches = []

    def work(batch):
        batches.append(sorted(r.seq for r in batch.collect()))
        if len(batches) == 3:
            paced.cancel(spark, folder)

    shots = paced.paced_run(rows, work, folder, pause_s=0)
    assert [len(b) for b in batches] == [20, 20, 20]
    assert {(r.batch, r.found, r.requested, r.done) for r in shots.collect()} == {(0, 90, 0, False), (1, 90, 20, False), (2, 90, 40, False), (3, 90, 60, False), (-1, 90, 60, True)}
    paced.cancel(spark, folder, False)
    shots = paced.paced_run(rows, work, folder, pause_s=0)
    assert sorted(k for b in batches for k in b) == list(range(90)) and [len(b) for b in batches[3:]] == [20, 10]
    assert {(r.batch, r.requested, r.done) for r in shots.collect()} >= {(4, 80, False), (5, 90, False), (-1, 90, True)}


def test_an_error_in_paced_work_is_no_cancel(spark, tmp_path):
    rows = spark.createDataFrame([(k,) for k in range(5)], "seq long")
    with pytest.raises(Exception, match="planted"):
        paced.paced_run(rows, lambda b: (_ for _ in ()).throw(ValueError("planted")), str(tmp_path), pause_s=0)
    assert paced.paced_run(rows, lambda b: b.count(), str(tmp_path), 2, pause_s=0).filter("done").first().requested == 5


def test_paced_work_in_a_task_is_cancelled_fails_and_goes_on(spark, tmp_path):
    folder, seen = str(tmp_path / "a folder"), str(tmp_path / "seen")
    rows = spark.createDataFrame([(k, f"p{k}") for k in range(95, 0, -1)], "seq long, path string").repartition(5)

    def work(batch):
        if len(os.listdir(seen)) == 2:
            files.put_file(files._opened(folder)[0], f"{folder}/control", "cancelled", b"")
        if batch["seq"][0].as_py() == 61 and not os.path.exists(f"{folder}/planted"):
            open(f"{folder}/planted", "w").close()
            raise ValueError("planted")
        with open(f"{seen}/{len(os.listdir(seen))}", "w") as f:
            json.dump(batch.to_pydict(), f)

    os.mkdir(seen)
    shots = paced.paced_run(rows, work, folder, pause_s=0, in_task=True)
    assert {tuple(r) for r in shots.collect()} == {(0, 95, 0, False), (1, 95, 20, False), (2, 95, 40, False), (3, 95, 60, False), (-1, 95, 60, True)}
    paced.cancel(spark, folder, False)
    with pytest.raises(Exception, match="planted"):
        paced.paced_run(rows, work, folder, pause_s=0, in_task=True)
    shots = paced.paced_run(rows, work, folder, 7, pause_s=0, in_task=True)  # the batches are as listed
    assert {tuple(r) for r in shots.collect()} >= {(4, 95, 80, False), (5, 95, 95, False), (-1, 95, 95, True)}
    got = [json.load(open(f"{seen}/{k}")) for k in range(5)]
    assert [x for b in got for x in b["seq"]] == list(range(1, 96)) and [len(b["path"]) for b in got] == [20, 20, 20, 20, 15]
    empty = paced.paced_run(rows.limit(0), work, f"{folder}/none", pause_s=0, in_task=True)
    assert {tuple(r) for r in empty.collect()} == {(0, 0, 0, False), (-1, 0, 0, True)}


def _jobs_of(spark, do):
    """Spark jobs that it takes."""
    edges = []
    for k in range(2):
        spark.sparkContext.setJobGroup(f"edge {k}", "")
        spark.sparkContext.parallelize([1]).count()
        edges.append(max(spark.sparkContext.statusTracker().getJobIdsForGroup(f"edge {k}")))
        spark.sparkContext.setJobGroup("done", "")
        out = do() if k == 0 else out
    return edges[1] - edges[0] - 1, out


def test_small_batches_cost_no_jobs(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("s_suppkey"), F.lit("x").alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    jobs, out = _jobs_of(spark, lambda: stream_queries.paced_run(spark, str(tmp_path)).collect())
    assert jobs < 30 and sorted(r.batch for r in out) == list(range(-1, 101)) and {r.worked for r in out} == {3000}


def test_paced_frames_come_in_order_and_cost_their_own_jobs(spark, tmp_path):
    rows, firsts = spark.range(120).select((119 - F.col("id")).alias("seq")).repartition(7), []
    jobs, _ = _jobs_of(spark, lambda: paced.paced_run(rows, lambda b: firsts.append([r.seq for r in b.collect()]), str(tmp_path), 3, pause_s=0).collect())
    assert [sorted(b) for b in firsts] == [list(range(k, k + 3)) for k in range(0, 120, 3)] and jobs < 40 + 25
