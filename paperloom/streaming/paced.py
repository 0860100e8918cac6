"""Paced work: a list of candidates in batches, a snapshot after each, and a cancel between batches.

The list is written once, in order; one batch at a time is handed to the work. Before every batch the
control is read, so a batch that has begun is always finished. The snapshots remember what is done: a
cancelled or broken run goes on where it stopped. Control and snapshots are small files, so that a batch
costs no Spark job but those of its work; work on Arrow tables (``in_task``) costs none.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.report import batches_of
from paperloom.sources.files import _opened, put_file

_SNAPSHOT = "batch int, found long, requested long, done boolean"


def cancel(spark: SparkSession, folder: str, on: bool = True) -> None:
    """Ask the run in ``folder`` to stop before its next batch, or (``on`` false) let it go on."""
    system, path, _ = _opened(_address(spark, folder))
    if on:
        put_file(system, f"{path}/control", "cancelled", b"")
    elif is_cancelled(spark, folder):
        system.delete_file(f"{path}/control/cancelled")


def is_cancelled(spark: SparkSession, folder: str) -> bool:
    return _is_asked(_address(spark, folder))


def paced_run(candidates: DataFrame, work: Callable, folder: str, size: int = 20, order: str = "seq", pause_s: float = 0.2, in_task: bool = False) -> DataFrame:
    """Do ``work`` on batches of ``size`` candidates, by the number column ``order``, one after another,
    until all are done or the run is cancelled; returns its snapshots.

    ``work`` gets a batch as a DataFrame, or with ``in_task`` as an Arrow table: then it runs in one
    task that goes through all batches, which suits many small ones. A batch that is run again after a
    failure is handed over again: delivery is at least once. ``folder`` belongs to this list of
    candidates; called again, the run goes on with what is left."""
    spark, todo = candidates.sparkSession, f"{folder}/todo"
    try:
        spark.read.parquet(todo)
    except AnalysisException:
        batches = batches_of(candidates, size, order).withColumn("batch", F.coalesce("batch", F.lit(1)))
        batches.repartitionByRange("batch").sortWithinPartitions("batch", order).write.parquet(todo)
    columns, listed = candidates.columns, spark.read.parquet(todo)
    files = listed.groupBy(F.input_file_name().alias("file")).agg(F.min("batch").alias("first"), F.max("batch").alias("last"), F.count("*").alias("n"), F.count_if(F.col("batch") == 1).alias("step"))
    files = files.orderBy("first").collect()  # a batch is in one file
    run = _Run(_address(spark, folder), sum(f.n for f in files), sum(f.step for f in files), pause_s)
    done = run.done()
    if done == 0:
        run.snapshot(0, 0)
    if in_task:
        left = listed.filter(F.col("batch") > done).select("batch", *columns)
        left = left.repartition(1).sortWithinPartitions("batch", order)  # in order, and so in one task
        left.mapInArrow(lambda rows: run.tables(rows, work), "done long").count()
    else:
        left = (f for f in files if f.last > done)
        read = ((f, spark.read.schema(listed.schema).parquet(unquote(f.file))) for f in left)
        run.each(((k, rows.filter(F.col("batch") == k).select(*columns)) for f, rows in read for k in range(f.first, f.last + 1)), work)
    run.snapshot(-1, run.requested(run.done()), True)
    return read_snapshots(spark, folder)


@dataclass
class _Run:
    """What driver and tasks know of a run: its folder, the candidates found, and those of a full batch."""

    address: str
    found: int
    size: int
    pause_s: float

    def requested(self, number: int) -> int:
        return min(number * self.size, self.found)

    def done(self) -> int:
        """The last batch that is done, 0 before the first."""
        system, path, _ = _opened(self.address)
        there = system.get_file_info(fs.FileSelector(f"{path}/snapshots", allow_not_found=True))
        return max((int(i.base_name.removesuffix(".json")) for i in there if not i.base_name.startswith(".")), default=0)

    def snapshot(self, number: int, requested: int, done: bool = False) -> None:
        """What is known after a batch (0: before the first, -1: at the end); written anew if it is again."""
        system, path, _ = _opened(self.address)
        row = {"batch": number, "found": self.found, "requested": requested, "done": done}
        put_file(system, f"{path}/snapshots", f"{number}.json", json.dumps(row).encode())

    def each(self, batches: Iterable[tuple], work: Callable) -> None:
        done = self.done()
        for number, batch in batches:
            if number <= done:
                continue
            if _is_asked(self.address):
                return
            work(batch)
            self.snapshot(number, self.requested(number))
            if self.requested(number) < self.found:
                time.sleep(self.pause_s)

    def tables(self, rows: Iterator[pa.RecordBatch], work: Callable) -> Iterator[pa.RecordBatch]:
        """The work on rows that come in order of their column ``batch``, in this task."""
        self.each(_batches(rows), work)
        for _ in rows:  # after a cancel
            pass
        yield pa.RecordBatch.from_pydict({"done": pa.array([self.done()], pa.int64())})


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    held: list[pa.RecordBatch] = []
    number = None
    for part in rows:
        numbers = part.column(0).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            if held and numbers[a] != number:
                yield number, pa.Table.from_batches(held).drop_columns(["batch"])
                held = []
            number = int(numbers[a])
            held.append(part.slice(a, b - a))
    if held:
        yield number, pa.Table.from_batches(held).drop_columns(["batch"])


def _address(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as Spark takes it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _is_asked(address: str) -> bool:
    system, path, _ = _opened(address)
    return system.get_file_info(f"{path}/control/cancelled").type == fs.FileType.File


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, found, requested, done) of a run."""
    return spark.read.schema(_SNAPSHOT).json(f"{folder}/snapshots")
