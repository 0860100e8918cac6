"""Keeping up with arriving files, as Structured Streaming jobs with batch twins."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paperloom.functions.fold import fold_out
from paperloom.operators.timeline import latest_n
from paperloom.sources.archive import claimed_files


def throttle(requests: DataFrame, window_s: int = 3600, key: str = "path", ts: str = "ts", order: str = "seq") -> DataFrame:
    """Batch twin: requests accepted unless their path was accepted less than the window ago.

    Only accepted requests move the clock, so each path's requests are folded in order; the state
    is one time, and what is returned are the accepted places."""
    kinds = dict(requests.dtypes)
    rows = requests.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(order).alias("o")))).alias("_r"))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        now = F.unix_micros(x["t"].cast("timestamp"))
        ok = last.isNull() | (now - last >= window_s * 1_000_000)
        return F.when(ok, now).otherwise(last), F.when(ok, F.array(x["o"])).otherwise(F.array().cast(f"array<{kinds[order]}>"))

    return rows.select(key, F.explode(fold_out(F.col("_r"), F.lit(None).cast("long"), step, kinds[order])).alias(order))


class _Throttle(StatefulProcessor):
    """Per path: the time of the last accepted request, kept until the watermark is one window past it."""

    def __init__(self, window_s: int):
        self.window = window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["micros", "seq"])
        last = self.last.get()[0] if self.last.exists() else None
        kept = []
        for micros, seq, ts in zip(every["micros"].tolist(), every["seq"], every["ts"]):
            if last is None or micros - last >= self.window:
                last = micros
                kept.append((key[0], seq, ts))
        if kept:
            self.last.update((last,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.window) // 1000)
        yield pd.DataFrame(kept, columns=["path", "seq", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame([], columns=["path", "seq", "ts"])

    def close(self) -> None:
        pass


def throttle_stream(requests: DataFrame, window_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """(path, seq, ts) of accepted requests of a stream of (path, ts timestamp, seq).

    Requests later than ``late`` behind the newest are dropped by the watermark, which also lets a
    path's state expire."""
    own = requests.withWatermark("ts", late).withColumn("micros", F.unix_micros("ts")).groupBy("path")
    return own.transformWithStateInPandas(_Throttle(window_s), "path string, seq long, ts timestamp", "append", "eventTime")


#: what becomes of a request: still queued, pushed out by newer ones, given out by a drain, met while
#: its path was queued, without a path, or itself a drain
QUEUE_STATES = ("queued", "evicted", "drained", "skipped", "ignored", "drain")


class FifoQueue:
    """Paths in the order they came, each once, at most ``most``; a path that left may come again."""

    def __init__(self, most: int, entries: list[tuple[str, int]] = ()):
        self.most, self.entries = most, OrderedDict(entries)

    def request(self, path: str | None, seq: int, action: str | None) -> list[tuple[str | None, int, str, int]]:
        """(path, seq, state, decided) of requests that are decided by this one."""
        if action == "drain":
            out = [(p, n, "drained", seq) for p, n in self.entries.items()]
            self.entries.clear()
            return [*out, (None, seq, "drain", seq)]
        if action == "remove":
            gone = self.entries.pop(path, None)
            return [] if gone is None else [(path, gone, "drained", seq)]
        if not path:
            return [(path, seq, "ignored", seq)]
        if path in self.entries:
            return [(path, seq, "skipped", seq)]
        self.entries[path] = seq
        if len(self.entries) <= self.most:
            return []
        return [(*self.entries.popitem(last=False), "evicted", seq)]


def queue_history(requests: DataFrame, most: int = 500, by: list[str] = (), key: str = "path", order: str = "seq", action: str | None = None) -> DataFrame:
    """One row a request: (by, path, seq, state, decided): its state of ``QUEUE_STATES`` and the order number
    of the request that decided it (null while queued).

    A path already queued is skipped and keeps its place; beyond ``most`` the oldest goes, and may be
    queued again later. ``action`` names a column: null or "add", "remove" (this path was used; no row
    of its own) or "drain" (all were used, oldest first). Each value of ``by`` has its own queue.

    Which requests are taken depends on all before, so a queue is read through in one task, in order,
    row by row: the task holds at most ``most`` entries. Queues are dealt to tasks by ``by``."""
    does = F.lit(None).cast("string") if action is None else F.col(action)
    box = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("one"))
    rows = requests.select(box.alias("by"), F.col(key).cast("string").alias("path"), F.col(order).cast("long").alias("seq"), does.alias("action"))
    rows = (rows.repartition("by") if by else rows.repartition(1)).sortWithinPartitions("by", "seq", "path")
    schema = f"by {rows.schema['by'].dataType.simpleString()}, path string, seq long, state string, decided long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, queue, kind = None, None, None

        def given(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.string(), pa.int64(), pa.string(), pa.int64())))], ["by", "path", "seq", "state", "decided"])

        for batch in batches:
            kind = batch.column("by").type
            found = []
            for own, path, seq, does in zip(*(batch.column(c).to_pylist() for c in ("by", "path", "seq", "action"))):
                if queue is None or own != now:
                    if queue is not None:
                        found += [(now, p, n, "queued", None) for p, n in queue.entries.items()]
                    now, queue = own, FifoQueue(most)
                found += [(now, *x) for x in queue.request(path, seq, does)]
            yield given(found)
        if queue is not None:
            yield given([(now, p, n, "queued", None) for p, n in queue.entries.items()])

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"by.{c}").alias(c) for c in by), F.col("path").alias(key), F.col("seq").alias(order), "state", "decided")


def bounded_queue(requests: DataFrame, most: int = 500, by: list[str] = (), key: str = "path", order: str = "seq", action: str | None = None) -> DataFrame:
    """(by, path, seq) of what is queued after all requests."""
    return queue_history(requests, most, by, key, order, action).filter("state = 'queued'").drop("state", "decided")


class _Queue(StatefulProcessor):
    """The same queue as a state of a stream: its entries in order."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "path string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values(["seq", "path"])
        queue = FifoQueue(self.most, [tuple(e) for e in self.entries.get()] if self.entries.exists() else [])
        found = []
        for path, seq, action in zip(every["path"], every["seq"].tolist(), every["action"]):
            found += queue.request(path, seq, action)
            if queue.entries.get(path) == seq:
                found.append((path, seq, "queued", seq))
        if queue.entries:
            self.entries.put(list(queue.entries.items()))
        else:
            self.entries.clear()
        yield pd.DataFrame([(key[0], *x) for x in found], columns=["by", "path", "seq", "state", "decided"])

    def close(self) -> None:
        pass


def queue_stream(requests: DataFrame, most: int = 500) -> DataFrame:
    """Changes (by, path, seq, state, decided) of the queues of a stream of (by string, path, seq, action):
    a request that is taken gives "queued" at once, and later perhaps "evicted" or "drained".

    Requests are taken in order within a batch and batch after batch."""
    return requests.groupBy("by").transformWithStateInPandas(_Queue(most), "by string, path string, seq long, state string, decided long", "append", "none")


def queued_now(changes: DataFrame) -> DataFrame:
    """What is queued by the changes that ``queue_stream`` has given out."""
    last = changes.groupBy("by", "path", "seq").agg(F.max(F.struct("decided", F.col("state") != "queued", "state"))["state"].alias("state"))
    return last.filter("state = 'queued'").drop("state")


def folded_stream(rows: DataFrame, path: str, checkpoint: str, fold: Callable[[DataFrame], DataFrame]):
    """Start a query that keeps a bounded table: after each batch, ``fold`` of the table before and
    the batch's rows. A batch that is run again writes the same folder."""
    spark, kinds = rows.sparkSession, rows.schema

    def merge(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(kinds).parquet(f"{path}/after={number - 1}") if number else batch.limit(0)
        fold(before.unionByName(batch)).write.mode("overwrite").parquet(f"{path}/after={number}")

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that ``folded_stream`` keeps, after its last batch."""
    rows = spark.read.schema(schema + ", after int").parquet(path)
    last = rows.agg(F.max("after").alias("after"))
    return rows.join(F.broadcast(last), "after").drop("after")  # one row


def ingest_stream(spark: SparkSession, folder: str, index_path: str, checkpoint: str, describe: Callable[[DataFrame], DataFrame], per_batch: int = 20):
    """Start a query that describes new files and merges the rows into an index by path.

    A batch that is run again writes the same folder, so delivery at least once does no harm."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch).load(folder)

    def merge(batch: DataFrame, number: int) -> None:
        described = describe(claimed_files(batch)).withColumn("batch", F.lit(number))
        described.write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index_path: str, schema: str) -> DataFrame:
    """The newest row of every path."""
    rows = spark.read.schema(schema + ", batch int").parquet(index_path)
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.col("batch").desc()))
    return rows.withColumn("_n", newest).filter("_n = 1").drop("_n", "batch")


def trace_ring(events: DataFrame, n: int = 40, order: list[str] = ("ts", "seq"), detail: str = "detail", most: int = 500) -> DataFrame:
    """The newest breadcrumbs, details cut to ``most`` characters."""
    return latest_n(events, n, list(order)).withColumn(detail, F.substring(detail, 1, most))
