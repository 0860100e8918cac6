"""Queries over requests, files and registries."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from paperloom.functions import registry as G
from paperloom.operators import classify as C
from paperloom.operators import render as R
from paperloom.operators import text as X
from paperloom.sources import archive as A
from paperloom.sources.files import _opened, put_file
from paperloom.streaming import ingest as I
from paperloom.streaming import paced
from paperloom.plans.views import events, lines, planted, table, with_views


def _folder(spark) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/plans-{uuid.uuid4().hex}"


def _requests(spark, d):
    return events(spark, d).select(F.concat(F.lit("f"), F.col("doc").cast("string")).alias("path"), "ts", "seq")


def throttle(spark, d):
    return I.throttle(_requests(spark, d), 6 * 3600)


@contextmanager
def _rocksdb(spark):
    """State stores with more than one column family, for the streams started inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def throttle_stream(spark, d):
    """The stateful stream over the same requests, run until it has read all."""
    out, check = _folder(spark), _folder(spark)
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long").option("pathGlobFilter", "events.parquet").parquet(d)
    requests = stream.select(F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    with _rocksdb(spark):
        query = I.throttle_stream(requests, 6 * 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("path string, seq long, ts timestamp").parquet(out).select("path", "seq")


def bounded_queue(spark, d):
    return I.bounded_queue(_requests(spark, d), 40)


def queue_history(spark, d):
    """A queue for each kind of event, with paths that were used and drains of the whole queue."""
    e = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"))
    e = e.withColumn("path", F.when(F.col("seq") % 29 != 0, F.col("path")))
    does = F.when(F.col("seq") % 97 == 0, "drain").when(F.col("seq") % 7 == 0, "remove").otherwise("add")
    return I.queue_history(e.withColumn("does", does), 25, ["kind"], action="does")


def _event_stream(spark, d):
    return spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, props string").option("pathGlobFilter", "events.parquet").parquet(d)


def queue_stream(spark, d):
    """The queue as the state of a stream of many batches; a drain comes with every 500th request."""
    arriving, out, check = _folder(spark), _folder(spark), _folder(spark)
    e = table(spark, d, "events").select(F.lit("all").alias("by"), F.concat(F.lit("f"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("seq"))
    e = e.withColumn("action", F.when(F.col("seq") % 500 == 499, "drain").otherwise("add"))
    n = e.count()
    # files that arrive one after another, each with the next requests in order
    e.repartitionByRange(1, "seq").sortWithinPartitions("seq").write.option("maxRecordsPerFile", n // 5 + 1).parquet(arriving)
    with _rocksdb(spark):
        stream = spark.readStream.schema("by string, path string, seq long, action string").option("maxFilesPerTrigger", 1).parquet(arriving)
        query = I.queue_stream(stream, 40).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
    changes = spark.read.schema("by string, path string, seq long, state string, decided long").parquet(out)
    return changes.filter("state not in ('queued', 'skipped')").select("path", "seq", "state").unionByName(I.queued_now(changes).select("path", "seq", F.lit("queued").alias("state")))


def paced_run(spark, d):
    """Suppliers in batches of 30, worked on one batch after another; the snapshots and what was done."""
    folder = _folder(spark)
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("seq"), "s_name")

    def work(batch: pa.Table) -> None:
        system, path, _ = _opened(f"{folder}/done")
        body = pa.BufferOutputStream()
        pq.write_table(batch, body)
        put_file(system, path, f"{batch['seq'][0]}.parquet", body.getvalue())

    snapshots = paced.paced_run(rows, work, folder, 30, pause_s=0, in_task=True)
    worked = spark.read.schema(rows.schema).parquet(f"{folder}/done").select("seq").distinct().count()
    return snapshots.withColumn("worked", F.lit(worked).cast("long"))


def trace_ring_stream(spark, d):
    out, check = _folder(spark), _folder(spark)
    rows = _event_stream(spark, d).select(F.col("user_id").alias("doc"), "ts", F.col("event_id").alias("seq"), F.repeat("props", 60).alias("detail"))
    I.folded_stream(rows, out, check, I.trace_ring).awaitTermination()
    return I.folded_table(spark, out, "doc long, ts timestamp_ntz, seq long, detail string").select("doc", "seq", "detail")


def trace_ring(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc"), "ts", F.col("event_id").alias("seq"), F.repeat("props", 60).alias("detail"))
    return I.trace_ring(e).select("doc", "seq", "detail")


def _files(spark, d) -> str:
    """Documents written out as one text file for each source and language."""
    path = _folder(spark)
    docs = table(spark, d, "documents").select("source", "lang", "text")
    docs.repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    return path


def read_archive(spark, d):
    files = A.read_archive(spark, [_files(spark, d)], recursive=True)
    files = A.claimed_files(files, "path")
    return files.groupBy(F.regexp_extract("path", "source=([^/]*)", 1).alias("source")).agg(F.sum("length").alias("bytes"))


def ingest_stream(spark, d):
    index, check = _folder(spark), _folder(spark)
    files = _files(spark, d)
    describe = lambda b: b.select("path", F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "length")
    I.ingest_stream(spark, f"{files}/source=*/lang=*", index, check, describe).awaitTermination()
    rows = I.read_index(spark, index, "path string, source string, length long")
    return rows.groupBy("source").agg(F.sum("length").alias("bytes"))


def read_prefixes(spark, d):
    """The first 1000 bytes of each file, all names listed, and whether they are worth converting."""
    files = A.read_archive(spark, [_one_file_each(spark, d)], recursive=True, prefix=1000)
    doc = F.regexp_extract("path", r"([0-9]+)\.ws$", 1).cast("long")
    return C.convertible(files).select(doc.alias("doc"), F.length("content").cast("long").alias("bytes"), "length", "variant", "is_convertible")


def _one_file_each(spark, d) -> str:
    path = _folder(spark)
    n = F.col("doc_id")
    body = F.when(n % 4 == 0, F.concat(F.repeat(F.lit("\x01"), 3000), F.col("text"))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select(F.lit("old").alias("format"), F.concat(F.when(n % 3 == 0, "_").otherwise(""), n.cast("string"), F.lit(".ws")).alias("name"), F.regexp_replace(body, r"[^\x00-\x7F]", "x").alias("body"))
    A.write_files(docs, path)
    return f"{path}/old"


def write_files(spark, d):
    """One file a document; rows that cannot be files are reported; what exists is refused, then replaced."""
    path = _folder(spark)
    n = F.col("doc_id")
    name = F.when(n % 11 == 0, F.lit("")).when(n % 13 == 0, F.concat(F.lit("a/"), n.cast("string"))).when(n % 17 == 0, F.repeat(F.lit("n"), 300)).otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    docs = table(spark, d, "documents").select(n.alias("doc"), F.lit("text").alias("format"), name.alias("name"), F.when(n % 9 != 0, F.col("text")).alias("body"))
    parts = {"first": A.write_files(docs, path, run="first"), "refused": A.write_files(docs.filter("doc % 2 = 0"), path, run="second"), "replaced": A.write_files(docs.filter("doc % 2 = 1").withColumn("body", F.lit("new")), path, "replace", run="third")}
    files = A.read_archive(spark, [f"{path}/text"])
    out = files.groupBy(F.when(F.col("content") == F.encode(F.lit("new"), "UTF-8"), "new").otherwise("old").alias("reason")).agg(F.count("*").alias("n")).withColumn("state", F.lit("file"))
    for state, part in parts.items():
        out = out.unionByName(part.groupBy(F.regexp_replace("reason", "not written: .*", "not written").alias("reason")).agg(F.count("*").alias("n")).withColumn("state", F.lit(state)))
    return out


def write_exports(spark, d):
    """Exports in two formats; what cannot be written is reported row by row; what exists is refused;
    a second run replaces the files of its names."""
    path, again = _folder(spark), _folder(spark)
    n = F.col("doc_id")
    name = F.when(n % 11 == 0, F.lit("")).when(n % 13 == 0, F.concat(F.lit("a/"), n.cast("string"))).otherwise(n.cast("string"))
    docs = table(spark, d, "documents").select(name.alias("name"), F.explode(F.array(F.lit("text"), F.lit("html"))).alias("format"), F.when(n % 9 != 0, F.col("text")).alias("body"))
    failed = A.write_exports(docs, path)
    written = spark.read.schema("name string, body string, format string").parquet(path)
    fresh, refused = A.without_overwrite(docs.filter("format = 'text'").unionByName(docs.filter("format = 'html'").withColumn("format", F.lit("rtf"))), written, ["format", "name"])
    A.write_replacing(docs, again, 1)
    for _ in range(2):  # the second run, and once more as after a failure
        A.write_replacing(docs.filter("length(name) % 2 = 1 and format = 'text'").withColumn("body", F.lit("new")), again, 2)
    newest = A.read_exports(spark, again)
    parts = {"written": written, "failed": failed.withColumn("format", F.col("reason")), "fresh": fresh, "refused": refused, "newest": newest, "replaced": newest.filter("body = 'new'")}
    out = None
    for name, part in parts.items():
        rows = part.groupBy("format").agg(F.count("*").alias("n")).withColumn("state", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def renderer_registry(spark, d):
    known = G.Renderers().register("text", R.render_text, ".txt", ("txt", "plain")).register("facsimile", lambda df: R.render_text(df, mode="facsimile"), ".txt", ("fax",))
    rows = lines(spark, d).withColumnRenamed("li", "line")
    out = known.render("plain", rows).withColumn("format", F.lit("plain")).unionByName(known.render("fax", rows).withColumn("format", F.lit("fax")))
    return out.withColumn("body", F.md5("body"))


def rule_registry(spark, d):
    rules = G.Rules()
    rules.register(G.Rule("spacing", "one space after a sentence", True, F.when(F.col("doc") % 2 == 0, F.lit("even")), lambda t: X.single_sentence_space(t)))
    rules.register(G.Rule("codes", "the caller's printer codes", False, F.lit("always"), lambda t: G.code_table(t, {44: ";"})))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"))
    out = rules.apply(planted(spark, d), rules.decisions(docs, enable=("codes",)))
    return out.select("doc", "li", F.md5("text").alias("text"))


QUERIES = {f.__name__: f for f in (throttle, throttle_stream, bounded_queue, queue_history, queue_stream, paced_run, trace_ring, trace_ring_stream, read_archive, ingest_stream, read_prefixes, write_files, write_exports, renderer_registry, rule_registry)}

_THROTTLE = """, R as (select 'f' || doc as path, ts, seq, row_number() over (partition by doc order by ts, seq) as n from EV),
    T as (with recursive W as (select path, ts as last, seq, n, true as ok from R where n = 1 union all
      select R.path, case when R.ts - W.last >= interval 6 hour then R.ts else W.last end, R.seq, R.n, R.ts - W.last >= interval 6 hour from W join R on R.path = W.path and R.n = W.n + 1) select * from W)
    select path, seq from T where ok"""


def _queue(requests: str, most: int, wanted: str) -> str:
    """The queue step by step: q is what is queued after a request, o what the request decides."""
    return f"""with recursive R as (select *, row_number() over (partition by kind order by seq, path nulls first) as n from ({requests})),
    W as (select kind, 0 as n, cast([] as struct(p varchar, s bigint)[]) as q, cast([] as struct(p varchar, s bigint, st varchar, a bigint)[]) as o from R group by kind union all
      select kind, n, case when drain then [] when remove then list_filter(q, lambda e: e.p is distinct from path) when skip or ignore then q when len(q) >= {most} then list_append(q[2:], {{'p': path, 's': seq}}) else list_append(q, {{'p': path, 's': seq}}) end,
        case when drain then list_append(list_transform(q, lambda e: {{'p': e.p, 's': e.s, 'st': 'drained', 'a': seq}}), {{'p': null, 's': seq, 'st': 'drain', 'a': seq}}) when remove then list_transform(list_filter(q, lambda e: e.p = path), lambda e: {{'p': e.p, 's': e.s, 'st': 'drained', 'a': seq}})
          when ignore then [{{'p': path, 's': seq, 'st': 'ignored', 'a': seq}}] when skip then [{{'p': path, 's': seq, 'st': 'skipped', 'a': seq}}] when len(q) >= {most} then [{{'p': q[1].p, 's': q[1].s, 'st': 'evicted', 'a': seq}}] else [] end
      from (select W.kind, R.n, q, path, seq, does = 'drain' as drain, does = 'remove' as remove, coalesce(path, '') = '' as ignore, len(list_filter(q, lambda e: e.p = path)) > 0 as skip from W join R on R.kind = W.kind and R.n = W.n + 1)),
    H as (select kind, x.p as path, x.s as seq, x.st as state, x.a as decided from (select kind, unnest(o) as x from W) union all select kind, x.p, x.s, 'queued', null from (select W.kind, unnest(q) as x from W join (select kind, max(n) as n from R group by kind) using (kind, n))) {wanted}"""


_BYTES = "select source, cast(sum(strlen(text) + 1) as bigint) as bytes from documents group by source"
ORACLES = {
    "throttle": with_views(_THROTTLE, "EV"),
    "throttle_stream": with_views(_THROTTLE, "EV"),
    "bounded_queue": _queue("select 'all' as kind, 'f' || user_id as path, event_id as seq, 'add' as does from events", 40, "select path, seq from H where state = 'queued'"),
    "queue_history": _queue("select event_type as kind, case when event_id % 29 <> 0 then 'f' || user_id end as path, event_id as seq, case when event_id % 97 = 0 then 'drain' when event_id % 7 = 0 then 'remove' else 'add' end as does from events", 25, "select kind, path, seq, state, decided from H"),
    "queue_stream": _queue("select 'all' as kind, 'f' || user_id as path, event_id as seq, case when event_id % 500 = 499 then 'drain' else 'add' end as does from events", 40, "select path, seq, state from H where state <> 'skipped'"),
    "paced_run": """with N as (select count(*) as n from supplier), B as (select unnest(range(0, (n + 29) // 30 + 1)) as b, n from N)
        select cast(b as integer) as batch, n as found, least(30 * b, n) as requested, false as done, n as worked from B union all select -1, n, n, true, n from N""",
    "trace_ring_stream": "select user_id as doc, event_id as seq, substr(repeat(props, 60), 1, 500) as detail from events order by ts desc, event_id desc limit 40",
    "trace_ring": "select user_id as doc, event_id as seq, substr(repeat(props, 60), 1, 500) as detail from events order by ts desc, event_id desc limit 40",
    "read_archive": _BYTES,
    "ingest_stream": _BYTES,
    "read_prefixes": """with B as (select doc_id as doc, regexp_replace(case when doc_id % 4 = 0 then repeat(chr(1), 3000) || text else text end, '[^\\x00-\\x7F]', 'x', 'g') as b from documents), P as (select doc, length(b) as length, b[1:1000] as c from B)
        select doc, length(c) as bytes, length, case when doc % 4 = 0 then 'binary' else 'text' end as variant, doc % 4 <> 0 as is_convertible from P""",
    "write_files": """with D as (select doc_id, text, case when doc_id % 11 = 0 then 'no name' when doc_id % 13 = 0 then 'the name is a path' when doc_id % 9 = 0 then 'nothing to write' when doc_id % 17 = 0 then 'not written' end as reason, case when doc_id % 11 = 0 then 'no name' when doc_id % 13 = 0 then 'the name is a path' when doc_id % 17 = 0 then 'not written' end as bad from documents)
        select case when doc_id % 2 = 1 then 'new' else 'old' end as reason, count(*) as n, 'file' as state from D where reason is null or (reason = 'nothing to write' and bad is null and doc_id % 2 = 1) group by 1
        union all select reason, count(*), 'first' from D where reason is not null group by 1 union all select coalesce(reason, 'already exists'), count(*), 'refused' from D where doc_id % 2 = 0 group by 1 union all select bad, count(*), 'replaced' from D where doc_id % 2 = 1 and bad is not null group by 1""",
    "write_exports": """with D as (select *, case when doc_id % 11 = 0 then 'no name' when doc_id % 13 = 0 then 'the name is a path' when doc_id % 9 = 0 then 'nothing to write' end as reason, case when doc_id % 11 = 0 then '' when doc_id % 13 = 0 then 'a/' || doc_id else '' || doc_id end as name from documents),
        F as (select unnest(['text', 'html']) as format)
        select format, count(*) as n, 'written' as state from D, F where reason is null group by format union all select reason, 2 * count(*), 'failed' from D where reason is not null group by reason
        union all select 'text', count(*), 'fresh' from D where reason is not null union all select 'rtf', count(*), 'fresh' from D union all select 'text', count(*), 'refused' from D where reason is null
        union all select 'html', count(*), 'newest' from D where reason is null union all select 'text', count(*), 'newest' from D where reason is null or (reason = 'nothing to write' and length(name) % 2 = 1)
        union all select 'text', count(*), 'replaced' from D where coalesce(reason, 'nothing to write') = 'nothing to write' and length(name) % 2 = 1""",
    "renderer_registry": with_views("select doc, md5(string_agg(text, chr(10) || chr(10) order by li)) as body, 'plain' as format from L group by doc union all select doc, md5(string_agg(text, chr(10) order by li)), 'fax' from L group by doc", "L"),
    "rule_registry": with_views("select doc, li, md5(replace(case when doc % 2 = 0 then regexp_replace(text, '([.?!]) {2,}', '\\1 ', 'g') else text end, ',', ';')) as text from LP", "LP"),
}
