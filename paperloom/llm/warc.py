"""WARC archives as a chunked record table.

Writing: a payload is split into segments of at most ``chunk_bytes``; the first segment is the
record and the others are WARC ``continuation`` records, so a row never holds more than one
segment. Archives are written by Spark's text sink: a row is one record and the line separator
is the record separator, which leaves commits, retries and any file system to Spark.

Reading: Spark's text source streams the pieces between record separators; a small state machine
in every task follows the Content-Length of each record and emits rows (record_id, chunk_no,
data) with the running SHA-1 of the payload. Only one piece is held at a time; of archives written
here none is longer than a segment, of others it reaches to the next separator. The last chunk of
a record carries the record's facts; ``read_records`` puts a record together from its chunk rows and
checks them against these.

Equal payloads (by SHA-256) of at least ``min_revisit_bytes`` are stored once: the record with
the smallest id is the response, the others are revisits with headers only.

Defined cases: null payload is empty; null url leaves out the target header; among repeated rows
with the smallest id each is a response; rows with a null id are written under the id ``null``
and come back with a null id (they revisit a numbered page if one has the payload); an empty
table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.scratch import new_path

SEPARATOR = "\r\n\r\n"
_END = SEPARATOR.encode()
_SALTS = 64
CHUNK_BYTES = 1 << 20


def digest_of(state) -> str:
    return base64.b32encode(state.digest()).decode()


def _clean(url: str) -> str:
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in url)


def records(page: str, url: str | None, payload: bytes, first: str | None, date: str, chunk_bytes: int) -> Iterator[bytes]:
    """The WARC records of one page, without the separator that ends each."""
    view = memoryview(payload)
    whole = sha1()
    for k in range(0, len(view), chunk_bytes):
        whole.update(view[k : k + chunk_bytes])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(view)}{SEPARATOR}".encode()
    name = f"urn:page:{page}"
    common = [] if url is None else [f"WARC-Target-URI: {_clean(url)}"]
    common.append(f"WARC-Date: {date}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{name}>", *common, f"WARC-Payload-Digest: sha1:{digest_of(whole)}", "Content-Type: application/http; msgtype=response"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>", f"Content-Length: {len(http)}"]
        yield SEPARATOR.join(["\r\n".join(head), ""]).encode() + http
        return
    segments = max(1, -(-len(view) // chunk_bytes))
    if segments > 1:
        head.append("WARC-Segment-Number: 1")
    body = view[:chunk_bytes]
    head.append(f"Content-Length: {len(http) + len(body)}")
    yield b"".join((SEPARATOR.join(["\r\n".join(head), ""]).encode(), http, body))
    for k in range(1, segments):
        body = view[k * chunk_bytes : (k + 1) * chunk_bytes]
        head = ["WARC/1.1", "WARC-Type: continuation", f"WARC-Record-ID: <{name}:segment:{k + 1}>", *common, f"WARC-Segment-Number: {k + 1}", f"WARC-Segment-Origin-ID: <{name}>"]
        if k == segments - 1:
            head.append(f"WARC-Segment-Total-Length: {len(http) + len(view)}")
        head.append(f"Content-Length: {len(body)}")
        yield b"".join((SEPARATOR.join(["\r\n".join(head), ""]).encode(), body))


def write_archives(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES, date: str = "2024-01-01T00:00:00Z"
) -> str:
    """Write one archive per task; returns the folder."""
    path = path or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"hash": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64("id", "url"), F.lit(_SALTS)).cast("int")})
    big = rows if min_revisit_bytes <= 0 else rows.filter(F.octet_length("payload") >= min_revisit_bytes)
    first = big.groupBy("hash").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 and first is not null")
    first = first.select("hash", "first", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))  # a payload with many copies is dealt to many tasks
    rows = rows.join(first, ["hash", "salt"], "left").select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for k in range(batch.num_rows):
                page, url, first = (batch.column(c)[k].as_py() for c in ("id", "url", "first"))
                payload = batch.column("payload")[k].as_buffer()
                for record in records("null" if page is None else str(page), url, payload, None if first is None else str(first), date, chunk_bytes):
                    out.append(record)
                    held += len(record)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    lines.write.option("lineSep", SEPARATOR).option("compression", "gzip").text(path)
    return path


class _Reader:
    """Follows the bytes of one archive as they come: head, block, separator, head, ..."""

    def __init__(self, archive: str | None, chunk_bytes: int):
        self.archive, self.chunk_bytes = archive, chunk_bytes
        self.state, self.held, self.left = "head", b"", 0
        self.record: dict | None = None
        self.number = -1

    def feed(self, data: bytes) -> Iterator[tuple]:
        while data:
            if self.state == "block":
                part, data = data[: self.left], data[self.left :]
                self.left -= len(part)
                yield from self.body(part)
                if not self.left:
                    self.state, self.held = "separator", b""
                continue
            self.held += data
            if self.state == "separator":
                if len(self.held) < len(_END):
                    return
                if not self.held.startswith(_END):
                    raise ValueError("a block does not end at its Content-Length")
                self.state, data, self.held = "head", self.held[len(_END) :], b""
                continue
            at = self.held.find(_END)
            if at < 0:
                return
            head, data, self.held = self.held[:at], self.held[at + len(_END) :], b""
            yield from self.open(head)

    def open(self, head: bytes) -> Iterator[tuple]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        self.left, self.block = int(named["content-length"]), b""
        self.state = "block" if self.left else "separator"
        if named["warc-type"] == "continuation":
            return
        yield from self.close()
        self.number += 1
        self.record = {
            "id": named["warc-record-id"].strip("<>"),
            "type": named["warc-type"],
            "refers": named.get("warc-refers-to", "").strip("<>") or None,
            "url": named.get("warc-target-uri"),
            "stated": named.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "http": named.get("content-type", "").startswith("application/http"),
            "sha": sha1(),
            "bytes": 0,
            "chunk": 0,
            "length": None,
        }

    def body(self, data: bytes) -> Iterator[tuple]:
        r = self.record
        if r["http"]:  # the HTTP head ends at the first separator
            self.block += data
            at = self.block.find(_END)
            if at < 0:
                if not self.left:
                    r["http"] = False
                    at = len(self.block)
                else:
                    return
            for line in self.block[:at].split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                if k.strip().lower() == b"content-length":
                    r["length"] = int(v)
            r["http"], data, self.block = False, self.block[at + len(_END) :], b""
        for k in range(0, len(data), self.chunk_bytes):
            part = data[k : k + self.chunk_bytes]
            r["sha"].update(part)
            r["bytes"] += len(part)
            yield self.row(part, False)
            r["chunk"] += 1

    def row(self, data: bytes | None, last: bool) -> tuple:
        r = self.record
        own = r["type"] != "revisit"
        facts = (r["type"], r["url"], r["refers"], r["bytes"] if own else r["length"], digest_of(r["sha"]) if own else r["stated"], not own or r["stated"] in (None, digest_of(r["sha"]))) if last else (None,) * 6
        return (self.archive, self.number, r["id"], r["chunk"], data, r["sha"].hexdigest(), last, *facts)

    def close(self) -> Iterator[tuple]:
        if self.record is not None:
            yield self.row(None, True)
        self.record = None


_CHUNK = pa.schema([("archive", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int64()), ("data", pa.binary()), ("sha1_so_far", pa.string()), ("is_end", pa.bool_()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())])


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of all archives in a folder: (archive, record_no) is a record's place,
    (record_id, chunk_no) its rows, which carry ``data`` and the SHA-1 of the payload so far.

    Rows with ``is_end`` follow a record's last chunk, have no data, and carry its facts:
    record_type, url, refers_to, payload_bytes, payload_digest (SHA-1, base32) and digest_ok.
    """
    pieces = spark.read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, file, between, out, held = _Reader(None, chunk_bytes), None, b"", [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CHUNK)], schema=_CHUNK)

        for batch in batches:
            names = batch.column("file").to_pylist()
            for k in range(batch.num_rows):
                if names[k] != file:
                    out += reader.close()
                    reader, file, between = _Reader(names[k], chunk_bytes), names[k], b""
                for row in reader.feed(between + batch.column("piece")[k].as_py()):
                    out.append(row)
                    held += len(row[4] or b"")
                    if held > 8 << 20:
                        yield rows()
                        out, held = [], 0
                between = _END
        out += reader.close()
        if out:
            yield rows()

    return pieces.mapInArrow(run, "archive string, record_no long, record_id string, chunk_no long, data binary, sha1_so_far string, is_end boolean, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, digest_ok boolean")


def read_records(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per record, put together from its chunk rows.

    ``digest_ok`` asks that the digest stated in the head is the payload's, that chunk numbers run from
    0 without a gap up to the end row's, that the chunks' bytes add up to the payload, that the first
    chunk's own SHA-1 is the running one, and that the last running digest is the payload's. Chunks are
    measured where they are read; only these figures are grouped, so a record's data never meet."""
    c = read_chunks(spark, path, chunk_bytes)
    is_chunk, is_end = ~F.col("is_end"), F.col("is_end")
    size = F.octet_length("data").cast("long")
    first_ok = (F.col("chunk_no") != 0) | (F.sha1("data") == F.col("sha1_so_far"))
    slim = c.select(
        "archive", "record_no", "chunk_no", "is_end", "record_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "sha1_so_far",
        F.when(is_chunk, size).alias("size"), F.when(is_chunk, first_ok).alias("first_ok"),
    )
    facts = ("record_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "chunk_no", "sha1_so_far")
    r = slim.groupBy("archive", "record_no").agg(
        F.max(F.when(is_end, F.struct(*facts))).alias("end"),
        F.count("size").alias("n"), F.sum("size").alias("bytes"), F.min(F.when(is_chunk, F.col("chunk_no"))).alias("low"), F.max(F.when(is_chunk, F.struct("chunk_no", "sha1_so_far"))).alias("last"),
        F.sum(F.when(is_chunk, F.col("chunk_no"))).alias("numbers"), F.coalesce(F.bool_and("first_ok"), F.lit(True)).alias("first_ok"),
    )
    own = F.col("end.record_type") != "revisit"
    # n numbers from 0 whose largest is n - 1 and whose sum is that of 0 .. n - 1
    dense = (F.col("n") == 0) | ((F.col("low") == 0) & (F.col("last.chunk_no") == F.col("n") - 1) & (2 * F.col("numbers") == F.col("n") * (F.col("n") - 1)))
    whole = dense & (F.col("n") == F.col("end.chunk_no")) & (F.coalesce("bytes", F.lit(0)) == F.col("end.payload_bytes")) & F.col("first_ok") & (F.coalesce("last.sha1_so_far", F.col("end.sha1_so_far")) == F.col("end.sha1_so_far"))
    ok = F.col("end.digest_ok") & F.when(own, whole).otherwise(F.col("n") == 0)
    page, first = F.regexp_extract("end.record_id", r"^urn:page:(-?\d+)$", 1), F.regexp_extract("end.refers_to", r"^urn:page:(-?\d+)$", 1)
    return r.select(F.when(page != "", page).cast("long").alias("page_id"), "end.payload_bytes", "end.payload_digest", "end.record_type", F.when(first != "", first).cast("long").alias("refers_to"), "end.url", F.coalesce(ok, F.lit(False)).alias("digest_ok"), F.col("n").alias("n_chunks"))
