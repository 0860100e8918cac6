"""Filter interaction audit: what each filter removes in every order of the filters.

Four filters judge a text by itself, in numpy over whole texts. The fifth, "identical to the text
of a smaller id", compares all texts: they are dealt to tasks by ranges of text and put into
compressed radix tries whose terminals hold the smallest id.

* A first pass builds tries of blocks of texts and gives out their frontiers: prefixes, extended
  where they are heavy, with the bytes below. Frontiers are merged by the same tries until they are
  few, and the ranges are cut from them, each at the shortest prefix that tells two ranges apart.
  Beyond ``PREFIX`` common bytes texts of a range are dealt by a digest.
* The second pass inserts each block into a trie before the shuffle: a row above the smallest id of
  its text in the block is a duplicate already and goes on without its text, so a text that fills a
  third of the table is sent once a block. The tries of the ranges settle the rest.

A row's failures are five bits. Rows are counted by part and bits, at most 32 counts a part, and all
orders are evaluated on the counts.

Defined cases: null text is empty; null part is the empty string; a row with a null id is neither a
duplicate nor the original of one; rows with one id and one text are no duplicates of each other;
labels of one id are combined (1 if any is 1), unlabelled rows are in no loss; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.scratch import forget, settle

FILTERS = "ABCDE"
#: bytes of texts in one trie before the shuffle, and aimed at in a range after it
BLOCK_BYTES, RANGE_BYTES = 16 << 20, 32 << 20
#: bytes of a prefix, entries of a block's frontier, entries that may come to the driver
PREFIX, FRONTIER, SUMMARY = 1024, 256, 65_536

_DUPLICATE = 1 << FILTERS.index("E")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#$%&*|", dtype=np.uint8)] = True


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes):
        self.label, self.children, self.value = label, {}, None


def _common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of ``a`` and of ``b`` from ``at``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class TextTrie:
    """Compressed radix trie over byte strings; a node is a branch, a terminal with a value, or both."""

    def __init__(self):
        self.root = _Node(b"")

    def terminal(self, text: bytes) -> _Node:
        """The node at which ``text`` ends, made where it is new (its value is None then)."""
        node, at, size = self.root, 0, len(text)
        while at < size:
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                return child
            if not text.startswith(child.label, at):
                cut = _common(child.label, text, at)
                upper = node.children[text[at]] = _Node(child.label[:cut])
                child.label = child.label[cut:]
                upper.children[child.label[0]] = child
                child = upper
            node, at = child, at + len(child.label)
        return node

    def walk(self) -> Iterator[tuple[bytes, object]]:
        """(text, value) of every terminal in the order of texts."""
        todo = [(b"", self.root)]
        while todo:
            prefix, node = todo.pop()
            prefix += node.label
            if node.value is not None:
                yield prefix, node.value
            todo += [(prefix, node.children[c]) for c in sorted(node.children, reverse=True)]

    def frontier(self, most: int = FRONTIER) -> list[tuple[bytes, int]]:
        """At most about ``most`` (prefix, weight) in the order of texts; terminals' values are weights.

        The heaviest prefix is split again and again, unless it is one text."""
        below: dict[int, int] = {}
        order, todo = [], [self.root]
        while todo:
            node = todo.pop()
            order.append(node)
            todo += node.children.values()
        for node in reversed(order):
            below[id(node)] = (node.value or 0) + sum(below[id(c)] for c in node.children.values())
        found, heap = [], [(-below[id(self.root)], self.root.label, self.root)]
        heapify(heap)
        while heap and len(heap) + len(found) < most:
            weight, prefix, node = heappop(heap)
            if not node.children or len(prefix) >= PREFIX:
                found.append((prefix, -weight))
                continue
            if node.value:
                found.append((prefix, node.value))
            for child in node.children.values():
                heappush(heap, (-below[id(child)], prefix + child.label, child))
        return sorted((p, w) for p, w in [*found, *((p, -w) for w, p, _ in heap)] if w)


def text_key(text: bytes) -> bytes:
    """What ranges are cut by: the text, or its beginning and a digest of all of it."""
    return text if len(text) <= PREFIX else text[:PREFIX] + blake2b(text, digest_size=8).digest()


def cut_ranges(entries: list[tuple[bytes, int]], parts: int) -> list[bytes]:
    """Lower bounds of all ranges but the first, at most ``parts`` of them, by weight."""
    spread = []
    target = max(1, sum(w for _, w in entries) // parts)
    for prefix, weight in sorted(entries):
        pieces = max(1, weight // target) if len(prefix) >= PREFIX else 1
        head = prefix[:PREFIX] if len(prefix) >= PREFIX else prefix
        spread += [(head + ((k << 64) // pieces).to_bytes(8, "big") if k else head, weight // pieces) for k in range(pieces)]
    bounds, held, before = [], 0, None
    for prefix, weight in spread:
        if held and held + weight / 2 > target and prefix != before:
            bounds.append(prefix[: _common(before, prefix) + 1])
            held = 0
        held, before = held + weight, prefix
    return sorted(set(bounds))


def failures(w: W.Words) -> np.ndarray:
    """Bits of the filters A to D for every row of a block of spaced words."""
    first = w.first()
    n_words = np.diff(first)
    key = W.mix(w.hash + W.mix(w.doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key), dtype=bool)
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    n_distinct = np.bincount(w.doc, weights=fresh, minlength=w.rows).astype(np.int64)
    upper = W.per_row((w.data >= 65) & (w.data <= 90), w.offsets)
    points = W.per_row((w.data & 0xC0) != 0x80, w.offsets)
    fails = (n_words < 100, 100 * n_distinct < 80 * n_words, 100 * upper > 10 * points, W.per_row(_SYMBOL[w.data], w.offsets) > 0)
    return sum(f.astype(np.int64) << k for k, f in enumerate(fails))


class _Holder:
    """A text's smallest id so far, the rows by part that have it, and the text's other failures."""

    __slots__ = ("id", "parts", "bits")

    def __init__(self, own: int, bits: int):
        self.id, self.parts, self.bits = own, {}, bits


class _Rows:
    """Decided rows (id, part, bits, n), and what is open in a trie."""

    def __init__(self):
        self.decided, self.trie, self.held = [], TextTrie(), 0

    def add(self, text: bytes, own: int, part: str, bits: int, n: int) -> None:
        node = self.trie.terminal(text)
        holder = node.value
        if holder is None:
            holder = node.value = _Holder(own, bits)
            self.held += len(text)
        elif own > holder.id:
            self.decided.append((own, part, bits | _DUPLICATE, n))
            return
        elif own < holder.id:
            self.decided += [(holder.id, p, bits | _DUPLICATE, k) for p, k in holder.parts.items()]
            holder.id, holder.parts = own, {}
        holder.parts[part] = holder.parts.get(part, 0) + n

    def open(self) -> Iterator[tuple[int, str, int, int, bytes]]:
        for text, holder in self.trie.walk():
            for part, n in holder.parts.items():
                yield holder.id, part, holder.bits, n, text


_DECIDED = "id long, part string, bits long, n long"
_FIELDS = pa.schema([("id", pa.int64()), ("part", pa.string()), ("bits", pa.int64()), ("n", pa.int64())])
_SENT = pa.schema([*_FIELDS, ("body", pa.binary()), ("range", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _frontiers(rows: DataFrame) -> DataFrame:
    """(prefix, weight) of blocks of texts: rows have a binary body and perhaps its weight."""
    weighted = "weight" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> pa.RecordBatch:
            found = trie.frontier()
            return pa.RecordBatch.from_arrays([pa.array([p[:PREFIX] for p, _ in found], pa.binary()), pa.array([w for _, w in found], pa.int64())], ["body", "weight"])

        trie, held = TextTrie(), 0
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("body")[k].as_buffer().to_pybytes()
                node = trie.terminal(text)
                if weighted:
                    node.value = (node.value or 0) + batch.column("weight")[k].as_py()
                elif node.value is None:
                    node.value = len(text) + 64
                    held += len(text)
                if held > BLOCK_BYTES:
                    yield given()
                    trie, held = TextTrie(), 0
        yield given()

    return rows.mapInArrow(run, "body binary, weight long")


def text_ranges(texts: DataFrame, body: Column, parts: int | None = None) -> list[bytes]:
    """Bounds of ranges of texts that hold about equal bytes; all texts are counted."""
    spark = texts.sparkSession
    found = settle(_frontiers(texts.select(body.alias("body"))), "frontier")
    while (n := found.count()) > SUMMARY:
        merged = settle(_frontiers(found.repartition(n // (32 * FRONTIER) + 1)), "frontier")
        forget(found)
        found = merged
    entries = [(bytes(r["body"]), r["weight"]) for r in found.collect()]  # at most SUMMARY rows
    forget(found)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(w for _, w in entries) // RANGE_BYTES + 1)
    return cut_ranges(entries, parts)


def failure_bits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", parts: int | None = None) -> DataFrame:
    """Rows (id, part, bits, n): n rows of that id and part fail the filters of ``bits`` (A is 1, E is 16)."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    bounds = text_ranges(slim, F.col("body").cast("binary"), parts)
    shipped = df.sparkSession.sparkContext.broadcast(bounds)  # a bound a range, PREFIX + 8 bytes each at most
    n_ranges = len(bounds) + 1

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, rows = shipped.value, _Rows()

        def sent(last: bool) -> Iterator[pa.RecordBatch]:
            out = [(*r, None, hash((r[0] or 0, k)) % n_ranges) for k, r in enumerate(rows.decided)]
            rows.decided = []
            held = 0
            for *row, text in rows.open() if last else ():
                out.append((*row, text, bisect_right(cuts, text_key(text))))
                held += len(text)
                if held > 4 << 20:
                    yield _batch(out, _SENT)
                    out, held = [], 0
            if out:
                yield _batch(out, _SENT)

        for batch in batches:
            ids, parts_of = batch.column("id").to_pylist(), batch.column("part").to_pylist()
            for w in W.blocks(batch.column("body"), W.SPACED):
                bits = failures(w).tolist()
                whole = w.data.tobytes()
                for k in range(w.rows):
                    own, part = ids[w.lo + k], parts_of[w.lo + k]
                    if own is None:
                        rows.decided.append((None, part, bits[k], 1))
                    else:
                        rows.add(whole[w.offsets[k] : w.offsets[k + 1]], own, part, bits[k], 1)
                if rows.held > BLOCK_BYTES:
                    yield from sent(True)
                    rows = _Rows()
            yield from sent(False)
        yield from sent(True)

    def settle_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows()
        for batch in batches:
            ids, parts_of, bits, ns = (batch.column(c).to_pylist() for c in ("id", "part", "bits", "n"))
            bodies = batch.column("body")
            for k in range(batch.num_rows):
                if bodies[k].is_valid:
                    rows.add(bodies[k].as_buffer().to_pybytes(), ids[k], parts_of[k], bits[k], ns[k])
                else:
                    rows.decided.append((ids[k], parts_of[k], bits[k], ns[k]))
            if rows.decided:
                yield _batch(rows.decided, _FIELDS)
                rows.decided = []
        out = [r[:4] for r in rows.open()]
        if out:
            yield _batch(out, _FIELDS)

    sent = slim.mapInArrow(judge, _DECIDED + ", body binary, range int")
    return sent.repartitionById(n_ranges, "range").drop("range").mapInArrow(settle_ranges, _DECIDED)


def audit(bits: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for every part, order of filters and step, from rows of ``failure_bits``."""
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    rows = bits.groupBy("id", "part", "bits").agg(F.sum("n").alias("n")).join(marks, "id", "left")
    by_bits = rows.groupBy("part", "bits").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))
    orders = F.array(*map(F.lit, map("".join, permutations(FILTERS))))
    rows = by_bits.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = [(1 << k, F.instr("filter_order", f)) for k, f in enumerate(FILTERS)]
    before = sum((F.when(at < F.col("step"), F.lit(b)).otherwise(F.lit(0)) for b, at in place), F.lit(0))
    bit = sum((F.when(at == F.col("step"), F.lit(b)).otherwise(F.lit(0)) for b, at in place), F.lit(0))
    rows = rows.withColumns({"before": before.cast("long"), "bit": bit.cast("long")})
    own = F.col("bits")
    fails, passed_before = own.bitwiseAND(F.col("bit")) != 0, own.bitwiseAND(F.col("before")) == 0

    def total(which: Column, of: str = "n") -> Column:
        return F.sum(F.when(which, F.col(of)).otherwise(F.lit(0)))

    out = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(passed_before & ~fails).alias("kept"),
        total(passed_before & fails).alias("removed"),
        total(~passed_before & fails).alias("redundant"),
        total(own == F.col("bit")).alias("unique_fails"),
        total(passed_before & fails, "good").alias("good_lost"),
        total(passed_before & fails, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")
