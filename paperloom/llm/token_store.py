"""Content-addressed store of token ids.

Whole texts become id streams; a rolling hash over the last 16 ids cuts each stream where its
content says so, and equal chunks get the same address (BLAKE2b of their bytes). A task emits a
chunk it has seen before only as an address, then one shuffle by address stores each chunk once.
The manifest is sorted by document id and holds, per document, its recipe (addresses and
lengths), the Merkle root over them and where its ids start in the whole stream. Every 4,096
documents have a seal over their ids, places and roots, every manifest part one over those seals,
and one root, stored apart with counts, covers all parts.

``verify`` reads the files back: seals made again from the manifest must be those stored, each chunk's bytes must hash to its address, lengths must agree
with the recipes and the Merkle roots with the addresses; the checksum of every document is put
together from its chunks' checksums, so no ids are moved. ``read_documents`` puts the ids
themselves together.

Ids are stored in 16 bits where the vocabulary allows it, else in 32.

Defined cases: null text is empty and has the end id only; repeated rows have recipes of their
own; a null document id sorts first; rows with equal ids are ordered by root; an empty table
gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.scratch import new_path, remove
from paperloom.llm.skew import join_dealt
from paperloom.llm.workers import giving_back

CUT_WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 4096
ADDRESS_BYTES = 20
#: documents a seal is made over; a part's seal is made over theirs
SEALED = 4096


def address(data: bytes) -> bytes:
    return blake2b(data, digest_size=ADDRESS_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd last node moves up unchanged."""
    level = [blake2b(b"\0" + x, digest_size=ADDRESS_BYTES).digest() for x in leaves]
    while len(level) > 1:
        pairs = [blake2b(b"\1" + a + b, digest_size=ADDRESS_BYTES).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[2 * len(pairs) :]
    return level[0] if level else blake2b(b"", digest_size=ADDRESS_BYTES).digest()


def cut_places(ids: np.ndarray) -> np.ndarray:
    """Where the last ids of a stream say that a chunk may end."""
    if len(ids) < CUT_WINDOW:
        return np.empty(0, dtype=np.int64)
    sums = W.running_sums(W.mix(ids.astype(np.uint64) + np.uint64(1)) - np.uint64(1))
    window = sums[CUT_WINDOW:] - sums[:-CUT_WINDOW]
    W.DOWN.scale(window)
    window = W.mix(window)
    return np.flatnonzero((window & np.uint64(MEAN - 1)) == 0) + CUT_WINDOW


def chunk_ends(places: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the stream ``begin`` .. ``end``; ``places`` may lie in several streams
    joined, as a chunk is longer than the window that cuts it."""
    ends, last = [], begin
    for at in places:
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(at)
            last = at
    while end - last > MOST:
        last += MOST
        ends.append(last)
    return ends + [end] if last < end else ends


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one stream."""
    return chunk_ends(cut_places(ids).tolist(), 0, len(ids))


_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[np.frombuffer(b",.;:!?", dtype=np.uint8)] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


#: a-z and U+00DF-U+00FF without the division sign, in UTF-8
_LATIN_WORD = re.compile(rb"(?:[a-z]|\xC3[\x9F-\xB6\xB8-\xBF])+").fullmatch
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
#: byte-level tokenizers write byte b as this character
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + k for k, b in enumerate(_HIDDEN)}


class PieceTable:
    """Ids of pieces of words by hash: open addressing in arrays, so a block is looked up at once."""

    def __init__(self, kind: type, slots: int = 1 << 20):
        self.kind, self.least = kind, slots
        self.held, self.uses = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int32)
        self.ids, self.upto = np.empty(0, dtype=kind), np.zeros(1, dtype=np.int64)
        self._build()

    def _build(self) -> None:
        slots = max(self.least, 1 << (2 * len(self.held)).bit_length())
        self.keys, self.numbers = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.int32)
        self._place(self.held, 0)

    def keep(self, most: int) -> None:
        """Drop all but the ``most`` pieces used most often, and halve their counts."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:most])
        length = self.upto[kept + 1] - self.upto[kept]
        upto = np.concatenate([[0], np.cumsum(length)])
        self.ids = self.ids[np.repeat(self.upto[kept] - upto[:-1], length) + np.arange(upto[-1])]
        self.held, self.uses, self.upto = self.held[kept], self.uses[kept] // 2, upto
        self._build()

    def __len__(self) -> int:
        return len(self.held)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's piece, or -1."""
        at = self._home(keys)
        there = self.keys[at]
        hit = there == keys
        out = np.where(hit, self.numbers[at], -1)
        left = np.flatnonzero(~hit & (there != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.numbers[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], at[on]
        return out

    def _place(self, keys: np.ndarray, first: int) -> None:
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.numbers[at[won]] = first + left[won]
            left, at = left[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def add(self, keys: np.ndarray, ids: list[int], lengths: list[int]) -> None:
        """Distinct new keys and the ids of their pieces."""
        first, self.held = len(self.held), np.concatenate([self.held, keys])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), dtype=np.int32)])
        self.ids = np.concatenate([self.ids, np.array(ids, dtype=self.kind)])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(lengths, dtype=np.int64)])
        if 2 * len(self.held) > len(self.keys):
            self._build()
        else:
            self._place(keys, first)


class WordEncoder:
    """Ids of texts, a piece of a word at a time.

    The tokenizer splits at white space and where a run of letters ends, and lowers letters, so a
    text's ids are those of its lowered words, cut between a Latin letter and closing punctuation.
    Each distinct piece is encoded once and kept in a table; beyond ``most`` pieces the
    half used least is dropped. Texts that may spell a special token are not lowered.
    """

    def __init__(self, tokenizer_json: str, block_bytes: int = 2 << 20, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.block_bytes, self.most = Tokenizer.from_str(tokenizer_json), block_bytes, most
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.uint32 if wide else np.uint16
        self.table = PieceTable(self.kind)
        # a lower-case Latin word passes the normalizer and splitter of this kind of tokenizer unchanged
        parts = json.loads(tokenizer_json)
        kinds = [x["type"] for part in ("normalizer", "pre_tokenizer") for x in (parts[part] or {}).get("normalizers", []) + (parts[part] or {}).get("pretokenizers", [])]
        self.model = self.tokenizer.model if kinds == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] else None
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def blocks(self, texts: pa.Array) -> Iterator[tuple[W.Words, np.ndarray, np.ndarray]]:
        """(block, ids of its words, where each row's ids begin) of a batch of texts."""
        special = pc.any(pc.match_substring(texts, "<|")).as_py()
        for w in W.blocks(texts, W.SPACED, lower=not special, limit=self.block_bytes):
            yield w, *self.block(w)

    def pieces(self, body: bytes, start: list[int], end: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Ids of pieces of ``body``, one after the other, how many each has, and which it is."""
        ids, lengths, which, others = [], [], [], []
        tokenize = self.model.tokenize if self.model is not None else None
        for k, (a, b) in enumerate(zip(start, end)):
            piece = body[a:b]
            if tokenize is None or not _LATIN_WORD(piece):
                others.append((k, piece))
                continue
            found = [t.id for t in tokenize(piece.decode() if piece.isascii() else piece.decode("latin-1").translate(_BYTE_CHARS))]
            ids += found
            lengths.append(len(found))
            which.append(k)
        for k in range(0, len(others), 2048):
            own = others[k : k + 2048]
            for (i, _), e in zip(own, self.encode([p.decode("utf-8", "replace") for _, p in own], add_special_tokens=False)):
                found = e.ids
                ids += found
                lengths.append(len(found))
                which.append(i)
        return ids, lengths, which

    def block(self, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(W.marked(w.data[1:], _CLOSING) & W.marked(w.data[:-1], _LETTER)) + 1
        begins, ends = np.zeros((2, len(w.data) + 1), dtype=bool)
        begins[w.start] = begins[cut] = ends[w.end] = ends[cut] = True
        start, end = np.flatnonzero(begins), np.flatnonzero(ends)
        keys = np.maximum(w.hashed(start, end), np.uint64(1))  # 0 marks a free place
        if len(self.table) > self.most:
            self.table.keep(self.most // 2)
        number = self.table.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            ids, lengths, which = self.pieces(w.data.tobytes(), start[at].tolist(), end[at].tolist())
            self.table.add(fresh[which], ids, lengths)
            number[new] = self.table.find(keys[new])
        self.table.uses += np.bincount(number, minlength=len(self.table)).astype(np.int32)
        first = self.table.upto[number]
        count = self.table.upto[number + 1] - first
        upto = np.concatenate([[0], np.cumsum(count)])
        out = self.table.ids[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])]
        return out, upto[np.searchsorted(start, w.offsets)]


@dataclass
class TokenStore:
    """Folders of one store."""

    chunks: str
    manifest: str
    seals: str
    root: str
    id_bytes: int


_ROW = pa.schema([("key", pa.binary()), ("kind", pa.string()), ("doc", pa.int64()), ("n", pa.int64()), ("root", pa.binary()), ("addresses", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("address", pa.binary()), ("data", pa.binary())])


def _batch(rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in _ROW], schema=_ROW)


def write_store(
    df: DataFrame, tokenizer_json: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, most_pieces: int = 600_000
) -> TokenStore:
    """Encode, cut, store each chunk once and write the manifest in ascending id order.

    A task works on ``block_bytes`` of text at a time and remembers the ids of ``most_pieces``
    pieces of words; both bound its memory.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "token-store")
    shipped = spark.sparkContext.broadcast(tokenizer_json)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, nth = WordEncoder(shipped.value, block_bytes, most_pieces), set(), 0
        for batch in batches:
            for w, ids, first in encoder.blocks(batch.column("body")):
                whole = np.full(len(ids) + w.rows, end_id, dtype=encoder.kind)  # an end id after each row's ids
                whole[np.arange(len(ids)) + np.repeat(np.arange(w.rows), np.diff(first))] = ids
                bounds = first + np.arange(w.rows + 1)
                places = cut_places(whole)
                own, places, limit = np.searchsorted(places, bounds, side="right").tolist(), places.tolist(), bounds.tolist()
                data, size = memoryview(whole.tobytes()), encoder.kind().itemsize
                names, lengths, roots, upto, chunks, blobs = [], [], [], [0], [], []
                for k in range(w.rows):
                    last = limit[k]
                    for end in chunk_ends(places[own[k] : own[k + 1]], last, limit[k + 1]):
                        blob = data[size * last : size * end]
                        name = address(blob)
                        names.append(name)
                        lengths.append(end - last)
                        last = end
                        if name not in seen:
                            seen.add(name)
                            chunks.append(name)
                            blobs.append(bytes(blob))
                    roots.append(merkle_root(names[upto[-1] :]))
                    upto.append(len(names))
                if len(seen) > 200_000:
                    seen.clear()
                if chunks:
                    yield _batch(len(chunks), key=pa.array(chunks, pa.binary()), kind=pa.array(["chunk"] * len(chunks)), address=pa.array(chunks, pa.binary()), data=pa.array(blobs, pa.binary()))
                doc = batch.column("doc").slice(w.lo, w.rows)
                # recipes do not meet: like ones of one task have keys of their own
                keys = [root + (d or 0).to_bytes(8, "big", signed=True) + (nth + k).to_bytes(6, "big") for k, (root, d) in enumerate(zip(roots, doc.to_pylist()))]
                nth += w.rows
                lists = (pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(x, t)) for x, t in ((names, pa.binary()), (lengths, pa.int32())))
                yield _batch(w.rows, key=pa.array(keys, pa.binary()), kind=pa.array(["recipe"] * w.rows), doc=doc, n=pa.array(np.diff(bounds)), root=pa.array(roots, pa.binary()), **dict(zip(("addresses", "lengths"), lists)))

    rows = docs.mapInArrow(giving_back(run), "key binary, kind string, doc long, n long, root binary, addresses array<binary>, lengths array<int>, address binary, data binary")
    # one exchange and one sort serve both: chunks meet by address, and files are written by kind
    nth = F.row_number().over(Window.partitionBy("kind", "key").orderBy("key"))
    parts = rows.withColumn("nth", nth).filter("kind = 'recipe' or nth = 1").drop("key", "nth")
    parts.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")
    parts = spark.read.schema(parts.schema).parquet(f"{path}/parts")

    recipes = parts.filter("kind = 'recipe'").select("doc", "n", "root", "addresses", "lengths")
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # many rows of one id, or of one id and text, are dealt to several ranges
    ordered = recipes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(count, "doc", "root", "tie").sortWithinPartitions("doc", "root").drop("tie").withColumn("part", F.spark_partition_id())
    ordered.write.parquet(f"{path}/ordered")
    ordered = spark.read.schema(ordered.schema).parquet(f"{path}/ordered")
    totals = ordered.groupBy("part").agg(F.sum("n").alias("all"))
    before = F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a part
    totals = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    in_part = Window.partitionBy("part").orderBy("doc", "root")
    own = F.sum("n").over(in_part.rowsBetween(Window.unboundedPreceding, -1))
    manifest = ordered.join(totals, "part").withColumns({"start": F.col("before") + F.coalesce(own, F.lit(0)), "block": F.floor((F.row_number().over(in_part) - 1) / SEALED)}).drop("before")
    manifest.write.option("compression", "zstd").parquet(f"{path}/manifest")
    manifest = spark.read.schema(manifest.schema).parquet(f"{path}/manifest")

    seals = _part_seals(manifest)
    seals.coalesce(1).write.parquet(f"{path}/seals")  # one row a part
    seals = spark.read.schema(seals.schema).parquet(f"{path}/seals")
    _top(seals).write.parquet(f"{path}/root")
    vocabulary = 2 if WordEncoder(tokenizer_json).kind is np.uint16 else 4
    remove(spark, f"{path}/ordered")
    return TokenStore(f"{path}/parts", f"{path}/manifest", f"{path}/seals", f"{path}/root", vocabulary)


def _sealed(order: str, *names: Column) -> Column:
    """SHA-256 over a group's leaves in order."""
    leaf = F.sha2(F.concat_ws(",", *names), 256)
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), leaf.alias("leaf")))), lambda r: r["leaf"]), ""), 256).alias("seal")


def _part_seals(manifest: DataFrame) -> DataFrame:
    """(part, start, n_tokens, n_docs, seal): blocks of documents are sealed by id, start, length and
    Merkle root, and every part over its blocks."""
    sums = [F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_docs").alias("n_docs")]
    leaf = (F.coalesce(F.col("doc").cast("string"), F.lit("null")), F.col("start").cast("string"), F.col("n").cast("string"), F.hex("root"))
    rows = manifest.withColumns({"n_tokens": F.col("n"), "n_docs": F.lit(1).cast("long")})
    blocks = rows.groupBy("part", "block").agg(*sums, _sealed("start", *leaf))
    return blocks.groupBy("part").agg(*sums, _sealed("block", F.col("block").cast("string"), F.col("seal")))


def _top(seals: DataFrame) -> DataFrame:
    """One row over all parts: counts and the seal of the seals."""
    counts = [F.count("*").alias("n_parts"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")]
    return seals.agg(*counts, _sealed("part", F.col("part").cast("string"), F.col("start").cast("string"), F.col("n_docs").cast("string"), F.col("n_tokens").cast("string"), F.col("seal")))


def verify_manifest(spark: SparkSession, store: TokenStore) -> None:
    """Stops if the manifest is not the one that was sealed: seals are made again from its rows and
    compared with the stored ones, and those with the root over all parts."""
    made = _part_seals(spark.read.schema(_MANIFEST).parquet(store.manifest))
    stored = spark.read.schema(made.schema).parquet(store.seals)
    top = spark.read.schema(_top(stored).schema).parquet(store.root).collect()
    if [tuple(r) for r in top] != [tuple(r) for r in _top(stored).collect()]:  # one row each
        raise ValueError("the seals of the store's parts are not those of its root")
    a, b = (x.select("part", F.struct("start", "n_tokens", "n_docs", "seal").alias(n)) for x, n in ((made, "made"), (stored, "stored")))
    bad = a.join(b, "part", "full_outer").filter(~F.col("made").eqNullSafe(F.col("stored"))).agg(F.min("part").alias("part"), F.count("*").alias("n")).first()
    if bad["n"]:
        raise ValueError(f"the manifest differs from its seals in {bad['n']} parts, first in part {bad['part']}")


_MANIFEST = "part int, doc long, n long, root binary, addresses array<binary>, lengths array<int>, start long, block long"


def _chunks(spark: SparkSession, store: TokenStore) -> DataFrame:
    return spark.read.schema("address binary, data binary, kind string").parquet(store.chunks).filter("kind = 'chunk'").select("address", "data")


def _manifest(spark: SparkSession, store: TokenStore) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(store.manifest).drop("block")


def _zero_operators(count: int = 40) -> list[np.ndarray]:
    """What 2**k zero bytes do to a CRC-32 register: four 256-entry tables for each k."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    column = (bits >> np.uint32(8)) ^ table[bits & np.uint32(255)]
    out = []
    for _ in range(count):
        tables = np.zeros((4, 256), dtype=np.uint32)
        for b in range(32):
            tables[b // 8] ^= np.where((np.arange(256) >> (b % 8)) & 1, column[b], 0).astype(np.uint32)
        out.append(tables)
        column = _apply(tables, column)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The part of a whole's CRC-32 that comes from a piece followed by so many bytes."""
    crc = crc.astype(np.uint32)
    for k, tables in enumerate(_zero_operators(int(zeros.max(initial=0)).bit_length())):
        crc = np.where((zeros >> k) & 1, _apply(tables, crc), crc)
    return crc


def verify(spark: SparkSession, store: TokenStore) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (ids as 32-bit), root.

    A manifest that is not the sealed one (a lost file or row, documents that changed places) stops
    at once; a chunk that does not hash to its address, a missing chunk, a wrong length or a wrong
    root stops the job that reads the result.
    """
    verify_manifest(spark, store)
    kind = np.uint16 if store.id_bytes == 2 else np.uint32

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for name, data in zip(batch.column("address").to_pylist(), batch.column("data").to_pylist()):
                if address(data) != name:
                    raise ValueError(f"chunk {name.hex()} has other content")
                ids = np.frombuffer(data, dtype=kind)
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["address", "held", "crc"])

    held = _chunks(spark, store).mapInArrow(giving_back(facts), "address binary, held long, crc long")
    manifest = _manifest(spark, store)

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for start, root, names, lengths in zip(*(batch.column(c).to_pylist() for c in ("start", "root", "addresses", "lengths"))):
                if merkle_root(names) != root:
                    raise ValueError(f"the recipe at {start} has another root")
                after = sum(lengths)
                for name, n in zip(names, lengths):
                    after -= n
                    rows.append((start, name, n, after))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["start", "address", "length", "after"])

    used = manifest.select("start", "root", "addresses", "lengths").mapInArrow(giving_back(uses), "start long, address binary, length long, after long")
    uses_of = manifest.select(F.explode("addresses").alias("address"))
    both = join_dealt(used, held, "address", uses_of.groupBy("address").agg(F.count("*").alias("n")), uses_of.count(), ["start", "after"], "left").withColumn("held", F.when(F.col("held") == F.col("length"), F.col("held")).otherwise(F.raise_error(F.lit("a chunk is missing or has another length")).cast("long")))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = crc_shift(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("start"), batch.column("held"), pa.array(moved.astype(np.int64))], ["start", "held", "crc"])

    moved = both.select("start", "held", "crc", "after").mapInArrow(giving_back(shift), "start long, held long, crc long")
    sums = moved.groupBy("start").agg(F.sum("held").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return manifest.select(F.col("doc").alias("doc_id"), "start", F.hex("root").alias("root")).join(sums, "start")


def read_documents(spark: SparkSession, store: TokenStore) -> DataFrame:
    """doc_id, start and ids (array of int) of every document, put together from its chunks."""
    used = _manifest(spark, store).select("doc", "start", F.posexplode("addresses").alias("at", "address"))
    counts = used.groupBy("address").agg(F.count("*").alias("n"))
    parts = join_dealt(used, _chunks(spark, store), "address", counts, used.count(), ["start", "at"]).groupBy("doc", "start").agg(F.sort_array(F.collect_list(F.struct("at", "data"))).alias("parts"))
    kind = np.uint16 if store.id_bytes == 2 else np.uint32

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [np.frombuffer(b"".join(p["data"] for p in row), dtype=kind).astype(np.int32) for row in part.column("parts").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return parts.mapInArrow(giving_back(join), "doc_id long, start long, ids array<int>")
