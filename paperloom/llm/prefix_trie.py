"""Conversation prefix trie with totals over subtrees, by a depth-band rollup.

A node is a distinct sequence of first turns. Its name is a digest of sums of turn hashes, so names
come from running sums, and a conversation need not be in one task: turns are dealt by ranges of
(conversation, turn), each range sums its own rows, and what lies before a range in a conversation
is added from one small row a range. No text is shuffled, only its digest and length.

Totals over subtrees: depths are cut into bands of ``height``. A node gives its own values to
itself and to its ancestors down from its band's root, at most ``height`` rows. The roots of bands,
which are a trie of a ``height``-th of the depth, are completed by the same rollup; then a completed
root gives its total to the ancestors in the band above it. So a trie of depth d takes about
log(d) / log(height) rounds, and no node explodes to more than ``height`` ancestors.

Defined cases: turns are ordered by turn (null first), then role, then the text's SHA-256; null role
and text are empty; repeated rows are repeated turns; rows with a null conv_id belong to no
conversation; extra columns are ignored; an empty table gives no node. Names have 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.scratch import settle
from paperloom.llm.skew import join_dealt

#: ids in one string on the way to the digest of a node's ends
_RUN = 256


def _before(totals: DataFrame, columns: list[str]) -> DataFrame:
    """(conv_id, piece) -> sums of ``columns`` over the conversation's earlier pieces."""
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("conv_id", "piece", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in columns))


@dataclass(frozen=True)
class Turns:
    """Ordered turns: rows (conv_id, piece, place from 1, said, chars), and (conv_id, n_turns)."""

    rows: DataFrame
    conversations: DataFrame


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Turns:
    """Number the turns of every conversation, however long; ``said`` is a digest of role and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = df.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.sha2(text, 256).alias("sha"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("tie")
    )
    dealt = slim.repartitionByRange("conv_id", "turn", "role", "sha", "tie").withColumn("piece", F.spark_partition_id())
    dealt = settle(dealt, "turns")
    counts = dealt.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    here = Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "sha")
    placed = dealt.withColumn("place", F.row_number().over(here)).join(_before(counts, ["n"]), ["conv_id", "piece"])
    rows = placed.select("conv_id", "piece", (F.col("place") + F.col("n_before")).alias("place"), F.sha2(F.concat("role", F.lit("\n"), "sha"), 256).alias("said"), "chars")
    return Turns(rows, counts.groupBy("conv_id").agg(F.sum("n").alias("n_turns")))


def with_shared_openings(turns: Turns, group: int = 100, opening: Column | None = None, longest: int = 5) -> Turns:
    """Conversations whose first turns are those of the first conversation of their group.

    A conversation c keeps its turns after its first h = ``opening`` (crc32 of its decimal id modulo
    6 by default, at most ``longest``); before them stand the first h turns of c - c % group, as
    many as there are. Conversations without a turn stay."""
    h = (F.crc32(F.col("conv_id").cast("string")) % (longest + 1)) if opening is None else opening
    first = F.col("conv_id") - F.col("conv_id") % group
    convs = turns.conversations.select("conv_id", "n_turns", h.cast("long").alias("h"), first.alias("first"))
    lengths = turns.conversations.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("first"), F.col("n_turns").alias("have"))
    convs = convs.join(lengths, "first", "left").withColumn("taken", F.least("h", F.coalesce("have", F.lit(0))))
    convs = settle(convs.withColumn("n_new", F.col("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))), "openings")
    heads = turns.rows.filter((F.col("conv_id") % group == 0) & (F.col("place") <= longest)).select(F.col("conv_id").alias("first"), "place", "said", "chars")
    opened = convs.select("conv_id", "first", "taken").join(heads, "first").filter("place <= taken").select("conv_id", F.lit(-1).alias("piece"), F.col("place").cast("long").alias("place"), "said", "chars")
    # a conversation of very many turns: (conv_id, piece) is the key, not conv_id alone
    total = turns.conversations.agg(F.coalesce(F.sum("n_turns"), F.lit(0))).first()[0]
    kept = join_dealt(turns.rows, convs.select("conv_id", "h", "taken"), "conv_id", turns.conversations.select("conv_id", F.col("n_turns").alias("n")), total, ["piece", "place"])
    kept = kept.filter("place > h").select("conv_id", "piece", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "said", "chars")
    return Turns(opened.unionByName(kept), convs.select("conv_id", F.col("n_new").alias("n_turns")))


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *(s.cast("string") for s in sums)).cast("binary"))


def paths(turns: Turns, height: int) -> DataFrame:
    """(conv_id, depth, node, ancestors, chars, is_last): each conversation's way from the root.

    ``ancestors`` are the nodes from the root of the band above the node's depth to its parent."""
    lanes = ["a", "b", "c", "d"]
    x, y = F.xxhash64("place", "said"), F.xxhash64(F.lit(7), "said", "place")
    low = F.lit(0xFFFFFFFF).cast("long")
    hashed = settle(turns.rows.select("*", x.bitwiseAND(low).alias("a"), F.shiftrightunsigned(x, 32).alias("b"), y.bitwiseAND(low).alias("c"), F.shiftrightunsigned(y, 32).alias("d")), "turn-hashes")
    before = _before(hashed.groupBy("conv_id", "piece").agg(*(F.sum(c).alias(c) for c in lanes)), lanes)
    here = Window.partitionBy("conv_id", "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select("*", *(F.sum(c).over(here).alias(f"{c}_here") for c in lanes)).join(before, ["conv_id", "piece"])
    upto = [F.col(f"{c}_here") + F.col(f"{c}_before") for c in lanes]
    above = [u - F.col(c) for u, c in zip(upto, lanes)]
    band = F.floor((F.col("place") - 1) / height)
    named = summed.select("conv_id", F.col("place").alias("depth"), band.alias("band"), _name(F.col("place"), upto).alias("node"), _name(F.col("place") - 1, above).alias("parent"), "chars")
    way = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = named.select("conv_id", "depth", "node", F.collect_list("parent").over(way).alias("ancestors"), "chars")
    root = _name(F.lit(0), [F.lit(0)] * len(lanes))
    roots = turns.conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.array().cast("array<string>").alias("ancestors"), F.lit(0).cast("long").alias("chars"))
    return roots.unionByName(rows)


def rollup(nodes: DataFrame, ways: DataFrame, values: list[str], height: int) -> DataFrame:
    """(node, values): the sums of ``values`` over every node's subtree.

    ``nodes`` has (node, depth, ancestors, values), ``ways`` the rows (conv_id, depth, node,
    ancestors) of which the ways through band roots are made."""
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("node", *values)
    spread = F.concat("ancestors", F.array("node"))
    sums = [F.sum(c).alias(c) for c in values]
    if deepest <= height:
        return nodes.select(F.explode(spread).alias("node"), *values).groupBy("node").agg(*sums)
    is_root = F.col("depth") % height == 0
    inside = nodes.select("depth", F.explode(F.when(is_root, F.array("node")).otherwise(spread)).alias("node"), *values).groupBy("node").agg(*sums)
    inside = settle(nodes.select("node", "depth", "ancestors").join(inside, "node"), "band-sums")
    band = F.floor((F.col("depth") - 1) / height)
    upper = ways.filter(is_root & (F.col("depth") > 0)).select("conv_id", (F.col("depth") / height).cast("long").alias("depth"), "node", F.element_at("ancestors", 1).alias("parent"))
    way = Window.partitionBy("conv_id", band).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    upper = settle(upper.select("conv_id", "depth", "node", F.collect_list("parent").over(way).alias("ancestors")), "band-ways")
    lists = upper.groupBy("node").agg(F.any_value("ancestors").alias("upper"))  # one and the same for all its conversations
    roots = inside.filter(is_root).select("node", (F.col("depth") / height).cast("long").alias("depth"), *values).join(lists, "node", "left")
    roots = roots.select("node", "depth", F.coalesce("upper", F.array().cast("array<string>")).alias("ancestors"), *values)
    done = settle(rollup(roots, upper, values, height), "band-roots")
    passed = inside.filter(is_root).select("node", "ancestors").join(done, "node").select(F.explode(F.slice("ancestors", 2, height)).alias("node"), *values)
    rest = inside.filter(~is_root).select("node", *values).unionByName(passed).groupBy("node").agg(*sums)
    return done.unionByName(rest)


def _ends(ways: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end; the ids of a node pass in order
    through one task, as strings of up to 256 ids."""
    last = ways.select("conv_id", "node", "depth").join(convs, "conv_id").filter("depth = n_turns")
    run = F.floor(F.col("conv_id") / _RUN)
    strings = last.groupBy("node", run.alias("run")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            names, digests = [], []
            for now, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if now == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    names.append(node)
                    digests.append(state.hexdigest())
                node, state = now, sha256(ids.encode())
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(digests)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ordered = strings.repartition("node").sortWithinPartitions("node", "run").select("node", "ids")
    return ordered.mapInArrow(digest, "node string, ends_sha256 string")


def prefix_trie(turns: Turns, height: int = 4) -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children,
    n_leaves and saved_tokens (over its subtree), ends_sha256 (members of as many turns)."""
    ways = settle(paths(turns, height), "ways")
    nodes = settle(
        ways.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.any_value("ancestors").alias("ancestors"), F.min("chars").alias("chars")).withColumn("parent", F.try_element_at("ancestors", F.lit(-1))),
        "nodes",
    )
    children = settle(nodes.filter("parent is not null").groupBy("parent").agg(F.count("*").alias("n")), "children")
    own = nodes.join(children.select(F.col("parent").alias("node"), F.col("n").alias("n_children")), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = settle(own.select("*", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "values")
    totals = rollup(own.select("node", "depth", "ancestors", "n_leaves", "saved_tokens"), ways, ["n_leaves", "saved_tokens"], height)
    total = nodes.count()
    named = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = join_dealt(own.drop("n_leaves", "saved_tokens"), named, "parent", children, total, ["node"], "left")
    out = out.join(totals, "node").join(_ends(ways, turns.conversations), "node", "left")
    nobody = F.sha2(F.lit(""), 256)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
