"""Mixing sources to target weights by a min-cost flow.

Documents are summed by membership pattern (the set of sources each belongs to; one source per
document is the plain case). Token capacity is routed from patterns to source quotas by
successive cheapest paths. The k-th use of a pattern costs k-1, a convex price, so no text is
repeated before the fresh ones of its source are used up. The flow says how many words every
pattern gives: whole passes over all its documents, and a last part that takes the documents
first in a seeded hash order.

The plan has one row per pattern and is joined by broadcast; its size is checked first
(``max_patterns``, an error beyond it). Per-document work is a map; where the last part ends is
found by sums over 4096 bins of the order per pattern, and again inside the bin of the end, so a
source with a third of all rows is never sorted, nor met in one task.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last;
repeated rows are taken one by one; an empty table gives an empty table; extra columns are kept by
``mix_sources`` unless they clash with the columns it adds, which then replace them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.scratch import settle

WORD = r"[^\x20\x09-\x0D]+"


def weights_by_order(names: list, cycle: tuple[float, ...] = (5, 2, 1)) -> dict:
    """Weights for sources by code point, null last, repeating ``cycle``."""
    ordered = sorted((n for n in names if n is not None), key=lambda s: [ord(c) for c in str(s)])
    ordered += [None] * any(n is None for n in names)
    return {n: cycle[i % len(cycle)] for i, n in enumerate(ordered)}


def targets(sizes: dict, weights: dict, max_times: float = 3) -> dict:
    """Shares of the total by weight; what is above ``max_times`` a source's size is shared anew."""
    total, out, open_ = float(sum(sizes.values())), {}, set(sizes)
    while open_:
        left = total - sum(out.values())
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight for s in open_}
        full = {s for s in open_ if share[s] > max_times * sizes[s]}
        if not full:
            return out | share
        out |= {s: float(max_times * sizes[s]) for s in full}
        open_ -= full
    return out


def route(capacity: dict, members: dict, quota: dict, max_times: int = 3) -> dict:
    """Words each pattern gives: cheapest flow, patterns (capacity per use) to sources (quota).

    Every augmenting path starts at the cheapest unused pass of some pattern and ends at an open
    quota; it may move earlier words of a shared source to another pattern's source (residual
    arcs), which is what keeps the flow optimal for overlapping sources.
    """
    used = {p: 0.0 for p in capacity}
    flow: dict = {p: dict.fromkeys(members[p], 0.0) for p in capacity}
    need = dict(quota)
    by_source: dict = {}
    for p in capacity:
        for s in members[p]:
            by_source.setdefault(s, []).append(p)
    dead: set = set()  # nothing reachable from here is open, now or later: searched once
    for times in range(max_times):  # price of this pass for all patterns alike: convex
        for start in capacity:
            while ("p", start) not in dead and used[start] < (times + 1) * capacity[start] - 1e-6:
                came, queue, goal = {("p", start): None}, [("p", start)], None
                for node in queue:
                    kind, key = node
                    if kind == "s" and need.get(key, 0) > 1e-6:
                        goal = node
                        break
                    step = [("s", s) for s in members[key]] if kind == "p" else [("p", p) for p in by_source[key] if flow[p][key] > 1e-6]
                    for nxt in step:
                        if nxt not in came and nxt not in dead:
                            came[nxt] = node
                            queue.append(nxt)
                if goal is None:
                    dead.update(came)
                    break
                path = [goal]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                room = min((times + 1) * capacity[start] - used[start], need[goal[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "s":
                        room = min(room, flow[b[1]][a[1]])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += room
                    else:
                        flow[b[1]][a[1]] -= room
                used[start] += room
                need[goal[1]] -= room
    return used


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_LEVELS, _LEVEL_BITS = 5, 12
_ALL = (1 << (_LEVELS * _LEVEL_BITS)) - 1


def _placed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """``docs`` and a number of each row that is the same at every use: the place in its file, or, for rows
    that come from no file, a number written down with them."""
    try:
        docs.select("_metadata.row_index")
        return docs, F.xxhash64("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        numbered = settle(docs.withColumn("_place", F.monotonically_increasing_id()), "mixing-rows")
        return numbered, F.xxhash64("_place")


def _order(id_col: str, text_col: str, place: Column, seed: int) -> Column:
    """The seeded order, 60 bits: a hash of id and text, then one of the row, so equal rows differ too."""
    upper = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), 28)
    return F.shiftleft(upper, 24).bitwiseOR(F.xxhash64(F.lit(seed), place).bitwiseAND(F.lit((1 << 24) - 1)))


def _cut(rows: DataFrame, room: DataFrame) -> DataFrame:
    """(key, cut): the largest order value that is taken, so that what is taken comes next to the key's
    ``left``.

    ``rows`` has (key, size, order), ``room`` (key, left), a row a pattern. A radix descent: sums by 12
    bits of the order say in which bin the cut lies, then by the next 12 bits of that bin's rows. So
    no rows are sorted, and rows of one value of the order meet in sums only."""
    edge = room.select("key", "left", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(_LEVELS):
        shift = _LEVEL_BITS * (_LEVELS - 1 - level)
        own = rows.join(F.broadcast(edge), "key").filter(F.shiftright("order", shift + _LEVEL_BITS) == F.col("prefix"))
        bins = own.groupBy("key", F.shiftright("order", shift).alias("bin")).agg(F.sum("size").alias("bin_size"), F.first("before").alias("before"), F.first("left").alias("left"))
        upto = F.col("before") + F.sum("bin_size").over(Window.partitionBy("key").orderBy("bin"))
        found = bins.withColumn("upto", upto).filter(F.col("upto") >= F.col("left")).groupBy("key").agg(F.min(F.struct("bin", F.col("upto").alias("upto"), "bin_size", "left")).alias("e"))
        edge = found.select("key", "e.left", F.col("e.bin").alias("prefix"), (F.col("e.upto") - F.col("e.bin_size")).alias("before"), F.col("e.bin_size").alias("tied"))
        if level < _LEVELS - 1:
            edge = edge.drop("tied")
    taken = F.col("before") + F.col("tied") / 2 <= F.col("left")
    return edge.select("key", F.when(taken, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))


def _pattern_key() -> Column:
    return F.xxhash64(F.size("member"), F.col("member"))


def mixing_plan(sizes: DataFrame, weights=weights_by_order, max_times: int = 3, max_patterns: int = 100_000) -> DataFrame:
    """Per pattern: size, target, whole passes, and where in hash order the last part ends.

    ``sizes`` has member (array of sources), size and order columns and is read three times.
    Documents above 1 percent of their pattern's size (under 100 of them) are chosen first and
    the rest fill up what they leave, so one long text does not throw a source off its target.
    """
    spark = sizes.sparkSession
    group = sizes.groupBy("member").agg(F.sum("size").cast("long").alias("capacity"))
    rows = group.limit(max_patterns + 1).collect()
    if len(rows) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    members = {i: list(r["member"]) for i, r in enumerate(rows)}
    capacity = {i: r["capacity"] or 0 for i, r in enumerate(rows)}
    per_source: dict = {}
    for i, own in members.items():
        for s in own:
            per_source[s] = per_source.get(s, 0) + capacity[i]
    total = sum(capacity.values())
    goal = targets(per_source, weights(list(per_source)), max_times)
    scale = total / sum(goal.values()) if sum(goal.values()) > total > 0 else 1.0
    used = route(capacity, members, {s: g * scale for s, g in goal.items()}, max_times)
    plan = []
    for i, own in members.items():
        passes = min(max_times, int((used[i] + 0.5) // capacity[i])) if capacity[i] else 0
        rest = used[i] - passes * capacity[i]
        rest = rest if rest >= 0.5 else 0.0
        plan.append((own, capacity[i], sum(per_source[s] for s in own), float(sum(goal[s] for s in own)), passes, rest))
    kind = sizes.schema["member"].dataType.simpleString()
    plan = spark.createDataFrame(plan, f"member {kind}, capacity long, source_size long, target double, passes int, rest double")
    plan = plan.withColumn("key", _pattern_key())

    slim = plan.select("key", "capacity", "rest")
    own = sizes.withColumn("key", _pattern_key()).select("key", "size", "order").join(F.broadcast(slim), "key")
    own = own.filter((F.col("rest") > 0) & (F.col("size") > 0)).withColumn("large", F.col("size") * 100 > F.col("capacity"))
    # fewer than 100 a pattern: in order, each that brings their sum nearer to their share of the rest
    # (one that is too long is passed over), then each that small ones cannot make up for
    big = own.filter("large").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("order", "size"))).alias("x"), F.sum("size").alias("all_large"))
    big = big.join(F.broadcast(slim), "key")
    share, few = F.col("rest") * F.col("all_large") / F.col("capacity"), F.col("capacity") - F.col("all_large")
    state = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("picks"))

    def picked(start: Column, fits) -> Column:
        def step(acc: Column, x: Column) -> Column:
            take = ~F.array_contains(acc["picks"], x["order"]) & fits(acc["sum"], x["size"])
            return F.when(take, F.struct((acc["sum"] + x["size"]).alias("sum"), F.concat(acc["picks"], F.array(x["order"])).alias("picks"))).otherwise(acc)

        return F.aggregate("x", start, step)

    big = big.withColumn("one", picked(state, lambda so_far, size: (so_far + size <= F.col("rest")) & (so_far + size / 2 <= share)))
    big = big.withColumn("two", picked(F.col("one"), lambda so_far, size: size / 2 <= F.col("rest") - so_far - few))
    big = big.select("key", F.col("two.picks").alias("picks"), F.col("two.sum").alias("sum_large"))
    left = slim.join(big, "key", "left").withColumn("left", F.col("rest") - F.coalesce("sum_large", F.lit(0)))

    small = own.filter(~F.col("large")).select("key", "size", "order")
    left = settle(left.select("key", "left", "picks"), "mixing-left")
    cut = _cut(small, left.select("key", "left").filter("left > 0"))
    out = plan.join(left, "key").join(cut, "key", "left")
    out = out.withColumn("cut", F.when(F.col("left") > 0, F.coalesce("cut", F.lit(_ALL))).otherwise(F.lit(-1)))
    return settle(out.drop("rest", "left"), "mixing-plan")


def apply_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target, copies and taken; ``docs`` has member, size and order columns."""
    small = plan.drop("member")
    docs = docs.withColumn("key", _pattern_key()).join(F.broadcast(small), "key", "left")
    large = F.col("size") * 100 > F.coalesce("capacity", F.lit(0))
    fits = F.when(large, F.array_contains("picks", F.col("order"))).otherwise(F.col("order") <= F.col("cut"))
    copies = F.col("passes") + F.coalesce(fits, F.lit(False)).cast("int")
    return docs.withColumn("copies", F.coalesce(copies, F.lit(0))).withColumn("taken", F.col("copies") * F.col("size"))


def mix_sources(
    docs: DataFrame,
    member: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=weights_by_order,
    max_times: int = 3,
    seed: int = 17,
    keep: list[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken added.

    ``member`` is an array of the sources a document belongs to (default: its ``source_col``).
    ``keep`` names the columns of ``docs`` to return (default: all).
    """
    member = F.array(F.col(source_col)) if member is None else F.array_sort(F.array_distinct(member))
    given = docs.columns
    docs, place = _placed(docs)
    added = {"member": member, "size": word_count(F.col(text_col)), "order": _order(id_col, text_col, place, seed)}
    keep = [c for c in (given if keep is None else keep) if c not in {*added, "source_size", "target", "copies", "taken"}]
    slim = settle(docs.select(*(c.alias(n) for n, c in added.items())), "mixing-sizes")
    plan = mixing_plan(slim, weights, max_times)
    wide = docs.select(*(F.col(c).alias(f"own_{c}") for c in keep), *(c.alias(n) for n, c in added.items()))
    out = apply_plan(wide, plan)
    return out.select(*(F.col(f"own_{c}").alias(c) for c in keep), "size", "source_size", "target", "copies", "taken")
