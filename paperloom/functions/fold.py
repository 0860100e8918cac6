"""Folds over a row's array whose output grows: it is built in pieces, so that no long array is
copied at every step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_out(values: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, finish: Callable[[Column], Column] | None = None, block: int = 256) -> Column:
    """Array of all that ``step`` gives out over ``values`` in order.

    ``step`` maps (state, value) to (next state, array<kind> given out), ``finish`` the last state
    to what is given out at the end."""
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["s"], x)
        return F.struct(after.alias("s"), F.concat(acc["o"], out).alias("o"))

    def part(acc: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(acc["s"].alias("s"), none.alias("o")), one)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["o"], F.array(d["o"])).alias("o")))

    def whole(v: Column) -> Column:
        last = F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / block).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * block + 1, F.lit(block)))
        end = lambda a: F.concat(F.flatten(a["o"]), none if finish is None else finish(a["s"]))
        return F.aggregate(parts, F.struct(state.alias("s"), nothing.alias("o")), part, end)

    return let(values, whole)
