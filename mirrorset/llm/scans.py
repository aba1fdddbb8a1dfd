"""Running states over arrays in column expressions, in time that grows with the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of an array that are handled together: an aggregate that appends copies what it has, so long arrays are built block by block.
BLOCK = 256


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def blocks(items: Column) -> Column:
    """An array cut into arrays of at most ``BLOCK`` items; empty and null arrays have none."""

    def cut(known: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(known), F.lit(BLOCK))
        return F.when(F.size(known) > 0, F.transform(places, lambda at: F.slice(known, at, BLOCK))).otherwise(F.array())

    return let(items, cut)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states after each item of an array; ``kind`` is the type of a state."""

    def item(state: Column, x: Column) -> Column:
        return let(step(state["last"], x), lambda now: F.struct(now.alias("last"), F.concat(state["all"], F.array(now)).alias("all")))

    def block(state: Column, part: Column) -> Column:
        start = F.struct(state["last"].alias("last"), F.array().cast(f"array<{kind}>").alias("all"))
        return F.aggregate(part, start, item, lambda s: F.struct(s["last"].alias("last"), F.concat(state["all"], F.array(s["all"])).alias("all")))

    start = F.struct(zero.cast(kind).alias("last"), F.array().cast(f"array<array<{kind}>>").alias("all"))
    return F.aggregate(blocks(items), start, block, lambda s: F.flatten(s["all"]))
