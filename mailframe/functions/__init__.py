"""Scalar functions over columns: built-in expressions, and Arrow functions where a grammar is needed."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value bound to a name: a value that body uses often is written and evaluated once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


#: Items of an array that are folded as they are; more are cut into blocks.
FEW = 100


def running(numbers: Column) -> Column:
    """For each number of an array the sum of those before it.

    A fold that appends to an array copies it each time, so the array is cut into blocks of the root of its size: 100,000
    numbers copy 16 million entries and not 5 billion.
    """

    def inside(part: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(part, state, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def blocks(x: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(x))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / side).cast("int") - 1), lambda i: F.slice(x, i * side + 1, side))
        return F.when(F.size(x) <= FEW, inside(x, F.lit(0).cast("long"))).when(F.size(x) > FEW, let(parts, lambda p: let(F.transform(p, total), lambda t: F.flatten(F.transform(p, lambda part, i: inside(part, total(F.slice(t, 1, i))))))))

    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    return F.coalesce(let(numbers.cast("array<bigint>"), blocks), F.array().cast("array<bigint>"))


def scanned(items: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """For each item of an array the state before it: an int that step(state, item) takes on. In blocks, as in ``running``."""

    def inside(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))

    def blocks(x: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(x))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / side).cast("int") - 1), lambda i: F.slice(x, i * side + 1, side))
        first = F.struct(F.lit(start).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        each = lambda s, part: let(inside(part, s["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))
        return F.when(F.size(x) <= FEW, inside(x, F.lit(start))["out"]).when(F.size(x) > FEW, F.aggregate(parts, first, each, lambda s: F.flatten(s["out"])))

    return F.coalesce(let(items, blocks), F.array().cast("array<int>"))
