"""Array functions inside a row that Spark lacks, from those that it has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), value being computed once for the row however often f uses it."""
    return F.transform(F.array(value), f)[0]


def blocks(items: Column) -> Column:
    """An array as an array of arrays, about as many as each is long; none of none."""
    n = F.size(items)
    width = F.ceil(F.sqrt(n)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(n / F.greatest(width, F.lit(1))).cast("int") - 1), lambda b: F.slice(items, b * width + 1, width))
    return F.when(n > 0, cut).otherwise(F.slice(F.array(items), 1, 0))


def running(items: Column, f: Callable[[Column, Column], Column]) -> Column:
    """For each of some whole numbers the fold of f, which must be associative and have 0 as its neutral element,
    over all up to it. In two levels, so that n numbers take about n * sqrt(n) steps and no array grows by one."""
    zero = F.lit(0).cast("bigint")
    fold = lambda xs: F.aggregate(xs, zero, lambda a, b: f(a, b).cast("bigint"))

    def joined(cut: Column) -> Column:
        def of_sums(sums: Column) -> Column:
            def block(b: Column) -> Column:
                own = F.get(cut, b)
                before = fold(F.slice(sums, F.lit(1), b))
                return bind(F.struct(own.alias("own"), before.alias("before")), lambda s: F.transform(F.sequence(F.lit(1), F.size(s["own"])), lambda j: f(s["before"], fold(F.slice(s["own"], F.lit(1), j))).cast("bigint")))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut) - 1), block))

        return bind(F.transform(cut, fold), of_sums)

    return F.when(F.size(items) > 0, bind(blocks(items), joined)).otherwise(F.array().cast("array<bigint>"))
