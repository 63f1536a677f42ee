"""Array expressions that stay linear in long arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are folded in one go: a fold copies what it has so far at each step.
SLICE = 256


def slices(values: Column) -> Column:
    """The array cut into slices of ``SLICE`` elements, one empty slice for an empty array."""
    last = F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / SLICE).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * SLICE + 1, F.lit(SLICE)))


def starts(sizes: Column) -> Column:
    """The sum of all elements before each one, for an array of bigint."""
    none = F.array().cast("array<bigint>")

    def run(part: Column, begin: Column) -> Column:
        empty = F.struct(begin.alias("at"), none.alias("out"))
        return F.aggregate(part, empty, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]

    zero = F.lit(0).cast("bigint")
    parts = slices(sizes)
    return F.flatten(F.zip_with(parts, run(F.transform(parts, lambda part: F.aggregate(part, zero, lambda a, x: a + x)), zero), run))
