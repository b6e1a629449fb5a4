"""A constant of bits that keeps most values out of a join: of fixed size, and the join that follows is exact."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often it stands in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_bits(values: DataFrame, column: str, bits: int) -> Column:
    """A constant of ``bits`` bits with those of the column's hashes set; ``bits`` is a multiple of 64 and doesn't grow with the data."""
    bit = F.pmod(F.xxhash64(column), F.lit(bits))
    words = values.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(b & 63 AS INT)))").alias("w"))
    found = [0] * (bits // 64)
    for row in words.collect():  # bits / 64 numbers at most
        found[row["at"]] = row["w"]
    return F.from_json(F.lit(json.dumps(found)), "array<long>")


def may_be_in(filled: Column, value: Column, bits: int) -> Column:
    """False only for values that weren't among those of ``hash_bits``; null for a null."""
    test = lambda b: F.getbit(F.get(filled, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
    return once(F.when(value.isNotNull(), F.pmod(F.xxhash64(value), F.lit(bits))), test)
