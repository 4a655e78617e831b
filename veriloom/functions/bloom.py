"""A Bloom filter as a column: a bounded array of longs that a scan tests keys against, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, as a power of two: half a megabyte, whatever the number of keys. More keys only make it less selective.
LOG_BITS = 22


def filter_of(keys: DataFrame, log_bits: int = LOG_BITS) -> Column:
    """``keys(h)`` with hashes -> the filter, to be given to :func:`may_hold`. It is computed once, before the scan starts."""
    slots = 1 << log_bits - 6
    on = keys.select(F.pmod(F.shiftright("h", 6), F.lit(slots)).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int")).alias("bit"))
    on = on.groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(slots).join(on, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"])).scalar()


def may_hold(bloom: Column, h: Column, log_bits: int = LOG_BITS) -> Column:
    """Whether the filter may hold the hash; never false for a hash it was made of."""
    word = F.get(bloom, F.pmod(F.shiftright(h, 6), F.lit(1 << log_bits - 6)).cast("int"))
    return F.getbit(word, h.bitwiseAND(63).cast("int")) == 1
