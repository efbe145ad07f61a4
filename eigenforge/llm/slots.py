"""A prefilter of bounded size: which keys may be among a set of keys.

The set becomes at most 2**16 rows (slot, 16 masks of 64 bits), so its broadcast has a fixed bound whatever the input. A
key that is in the set always passes; others pass at a rate that grows with the set, to all of them at worst. An exact join
or a verification follows, so the filter only saves work and never decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Few wide rows, as a broadcast costs the driver and each executor more by its rows than by its bits.
SLOT_BITS, MASKS_BITS = 16, 4


def _slot(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - SLOT_BITS).cast("int")


def _mask(key: Column) -> Column:
    """Which of its slot's masks a key is in."""
    return F.shiftrightunsigned(key, 64 - SLOT_BITS - MASKS_BITS).bitwiseAND(F.lit((1 << MASKS_BITS) - 1)).cast("int")


def _bit(key: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))


def slots_of(keys: DataFrame, key: str) -> DataFrame:
    """The filter's table from a column of 64-bit hashes."""
    marked = keys.select(_slot(F.col(key)).alias("slot"), _mask(F.col(key)).alias("at"), _bit(F.col(key)).alias("bit"))
    masks = [F.coalesce(F.bit_or(F.when(F.col("at") == j, F.col("bit"))), F.lit(0).cast("long")) for j in range(1 << MASKS_BITS)]
    return marked.groupBy("slot").agg(F.array(*masks).alias("masks"))


def may_hold(df: DataFrame, key: str, slots: DataFrame, flag: str) -> DataFrame:
    """df with a boolean column: whether the key may be in the set."""
    s = slots.select(F.col("slot").alias(f"_slot_{flag}"), F.col("masks").alias(f"_masks_{flag}"))
    hit = (F.get(f"_masks_{flag}", _mask(F.col(key))).bitwiseAND(_bit(F.col(key))) != 0).alias(flag)
    return df.join(F.broadcast(s), _slot(F.col(key)) == F.col(f"_slot_{flag}"), "left").select(*[F.col(c) for c in df.columns], F.coalesce(hit, F.lit(False)).alias(flag))
