"""Lookups as joins: a DataFrame of keys probes an index. Of equal keys the first inserted wins; a miss is null.

Whether the index is broadcast is left to Spark, which knows its size; an index too large for that is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.numbers import wrapped_u32


def first_wins(index: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key: the value inserted first (by seq). Map-side combined, so hot keys shuffle one row a task."""
    return index.groupBy(*keys).agg(F.min_by(value, "seq").alias(value))


def find(probe: DataFrame, index: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """probe with index's value for its key, null where there is none. index: key, value, seq."""
    return probe.join(first_wins(index, ["key"], "value").select(F.col("key").alias(key), F.col("value").alias(value)), key, "left")


def find_verified(probe: DataFrame, index: DataFrame, verify: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """find(), but only of rows whose string in `verify` (idx, value) is the key: verified first, then the first wins."""
    true = index.join(verify.select(F.col("idx").alias("value"), F.col("value").alias("key")), ["value", "key"])
    return find(probe, true, key, value)


def zero_as_one(hash64: Column) -> Column:
    """Raw hash 0 shares its slot with 1."""
    return F.when(hash64 == 0, F.lit(1).cast("long")).otherwise(hash64)


def find_raw(probe: DataFrame, index: DataFrame, key: str = "hash", value: str = "value", verify: DataFrame | None = None, text: str | None = None) -> DataFrame:
    """find() by a given 64-bit hash. index: hash, value, seq. Hits are verified only if asked: a row counts whose string in `verify` (idx, value) is the probe's `text`."""
    rows, on = index.select(zero_as_one(F.col("hash")).alias("slot"), "value", "seq"), ["slot"]
    keyed = probe.withColumn("slot", zero_as_one(F.col(key)))
    if verify is not None:
        rows = rows.join(verify.select(F.col("idx").alias("value"), F.col("value").alias("slot_text")), "value")
        keyed, on = keyed.withColumn("slot_text", F.col(text)), ["slot", "slot_text"]
    one = first_wins(rows, on, "value").withColumnRenamed("value", value)
    return keyed.join(one, on, "left").drop(*on)


def find_split(probe: DataFrame, index: DataFrame, low: str = "lo", high: str = "hi", value: str = "value", verify: DataFrame | None = None, text: str | None = None) -> DataFrame:
    """find_raw() with the hash as two unsigned halves."""
    whole = F.shiftleft(F.col(high).cast("long"), 32).bitwiseOR(F.col(low).cast("long"))
    return find_raw(probe.withColumn("whole_hash", whole), index, "whole_hash", value, verify, text).drop("whole_hash")


def find_list(probe: DataFrame, index: DataFrame, key: str = "key", items: str = "items") -> DataFrame:
    """probe with the list kept for its key (the first bucket of a repeated key). index: key, items, seq."""
    return probe.join(first_wins(index, ["key"], "items").select(F.col("key").alias(key), F.col("items").alias(items)), key, "left")


def find_pair(probe: DataFrame, index: DataFrame, a: str = "a", b: str = "b", item: str = "item") -> DataFrame:
    """probe with the record kept for its ordered pair; both sides wrap modulo 2^32. index: a, b, item, seq."""
    side = index.select(wrapped_u32(F.col("a")).alias("wrapped_a"), wrapped_u32(F.col("b")).alias("wrapped_b"), F.col("item").alias(item), "seq")
    one = first_wins(side, ["wrapped_a", "wrapped_b"], item)
    keyed = probe.withColumn("wrapped_a", wrapped_u32(F.col(a))).withColumn("wrapped_b", wrapped_u32(F.col(b)))
    return keyed.join(one, ["wrapped_a", "wrapped_b"], "left").drop("wrapped_a", "wrapped_b")


def build_sorted(entries: DataFrame) -> DataFrame:
    """(key, value, seq) in ranges of the key, sorted within them, first of equal keys only, so that a probe can pass files over; keys and values wrap modulo 2^32."""
    wrapped = entries.select(wrapped_u32(F.col("key")).alias("key"), wrapped_u32(F.col("value")).alias("value"), "seq")
    return wrapped.groupBy("key").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq")).repartitionByRange("key").sortWithinPartitions("key")


def find_sorted(probe: DataFrame, index: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """probe with the value of a build_sorted() index; the probe's key does not wrap."""
    return probe.join(index.select(F.col("key").alias(key), F.col("value").alias(value)), key, "left")


def hits(probe: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """Rows of probe whose key is in the index."""
    return probe.join(index.select(F.col("key").alias(key)), key, "left_semi")


def misses(probe: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """Rows of probe whose key is not in the index."""
    return probe.join(index.select(F.col("key").alias(key)), key, "left_anti")
