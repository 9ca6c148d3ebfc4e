"""Variable-length lists an entity, kept as arrays: building, measuring, slicing, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def build(items: DataFrame, columns: list[str], spine: DataFrame | None = None, struct: bool = False) -> DataFrame:
    """(idx, items): items (idx, pos, columns) gathered in order of pos; entities of `spine` (idx) without any get an empty list.

    One column gives a list of its values, several (or struct) a list of records.
    """
    item = F.struct(*columns) if struct or len(columns) > 1 else F.col(columns[0])
    held = F.sort_array(F.collect_list(F.struct("pos", item.alias("item"))))
    lists = items.groupBy("idx").agg(F.transform(held, lambda x: x["item"]).alias("items"))
    if spine is None:
        return lists
    whole = spine.select("idx").join(lists, "idx", "left")
    return whole.withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))


def bucket_count(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.count(F.lit(1)).alias("bucket_count"))


def ranges(buckets: DataFrame) -> DataFrame:
    """(idx, start, stop): where each bucket would lie in one flat array, in order of idx.

    Sizes are summed by blocks of idx first, so a window sees a block or the list of blocks, never all buckets.
    """
    block = F.floor(F.col("idx") / 65_536)
    sized = buckets.select("idx", F.size("items").cast("long").alias("n"), block.alias("block"))
    totals = sized.groupBy("block").agg(F.sum("n").alias("of_block"))
    before = totals.select("block", (F.sum("of_block").over(W.orderBy("block")) - F.col("of_block")).alias("before"))
    stop = F.col("before") + F.sum("n").over(W.partitionBy("block").orderBy("idx"))
    return sized.join(before, "block").select("idx", (stop - F.col("n")).alias("start"), stop.alias("stop"))


def lengths(buckets: DataFrame) -> DataFrame:
    return buckets.select("idx", F.size("items").cast("long").alias("length"))


def slice_of(buckets: DataFrame, idx: int) -> DataFrame:
    """The list of one bucket."""
    return buckets.filter(F.col("idx") == idx).select("items")


def flat_slice(buckets: DataFrame) -> DataFrame:
    """Buckets of strided items as flat lists of numbers."""
    return buckets.select("idx", F.flatten("items").alias("items"))


def get(buckets: DataFrame, idx: Column | str, i: Column | int) -> DataFrame:
    """Item i (from 0) of each bucket, null beyond its end."""
    at = F.lit(i) if isinstance(i, int) else i
    return buckets.select(F.col(idx) if isinstance(idx, str) else idx, F.get("items", at).alias("item"))


def exploded(buckets: DataFrame) -> DataFrame:
    """(idx, pos, item): one row an item, as the raw columns stand."""
    return buckets.select("idx", F.posexplode("items").alias("pos", "item"))
