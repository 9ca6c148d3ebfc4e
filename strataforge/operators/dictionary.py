"""String dictionaries: dense stable ids, appending, resolving and finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.sources.work import shared_folder

#: Below this many rows one window numbers them all; above, ranges are numbered in parallel.
ONE_WINDOW = 50_000


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 0, rows: int | None = None) -> DataFrame:
    """df with dense numbers from `start` in the given order, which must be total.

    Large inputs are ranged by the order's columns; each range numbers its own rows and adds the rows of the ranges before it, so no task
    sees more than a range. The ranged rows are checkpointed: their numbers and the counts then come from the same ranges.
    """
    rows = df.count() if rows is None else rows
    if rows <= ONE_WINDOW:
        return df.withColumn(name, F.row_number().over(W.orderBy(*order)) + F.lit(start - 1)).withColumn(name, F.col(name).cast("long"))
    shared_folder(df.sparkSession)  # checkpoints need one
    ranged = df.repartitionByRange(max(2, rows // ONE_WINDOW), *order).withColumn("range_no", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range_no", (F.sum("n").over(W.orderBy("range_no")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("range_no").orderBy(*order))
    return ranged.withColumn("own_no", own).join(before, "range_no").withColumn(name, (F.col("before") + F.col("own_no") + F.lit(start - 1)).cast("long")).drop("range_no", "own_no", "before")


def first_appearance(strings: DataFrame) -> DataFrame:
    """(value, seq): each non-empty string of strings (value, seq) with its first place."""
    return strings.filter(F.coalesce(F.col("value"), F.lit("")) != "").groupBy("value").agg(F.min("seq").alias("seq"))


def intern(strings: DataFrame) -> DataFrame:
    """(id, value): the dictionary of strings (value, seq): "" is 0, others follow from 1 by first appearance. Null counts as ""."""
    spark = strings.sparkSession
    empty = spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit("").alias("value"))
    return empty.unionByName(numbered(first_appearance(strings), ["seq", "value"], start=1).select("id", "value"))


def append(dictionary: DataFrame, strings: DataFrame) -> DataFrame:
    """dictionary with the new ones of strings (value, seq) after its last id; ids that are there stay."""
    new = first_appearance(strings).join(dictionary.select("value"), "value", "left_anti")
    last = dictionary.agg(F.max("id")).first()[0]
    return dictionary.select("id", "value").unionByName(numbered(new, ["seq", "value"], start=(-1 if last is None else last) + 1).select("id", "value"))


def resolve(ids: DataFrame, dictionary: DataFrame, id_column: str = "id", name: str = "value") -> DataFrame:
    """ids with the string of each id; "" for an id that is not there."""
    side = dictionary.select(F.col("id").alias("of_id"), F.col("value").alias("of_value"))
    joined = ids.join(side, ids[id_column] == side["of_id"], "left")
    return joined.withColumn(name, F.coalesce("of_value", F.lit(""))).drop("of_id", "of_value")


def id_of(values: DataFrame, dictionary: DataFrame, column: str = "value", name: str = "id") -> DataFrame:
    """values with the id of each string: 0 for "" and null, -1 for one that is not there."""
    side = dictionary.select(F.col("value").alias("of_value"), F.col("id").alias("of_id"))
    joined = values.join(side, values[column] == side["of_value"], "left")
    found = F.when(F.coalesce(F.col(column), F.lit("")) == "", F.lit(0)).otherwise(F.coalesce("of_id", F.lit(-1)))
    return joined.withColumn(name, found.cast("long")).drop("of_value", "of_id")


def same_as(ids: DataFrame, dictionary: DataFrame, key: str, id_column: str = "id", name: str = "same") -> DataFrame:
    """ids with whether each names the string `key`."""
    return resolve(ids, dictionary, id_column, "resolved").withColumn(name, F.col("resolved") == F.lit(key)).drop("resolved")
