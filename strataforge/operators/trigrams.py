"""Fuzzy search by trigrams: postings, overlap counts, a cutoff and a stable order.

Query grams keep their repeats, index grams do not. A hit must share all but one of the query's grams, and at least `ratio` of the
best hit's score. Equal scores stand in order of the first matching query gram, then of insertion.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.functions.grams import gram_count, grams

RATIO = 0.7
#: Queries of so many grams in all are sent to where the index is; more are met by a shuffle.
FEW = 100_000
#: Place and seq packed into one number, so that the least of them is kept in place, without a sort: t * SPAN + 1 + seq + 2**63, a null seq as 0.
SPAN, ZERO = Decimal(1 << 65), Decimal(1 << 63)


def postings(names: DataFrame) -> DataFrame:
    """(gram, id, seq): the distinct grams of each entity of names (id, name, seq), at their first insertion. Several names of an entity are united.

    An entity of one name gives its grams where its row stands; only names of entities with several are grouped by gram.
    """
    # never broadcast: sizes are estimated from the files, and what stands in them may be far larger
    several = names.groupBy(F.col("id").alias("of_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("of_id").hint("merge")
    each, same = names.select("id", "seq", "name"), F.col("id").eqNullSafe(F.col("of_id"))
    once = F.explode(F.array_distinct(grams(F.col("name")))).alias("gram")
    single, united = (each.join(several, same, how).select(once, "id", "seq") for how in ("left_anti", "left_semi"))
    # a missing seq comes first
    first = F.when(F.bool_or(F.col("seq").isNull()), F.lit(None)).otherwise(F.min("seq"))
    return single.unionByName(united.groupBy("gram", "id").agg(first.alias("seq")))


def scores(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, id, score, first, grams): how many grams of each query (query, text) each entity shares, before any cutoff."""
    q = queries.select("query", gram_count(F.col("text")).alias("grams"), F.posexplode(grams(F.col("text"))).alias("t", "gram"))
    few = (queries.agg(F.sum(gram_count(F.col("text")))).first()[0] or 0) <= FEW
    shared = q.hint("broadcast" if few else "merge").join(index, "gram")
    wide = lambda c: c.cast("decimal(38,0)")
    packed = wide(F.col("t")) * SPAN + F.coalesce(wide(F.col("seq")) + ZERO + F.lit(1), wide(F.lit(0)))
    found = shared.groupBy("query", "id", "grams").agg(F.count(F.lit(1)).alias("score"), F.min(packed.cast("decimal(38,0)")).alias("packed"))
    at = F.col("packed") % SPAN
    first = F.struct(((F.col("packed") - at) / SPAN).cast("int").alias("t"), F.when(at > 0, at - ZERO - F.lit(1)).cast("long").alias("seq"))
    return found.select("query", "id", "grams", "score", first.alias("first"))


def search(queries: DataFrame, index: DataFrame, ratio: float = RATIO, limit: int | None = None) -> DataFrame:
    """(query, place, id, score): the hits of each query (query, text) in order, place from 1.

    The hits of one query are ordered in one task; the minimum of grams shared keeps them few. A limit keeps each query's first so many.
    """
    # most entities share a few grams only: they go before anything is sorted, and the best hit is never among them if any hit is left
    shared = scores(queries, index).filter(F.col("score") >= F.greatest(F.lit(1), F.col("grams") - 1))
    best = shared.withColumn("best", F.max("score").over(W.partitionBy("query")))
    kept = best.filter(F.col("score") >= F.col("best") * F.lit(float(ratio)))
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "first.t", "first.seq", "id")
    placed = kept.withColumn("place", F.row_number().over(order))
    if limit is not None:
        placed = placed.filter(F.col("place") <= limit)
    return placed.select("query", "place", "id", F.col("score").cast("long").alias("score"))
