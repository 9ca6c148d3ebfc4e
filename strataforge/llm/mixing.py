"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys; within a source they are ordered by key, in ranges of the key that nest two levels
deep, so that no window holds more than a bounded share of a source however large that is. Word counts are summed by range, by range
of ranges and by source, and a document's prefix sum is the sum of the three levels before it. Each source is cut
where its prefix sum meets its budget, after as many whole epochs as the target holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strataforge.llm.common import WORD, columns_of, documents, fresh, stored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_REPEATS = 2.0
KEY_BITS = 60
RANGE_ROWS = 256
FANOUT_BITS = 8
#: Source tables of at most so many rows (under 10 MB) are broadcast; larger ones are joined by a shuffle, whose skew is split at run time.
BROADCAST_SOURCES = 100_000
BEFORE = (W.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD + "+")), F.lit(0)).cast("long")


def mix_key(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of id and text, the same in every run and every engine. Rows of one id differ by their texts."""
    of = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(of.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = MOST_REPEATS) -> DataFrame:
    """One row a source: source, source_rank, source_size, n_docs, weight, target.

    `sizes` has source and size a document. Sources in order of code points, null last, take the weights in turn and share
    `share` times all words; a target stops at `repeats` times its source, and the excess is shared again by weight.
    With sources in order of the level at which they fill up, the level where the rest meet the total has a closed form, so no loop is needed.
    The one-partition windows here see a row a source, never documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = by_source.withColumn("source_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = reduce(lambda rest, iw: F.when(F.col("source_rank") % len(weights) == iw[0], F.lit(float(iw[1]))).otherwise(rest), enumerate(weights), F.lit(None).cast("double"))
    capped = ranked.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("fills_at", F.col("cap") / F.col("weight"))
    fill = W.orderBy("fills_at", "source_rank")
    filled_before = F.coalesce(F.sum("cap").over(fill.rowsBetween(*BEFORE)), F.lit(0.0))
    weight_left = F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing))
    level = (F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)) - filled_before) / weight_left
    met = capped.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("fills_at"), F.col("level"))).over(W.partitionBy()))
    target = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level") * F.col("weight")).otherwise(F.col("cap"))
    return met.select("source", "source_rank", "source_size", "n_docs", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = MOST_REPEATS, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken, epochs, mix_key, words_before and the columns in `extra`.

    taken: whole epochs of the document plus what the source's cut leaves of it, in words. Null text has size 0; null sources form
    one source; documents with equal keys stand in order of id and size; repeated rows are taken one after another; texts of any length are counted whole; an empty table
    gives no rows.
    Other columns are not read unless named in `extra`.
    """
    slim = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), mix_key(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("mix_key"), *extra
        ),
        "mix-sizes",
    )
    targets = stored(source_targets(slim, weights, share, repeats), "mix-targets")
    # so many bits of the key name a range that a range holds RANGE_ROWS documents or so
    bits = F.least(F.lit(KEY_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / RANGE_ROWS)))).cast("int")
    side = targets.select(F.col("source").alias("of"), "source_rank", "source_size", "target", bits.alias("bits"))
    side = F.broadcast(side) if targets.count() <= BROADCAST_SOURCES else side
    placed = slim.join(side, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("fine", F.expr(f"shiftright(mix_key, {KEY_BITS} - bits)")).withColumn("coarse", F.shiftright("fine", FANOUT_BITS)).drop("bits")

    fine = placed.groupBy("source_rank", "coarse", "fine").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("source_rank", "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.select("source_rank", "coarse", F.coalesce(F.sum("n").over(W.partitionBy("source_rank").orderBy("coarse").rowsBetween(*BEFORE)), F.lit(0)).alias("coarse_before"))
    fine = fine.select("source_rank", "coarse", "fine", F.coalesce(F.sum("n").over(W.partitionBy("source_rank", "coarse").orderBy("fine").rowsBetween(*BEFORE)), F.lit(0)).alias("fine_before"))
    before = fine.join(coarse, ["source_rank", "coarse"]).select("source_rank", "fine", (F.col("fine_before") + F.col("coarse_before")).alias("range_before"))

    own = W.partitionBy("source_rank", "fine").orderBy("mix_key", "doc_id", "size", *extra).rowsBetween(*BEFORE)
    summed = placed.withColumn("own_before", F.coalesce(F.sum("size").over(own), F.lit(0))).join(before, ["source_rank", "fine"])
    summed = summed.withColumn("words_before", F.col("own_before") + F.col("range_before"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    summed = summed.withColumn("epochs", epochs)
    left = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size") - F.col("words_before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return summed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "epochs", "mix_key", F.col("words_before").cast("long").alias("words_before"), *extra)


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word, white space kept."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: each whole epoch of a document is a row, and the one at its source's cut ends at its last word taken. All columns, of whatever names and types.

    Rows are numbered and written first, so each repeated row gets its own share and the rows' words are exactly those of the mix. Documents without words are in no mix; an
    empty table gives no rows.
    """
    row, taken, size, words = fresh(docs, "mix_row", "mix_taken", "mix_size", "mix_words")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    mix = mix_sources(numbered.select("doc_id", "source", "text", row), extra=(row,), **how)
    share = mix.filter("taken > 0").select(row, F.col("taken").alias(taken), F.col("size").alias(size))
    got = numbered.join(share, row)
    rest = F.col(taken) % F.col(size)
    parts = F.concat(F.array_repeat(F.col(size), F.floor(F.col(taken) / F.col(size)).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = got.withColumn(words, F.explode(parts))
    text = F.when(F.col(words) == F.col(size), F.col("text")).otherwise(first_words(F.col("text"), F.col(words)))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*columns_of(docs))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS mix_key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, least(cap, weight * max(CASE WHEN lev <= cap / weight THEN lev END) OVER ()) AS target FROM l),
p AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS words_before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * source_size - words_before)) AS BIGINT) AS taken,
       CAST(epochs AS BIGINT) AS epochs, mix_key, words_before
FROM p
"""
