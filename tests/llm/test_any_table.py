"""Stages on tables with odd columns, repeated rows and no rows, and what queries leave behind."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from strataforge.llm import mixing, secrets, simhash, suffixes, toxicity
from strataforge.sources.work import shared_folder

NAMES = ("n", "i", "stays", "text_key", "text_key_1", "first_id", "place", "row_no", "mix_size", "mix_id", "mix_row", "mix_digest", "mix_words", "k1", "node", "size", "a.b")


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["one two three four five six seven eight nine ten", "password: hunter2kX9q and more words here", None, "", "x" * 40_000 + " y", "one two three four five six seven eight nine ten"]
    rows = [(i if i != 3 else None, t, f"s{i % 2}") for i, t in enumerate(texts)] + [(1, texts[1], "s1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    for name in NAMES:
        docs = docs.withColumn(name, F.lit(7))
    return docs.withColumn("m", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("l", F.array("text"))


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(i, 0) for i in range(6)], "doc_id long, toxic int")


def stages(marks):
    return {
        "toxicity": lambda d: toxicity.without_toxic(d, marks),
        "near": simhash.one_of_each,
        "secrets": secrets.mask_secrets,
        "mixing": mixing.mixed_documents,
    }


@pytest.mark.parametrize("name", ["toxicity", "near", "secrets", "mixing"])
def test_columns_of_any_name_and_type(odd, marks, name):
    out = stages(marks)[name](odd)
    assert out.columns == odd.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd.schema]
    rows = out.collect()
    assert rows and all(r["n"] == r["mix_size"] == r["a.b"] == 7 for r in rows)
    if name == "near":
        assert Counter(r["text"] or "" for r in rows).most_common(1)[0][1] == 1 and len(rows) == 4
        assert {r["doc_id"] for r in rows} == {0, 1, 2, 4}
    if name == "secrets":
        assert len(rows) == odd.count() and not any("hunter2" in (r["text"] or "") for r in rows)


def test_no_rows(spark, odd, marks, tmp_path):
    for stage in stages(marks).values():
        assert stage(odd.limit(0)).count() == 0
    empty = spark.read.parquet(f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.001/documents.parquet").limit(0)
    empty.write.parquet(f"file://{tmp_path}/documents.parquet")
    marks.limit(0).withColumn("quality", F.lit(0)).write.parquet(f"file://{tmp_path}/labels.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0


def test_repeated_rows_share_the_mix(spark):
    """Each of many equal rows gets its own share, so that the words are those of the mix."""
    rows = [(1, "a b c d e f g h i j", "s")] * 20 + [(i, "k " * (i % 13), "t" if i % 2 else "s") for i in range(38)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = mixing.mix_sources(docs).agg(F.sum("taken")).first()[0]
    assert sum(len(r["text"].split()) for r in mixing.mixed_documents(docs).collect()) == words


def test_rows_without_id_have_keys_of_their_own(spark):
    docs = spark.createDataFrame([(None, f"word {i}", "s") for i in range(500)], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).select("mix_key").distinct().count() == 500


def test_nothing_is_left_behind(spark, odd):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    tables = {t.name for t in spark.catalog.listTables()}
    suffixes.suffix_dedup(odd, 40, 16).count()
    assert {t.name for t in spark.catalog.listTables()} == tables
    left = {n.rpartition("-")[0] or n for n in set(os.listdir(folder)) - before}
    assert left <= {"removals"}
