"""The stages after one another, each on what the one before kept."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from strataforge.llm import secrets


@pytest.fixture(scope="module")
def stages(spark, small):
    small = small.replace("0.001", "0.01")  # enough labels to learn from
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, f in P.STAGES[:-1]:
        docs = P.stored(f(spark, docs, small), name)
        out.append(docs)
    return [spark.read.parquet(f"{small}/documents.parquet"), *out]


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages)


def test_decisions_take_effect(spark, small, stages):
    raw, clean, once, masked, mixed = stages
    assert 0 < clean.count() < raw.count() and once.count() < clean.count()
    texts = [r["text"] for r in once.collect()]
    assert len(set(texts)) == len(texts)
    assert masked.count() == once.count()
    before = {r["doc_id"]: r["text"] for r in once.collect()}
    guesser = secrets.corpus_guesser(once)
    for r in masked.collect():
        assert r["text"] == secrets.masked(before[r["doc_id"]], guesser=guesser) and secrets.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
    words = sum(len(r["text"].split()) for r in masked.collect())
    assert abs(sum(len(r["text"].split()) for r in mixed.collect()) - 1.5 * words) < 0.02 * words


def test_run(spark, small):
    out = P.run(spark, small)
    assert {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
    assert "pipeline" in entry.queries() and [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scans", "mixing", "packing"]


def test_sql(spark, small):
    """Queries with SQL agree with DuckDB."""
    from strataforge.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, small)
        names = sorted(got.columns)
        want = c.execute(sql)
        at = [[x[0] for x in want.description].index(n) for n in names]
        assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
