from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.operators import buckets, dictionary, lookup, trigrams


def pairs(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


keys = st.lists(st.tuples(st.sampled_from(["", "a", "b", "ą", "🚋", "c"]), st.integers(0, 9)), max_size=12)


@settings(max_examples=15, deadline=None)
@given(keys)
def test_find_first_wins(spark, entries):
    index = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(entries)], "key string, value long, seq long")
    probe = spark.createDataFrame([(k,) for k in ("", "a", "b", "ą", "🚋", "zz")], "key string")
    model: dict = {}
    for k, v in entries:
        model.setdefault(k, v)
    assert pairs(lookup.find(probe, index), "key", "value") == {(k, model.get(k)) for k in ("", "a", "b", "ą", "🚋", "zz")}


def test_verified_goes_on_to_later_duplicates(spark):
    index = spark.createDataFrame([("x", 0, 0), ("x", 1, 1), ("y", 0, 2)], "key string, value long, seq long")
    names = spark.createDataFrame([(0, "other"), (1, "x")], "idx long, value string")
    probe = spark.createDataFrame([("x",), ("y",)], "key string")
    assert pairs(lookup.find_verified(probe, index, names), "key", "value") == {("x", 1), ("y", None)}


def test_raw_zero_is_one(spark):
    index = spark.createDataFrame([(0, 42, 0), (1, 7, 1), (-5, 9, 2)], "hash long, value long, seq long")
    probe = spark.createDataFrame([(0,), (1,), (-5,), (3,)], "hash long")
    assert pairs(lookup.find_raw(probe, index), "hash", "value") == {(0, 42), (1, 42), (-5, 9), (3, None)}
    split = spark.createDataFrame([(2**32 - 5, 2**32 - 1)], "lo long, hi long")
    assert lookup.find_split(split, index).first()["value"] == 9


def test_pairs_are_ordered_and_wrap(spark):
    index = spark.createDataFrame([(1, 2, 100, 0), (3, 4, 100, 1), (0, 5, 42, 2), (1, 2, 9, 3)], "a long, b long, item long, seq long")
    probe = spark.createDataFrame([(1, 2), (2, 1), (2**32 + 3, 4), (0, 5 - 2**32), (9, 9)], "a long, b long")
    assert pairs(lookup.find_pair(probe, index), "a", "b", "item") == {(1, 2, 100), (2, 1, None), (2**32 + 3, 4, 100), (0, 5 - 2**32, 42), (9, 9, None)}


def test_sorted_wraps_on_build_only(spark):
    index = lookup.build_sorted(spark.createDataFrame([(30, 300, 0), (10, 100, 1), (10, 5, 2), (-1, 8, 3)], "key long, value long, seq long"))
    probe = spark.createDataFrame([(10,), (30,), (15,), (-1,), (2**32 - 1,)], "key long")
    assert pairs(lookup.find_sorted(probe, index), "key", "value") == {(10, 100), (30, 300), (15, None), (-1, None), (2**32 - 1, 8)}


def test_keyed_list_first_bucket(spark):
    index = spark.createDataFrame([("r", [10, 11], 0), ("r", [1], 1), ("s", [], 2)], "key string, items array<int>, seq long")
    probe = spark.createDataFrame([("r",), ("s",), ("t",)], "key string")
    got = {r["key"]: r["items"] for r in lookup.find_list(probe, index).collect()}
    assert got == {"r": [10, 11], "s": [], "t": None}


def test_dictionary(spark):
    words = spark.createDataFrame([("b", 0), ("", 1), ("a", 2), ("b", 3), (None, 4), ("🚋", 5)], "value string, seq long")
    d = dictionary.intern(words)
    assert pairs(d, "id", "value") == {(0, ""), (1, "b"), (2, "a"), (3, "🚋")}
    more = dictionary.append(d, spark.createDataFrame([("a", 0), ("z", 1), ("y", 2)], "value string, seq long"))
    assert pairs(more, "id", "value") == {(0, ""), (1, "b"), (2, "a"), (3, "🚋"), (4, "z"), (5, "y")}
    assert pairs(dictionary.resolve(spark.createDataFrame([(1,), (99,)], "id long"), d), "id", "value") == {(1, "b"), (99, "")}
    assert pairs(dictionary.id_of(spark.createDataFrame([("a",), ("",), ("q",), (None,)], "value string"), d), "value", "id") == {("a", 2), ("", 0), ("q", -1), (None, 0)}


def test_numbering_in_ranges_is_dense(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "ONE_WINDOW", 100)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = sorted((r["k"], r["n"]) for r in dictionary.numbered(df, ["k"], "n", 5).collect())
    assert got == [(k, k + 5) for k in range(1000)]


def test_buckets(spark):
    items = spark.createDataFrame([(0, 1, 20), (0, 0, 10), (2, 0, 30)], "idx long, pos int, v int")
    b = buckets.build(items, ["v"], spark.range(4).withColumnRenamed("id", "idx"))
    assert {r["idx"]: r["items"] for r in b.collect()} == {0: [10, 20], 1: [], 2: [30], 3: []}
    assert pairs(buckets.ranges(b), "idx", "start", "stop") == {(0, 0, 2), (1, 2, 2), (2, 2, 3), (3, 3, 3)}
    assert pairs(buckets.get(b, "idx", 1), "idx", "item") == {(0, 20), (1, None), (2, None), (3, None)}
    assert buckets.bucket_count(b).first()[0] == 4


def model_search(names, text, ratio, limit):
    def grams(s):
        s = s.lower()
        return [s[i : i + 3] for i in range(len(s) - 2)] if len(s) >= 3 else [s] if s else []

    postings: dict = {}
    for seq, (id, name) in enumerate(names):
        for g in grams(name):
            postings.setdefault(g, {}).setdefault(id, seq)
    q = grams(text)
    score: dict = {}
    for t, g in enumerate(q):
        for id, seq in postings.get(g, {}).items():
            s = score.setdefault(id, [0, (t, seq)])
            s[0] += 1
    if not score:
        return []
    best = max(s for s, _ in score.values())
    least = max(max(1, len(q) - 1), best * ratio)
    kept = sorted(((-s, first, id) for id, (s, first) in score.items() if s >= least))
    return [(id, -s) for s, _, id in kept][:limit]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.text("abAB ", max_size=7)), min_size=1, max_size=10), st.text("ab", max_size=6), st.sampled_from([0.0, 0.5, 0.7, 1.0]), st.sampled_from([None, 0, 2]))
def test_search_model(spark, names, text, ratio, limit):
    index = trigrams.postings(spark.createDataFrame([(i, n, s) for s, (i, n) in enumerate(names)], "id long, name string, seq long"))
    got = trigrams.search(spark.createDataFrame([("q", text)], "query string, text string"), index, ratio, limit).orderBy("place").collect()
    assert [(r["id"], r["score"]) for r in got] == model_search(names, text, ratio, limit)


def test_only_entities_of_several_names_are_grouped(spark):
    names = [(1, "abcab", 5), (2, "abcd", 2), (2, "bcd", 1), (None, "xyz", 9), (None, "xyzw", 8), (3, None, 3), (4, "Abcabc", None)]
    df = spark.createDataFrame(names, "id long, name string, seq long")
    got = {tuple(r) for r in trigrams.postings(df).collect()}
    one = {("abc", 1, 5), ("bca", 1, 5), ("cab", 1, 5), *((g, 4, None) for g in ("abc", "bca", "cab"))}
    assert got == one | {("abc", 2, 2), ("bcd", 2, 1), ("xyz", None, 8), ("yzw", None, 8)}
    # nothing is grouped or sorted by gram where each entity has one name, and no index is broadcast or sorted for its scores
    single = trigrams.postings(df.filter("id = 1"))
    index = trigrams.scores(spark.createDataFrame([("q", "abca")], "query string, text string"), single)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("BroadcastExchange") == 1 and "BuildLeft" in plan


def test_first_gram_and_seq_of_scores(spark):
    """Queries too many to send give the same; seqs of any size, missing ones included, are kept."""
    index = spark.createDataFrame([("abc", 1, -(2**63)), ("bcd", 1, 7), ("bcd", 2, 2**63 - 1), ("bcd", 3, None), ("bcd", 4, 5), ("bcd", 4, 3)], "gram string, id long, seq long")
    asked = spark.createDataFrame([("q", "abcd")], "query string, text string")
    want = {1: (2, 0, -(2**63)), 2: (1, 1, 2**63 - 1), 3: (1, 1, None), 4: (2, 1, 3)}
    for few in (trigrams.FEW, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(trigrams, "FEW", few)
            assert {r["id"]: (r["score"], *r["first"]) for r in trigrams.scores(asked, index).collect()} == want


def test_split_lookup_verifies_if_asked(spark):
    index = spark.createDataFrame([(7, 0, 0), (7, 1, 1), (0, 2, 2)], "hash long, value long, seq long")
    names = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx long, value string")
    probe = spark.createDataFrame([(7, 0, "b"), (7, 0, "z"), (1, 0, "c")], "lo long, hi long, name string")
    got = {r["name"]: r["value"] for r in lookup.find_split(probe, index, verify=names, text="name").collect()}
    assert got == {"b": 1, "z": None, "c": 2}
    assert [r["value"] for r in lookup.find_split(probe.limit(1), index).collect()] == [0]
