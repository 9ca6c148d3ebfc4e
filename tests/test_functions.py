from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.errors import SnapshotError, UnknownSignatureError
from strataforge.functions import numbers as N
from strataforge.functions.grams import gram_count, grams
from strataforge.functions.hashing import hash64, signed64, split64
from strataforge.plans import fields as K

#: Known hashes.
GOLDEN = {"": 4566015895661888040, "a": 12829726840038533621, "R-ONZ": 10808491102859682830, "Kraków": 1840101414684575185, "🚋": 1630107054955553153}


@pytest.mark.parametrize("text", GOLDEN)
def test_hash64_golden(text):
    assert hash64(text) == GOLDEN[text]


def test_hash_halves():
    assert split64(hash64("a")) == (hash64("a") % 2**32, hash64("a") >> 32)
    assert signed64(2**64 - 1) == -1


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [("u8", 255.0, 255), ("u8", 3.9, 3), ("i8", -1.7, -1), ("u8c", 2.5, 2), ("u8c", 3.5, 4), ("i32", float("nan"), 0), ("u32", 2.0**32 - 1, 2**32 - 1), ("f64", 1e300, 1e300), ("u16", None, 0)],
)
def test_stored(spark, kind, value, want):
    assert one(spark, N.stored(F.lit(value).cast("double"), kind)) == want


def test_f32_overflow_and_nan(spark):
    assert one(spark, N.stored(F.lit(1e39), "f32")) == float("inf")
    v = one(spark, N.stored(F.lit(float("nan")), "f64"))
    assert v != v


@pytest.mark.parametrize(("kind", "value"), [("u8", 255.5), ("u8", -0.5), ("u8", 256.0), ("i8", 128.0), ("u16", 70000.0), ("u32", 2.0**32), ("u8c", 256.0), ("i16", float("-inf"))])
def test_stored_refuses(spark, kind, value):
    with pytest.raises(Exception, match="RangeError f: value .* at index 2 does not fit"):
        one(spark, N.stored(F.lit(value), kind, "f", F.lit(2)))


def test_fitted(spark):
    assert one(spark, N.fitted(F.array(F.lit(1)), 3)) == [1, 0, 0]
    assert one(spark, N.fitted(F.array(*map(F.lit, range(5))), 2)) == [0, 1]
    assert one(spark, N.fitted(F.lit(None).cast("array<int>"), 2)) == [0, 0]


def test_list_checks(spark):
    assert one(spark, N.any_out_of_range(F.array(F.lit(1.0), F.lit(300.0)), "u8"))
    assert one(spark, N.stored_list(F.array(F.lit(1.5), F.lit(2.0)), "u8")) == [1, 2]
    assert N.range_of("i8") == (-128, 127) and N.range_of("f32") is None
    assert N.pack_numbers([1, 258], "u16") == b"\x01\x00\x02\x01"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=8), min_size=1, max_size=8))
def test_grams_model(spark, names):
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", grams(F.col("n")).alias("g"), gram_count(F.lower("n")).alias("k")).collect()
    for r in got:
        low = spark.range(1).select(F.lower(F.lit(r["n"]))).first()[0]
        want = [low[i : i + 3] for i in range(len(low) - 2)] if len(low) >= 3 else [low] if low else []
        assert r["g"] == want and r["k"] == len(want)


SIGNATURES = [
    "stringTable", "stringRefArray", "singleStringRef", "rawBytes", "sortedU32Index", "trigramIndex", "num:Uint8ClampedArray", "hashLookup:", "hashLookup:stopId",
    "bucketArray:strRef", "bucketArray:Int32Array:2", "keyedIndex:Uint32Array:1", "multiBucketArray:name=strRef,at=Int32Array:2", "pairIndex2:from=Uint32Array:1,to=Uint8Array:1", "pairIndex:x=Float64Array:1", "multiBucketArray:",
]


@pytest.mark.parametrize("signature", SIGNATURES)
def test_signatures_round_trip(signature):
    assert K.field_from_signature(signature).signature == signature


@pytest.mark.parametrize("signature", ["", "nope", "num:BigInt64Array", "bucketArray:Int32Array", "bucketArray:Int32Array:0", "pairIndex2:x", "num:", "stringTable:x"])
def test_unknown_signatures(signature):
    with pytest.raises(UnknownSignatureError):
        K.field_from_signature(signature)


def test_reserved_names_and_strides():
    with pytest.raises(SnapshotError):
        K.pair_index(**{"a,b": K.u8()})
    with pytest.raises(SnapshotError):
        K.numbers("u8", 0)
