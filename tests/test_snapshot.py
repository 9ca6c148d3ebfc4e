from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strataforge.errors import CarryConflictError, FormatError, MigrationDataLossError, MigrationPathError, SchemaMismatchError, SnapshotError
from strataforge.operators import lookup
from strataforge.plans import fields as K
from strataforge.plans.migrate import Migration, route
from strataforge.plans.schema import Schema, diff_manifests
from strataforge.sources import snapshot as S
from strataforge.sources.work import work_path

ALL = {
    "strings": K.string_table(), "city": K.single_string_ref(), "stopLookup": K.hash_lookup("stopId"), "stopId": K.string_ref_array(), "stopLat": K.num_array("i32"),
    "stopRoutes": K.bucket_array(K.u32()), "stopEntrances": K.multi_bucket_array(name=K.string_ref(), location=K.i32_pair()), "segments": K.pair_index(**{"from": K.u32(), "to": K.u8()}),
    "trigrams": K.trigram_index(), "sorted": K.sorted_u32_index(), "keyed": K.keyed_index(K.u32()), "blob": K.raw_bytes(),
}
STOPS = ["stop-a", "stop-b", "stop-c"]


def build_all(spark):
    df = spark.createDataFrame
    w = S.builder(spark, Schema(ALL, 1)).put("city", "warsaw").put("blob", b"\x01\x02\x03\x04\x05")
    w.put("stopLookup", df([(s, i, i) for i, s in enumerate(STOPS)], "key string, value long, seq long"))
    w.put("stopId", df(list(enumerate(STOPS)), "idx long, value string"))
    w.put("stopLat", df([(0, 52200000), (1, 52300000), (2, -1)], "idx long, value long"))
    w.put("stopRoutes", df([(0, [1, 2, 3]), (1, []), (2, [9])], "idx long, items array<long>"))
    w.put("stopEntrances", df([(0, [("Wejście A", [21000000, 52000000])]), (1, []), (2, None)], "idx long, items array<struct<name:string,location:array<int>>>"))
    w.put("segments", df([(4, 7, (100, 200), 0)], "a long, b long, item struct<from:long,to:long>, seq long"))
    w.put("trigrams", df([(0, "Dworzec Centralny", 0)], "id long, name string, seq long"))
    w.put("sorted", df([(77, 5, 0)], "key long, value long, seq long"))
    w.put("keyed", df([("line-1", [3, 4], 0)], "key string, items array<long>, seq long"))
    return w.commit(work_path(spark, "all"))


def test_every_kind_round_trips(spark):
    s = S.read(spark, Schema(ALL, 1), build_all(spark).path)
    assert s.get("city").first()["value"] == "warsaw" and bytes(s.get("blob").first()["value"]) == b"\x01\x02\x03\x04\x05"
    probe = spark.createDataFrame([("stop-b",), ("none",)], "key string")
    assert {r["key"]: r["value"] for r in lookup.find_verified(probe, s.get("stopLookup"), s.get("stopId")).collect()} == {"stop-b": 1, "none": None}
    assert {r["idx"]: r["items"] for r in s.get("stopRoutes").collect()} == {0: [1, 2, 3], 1: [], 2: [9]}
    entrance = {r["idx"]: r["items"] for r in s.get("stopEntrances").collect()}
    assert entrance[0][0]["name"] == "Wejście A" and entrance[0][0]["location"] == [21000000, 52000000] and entrance[1] == [] and entrance[2] == []
    assert s.get("segments").first()["item"]["to"] == 200
    assert s.get("sorted").first()["value"] == 5 and s.get("keyed").first()["items"] == [3, 4]
    assert s.get("trigrams").count() == 15
    assert {r["value"] for r in s.strings.collect()} == {"", "warsaw", *STOPS, "Wejście A"}
    assert s.strings.count() == 6 and s.strings.agg(F.max("id")).first()[0] == 5
    assert {r["value"]: r["id"] for r in s.ids("stopId").collect()}.keys() == set(STOPS)
    assert s.entity_view("stopId", "stopLat").filter("idx = 2").first()["stopLat"] == -1
    assert S.matches(spark, Schema(ALL, 1), s.path) and not S.matches(spark, Schema(ALL, 2), s.path)
    assert {r["name"] for r in S.inspect(spark, s.path).collect()} == set(ALL)
    assert s.signature("stopLat") == "num:Int32Array" and s.try_get("nothing") is None


def test_range_error_reaches_the_writer(spark):
    w = S.builder(spark, Schema({"strings": K.string_table(), "n": K.num_array("u8")}))
    with pytest.raises(Exception, match="RangeError n"):
        w.put("n", spark.createDataFrame([(0, 256.0)], "idx long, value double")).commit(work_path(spark, "bad"))


def test_unset_fields_are_empty(spark):
    s = S.builder(spark, Schema(ALL, 1)).commit(work_path(spark, "empty"))
    assert s.get("city").first()["value"] == "" and s.get("stopRoutes").count() == 0 and s.strings.count() == 1


def test_not_a_snapshot(spark, tmp_path):
    assert not S.is_snapshot(spark, f"file://{tmp_path}")
    (tmp_path / "manifest.json").write_text("{")
    with pytest.raises(FormatError):
        S.Snapshot(spark, f"file://{tmp_path}")


def test_schema_hash_golden():
    quick = {"strings": K.string_table(), "city": K.single_string_ref(), "stopLookup": K.hash_lookup("stopId"), "stopId": K.string_ref_array(), "stopName": K.string_ref_array(), "stopLat": K.num_array("i32"), "stopRoutes": K.bucket_array(K.u32())}
    assert Schema(quick).hash == 5893876162624689291
    assert Schema({**quick, "stopSearch": K.trigram_index()}).hash == 2945778429464777919


def test_schema_refusals():
    with pytest.raises(SnapshotError):
        Schema({"n": K.num_array("u8")})
    with pytest.raises(SnapshotError):
        Schema({"a": K.string_table(), "b": K.string_table()})
    with pytest.raises(SnapshotError):
        Schema({"a": K.string_table(), "l": K.hash_lookup("nothing")})
    with pytest.raises(SnapshotError):
        Schema({"a": K.string_table(), "7": K.num_array("u8")})


def test_mismatch_names_the_difference(spark):
    path = build_all(spark).path
    other = Schema({**{k: v for k, v in ALL.items() if k != "blob"}, "stopLat": K.num_array("f64"), "new": K.num_array("u8")}, 1)
    with pytest.raises(SchemaMismatchError) as e:
        S.read(spark, other, path)
    assert {(d.kind, d.name) for d in e.value.diff} == {("changed", "stopLat"), ("added", "new"), ("removed", "blob")}
    moved = diff_manifests([("a", "x", 1), ("b", "y", 1)], [("b", "y", 1), ("a", "x", 1)])
    assert {(d.kind, d.name, d.before, d.after) for d in moved} == {("moved", "a", 0, 1), ("moved", "b", 1, 0)}


# --- migrations

V1 = {"strings": K.string_table(), "cityName": K.single_string_ref(), "stopLookup": K.hash_lookup("stopId"), "stopId": K.string_ref_array(), "stopName": K.string_ref_array(), "stopLat": K.num_array("i32"), "stopRoutes": K.bucket_array(K.u32())}
V2 = {"strings": K.string_table(), "city": K.single_string_ref(), "stopLookup": K.hash_lookup("stopId"), "stopId": K.string_ref_array(), "stopName": K.string_ref_array(), "stopLat": K.num_array("i32"), "stopRoutes": K.bucket_array(K.u32()), "stopBearing": K.num_array("u16")}
V3 = {**V2, "stopLat": K.num_array("f64")}
NAMES = ["Rondo ONZ", "Dworzec Centralny", "Kraków Główny"]


def bearings(c):
    return {"stopBearing": c.previous.get("stopId").select("idx", F.lit(90).alias("value"))}


ONE = Migration(1, 2, "to2", renames={"cityName": "city"}, defines={"stopBearing": K.num_array("u16")}, up=bearings)
TWO = Migration(2, 3, "to3", defines=["stopLat"], up=lambda c: {"stopLat": c.previous.get("stopLat").withColumn("value", F.col("value") / 1e6)})


@pytest.fixture(scope="module")
def v1(spark):
    df = spark.createDataFrame
    w = S.builder(spark, Schema(V1, 1)).put("cityName", "warsaw").put("stopLookup", df([(s, i, i) for i, s in enumerate(STOPS)], "key string, value long, seq long"))
    w.put("stopId", df(list(enumerate(STOPS)), "idx long, value string")).put("stopName", df(list(enumerate(NAMES)), "idx long, value string"))
    w.put("stopLat", df([(0, 52231000), (1, 52228000), (2, 50067000)], "idx long, value long")).put("stopRoutes", df([(0, [1, 2]), (1, []), (2, [7])], "idx long, items array<long>"))
    return w.commit(work_path(spark, "v1"))


def test_chain(spark, v1):
    s, report = S.open_snapshot(spark, Schema(V3, 3, [ONE, TWO]), v1.path)
    assert sorted(r["value"] for r in s.get("stopLat").collect()) == [50.067, 52.228, 52.231]
    assert [r["value"] for r in s.get("stopBearing").collect()] == [90, 90, 90] and s.get("city").first()["value"] == "warsaw"
    assert [x.added for x in report.steps] == [["stopBearing"], []] and [x.rebuilt for x in report.steps] == [[], ["stopLat"]]
    assert s.entries["stopRoutes"].path == v1.entries["stopRoutes"].path  # carried: the same files
    assert {(r["id"], r["value"]) for r in v1.strings.collect()} <= {(r["id"], r["value"]) for r in s.strings.collect()}
    assert not S.open_snapshot(spark, Schema(V3, 3, [ONE, TWO]), s.path)[1].migrated


def test_write_back(spark, v1):
    copy = work_path(spark, "copy")
    fs = S.files
    fs.write_text(spark, f"{copy}/manifest.json", fs.read_text(spark, f"{v1.path}/manifest.json"))
    schema = Schema(V3, 3, [ONE, TWO])
    S.open_snapshot(spark, schema, copy, write_back=True)
    assert S.matches(spark, schema, copy)


def fails(spark, v1, fields, *steps, version=2):
    return S.open_snapshot(spark, Schema(fields, version, list(steps)), v1.path)


def test_guards(spark, v1):
    with pytest.raises(SchemaMismatchError):
        S.open_snapshot(spark, Schema(V3, 3, [ONE, TWO]), v1.path, migrating=False)
    with pytest.raises(SnapshotError, match=r"\(none\) instead of"):
        fails(spark, v1, V2, Migration(1, 2, "x", renames={"cityName": "city"}))
    with pytest.raises(SnapshotError, match=r"instead of \(none\)"):
        fails(spark, v1, {k: v for k, v in V1.items() if k != "stopLat"}, Migration(1, 2, "x"))
    with pytest.raises(MigrationDataLossError):
        fails(spark, v1, {**V1, "stopLat": K.num_array("f64")}, Migration(1, 2, "x", defines=["stopLat"]))
    with pytest.raises(MigrationDataLossError):  # list kinds are guarded as well
        fails(spark, v1, {**V1, "stopRoutes": K.bucket_array(K.u8())}, Migration(1, 2, "x", defines=["stopRoutes"]))
    with pytest.raises(CarryConflictError):
        fails(spark, v1, V1, Migration(1, 2, "x", up=lambda c: {"stopLat": c.previous.get("stopLat")}))
    with pytest.raises(SnapshotError, match="current schema lacks"):
        fails(spark, v1, V1, Migration(1, 2, "x", defines=["unknown"]))
    with pytest.raises(MigrationPathError, match="other fields"):
        S.open_snapshot(spark, Schema(V2, 1), v1.path)
    with pytest.raises(MigrationPathError, match="only grow"):
        S.open_snapshot(spark, Schema(V2, 0), v1.path)
    with pytest.raises(SnapshotError, match="no field"):
        fails(spark, v1, V1, Migration(1, 2, "x", rebuilds=["stopLat"], up=lambda c: c.previous.get("nope")))


def test_rebuild_drop_and_declared_loss(spark, v1):
    s, report = fails(spark, v1, V1, Migration(1, 2, "x", rebuilds=["stopLat"], up=lambda c: {"stopLat": c.previous.get("stopLat").withColumn("value", F.lit(1))}))
    assert report.steps[0].rebuilt == ["stopLat"] and s.get("stopLat").agg(F.sum("value")).first()[0] == 3
    s, report = fails(spark, v1, {k: v for k, v in V1.items() if k != "stopRoutes"}, Migration(1, 2, "x", drops=["stopRoutes"]))
    assert report.steps[0].dropped == ["stopRoutes"] and not s.has("stopRoutes")
    s, report = fails(spark, v1, V1, Migration(1, 2, "x", drops=["stopLat"], defines=["stopLat"]))
    assert report.steps[0].added == ["stopLat"] and s.get("stopLat").count() == 0


def test_rename_swap_and_verifier(spark, v1):
    swapped = {**V1, "stopName": K.string_ref_array(), "stopLookup": K.hash_lookup("stopName")}
    s, _ = fails(spark, v1, swapped, Migration(1, 2, "x", renames={"stopId": "stopName", "stopName": "stopId"}))
    assert {r["value"] for r in s.get("stopName").collect()} == set(STOPS)
    assert s.signature("stopLookup") == "hashLookup:stopName"


def test_route():
    step = lambda a, b: Migration(a, b)
    assert route([step(1, 3), step(3, 4)], 1, 4) == [step(1, 3), step(3, 4)]
    assert route([], 2, 2) == []
    for steps, a, b, why in [([step(1, 2), step(1, 3)], 1, 3, "left by 2 steps"), ([step(2, 2)], 1, 2, "leads from 2 to 2"), ([step(1, 2)], 1, 3, "end at version 2"), ([step(1, 4)], 1, 3, "end at version 4"), ([], 3, 1, "only grow")]:
        with pytest.raises(MigrationPathError, match=why):
            route(steps, a, b)
