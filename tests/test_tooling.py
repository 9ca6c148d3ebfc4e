from __future__ import annotations

import json

import pytest

from strataforge.__main__ import format_bytes, main
from strataforge.errors import ConfigError, FormatError, MissingMigrationsError, SchemaDriftError, SnapshotError, UnfinishedMigrationError
from strataforge.plans import fields as K
from strataforge.plans import generate as G
from strataforge.plans.config import derive_name, resolve_targets
from strataforge.plans.migrate import define_migrations, migration, todo
from strataforge.plans.schema import Schema, compile_schema, diff_manifests

BASE = {"strings": K.string_table(), "city": K.single_string_ref(), "stopId": K.string_ref_array(), "stopLat": K.num_array("i32")}


@pytest.mark.parametrize(
    ("signature", "source"),
    [
        ("num:Int32Array", 'num_array("i32")'), ("hashLookup:stopId", 'hash_lookup("stopId")'), ("hashLookup:", "hash_lookup()"), ("bucketArray:Int32Array:2", "bucket_array(i32_pair())"),
        ("keyedIndex:strRef", "keyed_index(string_ref())"), ("bucketArray:Float32Array:3", 'bucket_array(numbers("f32", 3))'), ("trigramIndex", "trigram_index()"), ("pairIndex2:to=Uint8Array:1", 'pair_index(**{"to": u8()})'),
    ],
)
def test_rendered_fields_evaluate_back(signature, source):
    assert G.render_field(signature) == source
    assert eval(source, vars(K)).signature == signature


def change(new, renames=None, old=BASE):
    return G.describe_change(diff_manifests(compile_schema(old).manifest, compile_schema(new).manifest), renames or {})


@pytest.mark.parametrize(
    ("new", "renames", "name"),
    [
        ({**BASE, "stopBearing": K.num_array("u16")}, None, "add_stop_bearing"),
        ({k: v for k, v in BASE.items() if k != "city"}, None, "drop_city"),
        ({**BASE, "stopLat": K.num_array("f64")}, None, "change_stop_lat"),
        ({**BASE, "a": K.raw_bytes(), "b": K.raw_bytes(), "stopLat": K.num_array("f64")}, None, "add_2_fields_and_change_stop_lat"),
        ({("town" if k == "city" else k): v for k, v in BASE.items()}, {"city": "town"}, "rename_city_to_town"),
        (dict(reversed(BASE.items())), None, "reorder_fields"),
    ],
)
def test_suggested_names(new, renames, name):
    assert G.suggest_name(change(new, renames)) == name


def test_rename_candidates():
    new = {("town" if k == "city" else k): v for k, v in BASE.items()}
    assert G.rename_candidates(diff_manifests(compile_schema(BASE).manifest, compile_schema(new).manifest)) == [("city", "town", "singleStringRef")]


def test_plan_states():
    first = G.plan_generation(compile_schema(BASE), G.empty_journal(), None, "out", "now")
    assert first.status == "initial" and [p for p, _ in first.files] == ["out/meta/0000_snapshot.json", "out/meta/journal.json", "out/__init__.py"]
    previous, journal = json.loads(first.files[0][1]), json.loads(first.files[1][1])
    assert G.plan_generation(compile_schema(BASE), journal, previous, "out", "now").status == "up-to-date"
    more = G.plan_generation(compile_schema({**BASE, "x": K.num_array("u8")}), journal, previous, "out", "now")
    assert more.id == "0001_add_x" and more.version == 1 and more.files[0][0] == "out/m0001_add_x.py"
    with pytest.raises(FormatError):
        G.parse_journal('{"format": 9}')


def test_enforcement_order():
    schema = Schema(BASE)
    fields = schema.compiled.manifest
    pending = migration(id="0001_x", pending=["a"])
    with pytest.raises(MissingMigrationsError):
        Schema(BASE, migrations=define_migrations(0, []))
    with pytest.raises(SchemaDriftError):
        Schema(BASE, migrations=define_migrations(1, [pending], fields))
    with pytest.raises(UnfinishedMigrationError):
        Schema(BASE, migrations=define_migrations(schema.hash, [pending], fields))
    assert Schema(BASE, migrations=define_migrations(schema.hash, [pending], fields), enforce=False).version == 1
    assert Schema(BASE, migrations=define_migrations(schema.hash, [migration(id="0001_x")], fields)).version == 1
    with pytest.raises(SnapshotError):
        Schema(BASE, version=1, migrations=define_migrations(schema.hash, [], fields))
    with pytest.raises(SnapshotError):
        define_migrations(1, [migration()])
    with pytest.raises(SnapshotError, match="never filled in"):
        todo("x", "hint")


def test_config():
    assert derive_name("./src/stops/schema.py") == "stops" and derive_name("stops_schema.py") == "stops" and derive_name("../schema.py") == "schema"
    (t,) = resolve_targets({"schema": "./a/schema.py"})
    assert (t.name, t.out, t.listed) == ("a", "./migrations", False)
    two = resolve_targets({"schemas": ["./stops.py", {"schema": "./routes.py", "name": "r", "out": "./r"}], "out": "./m/"})
    assert [(t.name, t.out) for t in two] == [("stops", "./m/stops"), ("r", "./r")]
    assert [t.name for t in resolve_targets({"schemas": ["./a.py", "./b.py"]}, only=["b"])] == ["b"]
    assert resolve_targets({"schemas": ["./a.py"]}, schema="./z.py", out="./o")[0].out == "./o"
    for bad in [{}, {"schema": "a", "schemas": ["b"]}, {"schemas": []}, {"schemas": "a"}, {"schemas": [{}]}, {"schemas": ["x/a.py", "y/a.py"]}, {"schemas": [{"schema": "a.py", "out": "o"}, {"schema": "b.py", "out": "./o"}]}, {"schemas": [{"schema": "a.py", "name": "p"}, {"schema": "./a.py", "name": "q"}]}]:
        with pytest.raises(ConfigError):
            resolve_targets(bad)
    with pytest.raises(ConfigError):
        resolve_targets({"schema": "./a.py"}, only=["zz"])


SOURCE = "from strataforge.plans.fields import *\nfields = {'strings': string_table(), 'city': single_string_ref()%s}\n"


def test_command_line(tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    schema = tmp_path / "stops.py"
    schema.write_text(SOURCE % "")
    flags = ["--schema", "stops.py", "--out", "moves"]
    assert main(["status", *flags]) == 1
    assert main(["generate", *flags]) == 0 and main(["status", *flags]) == 0 and main(["generate", *flags]) == 0
    schema.write_text(SOURCE % ", 'lat': num_array('f64')")
    assert main(["check", *flags]) == 1
    assert main(["generate", *flags]) == 1  # a field waits for data
    assert (tmp_path / "moves/m0001_add_lat.py").exists() and main(["status", *flags]) == 1
    step = tmp_path / "moves/m0001_add_lat.py"
    step.write_text(step.read_text().replace('    pending=["lat"],\n', ""))
    assert main(["status", *flags]) == 0
    schema.write_text((SOURCE % ", 'lat': num_array('f64')").replace("city", "town"))
    assert main(["generate", *flags]) == 1 and "--rename city=town" in capsys.readouterr().err
    assert main(["generate", *flags, "--rename", "city=town"]) == 0
    assert main(["generate", *flags, "--rename", "x"]) == 1
    assert main(["help"]) == 0 and main(["inspect", "nowhere"]) == 1


def test_inspect(spark, capsys):
    from strataforge.sources import snapshot as S
    from strataforge.sources.work import work_path

    path = S.builder(spark, Schema(BASE)).put("city", "x").commit(work_path(spark, "cli")).path
    assert main(["inspect", path, "--top", "1"]) == 0 and "more" in capsys.readouterr().out
    assert main(["inspect", path, "--json", "--sort", "name"]) == 0 and '"version": 0' in capsys.readouterr().out
    assert format_bytes(10) == "10 B" and format_bytes(1792) == "1.75 KiB" and format_bytes(50 * 2**20) == "50.0 MiB"


def test_legacy_pairs_keep_their_signature():
    from strataforge.plans import fields as K
    from strataforge.plans.generate import render_field

    signature = "pairIndex:x=Uint32Array:1"
    assert eval(render_field(signature), vars(K)).signature == signature
    assert eval(render_field("pairIndex2:x=Uint32Array:1"), vars(K)).signature == "pairIndex2:x=Uint32Array:1"


def test_shadowed(tmp_path, monkeypatch):
    from strataforge.__main__ import shadowed

    assert shadowed(str(tmp_path / "json")) and not shadowed(str(tmp_path / "moves_of_mine"))


def test_replace_is_one_step(spark, tmp_path):
    from strataforge.sources import files

    path = f"file://{tmp_path}/x.json"
    for text in ("one", "two"):
        files.write_text(spark, path, text)
        assert files.read_text(spark, path) == text
    assert not files.exists(spark, f"{path}.draft")


def test_shared_folder_must_be_named(monkeypatch):
    from types import SimpleNamespace

    from strataforge.sources import work

    conf = SimpleNamespace(get=lambda *_: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(SnapshotError):
        work.shared_folder(session)
