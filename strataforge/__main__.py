"""python -m strataforge generate | status | check | inspect | help"""

from __future__ import annotations

import argparse
import importlib.machinery
import importlib.util
import json
import os
import sys
from datetime import UTC, datetime
from pathlib import Path
from types import ModuleType

from strataforge.errors import ConfigError, SnapshotError, generate_command
from strataforge.plans import generate as gen
from strataforge.plans.config import CONFIG_FILE, Target, resolve_targets
from strataforge.plans.fields import Field
from strataforge.plans.schema import Schema, diff_manifests


def shadowed(out: str) -> str | None:
    """Where a package stands that has the name of a folder of migrations, if there is one elsewhere."""
    where = Path(out).resolve()
    found = importlib.machinery.PathFinder.find_spec(where.name) if where.name.isidentifier() else None
    inside = found and (found.origin is None or Path(found.origin).resolve().is_relative_to(where))
    return found.origin if found and not inside else None


def load_module(path: str, name: str) -> ModuleType:
    where = Path(path)
    target = where / "__init__.py" if where.is_dir() else where
    spec = importlib.util.spec_from_file_location(name, target, submodule_search_locations=[str(where)] if where.is_dir() else None)
    if spec is None or not target.exists():
        raise ConfigError(f"{path} is not a Python module.")
    for old in [m for m in sys.modules if m == name or m.startswith(f"{name}.")]:
        del sys.modules[old]  # what is on disk may be newer
    module = importlib.util.module_from_spec(spec)
    sys.modules[name] = module
    spec.loader.exec_module(module)
    return module


def load_schema(target: Target) -> Schema:
    """The schema a module holds: a Schema, or a dict of fields called `fields`. Enforcement is off, so a drifted one still loads."""
    module = load_module(target.schema, f"schema_of_{target.name}")
    found = {k: v for k, v in vars(module).items() if isinstance(v, Schema)}
    if target.export:
        value = getattr(module, target.export, None)
        if isinstance(value, dict):
            return Schema(value)
        if not isinstance(value, Schema):
            raise ConfigError(f'{target.schema} holds no schema called "{target.export}".')
        return value
    if len(found) > 1:
        raise ConfigError(f'{target.schema} holds several schemas ({", ".join(found)}); name one as "export".')
    if found:
        return next(iter(found.values()))
    fields = getattr(module, "fields", None)
    if isinstance(fields, dict) and all(isinstance(f, Field) for f in fields.values()):
        return Schema(fields)
    raise ConfigError(f"{target.schema} holds no schema.")


def last_state(target: Target) -> tuple[dict, dict | None]:
    """(journal, last recorded snapshot) of a folder; empty and None where nothing is recorded."""
    where = Path(gen.journal_path(target.out))
    if not where.exists():
        return gen.empty_journal(), None
    journal = gen.parse_journal(where.read_text())
    if not journal["entries"]:
        return journal, None
    return journal, json.loads(Path(gen.snapshot_path(target.out, journal["entries"][-1]["version"])).read_text())


def change_lines(change: gen.Change) -> list[str]:
    return [
        *(f"  + {n} {s}" for n, s in change.added), *(f"  - {n} {s}" for n, s in change.removed), *(f"  ~ {n} {a} -> {b}" for n, a, b in change.changed),
        *(f"  {a} renamed to {b}" for a, b in change.renamed), *(["  fields reordered"] if change.reordered else []),
    ]


def fix(target: Target) -> str:
    return generate_command(target.name if target.listed else None)


def generate_one(target: Target, name: str | None, renames: dict[str, str], ask) -> int:
    """Write what is missing; returns how many fields still need data."""
    schema = load_schema(target)
    journal, previous = last_state(target)
    renames = dict(renames)
    if previous:
        for old, new, signature in gen.rename_candidates(diff_manifests(gen.recorded_manifest(previous), schema.compiled.manifest)):
            if old in renames:
                continue
            if ask is None:
                raise SnapshotError(f"{old} is gone and {new} is new, both {signature}. If that is a rename: {fix(target)} --rename {old}={new}. If not, run this in a terminal and say so.")
            if ask(f"Is {old} renamed to {new} (both {signature})? [y/N] "):
                renames[old] = new
    plan = gen.plan_generation(schema.compiled, journal, previous, target.out, datetime.now(UTC).isoformat(), name, target.name if target.listed else None, renames)
    for path, content in plan.files:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(content)
    if plan.status == "up-to-date":
        print(f"Schema is up to date (version {previous['version']})")
        return 0
    if plan.status == "initial":
        print(f"Initialised {target.out} at version 0 with {len(schema.layout)} fields")
        return 0
    print("\n".join([plan.id, *change_lines(plan.change)]))
    pending = len(plan.change.added) + len(plan.change.changed)
    print(f"{pending} field(s) need data: fill in up() in {plan.files[0][0]}" if pending else "Nothing to fill in: every field is carried over.")
    return pending


def status_one(target: Target) -> bool:
    """Whether a schema is recorded, filled in and unchanged."""
    schema = load_schema(target)
    _, previous = last_state(target)
    if previous is None:
        print(f"{target.out} is empty; run: {fix(target)}")
        return False
    if int(previous["hash"]) != schema.hash:
        print(f"Schema has changes that are not recorded (version {previous['version']})")
        for d in diff_manifests(gen.recorded_manifest(previous), schema.compiled.manifest):
            print({"added": f"  + {d.name} {d.after}", "removed": f"  - {d.name} {d.before}", "changed": f"  ~ {d.name} {d.before} -> {d.after}", "moved": f"  > {d.name}: {d.before} -> {d.after}"}[d.kind])
        print(f"Run: {fix(target)}")
        return False
    bundle = load_module(target.out, f"migrations_of_{target.name}").migrations
    for step, fields in bundle.unfinished:
        print(f"Unfinished: {step}: {', '.join(fields)}")
    if not bundle.unfinished:
        print(f"Up to date: version {previous['version']}, {len(previous['fields'])} fields")
    return not bundle.unfinished


def format_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    value, unit = n / 1024, 0
    while value >= 1024 and unit < 2:
        value, unit = value / 1024, unit + 1
    return f"{value:.2f} {('KiB', 'MiB', 'GiB')[unit]}" if value < 10 else f"{value:.1f} {('KiB', 'MiB', 'GiB')[unit]}"


def inspect_path(path: str, as_json: bool, sort: str, top: int | None) -> None:
    """Field sizes from the manifest of a snapshot. A local one needs no Spark session, any other is read through one."""
    if "://" in path and not path.startswith("file://"):
        from pyspark.sql import SparkSession

        from strataforge.sources.snapshot import read_header

        manifest = read_header(SparkSession.builder.getOrCreate(), path)
    else:
        where = Path(path.removeprefix("file://")) / "manifest.json"
        if not where.exists():
            raise SnapshotError(f"{path} is not a snapshot.")
        manifest = json.loads(where.read_text())
    fields = manifest["fields"]
    key = {"bytes": lambda f: -f["bytes"], "name": lambda f: f["name"], "order": lambda f: 0}[sort]
    fields = sorted(fields, key=key)
    total = sum(f["bytes"] for f in fields)
    if as_json:
        print(json.dumps({**manifest, "fields": fields, "bytes": total}, indent=2))
        return
    print(f"{path}\n  format {manifest['format']}  version {manifest['version']}  hash {manifest['hash']}\n  {format_bytes(total)} in {len(fields)} fields")
    for f in fields[:top]:
        print(f"  {f['name']:<24} {format_bytes(f['bytes']):>10}  {100 * f['bytes'] / max(total, 1):5.1f}%  {f['signature']}")
    if top is not None and top < len(fields):
        print(f"  ... {len(fields) - top} more")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="strataforge", description=__doc__)
    commands = parser.add_subparsers(dest="command")
    for command in ("generate", "status", "check"):
        p = commands.add_parser(command)
        for flag in ("--config", "--schema", "--out", "--export"):
            p.add_argument(flag)
        p.add_argument("--only", action="append")
        if command == "generate":
            p.add_argument("--name")
            p.add_argument("--rename", action="append", default=[])
    p = commands.add_parser("inspect")
    p.add_argument("path")
    p.add_argument("--json", action="store_true")
    p.add_argument("--sort", choices=("bytes", "name", "order"), default="bytes")
    p.add_argument("--top", type=int)
    commands.add_parser("help")
    args = parser.parse_args(argv)
    if args.command in (None, "help"):
        parser.print_help()
        return 0
    try:
        if args.command == "inspect":
            inspect_path(args.path, args.json, args.sort, args.top)
            return 0
        where = args.config or CONFIG_FILE
        config = json.loads(Path(where).read_text()) if os.path.exists(where) else {}
        targets = resolve_targets(config, args.schema, args.out, args.export, args.only)
        for t in targets:
            if hidden := shadowed(t.out):
                print(f"Note: {t.out} has the name of a package ({hidden}); an import may find either. --out takes another folder.", file=sys.stderr)
        if args.command != "generate":
            return int(not all([status_one(t) for t in targets]))
        if len(targets) > 1 and (args.name or args.rename):
            raise ConfigError(f"--name and --rename are for one schema; {len(targets)} are chosen. Add --only.")
        pairs = [r.split("=") for r in args.rename]
        if any(len(p) != 2 or not all(p) for p in pairs):
            raise ConfigError("--rename takes old=new.")
        ask = (lambda q: input(q).strip().lower().startswith("y")) if sys.stdin.isatty() else None
        return int(sum([generate_one(t, args.name, dict(pairs), ask) for t in targets]) > 0)
    except SnapshotError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
