"""Writes migrations: compares a schema with its last recorded state and renders what changed as a step to fill in."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from strataforge.errors import FormatError
from strataforge.functions.numbers import SHORT
from strataforge.plans.fields import Column_, field_from_signature
from strataforge.plans.schema import Compiled, FieldDiff, Manifest, diff_manifests

JOURNAL_FORMAT = 1
ALIAS = {name: short for short, name in SHORT.items()}
BUILDERS = {
    "stringTable": "string_table", "stringRefArray": "string_ref_array", "singleStringRef": "single_string_ref", "rawBytes": "raw_bytes", "num": "num_array", "bucketArray": "bucket_array",
    "multiBucketArray": "multi_bucket_array", "hashLookup": "hash_lookup", "keyedIndex": "keyed_index", "pairIndex2": "pair_index", "sortedU32Index": "sorted_u32_index", "trigramIndex": "trigram_index",
}


# --- journal


def empty_journal() -> dict:
    return {"format": JOURNAL_FORMAT, "entries": []}


def parse_journal(text: str) -> dict:
    journal = json.loads(text)
    if journal.get("format") != JOURNAL_FORMAT:
        raise FormatError(f"The journal has format {journal.get('format')}; this build reads {JOURNAL_FORMAT}.")
    return journal


def number(version: int) -> str:
    return f"{version:04d}"


def journal_path(out: str) -> str:
    return f"{out}/meta/journal.json"


def snapshot_path(out: str, version: int) -> str:
    return f"{out}/meta/{number(version)}_snapshot.json"


def migration_path(out: str, version: int, name: str) -> str:
    return f"{out}/m{number(version)}_{name}.py"


def barrel_path(out: str) -> str:
    return f"{out}/__init__.py"


def recorded_manifest(snapshot: dict) -> Manifest:
    return [tuple(f) for f in snapshot["fields"]]


# --- what changed


@dataclass
class Change:
    added: list[tuple[str, str]] = field(default_factory=list)
    removed: list[tuple[str, str]] = field(default_factory=list)
    changed: list[tuple[str, str, str]] = field(default_factory=list)
    renamed: list[tuple[str, str]] = field(default_factory=list)
    reordered: bool = False

    @property
    def empty(self) -> bool:
        return not (self.added or self.removed or self.changed or self.renamed or self.reordered)


def describe_change(diff: list[FieldDiff], renames: dict[str, str]) -> Change:
    out = Change(renamed=list(renames.items()))
    for d in diff:
        if d.kind == "added" and d.name not in renames.values():
            out.added.append((d.name, d.after))
        elif d.kind == "removed" and d.name not in renames:
            out.removed.append((d.name, d.before))
        elif d.kind == "changed":
            out.changed.append((d.name, d.before, d.after))
        elif d.kind == "moved":
            out.reordered = True
    return out


def snake_case(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)).lower()


def suggest_name(change: Change) -> str:
    """Two parts at most, of what is added, dropped, changed and renamed, in this order."""
    parts = []
    for verb, names in (("add", change.added), ("drop", change.removed), ("change", change.changed)):
        if names:
            parts.append(f"{verb}_{snake_case(names[0][0])}" if len(names) == 1 else f"{verb}_{len(names)}_fields")
    if change.renamed:
        (old, new), *more = change.renamed
        parts.append(f"rename_{len(more) + 1}_fields" if more else f"rename_{snake_case(old)}_to_{snake_case(new)}")
    return "_and_".join(parts[:2]) or ("reorder_fields" if change.reordered else "update_schema")


def rename_candidates(diff: list[FieldDiff]) -> list[tuple[str, str, str]]:
    """(removed, added, signature) of every pair that could be one field under a new name."""
    return [(a.name, b.name, a.before) for a in diff if a.kind == "removed" for b in diff if b.kind == "added" and a.before == b.after]


# --- rendering


def render_column(c: Column_) -> str:
    if c.number is None:
        return "string_ref()"
    short = ALIAS[c.number.name]
    if c.stride == 1:
        return f"{short}()"
    return "i32_pair()" if (short, c.stride) == ("i32", 2) else f'numbers("{short}", {c.stride})'


def render_field(signature: str) -> str:
    """The expression that declares a field of this signature."""
    f = field_from_signature(signature)
    if f.legacy:  # what builders make has the current signature
        return f"field_from_signature({json.dumps(signature)})"
    call = BUILDERS[f.kind]
    if f.kind == "num":
        return f'{call}("{ALIAS[f.columns[0][1].number.name]}")'
    if f.kind == "hashLookup":
        return f'{call}("{f.verify_via}")' if f.verify_via else f"{call}()"
    if f.kind in ("bucketArray", "keyedIndex"):
        return f"{call}({render_column(f.columns[0][1])})"
    if f.kind in ("multiBucketArray", "pairIndex2"):
        return f"{call}(**{{{', '.join(f'{json.dumps(n)}: {render_column(c)}' for n, c in f.columns)}}})"
    return f"{call}()"


def render_migration(id: str, change: Change, previous: Manifest) -> str:
    new = [(n, s, None) for n, s in change.added] + [(n, after, before) for n, before, after in change.changed]
    body = [f"    id={json.dumps(id)},"]
    if new:
        body += ["    defines={", *(f"        {json.dumps(n)}: {render_field(s)}," for n, s, _ in new), "    },"]
    if change.renamed:
        body.append(f"    renames={json.dumps(dict(change.renamed))},")
    if change.removed:
        body.append(f"    drops={json.dumps([n for n, _ in change.removed])},")
    head = ["# Generated. Every field is carried over; there is nothing to fill in."]
    up: list[str] = []
    if new:
        names = [n for n, *_ in new]
        carried = ", ".join(n for n, *_ in previous if n not in names)
        head = ["# Generated. Fill in up(), then take the names out of pending.", f"# Carried over: {carried}"]
        body += [f"    pending={json.dumps(names)},", "    up=up,"]
        up = ["def up(context):", "    return {"]
        for n, s, before in new:
            up.append(f"        # {n}: {before} -> {s}; the old one is context.previous.get({json.dumps(n)})" if before else f"        # {n}: new, {s}")
            up.append(f"        {json.dumps(n)}: todo({json.dumps(n)}),")
        up += ["    }", "", ""]
    imports = ["from strataforge.plans.fields import *  # noqa: F403", f"from strataforge.plans.migrate import migration{', todo' * bool(new)}", "", ""]
    return "\n".join([*head, *imports, *up, "step = migration(", *body, ")", ""])


def render_barrel(journal: dict, snapshot: dict, schema_name: str | None) -> str:
    steps = [e for e in journal["entries"] if e["version"] > 0]
    lines = ["# Generated; do not edit.", "from strataforge.plans.migrate import define_migrations", ""]
    lines += [f"from .m{e['id']} import step as m{number(e['version'])}" for e in steps]
    lines += ["", "migrations = define_migrations(", *([f"    name={json.dumps(schema_name)},"] if schema_name else []), f'    hash="{snapshot["hash"]}",', "    fields=["]
    lines += [f"        ({json.dumps(n)}, {json.dumps(s)}, {c})," for n, s, c in snapshot["fields"]]
    return "\n".join([*lines, "    ],", f"    entries=[{', '.join('m' + number(e['version']) for e in steps)}],", ")", ""])


@dataclass
class Plan:
    """status: initial, up-to-date or generated; files: (path, content) in the order to write them."""

    status: str
    files: list[tuple[str, str]]
    id: str = ""
    version: int = 0
    change: Change | None = None


def plan_generation(compiled: Compiled, journal: dict, previous: dict | None, out: str, timestamp: str, name: str | None = None, schema_name: str | None = None, renames: dict[str, str] | None = None) -> Plan:
    """What to write so that the folder records the schema as it is now. Nothing is read or written here."""
    version, change, step = 0, None, []
    if previous:
        before = recorded_manifest(previous)
        change = describe_change(diff_manifests(before, compiled.manifest), renames or {})
        if change.empty:
            return Plan("up-to-date", [])
        version = previous["version"] + 1
    slug = name or suggest_name(change) if change else "initial"
    id = f"{number(version)}_{slug}"
    if change:
        step = [(migration_path(out, version, slug), render_migration(id, change, before))]
    snapshot = {"version": version, "id": id, "hash": str(compiled.hash), "fields": [list(f) for f in compiled.manifest]}
    entries = [*(journal["entries"] if change else []), {"version": version, "id": id, "hash": snapshot["hash"], "created": timestamp}]
    after = {**journal, "entries": entries}
    text = lambda x: json.dumps(x, indent=2) + "\n"
    files = [*step, (snapshot_path(out, version), text(snapshot)), (journal_path(out), text(after)), (barrel_path(out), render_barrel(after, snapshot, schema_name))]
    return Plan("generated" if change else "initial", files, id, version, change)
