"""Schemas: an ordered set of fields, compiled to a layout and a 64-bit hash, with a version and migrations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from strataforge.errors import MissingMigrationsError, SchemaDriftError, SnapshotError, UnfinishedMigrationError
from strataforge.functions.hashing import hash64
from strataforge.plans.fields import Field
from strataforge.plans.migrate import Bundle, Migration, route

#: name, signature, section count.
Manifest = list[tuple[str, str, int]]


@dataclass(frozen=True)
class Layout:
    name: str
    field: Field
    first_section: int

    @property
    def signature(self) -> str:
        return self.field.signature

    @property
    def sections(self) -> int:
        return self.field.sections


@dataclass(frozen=True)
class Compiled:
    """Fields with their sections, and a hash that any change of names, kinds or places changes."""

    layout: tuple[Layout, ...]
    hash: int

    @cached_property
    def by_name(self) -> dict[str, Layout]:
        return {x.name: x for x in self.layout}

    @property
    def manifest(self) -> Manifest:
        return [(x.name, x.signature, x.sections) for x in self.layout]


def compile_schema(fields: Mapping[str, Field]) -> Compiled:
    layout, at = [], 0
    for name, field in fields.items():
        layout.append(Layout(name, field, at))
        at += field.sections
    total = sum(hash64(f"{x.name}:{x.signature}:{x.first_section}:{x.sections}") for x in layout)
    return Compiled(tuple(layout), total % (1 << 64))


@dataclass(frozen=True)
class FieldDiff:
    """kind: added (after: signature), removed (before), changed (both), moved (places)."""

    kind: str
    name: str
    before: str | int | None = None
    after: str | int | None = None


def diff_manifests(before: Manifest, after: Manifest) -> list[FieldDiff]:
    """What turns one manifest into another: for each new field whether it is added, changed or moved, then what is removed.

    A field moves if its place among the fields differs and nothing else about it.
    """
    old = {name: (i, signature) for i, (name, signature, _) in enumerate(before)}
    out = []
    for i, (name, signature, _) in enumerate(after):
        if name not in old:
            out.append(FieldDiff("added", name, None, signature))
        elif old[name][1] != signature:
            out.append(FieldDiff("changed", name, old[name][1], signature))
        elif old[name][0] != i:
            out.append(FieldDiff("moved", name, old[name][0], i))
    kept = {name for name, *_ in after}
    return out + [FieldDiff("removed", name, signature, None) for name, signature, _ in before if name not in kept]


class Schema:
    """What a snapshot is built, read and migrated with.

    migrations: a list of Migration for hand-numbered versions, or a Bundle, which brings the version with it. enforce: refuse a bundle
    that lacks migrations, has drifted from the fields or holds placeholders, in this order.
    """

    def __init__(self, fields: Mapping[str, Field], version: int | None = None, migrations: Bundle | Sequence[Migration] = (), enforce: bool = True) -> None:
        self.fields = dict(fields)
        for name in self.fields:
            if not name or name.isdigit():
                raise SnapshotError(f'"{name}" cannot name a field.')
        self.compiled = compile_schema(self.fields)
        self.bundle = migrations if isinstance(migrations, Bundle) else None
        if self.bundle and version is not None:
            raise SnapshotError("The bundle numbers versions; leave out version.")
        self.migrations = list(self.bundle.migrations if self.bundle else migrations)
        self.version = self.bundle.version if self.bundle else version or 0
        tables = [n for n, f in self.fields.items() if f.kind == "stringTable"]
        if len(tables) != 1:
            raise SnapshotError(f"A schema needs one string table, not {len(tables)}.")
        self.string_table = tables[0]
        for name, field in self.fields.items():
            if field.verify_via and getattr(self.fields.get(field.verify_via), "kind", "") != "stringRefArray":
                raise SnapshotError(f'"{name}" verifies via "{field.verify_via}", which is no string column of this schema.')
        if self.bundle and enforce:
            self._enforce(self.bundle)
        if self.migrations:
            latest = max(m.end for m in self.migrations)
            if latest != self.version:
                raise SnapshotError(f"The last migration ends at version {latest}, but the schema is at {self.version}.")
            route(self.migrations, min(m.start for m in self.migrations), self.version)

    def _enforce(self, bundle: Bundle) -> None:
        if not bundle.hash and not bundle.migrations:
            raise MissingMigrationsError(bundle.name)
        if bundle.hash != self.hash:
            raise SchemaDriftError(bundle.hash, self.hash, diff_manifests(bundle.manifest, self.compiled.manifest), bundle.name)
        if bundle.unfinished:
            raise UnfinishedMigrationError(bundle.unfinished, bundle.name)

    @property
    def hash(self) -> int:
        return self.compiled.hash

    @property
    def layout(self) -> tuple[Layout, ...]:
        return self.compiled.layout
