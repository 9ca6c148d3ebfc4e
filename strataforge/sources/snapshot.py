"""Snapshots on disk: one immutable Parquet dataset a field and a manifest that describes them.

The manifest is written last and replaced as a whole, so a snapshot is there entirely or not at all. It names fields by signature: a snapshot
opens without the code that wrote it. Sizes and row counts stand in it, so inspecting reads nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.errors import FormatError, SchemaMismatchError, SnapshotError
from strataforge.functions.numbers import fitted, stored, wrapped_u32
from strataforge.operators import dictionary
from strataforge.operators.lookup import build_sorted
from strataforge.operators.trigrams import postings
from strataforge.plans.fields import Column_, Field, field_from_signature
from strataforge.plans.migrate import Report, migrate
from strataforge.plans.schema import Compiled, FieldDiff, Schema, compile_schema, diff_manifests
from strataforge.sources import files

FORMAT = 1
MANIFEST = "manifest.json"
#: So many fields are written at a time.
WRITERS = 8


@dataclass(frozen=True)
class Entry:
    """What the manifest says of one field."""

    name: str
    signature: str
    sections: int
    path: str
    rows: int
    bytes: int


def value_to_store(value: Column, column: Column_, label: str, index: Column | None = None) -> Column:
    """One item as a column of a field stores it: strings never null, numbers checked and converted, strides filled or cut."""
    if column.number is None:
        return F.coalesce(value.cast("string"), F.lit(""))
    if column.stride == 1:
        return stored(value, column.number.name, label, index)
    return F.transform(fitted(value, column.stride), lambda v, i: stored(v, column.number.name, label, i))


def _items(field: Field, name: str, items: str = "items") -> Column:
    if field.kind in ("bucketArray", "keyedIndex"):
        column = field.columns[0][1]
        return F.coalesce(F.transform(items, lambda v, i: value_to_store(v, column, name, i)), F.array().cast(f"array<{column.spark.simpleString()}>"))
    record = lambda v, i: F.struct(*(value_to_store(v[n], c, f"{name}.{n}", i).alias(n) for n, c in field.columns))
    return F.coalesce(F.transform(items, record), F.array().cast(field.frame["items"].dataType))


def prepared(field: Field, name: str, df: DataFrame) -> DataFrame:
    """df as the field's dataset: checked, converted, and reduced to what lookups need (the first of equal keys)."""
    kind = field.kind
    if kind == "num":
        out = df.select(F.col("idx").cast("long").alias("idx"), value_to_store(F.col("value"), field.columns[0][1], name, F.col("idx")).alias("value"))
    elif kind == "stringRefArray":
        out = df.select(F.col("idx").cast("long").alias("idx"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    elif kind in ("bucketArray", "multiBucketArray"):
        out = df.select(F.col("idx").cast("long").alias("idx"), _items(field, name).alias("items"))
    elif kind == "hashLookup":
        out = df.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), wrapped_u32(F.col("value")).alias("value"), F.col("seq").cast("long").alias("seq"))
        if not field.verify_via:  # with verification a later duplicate may be the one that holds
            out = out.groupBy("key").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    elif kind == "keyedIndex":
        rows = df.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), _items(field, name).alias("items"), F.col("seq").cast("long").alias("seq"))
        out = rows.groupBy("key").agg(F.min_by("items", "seq").alias("items"), F.min("seq").alias("seq"))
    elif kind == "pairIndex2":
        item = F.struct(*(value_to_store(F.col("item")[n], c, f"{name}.{n}").alias(n) for n, c in field.columns))
        rows = df.select(wrapped_u32(F.col("a")).alias("a"), wrapped_u32(F.col("b")).alias("b"), item.alias("item"), F.col("seq").cast("long").alias("seq"))
        out = rows.groupBy("a", "b").agg(F.min_by("item", "seq").alias("item"), F.min("seq").alias("seq"))
    elif kind == "sortedU32Index":
        out = build_sorted(df)
    elif kind == "trigramIndex":
        out = postings(df.filter("id >= 0")) if "name" in df.columns else df
    else:
        out = df
    return out.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in field.frame))


def strings_of(entry: Field, df: DataFrame, ordinal: int) -> DataFrame | None:
    """(value, seq) of the strings a field holds, seq in order of field, entity and item; None if it holds none."""
    at = lambda *x: F.struct(F.lit(ordinal).alias("f"), *(c.cast("long").alias(n) for n, c in zip(("i", "j", "k"), x, strict=True))).alias("seq")
    zero = F.lit(0)
    if entry.kind == "stringRefArray":
        return df.select("value", at(F.col("idx"), zero, zero))
    if entry.kind == "singleStringRef":
        return df.select("value", at(zero, zero, zero))
    texts = [(k, n) for k, (n, c) in enumerate(entry.columns) if c.number is None]
    if not texts or entry.kind not in ("bucketArray", "keyedIndex", "multiBucketArray", "pairIndex2"):
        return None
    order = F.col("seq") if entry.kind in ("keyedIndex", "pairIndex2") else F.col("idx")
    if entry.kind == "pairIndex2":
        parts = [df.select(F.col("item")[n].alias("value"), at(order, zero, F.lit(k))) for k, n in texts]
    else:
        each = df.select(order.alias("o"), F.posexplode("items").alias("p", "v"))
        named = entry.kind == "multiBucketArray"
        parts = [each.select((F.col("v")[n] if named else F.col("v")).alias("value"), at(F.col("o"), F.col("p"), F.lit(k))) for k, n in texts]
    return reduce(DataFrame.unionByName, parts)


class SnapshotWriter:
    """Collects a DataFrame a field; commit() writes them and then the manifest."""

    def __init__(self, spark: SparkSession, compiled: Compiled, version: int) -> None:
        self.spark, self.compiled, self.version = spark, compiled, version
        self.data: dict[str, DataFrame | str | bytes] = {}
        self.kept: dict[str, Entry] = {}
        self.base: DataFrame | None = None

    def put(self, name: str, data: DataFrame | str | bytes) -> SnapshotWriter:
        """Set a field's contents; what was put before is replaced. A string or bytes stands for a single-value field."""
        if name not in self.compiled.by_name:
            raise SnapshotError(f'The schema has no field "{name}".')
        self.data[name] = data
        return self

    def carry(self, name: str, previous: Snapshot, source: str | None = None) -> SnapshotWriter:
        """Take a field over from another snapshot: the new manifest names the same files."""
        layout, entry = self.compiled.by_name.get(name), previous.entries[source or name]
        if layout is None:
            raise SnapshotError(f'The schema has no field "{name}".')
        if layout.sections != entry.sections:
            raise SnapshotError(f'"{name}" has {layout.sections} sections, what is carried has {entry.sections}.')
        self.kept[name] = Entry(name, layout.signature, entry.sections, entry.path, entry.rows, entry.bytes)
        return self

    def is_carried(self, name: str) -> bool:
        return name in self.kept

    def keep_strings(self, previous: Snapshot) -> SnapshotWriter:
        """Start from another snapshot's dictionary: its ids stay, new strings follow."""
        self.base = previous.strings
        return self

    def _frame(self, name: str, field: Field) -> DataFrame:
        data = self.data.get(name)
        if isinstance(data, DataFrame):
            return data
        if field.kind == "singleStringRef":
            return self.spark.createDataFrame([(data or "",)], "value string")
        if field.kind == "rawBytes":
            return self.spark.createDataFrame([(bytearray(data or b""),)], "value binary")
        return self.spark.createDataFrame([], field.frame)

    def commit(self, path: str) -> Snapshot:
        entries: dict[str, Entry] = {}

        def write(name: str, field: Field, sections: int, df: DataFrame) -> DataFrame:
            where = files.resolved(self.spark, f"{path}/fields/{name}-{uuid.uuid4().hex}")
            df.write.parquet(where)
            back = self.spark.read.schema(field.frame).parquet(where)
            entries[name] = Entry(name, field.signature, sections, where, back.count(), files.size_of(self.spark, where))
            return back

        def fill(ordinal: int, x) -> DataFrame | None:
            """Write a field, or name the files of a carried one; returns the strings it holds."""
            if x.name in self.kept:
                entries[x.name] = self.kept[x.name]
                return strings_of(x.field, self.spark.read.schema(x.field.frame).parquet(self.kept[x.name].path), ordinal) if self.base is None else None
            data = self._frame(x.name, x.field)
            frame = prepared(x.field, x.name, data) if isinstance(self.data.get(x.name), DataFrame) else data
            return strings_of(x.field, write(x.name, x.field, x.sections, frame), ordinal)

        # fields do not depend on each other, so their jobs run side by side
        with ThreadPoolExecutor(WRITERS) as pool:
            texts = list(pool.map(lambda ix: fill(*ix), [(i, x) for i, x in enumerate(self.compiled.layout) if x.field.kind != "stringTable"]))
        table = next(x for x in self.compiled.layout if x.field.kind == "stringTable")
        found = [t for t in texts if t is not None]
        strings = reduce(DataFrame.unionByName, found) if found else None
        if strings is None:
            base = self.base if self.base is not None else self.spark.createDataFrame([(0, "")], table.field.frame)
        else:
            base = dictionary.append(self.base, strings) if self.base is not None else dictionary.intern(strings)
        write(table.name, table.field, table.sections, base)
        manifest = {"format": FORMAT, "hash": str(self.compiled.hash), "version": self.version, "fields": [vars(entries[x.name]) for x in self.compiled.layout]}
        files.write_text(self.spark, f"{path}/{MANIFEST}", json.dumps(manifest, indent=1))
        return Snapshot(self.spark, path)


def builder(spark: SparkSession, schema: Schema) -> SnapshotWriter:
    return SnapshotWriter(spark, schema.compiled, schema.version)


def read_header(spark: SparkSession, path: str) -> dict:
    """The manifest alone, checked for shape; no Spark job runs."""
    where = f"{path}/{MANIFEST}"
    if not files.exists(spark, where):
        raise FormatError(f"{path} holds no snapshot.")
    try:
        manifest = json.loads(files.read_text(spark, where))
    except ValueError as e:
        raise FormatError(f"The manifest of {path} is not readable: {e}") from e
    if not isinstance(manifest, dict) or not {"format", "hash", "version", "fields"} <= manifest.keys():
        raise FormatError(f"The manifest of {path} lacks what a snapshot needs.")
    if manifest["format"] != FORMAT:
        raise FormatError(f"{path} has format {manifest['format']}; this build reads {FORMAT}.")
    return manifest


def is_snapshot(spark: SparkSession, path: str) -> bool:
    try:
        read_header(spark, path)
    except FormatError:
        return False
    return True


class Snapshot:
    """An opened snapshot: fields by name, lazily, from the manifest alone."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        header = read_header(spark, path)
        self.spark, self.path = spark, path
        self.hash, self.version = int(header["hash"]), int(header["version"])
        self.entries = {e["name"]: Entry(**e) for e in header["fields"]}

    @property
    def manifest(self) -> list[tuple[str, str, int]]:
        return [(e.name, e.signature, e.sections) for e in self.entries.values()]

    @property
    def names(self) -> list[str]:
        return list(self.entries)

    @property
    def fields(self) -> dict[str, Field]:
        return {name: field_from_signature(e.signature) for name, e in self.entries.items()}

    @property
    def total_bytes(self) -> int:
        return sum(e.bytes for e in self.entries.values())

    def has(self, name: str) -> bool:
        return name in self.entries

    def signature(self, name: str) -> str | None:
        return self.entries[name].signature if name in self.entries else None

    def rows(self, name: str) -> int:
        """Rows a field holds; a single value counts unless it is empty."""
        e = self.entries[name]
        if e.signature in ("singleStringRef", "rawBytes"):
            return self.get(name).filter(F.octet_length("value") > 0).count()
        return e.rows

    def get(self, name: str) -> DataFrame:
        if name not in self.entries:
            raise SnapshotError(f'The snapshot has no field "{name}". There are: {", ".join(self.entries)}.')
        e = self.entries[name]
        return self.spark.read.schema(field_from_signature(e.signature).frame).parquet(e.path)

    def try_get(self, name: str) -> DataFrame | None:
        return self.get(name) if name in self.entries else None

    @property
    def strings(self) -> DataFrame:
        return self.get(next(n for n, e in self.entries.items() if e.signature == "stringTable"))

    def ids(self, name: str) -> DataFrame:
        """A string column with the dictionary ids of its values."""
        return dictionary.id_of(self.get(name), self.strings)

    def entity_view(self, *names: str) -> DataFrame:
        """Fields side by side, one row an entity; each field's value takes the field's name."""
        frames = [self.get(n).withColumnRenamed("value", n).withColumnRenamed("items", n) for n in names]
        return reduce(lambda a, b: a.join(b, "idx", "full_outer"), frames)

    def cached(self, *names: str) -> Snapshot:
        """The same, with these fields (default all) kept in executors' memory, shared by all tasks."""
        for n in names or self.entries:
            self.get(n).persist()
        return self


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(name, signature, rows, bytes, share) of each field, from the manifest alone."""
    snapshot = Snapshot(spark, path)
    total = max(1, snapshot.total_bytes)
    return spark.createDataFrame([(e.name, e.signature, e.rows, e.bytes, e.bytes / total) for e in snapshot.entries.values()], "name string, signature string, rows long, bytes long, share double")


def diff(schema: Schema, snapshot: Snapshot) -> list[FieldDiff]:
    return diff_manifests(snapshot.manifest, schema.compiled.manifest)


def matches(spark: SparkSession, schema: Schema, path: str) -> bool:
    """Whether hash and version are the schema's; False where there is no snapshot."""
    try:
        s = Snapshot(spark, path)
    except FormatError:
        return False
    return (s.hash, s.version) == (schema.hash, schema.version)


def read(spark: SparkSession, schema: Schema, path: str) -> Snapshot:
    """Open a snapshot of exactly this schema; the version is not asked for."""
    s = Snapshot(spark, path)
    if s.hash != schema.hash:
        hint = f"The snapshot is at version {s.version}, this build at {schema.version}: open it with migration." if schema.migrations else f"Build it anew, or declare a migration to version {schema.version}."
        raise SchemaMismatchError(schema.hash, s.hash, diff(schema, s), hint)
    return s


def open_snapshot(spark: SparkSession, schema: Schema, path: str, migrating: bool = True, write_back: bool = False, to: str | None = None, log: Callable[[str], None] = lambda _: None) -> tuple[Snapshot, Report]:
    """Open a snapshot and bring it up to date if need be.

    The migrated one is written under `to` (default beside the old one). write_back replaces the old manifest by the new one, in one step,
    so the same path opens as current from then on.
    """
    s = Snapshot(spark, path)
    if (s.hash, s.version) == (schema.hash, schema.version):
        return s, Report(False, s.version, schema.version)
    if not migrating:
        raise SchemaMismatchError(schema.hash, s.hash, diff(schema, s), "Migration is off for this call.")
    new, report = migrate(schema, s, to or f"{path}.v{schema.version}-{uuid.uuid4().hex[:8]}", log)
    if write_back:
        files.write_text(spark, f"{path}/{MANIFEST}", files.read_text(spark, f"{new.path}/{MANIFEST}"))
        new = Snapshot(spark, path)
    return new, report


def manifest_frame(spark: SparkSession, manifest: list[tuple[str, str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(manifest)], "place int, name string, signature string, sections int")


__all__ = ["Entry", "Snapshot", "SnapshotWriter", "builder", "compile_schema", "diff", "inspect", "is_snapshot", "manifest_frame", "matches", "open_snapshot", "read", "read_header"]
