"""Field kinds and their signatures: the vocabulary a schema is declared in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from strataforge.errors import SnapshotError, UnknownSignatureError
from strataforge.functions.numbers import NUMBER_TYPES, SHORT, NumberType, number_type

#: Names that the signature grammar could not carry.
RESERVED = set(",=")


@dataclass(frozen=True)
class Column_:
    """What one column of a field holds: numbers of a type, `stride` of them an item, or strings."""

    number: NumberType | None = None
    stride: int = 1

    @property
    def tag(self) -> str:
        return "strRef" if self.number is None else f"{self.number.name}:{self.stride}"

    @property
    def spark(self) -> T.DataType:
        if self.number is None:
            return T.StringType()
        return self.number.spark if self.stride == 1 else T.ArrayType(self.number.spark)

    @property
    def width(self) -> int:
        """Bytes an item takes in the compact layout; strings are 4-byte ids."""
        return 4 if self.number is None else self.number.width * self.stride


def numbers(kind: str, stride: int = 1) -> Column_:
    if not isinstance(stride, int) or stride < 1:
        raise SnapshotError(f"A stride is a whole number from 1, not {stride!r}.")
    return Column_(number_type(kind), stride)


def string_ref() -> Column_:
    return Column_()


def i32_pair() -> Column_:
    return numbers("i32", 2)


i8, u8, u8c, i16, u16, i32, u32, f32, f64 = (lambda kind=k: numbers(kind) for k in SHORT)


@dataclass(frozen=True)
class Field:
    """One declared field: its kind, the columns it has, and for verified lookups the field that confirms a hit."""

    kind: str
    columns: tuple[tuple[str, Column_], ...] = ()
    verify_via: str = ""
    legacy: bool = False

    @property
    def signature(self) -> str:
        tags = [c.tag for _, c in self.columns]
        if self.kind == "num":
            return f"num:{self.columns[0][1].number.name}"
        if self.kind in ("bucketArray", "keyedIndex"):
            return f"{self.kind}:{tags[0]}"
        if self.kind in ("multiBucketArray", "pairIndex2"):
            return f"{'pairIndex' if self.legacy else self.kind}:" + ",".join(f"{n}={t}" for (n, _), t in zip(self.columns, tags, strict=True))
        return f"hashLookup:{self.verify_via}" if self.kind == "hashLookup" else self.kind

    @property
    def sections(self) -> int:
        """How many consecutive sections the field owns."""
        return SECTIONS[self.kind] + (len(self.columns) if self.kind in ("multiBucketArray", "pairIndex2") else 0)

    @property
    def frame(self) -> T.StructType:
        """The columns of the DataFrame that holds the field."""
        item = T.StructType([T.StructField(n, c.spark) for n, c in self.columns])
        one = self.columns[0][1].spark if self.columns else None
        shapes = {
            "stringTable": [("id", T.LongType()), ("value", T.StringType())],
            "num": [("idx", T.LongType()), ("value", one)],
            "stringRefArray": [("idx", T.LongType()), ("value", T.StringType())],
            "singleStringRef": [("value", T.StringType())],
            "rawBytes": [("value", T.BinaryType())],
            "bucketArray": [("idx", T.LongType()), ("items", T.ArrayType(one) if one else None)],
            "multiBucketArray": [("idx", T.LongType()), ("items", T.ArrayType(item))],
            "hashLookup": [("key", T.StringType()), ("value", T.LongType()), ("seq", T.LongType())],
            "keyedIndex": [("key", T.StringType()), ("items", T.ArrayType(one) if one else None), ("seq", T.LongType())],
            "pairIndex2": [("a", T.LongType()), ("b", T.LongType()), ("item", item), ("seq", T.LongType())],
            "sortedU32Index": [("key", T.LongType()), ("value", T.LongType()), ("seq", T.LongType())],
            "trigramIndex": [("gram", T.StringType()), ("id", T.LongType()), ("seq", T.LongType())],
        }
        return T.StructType([T.StructField(n, t) for n, t in shapes[self.kind]])


#: Sections a kind owns beside one for each named column.
SECTIONS = {"stringTable": 2, "stringRefArray": 1, "singleStringRef": 1, "num": 1, "rawBytes": 1, "bucketArray": 2, "multiBucketArray": 1, "hashLookup": 3, "keyedIndex": 5, "pairIndex2": 3, "sortedU32Index": 2, "trigramIndex": 5}
PLAIN = ("stringTable", "stringRefArray", "singleStringRef", "rawBytes", "sortedU32Index", "trigramIndex")


def string_table() -> Field:
    return Field("stringTable")


def num_array(kind: str) -> Field:
    return Field("num", (("value", numbers(kind)),))


def string_ref_array() -> Field:
    return Field("stringRefArray")


def single_string_ref() -> Field:
    return Field("singleStringRef")


def raw_bytes() -> Field:
    return Field("rawBytes")


def bucket_array(column: Column_) -> Field:
    return Field("bucketArray", (("value", column),))


def multi_bucket_array(**columns: Column_) -> Field:
    return Field("multiBucketArray", _named(columns))


def hash_lookup(verify_via: str = "") -> Field:
    return Field("hashLookup", verify_via=verify_via)


def keyed_index(column: Column_) -> Field:
    return Field("keyedIndex", (("value", column),))


def pair_index(**columns: Column_) -> Field:
    return Field("pairIndex2", _named(columns))


def sorted_u32_index() -> Field:
    return Field("sortedU32Index")


def trigram_index() -> Field:
    return Field("trigramIndex")


def _named(columns: dict[str, Column_]) -> tuple[tuple[str, Column_], ...]:
    for name in columns:
        if RESERVED & set(name):
            raise SnapshotError(f'Column name "{name}" holds a character that signatures use.')
    return tuple(columns.items())


def _column(tag: str, signature: str) -> Column_:
    if tag == "strRef":
        return string_ref()
    name, colon, stride = tag.rpartition(":")
    if not colon or name not in NUMBER_TYPES or not stride.isdigit() or int(stride) < 1:
        raise UnknownSignatureError(signature)
    return Column_(NUMBER_TYPES[name], int(stride))


def _columns(spec: str, signature: str) -> tuple[tuple[str, Column_], ...]:
    out = []
    for part in spec.split(",") if spec else []:
        name, equals, tag = part.partition("=")
        if not equals:
            raise UnknownSignatureError(signature)
        out.append((name, _column(tag, signature)))
    return tuple(out)


def field_from_signature(signature: str) -> Field:
    """The field a signature describes; Field.signature gives it back."""
    kind, _, rest = signature.partition(":")
    if signature in PLAIN:
        return Field(signature)
    if kind == "num" and rest in NUMBER_TYPES:
        return Field("num", (("value", Column_(NUMBER_TYPES[rest])),))
    if kind == "hashLookup":
        return hash_lookup(rest)
    if kind in ("bucketArray", "keyedIndex"):
        return Field(kind, (("value", _column(rest, signature)),))
    if kind in ("multiBucketArray", "pairIndex2"):
        return Field(kind, _columns(rest, signature))
    if kind == "pairIndex":  # written before pair keys were mixed: read alike
        return Field("pairIndex2", _columns(rest, signature), legacy=True)
    raise UnknownSignatureError(signature)
