"""Numeric element types: ranges, Spark types, and the expressions that check and store values."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class NumberType:
    """One storable element type; low is None where any double fits."""

    name: str
    width: int
    low: int | None
    high: int | None
    spark: T.DataType
    rounds: bool = False


#: The nine element types by signature name. Unsigned ones take the next wider Spark type.
NUMBER_TYPES = {
    t.name: t
    for t in (
        NumberType("Int8Array", 1, -(2**7), 2**7 - 1, T.ByteType()),
        NumberType("Uint8Array", 1, 0, 2**8 - 1, T.ShortType()),
        NumberType("Uint8ClampedArray", 1, 0, 2**8 - 1, T.ShortType(), rounds=True),
        NumberType("Int16Array", 2, -(2**15), 2**15 - 1, T.ShortType()),
        NumberType("Uint16Array", 2, 0, 2**16 - 1, T.IntegerType()),
        NumberType("Int32Array", 4, -(2**31), 2**31 - 1, T.IntegerType()),
        NumberType("Uint32Array", 4, 0, 2**32 - 1, T.LongType()),
        NumberType("Float32Array", 4, None, None, T.FloatType()),
        NumberType("Float64Array", 8, None, None, T.DoubleType()),
    )
}
#: Short names for declarations.
SHORT = {"i8": "Int8Array", "u8": "Uint8Array", "u8c": "Uint8ClampedArray", "i16": "Int16Array", "u16": "Uint16Array", "i32": "Int32Array", "u32": "Uint32Array", "f32": "Float32Array", "f64": "Float64Array"}


def number_type(name: str) -> NumberType:
    return NUMBER_TYPES[SHORT.get(name, name)]


def range_of(name: str) -> tuple[int, int] | None:
    """(low, high) of an element type, None where nothing is out of range."""
    t = number_type(name)
    return None if t.low is None else (t.low, t.high)


def out_of_range(value: Column, name: str) -> Column:
    """True where value does not fit; NaN and null fit (NaN is asked for first, since Spark orders it above all numbers)."""
    bounds = range_of(name)
    v = value.cast("double")
    if bounds is None:
        return F.lit(False)
    return F.coalesce(~F.isnan(v) & ((v < bounds[0]) | (v > bounds[1])), F.lit(False))


def converted(value: Column, name: str) -> Column:
    """value as the element type stores it, unchecked: null is 0, integers truncate (the clamped type rounds half to even) and take NaN as 0."""
    t = number_type(name)
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    if t.low is None:
        return v.cast(t.spark)
    whole = F.rint(F.nanvl(v, F.lit(0.0))) if t.rounds else F.nanvl(v, F.lit(0.0))
    return whole.cast("long").cast(t.spark)


def stored(value: Column, name: str, label: str = "value", index: Column | None = None) -> Column:
    """converted(), but a value out of range fails the query with field, value and index in the message. The check sees the value before rounding."""
    place = F.coalesce(index.cast("string"), F.lit("?")) if index is not None else F.lit("?")
    message = F.concat(F.lit(f"RangeError {label}: value "), value.cast("string"), F.lit(" at index "), place, F.lit(f" does not fit {number_type(name).name}"))
    return F.when(out_of_range(value, name), F.raise_error(message).cast(number_type(name).spark)).otherwise(converted(F.when(~out_of_range(value, name), value), name))


def stored_list(values: Column, name: str, label: str = "value") -> Column:
    """stored() for each element of an array."""
    return F.transform(values, lambda v, i: stored(v, name, label, i))


def any_out_of_range(values: Column, name: str) -> Column:
    return F.exists(values, lambda v: out_of_range(v, name))


def fitted(values: Column, stride: int) -> Column:
    """An array of exactly `stride` values: short ones are filled with 0, long ones cut, nulls are 0; a null array is all 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(stride - 1)), lambda i: F.coalesce(F.get(values, i), F.lit(0)))


def wrapped_u32(value: Column) -> Column:
    """value modulo 2^32, as unchecked u32 buffers keep it."""
    return F.pmod(value.cast("long"), F.lit(2**32))


def pack_numbers(values: list[float], name: str) -> bytes:
    """Little-endian bytes of values in their element type."""
    code = {"Int8Array": "b", "Uint8Array": "B", "Uint8ClampedArray": "B", "Int16Array": "h", "Uint16Array": "H", "Int32Array": "i", "Uint32Array": "I", "Float32Array": "f", "Float64Array": "d"}[number_type(name).name]
    return struct.pack(f"<{len(values)}{code}", *values)
