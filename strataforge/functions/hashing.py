"""The 64-bit hash of names and signatures, on the driver. Index keys are compared exactly and never hashed with it."""

from __future__ import annotations

from array import array

MASK = 0xFFFFFFFF
#: Fixed values of the two 32-bit lanes: seed, what the unit is mixed with, multiplier, turn, multiplier, turn, increment.
LANES = (
    (0x9747B28C, 0x00000000, 0xCC9E2D51, 15, 0x1B873593, 13, 0xE6546B64),
    (0x2F2FDD8B, 0x5BD1E995, 0x85EBCA6B, 17, 0xC2B2AE35, 11, 0x38495AB5),
)
#: Fixed values of the final avalanche: shift, multiplier.
AVALANCHE = ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1))


def turn(x: int, n: int) -> int:
    """x as 32 bits, turned left by n."""
    return (x << n | x >> 32 - n) & MASK


def fmix32(x: int) -> int:
    """A bijection of 32-bit numbers in which every bit reaches every other."""
    for shift, times in AVALANCHE:
        x = (x ^ x >> shift) * times & MASK
    return x


def code_units(text: str) -> array:
    """UTF-16 code units, lone surrogates included."""
    return array("H", text.encode("utf-16-le", "surrogatepass"))


def lane(units: array, seed: int, flip: int, first: int, turn_in: int, second: int, turn_out: int, add: int) -> int:
    state = seed
    for unit in units:
        mixed = turn((unit ^ flip) * first & MASK, turn_in) * second & MASK
        state = (turn(state ^ mixed, turn_out) * 5 + add) & MASK
    return state


def hash64(text: str) -> int:
    """Unsigned 64 bits of a text: the high half depends on both lanes."""
    units = code_units(text)
    low, high = (lane(units, *constants) for constants in LANES)
    return fmix32(((high ^ len(units)) + low) & MASK) << 32 | fmix32(low ^ len(units))


def split64(value: int) -> tuple[int, int]:
    """(low, high) halves of a 64-bit number."""
    return value & MASK, value >> 32 & MASK


def signed64(value: int) -> int:
    """An unsigned 64-bit number as a BIGINT holds it."""
    return value - (1 << 64) if value >> 63 else value
