"""Media columns: text payloads in ISO base media containers, described from boxes and sample tables.

`wrap` stores a payload as one track of fixed-size samples; `inspect` walks the nested boxes of any such
file, decodes its sample tables and reports codec, duration and the byte range of each key frame without
touching the payload; `payload` reads the samples back through the ranges found.
Null text counts as empty; an empty text is stored as 64 zero bytes; equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct as st
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from strataforge.llm.common import documents, id_and_text, map_rows, struct

UNIT = 64
TIMESCALE = 8000
SAMPLES_PER_CHUNK = 1024
KEYFRAME_EVERY = 256
#: Boxes whose payload is boxes again (fixed values of the container format).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
MATRIX = st.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = st.pack(">I4s", size, kind) if size < 1 << 32 else st.pack(">I4sQ", 1, kind, size + 8)
    return head + b"".join(parts)


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, st.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """data, then zero bytes up to a positive multiple of UNIT."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wrap(data: bytes) -> bytes:
    """A complete container whose samples are the padded data: ftyp, moov, mdat."""
    body = padded(data)
    n = len(body) // UNIT
    chunks = -(-n // SAMPLES_PER_CHUNK)
    duration = n * UNIT
    wide = len(body) >= 1 << 31
    entry = box(b"raw ", bytes(6), st.pack(">H", 1), st.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    runs = [(1, SAMPLES_PER_CHUNK)] if n >= SAMPLES_PER_CHUNK else []
    if n % SAMPLES_PER_CHUNK:
        runs.append((chunks, n % SAMPLES_PER_CHUNK))
    keys = range(1, n + 1, KEYFRAME_EVERY)
    ftyp = box(b"ftyp", b"isom", st.pack(">I", 512), b"isom", b"mp41")

    def moov(first: int) -> bytes:
        places = [first + i * SAMPLES_PER_CHUNK * UNIT for i in range(chunks)]
        offsets = full(b"co64", st.pack(f">I{chunks}Q", chunks, *places)) if wide else full(b"stco", st.pack(f">I{chunks}I", chunks, *places))
        stbl = box(
            b"stbl",
            full(b"stsd", st.pack(">I", 1), entry),
            full(b"stts", st.pack(">III", 1, n, UNIT)),
            full(b"stss", st.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", st.pack(">I", len(runs)), *(st.pack(">III", c, k, 1) for c, k in runs)),
            full(b"stsz", st.pack(">II", UNIT, n)),
            offsets,
        )
        dinf = box(b"dinf", full(b"dref", st.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", st.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
        tkhd = full(b"tkhd", st.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), st.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=7)
        mvhd = full(b"mvhd", st.pack(">QQIQ", 0, 0, TIMESCALE, duration), st.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), st.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 16 if len(body) + 8 >= 1 << 32 else 8
    return ftyp + moov(len(ftyp) + len(moov(0)) + head) + box(b"mdat", body)


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 1
    duration: int = 0
    sizes: tuple[int, list[int], int] = (0, [], 0)
    runs: list[tuple[int, int]] = None
    places: list[int] = None
    keys: list[int] | None = None

    def samples(self) -> Iterator[tuple[int, int]]:
        """(offset, size) of each sample, from stsc, stsz and stco alone."""
        fixed, each, count = self.sizes
        runs = [*(self.runs or []), (len(self.places or []) + 1, 0)]
        i = 0
        for (first, per), (after, _) in zip(runs, runs[1:], strict=False):
            for chunk in range(first, after):
                at = self.places[chunk - 1]
                for _ in range(per):
                    if i >= count:
                        return
                    size = fixed or each[i]
                    yield at, size
                    at += size
                    i += 1

    def keyframes(self) -> list[tuple[int, int, int]]:
        """(sample number from 1, offset, size); without stss every sample is a key frame."""
        wanted = None if self.keys is None else set(self.keys)
        return [(i, at, size) for i, (at, size) in enumerate(self.samples(), 1) if wanted is None or i in wanted]


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, payload start, payload end) of the boxes in data[start:end]."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = st.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("truncated 64-bit box size")
            (size,), head = st.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} does not fit its parent")
        yield kind, start + head, start + size
        start += size


def inspect(data: bytes) -> list[Track]:
    """The tracks of a container. Payload boxes (mdat) are stepped over, never read."""
    tracks: list[Track] = []

    def walk(start: int, end: int) -> None:
        for kind, a, b in boxes(data, start, end):
            if kind == b"trak":
                tracks.append(Track())
            if kind in CONTAINERS:
                walk(a, b)
            elif kind in DECODERS and tracks:
                DECODERS[kind](tracks[-1], data, a)

    walk(0, len(data))
    return tracks


def _mdhd(t: Track, d: bytes, a: int) -> None:
    if d[a]:
        t.timescale, t.duration = st.unpack_from(">IQ", d, a + 20)
    else:
        t.timescale, t.duration = st.unpack_from(">II", d, a + 12)


def _hdlr(t: Track, d: bytes, a: int) -> None:
    t.handler = d[a + 8 : a + 12].decode("latin-1")


def _stsd(t: Track, d: bytes, a: int) -> None:
    if st.unpack_from(">I", d, a + 4)[0]:
        t.codec = d[a + 12 : a + 16].decode("latin-1").strip()


def _stsz(t: Track, d: bytes, a: int) -> None:
    fixed, n = st.unpack_from(">II", d, a + 4)
    t.sizes = (fixed, [] if fixed else list(st.unpack_from(f">{n}I", d, a + 12)), n)


def _stsc(t: Track, d: bytes, a: int) -> None:
    (n,) = st.unpack_from(">I", d, a + 4)
    t.runs = [st.unpack_from(">II", d, a + 8 + 12 * i) for i in range(n)]


def _stco(t: Track, d: bytes, a: int) -> None:
    (n,) = st.unpack_from(">I", d, a + 4)
    t.places = list(st.unpack_from(f">{n}I", d, a + 8))


def _co64(t: Track, d: bytes, a: int) -> None:
    (n,) = st.unpack_from(">I", d, a + 4)
    t.places = list(st.unpack_from(f">{n}Q", d, a + 8))


def _stss(t: Track, d: bytes, a: int) -> None:
    (n,) = st.unpack_from(">I", d, a + 4)
    t.keys = list(st.unpack_from(f">{n}I", d, a + 8))


DECODERS = {b"mdhd": _mdhd, b"hdlr": _hdlr, b"stsd": _stsd, b"stsz": _stsz, b"stsc": _stsc, b"stco": _stco, b"co64": _co64, b"stss": _stss}


def payload(data: bytes, track: Track) -> bytes:
    """The samples of a track; neighbouring ones are read as one range."""
    out, lo, hi = [], None, None
    for at, size in track.samples():
        if at == hi:
            hi += size
        else:
            if lo is not None:
                out.append(data[lo:hi])
            lo, hi = at, at + size
    if lo is not None:
        out.append(data[lo:hi])
    return b"".join(out)


MEDIA = "doc_id long, n_bytes long, media binary, codec string, timescale long, duration long, n_samples long, keyframes array<struct<sample:long,start:long,size:long>>"
DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_s double, n_keyframes long"


def media_column(docs: DataFrame) -> DataFrame:
    """One container per document with its codec, duration and key frame byte ranges, all read from its boxes.

    Null text counts as empty. Rows with a null doc_id stay; repeated rows give repeated results; other columns are not read.
    """

    def rows(it):
        for r in it:
            data = (r["text"] or "").encode()
            media = wrap(data)
            (t,) = inspect(media)
            keys = [{"sample": i, "start": a, "size": s} for i, a, s in t.keyframes()]
            yield r["doc_id"], len(data), media, t.codec, t.timescale, t.duration, t.sizes[2], keys

    return map_rows(id_and_text(docs), rows, struct(MEDIA), rows=128)


def digest(data: bytes) -> tuple:
    """What op6 reports of one stored payload, all of it from the stored bytes."""
    media = wrap(data)
    (t,) = inspect(media)
    back = payload(media, t)
    keys = t.keyframes()
    ranges = zlib.crc32(b"".join(st.pack(">QQ", a, s) for _, a, s in keys))
    feature = f"codec={t.codec};handler={t.handler};timescale={t.timescale};duration={t.duration};samples={t.sizes[2]};keyframes={len(keys)};first={keys[0][1]}+{keys[0][2]};last={keys[-1][1]}+{keys[-1][2]};ranges={ranges:08x}"
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, t.duration / t.timescale, len(keys)


def media_digests(docs: DataFrame) -> DataFrame:
    """media_column() reduced to sizes, hashes and a feature string within the same pass, so no container is shuffled or kept."""

    def rows(it):
        for r in it:
            yield (r["doc_id"], *digest((r["text"] or "").encode()))

    return map_rows(id_and_text(docs), rows, struct(DIGESTS))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(documents(spark, sf_dir))
