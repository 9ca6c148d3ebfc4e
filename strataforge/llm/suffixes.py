"""Suffix-array dedup: repeated byte strings found by merging shard Burrows-Wheeler transforms.

A string of LENGTH bytes is a window. Each window is held by its anchor, the k-mer in it with the smallest hash; equal windows have equal
anchors at equal places. Anchors that stand once in the whole corpus hold no repeated window, so only stretches around repeated anchors
go on, grouped by anchor, each distinct stretch once with its number of occurrences.

A task turns its stretches into 8-byte symbols counted from the anchor, builds the transform of each shard from the shard's own suffix array, and merges the
transforms by refining their interleave: every pass deals the rows by the symbol before them and so sorts the merged suffixes one
symbol deeper, while a change of symbol or of the row's former interval opens a new interval. No suffix is compared again. After as many passes as whole
symbols fit a window, an interval of two or more rows is a string shared up to the bytes on its rim, which are then compared exactly.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest, xxh64_intdigest

from strataforge.llm.common import documents, forget, id_and_text, map_rows, stored, struct
from strataforge.sources.work import work_path

LENGTH = 200
KMER = 64
SYMBOL = 8
#: Windows of long texts are taken so many at a time.
STRIDE = 1 << 22
#: A key with more distinct stretches than this is dealt out, so that no task holds more of one key.
KEY_CAP = 65_536
SHARD_SYMBOLS = 1 << 16
TASK_ROWS = 20_000


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.array([xxh64_intdigest(bytes([i]), 7) | 1 for i in range(256)], np.uint64)


def kmer_hashes(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """A hash of the k bytes (k a power of two) at each position, by doubling."""
    h, width, mul = _byte_values()[data], 1, 0x9E3779B97F4A7C15
    while width < k:
        h = h[:-width] * np.uint64(mul) + h[width:]
        mul = (mul * mul + 2 * width) % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while 2 * width <= w:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    return np.minimum(v[: len(v) - (w - width)], v[w - width :]) if w > width else v


def anchored(data: bytes, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, ...]:
    """(key, first, count, ahead) of the runs of windows that one anchor holds: the anchor's hash, the first window, how many, and how far the anchor lies behind the first window's start.

    Equal hashes within a window: the leftmost is the anchor.
    """
    out = []
    w = length - k + 1
    bits = np.uint64(23)  # a stride and its last window fit
    for at in range(0, max(0, len(data) - length + 1), STRIDE):
        part = np.frombuffer(data, np.uint8)[at : at + STRIDE + length - 1]
        h = kmer_hashes(part, k)
        low = _sliding_min(h >> bits << bits | np.arange(len(h), dtype=np.uint64), w) & np.uint64((1 << 23) - 1)
        place = low.astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, len(place)))
        out.append((h[place[first]].view(np.int64), first + at, count, place[first] - first))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


# --- shard transforms and their merge


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a circular text sorted by at least `depth` symbols, by doubling; ties by position."""
    _, rank = np.unique(text, return_inverse=True)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        key = rank * len(text) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        rank = np.empty_like(rank)
        rank[order] = new
        width *= 2
        if new[-1] == len(text) - 1:
            break
    return order


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, interval) of the merged rows: which shard each comes from, and the id of the rows that share its first `depth` symbols.

    Rows of a shard keep their order, so the interleave tells all. Shards must be sorted to `depth` at least. Stops early once every interval is a single row.
    """
    which = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    starts = np.cumsum([0, *(len(t) for t in transforms)])[:-1]
    flat = np.concatenate(transforms)
    n = len(flat)
    interval = np.zeros(n, np.int64)
    for _ in range(depth):
        # the next row of each shard, in merged order
        by_shard = np.argsort(which, kind="stable")
        row = np.empty(n, np.int64)
        row[by_shard] = np.arange(n) - np.repeat(np.cumsum(np.bincount(which, minlength=len(starts))) - np.bincount(which, minlength=len(starts)), np.bincount(which, minlength=len(starts)))
        symbol = flat[starts[which] + row]
        dealt = np.argsort(symbol, kind="stable")
        s, was = symbol[dealt], interval[dealt]
        which = which[dealt]
        interval = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]) | (was[1:] != was[:-1])]))
        if interval[-1] == n - 1:
            break
    return which, interval


def repeated_windows(stretches: list[bytes], ahead: list[int], length: int = LENGTH, shard_symbols: int = SHARD_SYMBOLS) -> list[np.ndarray]:
    """For each stretch the windows in it (as booleans by start) that another stretch holds as well.

    Stretches are distinct; ahead: where their anchors are. Equal windows must have equal places to their anchors, as anchored() gives them.
    """
    depth = length // SYMBOL - 1
    pads, blocks, counts = [], [], []
    for s, a in zip(stretches, ahead, strict=True):
        pad = -a % SYMBOL
        full = bytes(pad) + s + bytes(-(pad + len(s)) % SYMBOL + SYMBOL)
        pads.append(pad)
        blocks.append(np.frombuffer(full, ">u8").astype(np.uint64))
        counts.append(len(s) - length + 1)
    n = len(stretches)
    values = np.concatenate(blocks)
    _, ranks = np.unique(values, return_inverse=True)
    sizes = np.array([len(b) for b in blocks])
    ends = np.cumsum(sizes)
    # a shard: whole stretches, each followed by a separator of its own, all below the ranks
    shards, texts, origin, size = [], [], np.empty(len(values), np.int64), 0
    group: list[int] = []
    for i in range(n):
        group.append(i)
        size += sizes[i]
        if size >= shard_symbols or i == n - 1:
            shards.append(group)
            group, size = [], 0
    places = []
    for g in shards:
        text, place = [], []
        for i in g:
            a, b = ends[i] - sizes[i], ends[i]
            text += [ranks[a:b] + n, np.array([i])]
            place += [np.arange(a, b), np.array([-1])]
        texts.append(np.concatenate(text))
        places.append(np.concatenate(place))
    orders = [suffix_array(t, depth) for t in texts]
    which, interval = merge_transforms([t[o - 1] for t, o in zip(texts, orders, strict=True)], depth)
    rows = np.empty(len(which), np.int64)
    for j, (o, p) in enumerate(zip(orders, places, strict=True)):
        rows[which == j] = p[o]
    many = np.bincount(interval)[interval] > 1
    at_block = np.full(len(values), -1, np.int64)
    real = (rows >= 0) & many
    at_block[rows[real]] = interval[real]

    # rim: what a window has of the symbol before its whole ones and of the symbol after them, together SYMBOL bytes
    stretch = np.repeat(np.arange(n), counts)
    j = np.arange(len(stretch)) - np.repeat(np.cumsum(counts) - counts, counts)
    x = j + np.array(pads)[stretch]
    p, r = -(-x // SYMBOL), -x % SYMBOL
    first = (ends - sizes)[stretch]
    held = at_block[first + p]
    some = np.flatnonzero(held >= 0)
    out = np.zeros(len(stretch), bool)
    if len(some):
        low = (np.uint64(1) << (8 * r[some]).astype(np.uint64)) - np.uint64(1)
        before = values[np.maximum(first[some] + p[some] - 1, 0)]
        rim = (before & low) | (values[first[some] + p[some] + depth] & ~low)
        group = held[some] * SYMBOL + r[some]
        order = np.lexsort([rim, group])
        same = (group[order][1:] == group[order][:-1]) & (rim[order][1:] == rim[order][:-1])
        twice = np.zeros(len(some), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        out[some] = twice
    return np.split(out, np.cumsum(counts)[:-1])


# --- the corpus


def text_keys(text: Column) -> list[Column]:
    """96 bits that stand for a text."""
    return [F.xxhash64(text).alias("t"), F.crc32(text.cast("binary")).alias("u")]


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """(t, u, text, copies) and the name of the table: each text once, bucketed by its key in the shared folder, so that later joins move nothing of it."""
    spark = docs.sparkSession
    texts = id_and_text(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    once = texts.select(*text_keys(F.col("text")), "text").groupBy("t", "u").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    name = f"texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.bucketBy(buckets, "t", "u").option("path", work_path(spark, name)).saveAsTable(name)
    return spark.table(name), name


def _packed(first: Column, count: Column, ahead: Column) -> Column:
    return F.shiftleft(first, 16).bitwiseOR(F.shiftleft(count, 8)).bitwiseOR(ahead)


def _anchors(texts: DataFrame, length: int, k: int) -> DataFrame:
    """(t, u, key, first << 16 | (count - 1) << 8 | ahead) of all anchors."""
    schema = "t long, u long, key long, run long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, u, text = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            held, size = [], 0
            for i in range(b.num_rows):
                key, first, count, ahead = anchored(text[i].as_buffer().to_pybytes() if hasattr(text[i], "as_buffer") else text[i].as_py().encode(), length, k)
                held.append((np.full(len(key), t[i]), np.full(len(key), u[i]), key, first << 16 | (count - 1) << 8 | ahead))
                size += len(key)
                if size > 50_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["t", "u", "key", "run"])
                    held, size = [], 0

    return texts.select("t", "u", "text").mapInArrow(run, schema)


def _stretches(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Cuts the stretch of each run out of its text; runs come to the texts' buckets."""
    by_text = runs.groupBy("t", "u").agg(F.collect_list(F.struct("key", "run")).alias("runs"))

    def rows(it):
        for r in it:
            data = r["text"].encode()
            for x in r["runs"]:
                first, count, ahead = x["run"] >> 16, (x["run"] >> 8 & 255) + 1, x["run"] & 255
                part = data[first : first + count + length - 1]
                h = xxh3_128_intdigest(part)
                yield r["t"], r["u"], first, x["key"], ahead, _signed(h >> 64), _signed(h & (1 << 64) - 1), part

    joined = texts.join(by_text, ["t", "u"]).select("t", "u", "text", "runs")
    return map_rows(joined, rows, struct("t long, u long, first long, key long, ahead int, s1 long, s2 long, part binary"), rows=4096)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


FOUND = "s1 long, s2 long, ranges array<struct<a:int,n:int>>"


def _ranges(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [{"a": int(a), "n": int(b - a)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _by_merge(parts: DataFrame, length: int, tasks: int) -> DataFrame:
    """Ranges of repeated windows of each distinct stretch; all stretches of a key are in one task, which merges its shards' transforms."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in pdfs if len(p)]
        if not held:
            return
        pdf = pd.concat(held, ignore_index=True).sort_values(["key", "s1", "s2", "ahead"], ignore_index=True)
        # keys share no window, so a task may go through them in blocks of whole keys
        key = pdf["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cut, last = [0], 0
        for s in starts[1:]:
            if s - last >= TASK_ROWS:
                cut.append(int(s))
                last = s
        for a, b in zip(cut, [*cut[1:], len(pdf)], strict=True):
            block = pdf.iloc[a:b]
            flags = repeated_windows(block["part"].tolist(), block["ahead"].tolist(), length)
            flags = [np.ones(len(f), bool) if n > 1 else f for f, n in zip(flags, block["n"], strict=True)]
            ranges = [_ranges(f) for f in flags]
            got = [i for i, r in enumerate(ranges) if r]
            yield pd.DataFrame({"s1": block["s1"].to_numpy()[got], "s2": block["s2"].to_numpy()[got], "ranges": [ranges[i] for i in got]})

    return parts.repartition(tasks, "key").mapInPandas(run, struct(FOUND))


def _dealt(cut: DataFrame, cap: int, length: int, k: int) -> DataFrame:
    """cut, with the keys of more than `cap` distinct stretches dealt out until none is left.

    The windows of such a key are halved by how far their anchor lies behind their start. All windows of a half hold the bytes around the anchor that its range of
    distances leaves in common, so equal windows stay together when the half is dealt by a hash of those bytes. In the end a half is one distance, whose windows are
    dealt by their hash. Stretches are cut to the windows of their half, so no window is looked at twice.
    """
    done: list[DataFrame] = []
    now = cut.withColumn("low", F.lit(0)).withColumn("high", F.lit(length - k))
    while True:
        distinct = now.groupBy("key", "s1", "s2").agg(F.count(F.lit(1)).alias("n"))
        large = stored(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap).select("key"), "large-keys")
        if large.isEmpty():
            forget(large)
            return reduce(DataFrame.unionByName, [*done, now.select(*cut.columns)])
        done.append(now.join(large, "key", "left_anti").select(*cut.columns))
        big = now.join(large, "key", "left_semi").withColumn("mid", F.floor((F.col("low") + F.col("high") + 1) / 2).cast("int"))
        last = F.length("part") - length
        half = lambda low, high: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
        halves = F.when(F.col("low") == F.col("high"), F.array(half(F.col("low"), F.col("high")))).otherwise(F.array(half(F.col("low"), F.col("mid") - 1), half(F.col("mid"), F.col("high"))))
        each = big.withColumn("half", F.explode(halves)).withColumn("i", F.greatest(F.lit(0), F.col("ahead") - F.col("half.high"))).withColumn("j", F.least(last, F.col("ahead") - F.col("half.low")))
        each = each.filter("i <= j")
        held = F.substring(F.col("part"), F.col("ahead") - F.col("half.low") + 1, length - F.col("half.high") + F.col("half.low"))
        part = F.substring(F.col("part"), F.col("i") + 1, F.col("j") - F.col("i") + length)
        each = each.select("t", "u", (F.col("first") + F.col("i")).alias("first"), F.xxhash64("key", "half", held).alias("key"), (F.col("ahead") - F.col("i")).cast("int").alias("ahead"), part.alias("part"), F.col("half.low").alias("low"), F.col("half.high").alias("high"))
        now = stored(each.withColumn("s1", F.xxhash64("part")).withColumn("s2", F.xxhash64(F.lit(1), "part")).select(*cut.columns, "low", "high"), "dealt-stretches")


def repeated_ranges(texts: DataFrame, length: int = LENGTH, k: int = KMER, cap: int = KEY_CAP) -> tuple[DataFrame, list[DataFrame]]:
    """(t, u, ranges), and the tables it reads, to be deleted after it: for each text the starts (as ranges a, n) of its windows that stand elsewhere in these distinct texts too.

    Distinct texts may share windows with themselves and each other; copies of whole texts are the caller's to know.
    """
    anchors = _anchors(texts, length, k)
    # written, so that the join has plain shuffles on both sides and an anchor that stands very often is split at run time
    often = stored(anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "repeated-anchors")
    runs = anchors.join(often, "key").select("t", "u", "key", "run")
    cut = _dealt(stored(_stretches(texts, runs, length), "stretches"), cap, length, k)
    parts = stored(cut.groupBy("key", "s1", "s2", "ahead").agg(F.first("part").alias("part"), F.count(F.lit(1)).alias("n")), "distinct-stretches")
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-parts.count() // TASK_ROWS))
    found = _by_merge(parts, length, tasks)
    found = stored(found, "repeats")
    at = F.transform("ranges", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), r["n"].cast("long").alias("n")))
    ranges = cut.select("t", "u", "first", "s1", "s2").join(found, ["s1", "s2"]).select("t", "u", at.alias("r")).groupBy("t", "u").agg(F.flatten(F.collect_list("r")).alias("ranges"))
    forget(often, parts)
    return ranges, [cut, found]


def spans(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte spans that windows at these starts cover; touching spans are one."""
    out: list[list[int]] = []
    for a, n in sorted(ranges):
        b = a + n - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


REMOVED = "t long, u long, n_bytes long, spans array<struct<a:long,b:long>>, kept_sha256 string"


def removals(docs: DataFrame, length: int = LENGTH, k: int = KMER, cap: int = KEY_CAP) -> DataFrame:
    """One row a distinct text: key, size, spans to remove and the hash of what is left."""
    texts, name = distinct_texts(docs)
    ranges, read = repeated_ranges(texts, length, k, cap)
    joined = texts.join(ranges, ["t", "u"], "left").select("t", "u", "text", "copies", "ranges")

    def rows(it):
        for r in it:
            data = r["text"].encode()
            cut = [(0, len(data))] if r["copies"] > 1 and len(data) >= length else spans([(x["a"], x["n"]) for x in r["ranges"] or []], length)
            kept, at = hashlib.sha256(), 0
            for a, b in cut:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            yield r["t"], r["u"], len(data), [{"a": a, "b": b} for a, b in cut], kept.hexdigest()

    out = stored(map_rows(joined, rows, struct(REMOVED)), "removals")
    forget(texts, *read)
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, k: int = KMER, cap: int = KEY_CAP) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges a to b to remove).

    Null text counts as empty; texts of any length are judged whole. Repeated rows are copies: from `length` bytes on they are removed whole. Null ids stay; an empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    found = removals(docs, length, k, cap)
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    digests = found.select("t", "u", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "spans")
    own = id_and_text(docs).select("doc_id", *text_keys(F.coalesce("text", F.lit(""))))
    return own.join(digests, ["t", "u"]).drop("t", "u")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("spans")
