"""SimHash near-dedup by the generalised pigeonhole principle.

The 64 bits are split into partitions that hold correlated bits together, and partitions get thresholds of their own that sum, each plus one, to
the distance plus one: two fingerprints within the distance then meet some partition's threshold. The
thresholds come from a dynamic programme over probes and estimated candidates, both counted over all fingerprints.

Two values at t bits or less from each other lie t / 2 bits (rounded up) or less from a common point, so both sides visit the points around
their own part of the bits, and those that meet at a point are verified on all bits, block by block where they meet. No list of pairs is
made: what leaves a point is a spanning forest. A point where very many meet is dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from strataforge.llm.common import columns_of, documents, forget, fresh, id_and_text, map_rows, stored, struct, text_keys
from strataforge.llm.graph import connected_components

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
#: A point where more fingerprints than this meet is dealt out as pairs of blocks of about this size.
GROUP_CAP = 2048
#: What it costs to verify a pair, in rows shuffled.
VERIFY_COST = 0.02
#: Near copies: five-word shingles, this similarity; candidates lie so many bits apart at most.
NEAR_SHINGLE = 5
SIMILARITY = 0.8
NEAR_DISTANCE = 8
#: A component of candidates with more texts than this is verified as pairs of blocks of about this size.
VERIFY_CAP = 512
#: Most bits of the table that tells which texts are worth a join, 32 a text before; with more texts more rows pass, and none is lost.
SIEVE_BITS = 1 << 26
CONTENT_BYTES = 6
LEAST_CONTENT = 8


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits, each 1 if it is set in over half the hashes of the text's word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    stops = ends[shingle - 1 :].tolist()
    n, ones = len(starts), np.zeros(BITS, np.int64)
    for a in range(0, n, 1 << 15):
        b = min(n, a + (1 << 15))
        h = np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts[a:b], stops[a:b], strict=True)), np.uint64, b - a)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), one row a document; null text counts as empty, other columns are not read."""

    def rows(it):
        for r in it:
            yield r["doc_id"], signed(fingerprint(r["text"] or ""))

    return map_rows(id_and_text(docs), rows, struct("doc_id long, fp long"))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: 64 x 64 sums over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            m = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            for a in range(0, len(m), 1 << 14):
                both += m[a : a + (1 << 14)].T @ m[a : a + (1 << 14)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], ["n", "both"])

    parts = fps.select("fp").mapInArrow(run, "n long, both array<double>").select("n", F.posexplode("both"))
    sums = parts.groupBy("pos").agg(F.sum("col").alias("s"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in sums:
        both[r["pos"]] = r["s"]
    return (sums[0]["n"] if sums else 0), both.reshape(BITS, BITS)


def partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of nearly equal size; each starts from the bit most correlated with the rest and takes in what is most correlated with it."""
    mean = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(mean, mean)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            b = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) with sum (t + 1) = distance + 1 and the least total cost; costs[i][t] is partition i's at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (c, t) in best.items():
            for more in range(distance + 2 - used):
                new = (c + (cost[more - 1] if more else 0.0), [*t, more - 1])
                if used + more not in after or new[0] < after[used + more][0]:
                    after[used + more] = new
        best = after
    return best[distance + 1]


def mask(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def _ball_size(bits: int, threshold: int) -> int:
    return sum(math.comb(bits, k) for k in range(-(-threshold // 2) + 1))


def _ball(bits: list[int], threshold: int) -> list[int]:
    """What to flip to reach each point that a partner within threshold can share, nothing first."""
    return [mask(list(c)) for k in range(-(-threshold // 2) + 1) for c in combinations(bits, k)]


def plan(fps: DataFrame, distance: int = DISTANCE, most: int = 4) -> list[tuple[list[int], int]]:
    """The partitions to probe and their thresholds.

    Candidates at threshold 0 are the pairs that agree on a partition, counted over all fingerprints; those at larger ones follow from it and
    from how often each bit differs.
    """
    n, both = bit_counts(fps)
    if not n:
        return [(list(range(BITS)), 0)]  # nothing to probe
    q = np.diag(both) / n
    differ = 2 * q * (1 - q)
    options = {m: partitions(n, both, m) for m in range(1, most + 1)}
    keys = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask(p))).alias("key")) for m, ps in options.items() for i, p in enumerate(ps)))
    sizes = fps.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c")).groupBy("k.m", "k.i").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    pairs = {(r["m"], r["i"]): r["pairs"] for r in sizes}
    found = []
    for m, ps in options.items():
        costs = []
        for i, p in enumerate(ps):
            # elementary symmetric sums of the odds: pairs that differ in exactly k bits, for each that differs in none
            ways = np.zeros(distance + 1)
            ways[0] = 1
            for odd in differ[p] / np.maximum(1 - differ[p], 1e-9):
                ways[1:] += odd * ways[:-1]
            at0 = max(pairs.get((m, i), 0.0), n * n / 2 * float(np.prod(1 - differ[p])))
            candidates = np.minimum(at0 * np.cumsum(ways), n * n / 2)
            costs.append([n * _ball_size(len(p), t) + VERIFY_COST * candidates[t] for t in range(distance + 1)])
        found.append((*allocate(costs, distance), ps))
    _, thresholds, ps = min(found, key=lambda x: x[0])
    return [(p, t) for p, t in zip(ps, thresholds, strict=True) if t >= 0]


def _forest(fp: np.ndarray, node: np.ndarray, distance: int) -> list[tuple]:
    """Each member of a component within the distance, tied to the component's first member."""
    label = np.arange(len(fp))
    while True:
        new = label.copy()
        for a in range(0, len(fp), 1024):
            near = np.bitwise_count(fp[a : a + 1024, None] ^ fp[None, :]) <= distance
            new[a : a + 1024] = np.where(near, label[None, :], len(fp)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return [(node[i], node[label[i]]) for i in tied]


LINKS = "a long, b long"


def near_links(nodes: DataFrame, distance: int = DISTANCE, cap: int = GROUP_CAP, chosen: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Links between nodes (node, fp: long): a forest that connects all that pairs of fingerprints within the distance connect."""
    chosen = chosen or plan(nodes.select("fp").distinct(), distance)

    def visits(i: int, bits: list[int], t: int) -> Column:
        base = F.col("fp").bitwiseAND(F.lit(mask(bits)))
        return F.array(*(F.xxhash64(F.lit(i), base.bitwiseXOR(F.lit(x))) for x in _ball(bits, t)))

    keyed = nodes.select("node", "fp", F.explode(F.concat(*(visits(i, bits, t) for i, (bits, t) in enumerate(chosen)))).alias("key"))
    crowded = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap), "crowded")
    if not crowded.isEmpty():
        blocks = F.ceil(F.col("n") / cap).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.xxhash64("key", F.least(x, own), F.greatest(x, own)))
        spread = keyed.join(crowded, "key", "left").withColumn("keys", F.when(F.col("n").isNull(), F.array("key")).otherwise(cells))
        keyed = spread.select("node", "fp", F.explode("keys").alias("key"))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in pdfs:  # sorted by key; the last key of a batch may go on in the next
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            key = pdf["key"].to_numpy()
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0
            held = pdf.iloc[end:]
            yield links(pdf.iloc[:end])
        if held is not None:
            yield links(held)

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        key, node, fp = (pdf[c].to_numpy() for c in ("key", "node", "fp"))
        fp = fp.view(np.uint64) if len(fp) else fp
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, int)
        out: list[tuple] = []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a > 1:
                out += _forest(fp[a:b], node[a:b], distance)
        return pd.DataFrame(out, columns=["a", "b"])

    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(run, struct(LINKS))


def simhash_components(docs: DataFrame, distance: int = DISTANCE, cap: int = GROUP_CAP) -> DataFrame:
    """One row a document: doc_id, fp, component_id (the smallest doc_id that links lead to, its own included).

    Documents without words have fingerprint 0 and are linked like others. Equal fingerprints count once in the search. A component without any
    id has a null component_id. Repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    groups = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    nodes = groups.select(F.col("fp").alias("node"), "fp")
    tied = connected_components(near_links(nodes, distance, cap=cap).select("a", "b")).withColumnRenamed("node", "fp")
    classes = groups.join(tied, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(classes.join(smallest, "component").select("fp", "component_id"), "classes")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


# --- near copies, verified


def content_fingerprint(text: str) -> int:
    """The fingerprint of a text's longer words, one by one; of all words where it has few such.

    Short words are what texts of a language share; without them unrelated texts lie far apart, and a changed word moves few bits.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    content = [w for w in words if len(w) >= CONTENT_BYTES]
    return fingerprint(b" ".join(content if len(content) >= LEAST_CONTENT else words).decode("utf-8", "surrogatepass"), 1)


def shingle_set(text: str, k: int = NEAR_SHINGLE) -> list[int]:
    """Distinct 32-bit hashes of a text's k-word shingles (fewer words: the whole sequence), sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= k:
        return [xxh64_intdigest(b" ".join(words), SEED) & 0x7FFFFFFF]
    return sorted({xxh64_intdigest(b" ".join(words[i : i + k]), SEED) & 0x7FFFFFFF for i in range(len(words) - k + 1)})


def _alike(sets: DataFrame, similarity: float, cap: int = VERIFY_CAP) -> DataFrame:
    """Links (a, b) that connect all that pairs of the same component with this Jaccard similarity connect; sets: node, component, shingles.

    Each pair is compared where its component meets, unless its two are connected there already. A component of more than `cap` is dealt out as pairs of blocks.
    """
    blocks = F.ceil(F.col("n") / cap).cast("int")
    crowded = stored(sets.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap), "crowded")
    if not crowded.isEmpty():
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        cells = F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.xxhash64("component", F.least(x, own), F.greatest(x, own)))
        spread = sets.join(F.broadcast(crowded), "component", "left").withColumn("keys", F.when(F.col("n").isNull(), F.array("component")).otherwise(cells))
        keyed = spread.select(F.explode("keys").alias("key"), "node", "shingles")
    else:
        keyed = sets.select(F.col("component").alias("key"), "node", "shingles")

    def tied(node: list[int], held: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = [len(x) for x in held]
        label = np.arange(len(node))
        for i in range(1, len(node)):
            for j in range(i):
                if label[i] == label[j] or min(size[i], size[j]) < similarity * max(size[i], size[j]):
                    continue
                shared = len(np.intersect1d(held[i], held[j], assume_unique=True))
                if shared >= similarity * (size[i] + size[j] - shared):
                    label[label == label[i]] = label[j]
                    yield node[i], node[j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, node, held, out = None, [], [], []
        for b in batches:  # sorted by key
            lists = b.column(2)
            flat, edge = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
            for i, (k, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != now:
                    out += tied(node, held)
                    now, node, held = k, [], []
                node.append(x)
                held.append(flat[edge[i] : edge[i + 1]].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        out += tied(node, held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")


def _sieve(keys: DataFrame, key: str = "k1") -> Callable[[np.ndarray], np.ndarray]:
    """Whether text keys may be among these: always true where they are. A bit a key, sent to all executors, so that texts no join is to find need not be shuffled."""
    slots = keys.select(F.pmod(F.col(key), F.lit(SIEVE_BITS)).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()
    size = min(SIEVE_BITS, 1 << (32 * len(slots) + 7).bit_length())
    table = np.zeros(size, bool)
    table[slots % size] = True
    bits = keys.sparkSession.sparkContext.broadcast(np.packbits(table, bitorder="little"))

    def among(k: np.ndarray) -> np.ndarray:
        slot = k.astype(np.int64) % size
        return (bits.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)

    return among


def near_copy_classes(docs: DataFrame, similarity: float = SIMILARITY, distance: int = NEAR_DISTANCE, cap: int = GROUP_CAP) -> DataFrame:
    """Classes of different texts that verified links join, one row a text: k1, k2 (the text's 128 bits), node (its number), first_id, copies, keeper (the node that stays).

    Candidates are texts whose content fingerprints are within `distance`. All pairs of the texts that candidates connect count, by the Jaccard
    similarity of their five-word shingles. Only texts with such a link come with another keeper than themselves.
    """

    def rows(it):
        for r in it:
            yield r["doc_id"], r["k1"], r["k2"], signed(content_fingerprint(r["text"] or ""))

    keys = text_keys(F.coalesce("text", F.lit("")))
    marked = stored(map_rows(id_and_text(docs).select("doc_id", *keys, "text"), rows, struct("doc_id long, k1 long, k2 long, fp long")), "fingerprints")
    once = marked.groupBy("k1", "k2").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # the number is fixed once it is written
    nodes = stored(once.withColumn("rank", F.coalesce("first_id", F.lit((1 << 63) - 1))).withColumn("node", F.monotonically_increasing_id()), "nodes")
    forget(marked)
    # written, as the components read them more than once
    near = stored(near_links(nodes.select("node", "fp"), distance, cap=cap), "links")
    wanted = stored(nodes.join(connected_components(near), "node").select("k1", "k2", "node", "component"), "candidates")
    forget(near)
    among = _sieve(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(among(b.column(0).to_numpy())))
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                lists = pa.array([shingle_set(t or "") for t in part.column(2).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["k1", "k2", "shingles"])

    # one Python evaluation in the stage: with two of them every task has two workers, which live on and keep what later stages load
    asked = id_and_text(docs).select(*keys, "text").mapInArrow(sets, struct("k1 long, k2 long, shingles array<int>"))
    shingled = stored(asked.join(wanted, ["k1", "k2"]).select("node", "component", "shingles").dropDuplicates(["node"]), "shingles")
    alike = stored(_alike(shingled, similarity), "alike")
    forget(wanted, shingled)
    classes = connected_components(alike)
    ranked = nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keeper = ranked.groupBy("component").agg(F.min(F.struct("rank", "node")).alias("k")).select("component", F.col("k.node").alias("keeper"))
    return ranked.join(keeper, "component").select("k1", "k2", "node", "first_id", "copies", "keeper")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, distance: int = NEAR_DISTANCE, cap: int = GROUP_CAP) -> DataFrame:
    """docs with one document of each class of near and exact copies, that with the smallest id; all its columns, of whatever names and types.

    A null text counts as empty; texts of any length are compared whole. Of rows alike in id and text the first by their other columns, written as JSON, stays; rows without id come
    last, and one of them stays only if its class has no id at all. An empty table gives no rows.
    """
    classes = near_copy_classes(docs, similarity, distance, cap)
    k1, k2, first, stays, place = fresh(docs, "text_key_1", "text_key_2", "first_id", "stays", "place")
    # texts that are alone in every way need no decision; the rest is a small share of the rows
    told = classes.filter((F.col("keeper") != F.col("node")) | (F.col("copies") > 1))
    decided = stored(told.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("first_id").alias(first), (F.col("keeper") == F.col("node")).alias(stays)), "decided")
    keyed = docs.withColumns(dict(zip((k1, k2), text_keys(F.coalesce(F.col("text").cast("string"), F.lit(""))), strict=True)))
    among = _sieve(decided, k1)
    maybe = F.pandas_udf(lambda k: pd.Series(among(k.to_numpy())), "boolean")(F.col(k1))
    joined = keyed.filter(maybe).join(decided, [k1, k2], "left")
    single = keyed.filter(~maybe).select(*columns_of(docs)).unionByName(joined.filter(F.col(stays).isNull()).select(*columns_of(docs)))
    several = joined.filter(F.col(stays) & F.col("doc_id").cast("long").eqNullSafe(F.col(first)))
    # rows alike in id and text: only those of texts with copies can be
    order = W.partitionBy(k1, k2).orderBy(F.to_json(F.struct(*columns_of(docs, "text"))))
    one = several.withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
    return single.unionByName(one.select(*columns_of(docs)))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_components(documents(spark, sf_dir)).select("doc_id", hex16.alias("fingerprint"), "component_id")
