"""Operators over the whole corpus against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import graph, mixing, packing, passages, simhash, suffixes

SCHEMA = "doc_id long, text string, source string, key string"


def rng_words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed, n=40):
    """Documents with copies, near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    base = [rng_words(rng, rng.randint(0, 160)) for _ in range(n)]
    passage = rng_words(rng, 70)
    out = list(base)
    out += [base[0], base[0], base[1]]
    for i in range(6):
        w = base[2 + i].split() or ["x"]
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [rng_words(rng, 30) + " " + passage + " " + rng_words(rng, 30) for _ in range(4)]
    out += ["", "one", "a b", "é " * 150, "x" * 700, "x" * 450, "line\n" * 90]
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, "k") for i, t in enumerate(out)]
    return rows + [(None, base[3], None, "k"), (None, None, "s1", "k"), (5, base[5], "s2", "k"), (5, base[5], "s2", "k")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(1), SCHEMA)


# --- components


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union(pairs, {x for p in pairs for x in p})


def test_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 2 * sizes[s] + 1e-9] if w else []
        if not over:
            return {**target, **{s: left * weight[s] / w for s in open_}}
        for s in over:
            target[s] = 2.0 * sizes[s]
            open_.discard(s)


def test_mix(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    for r in got:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    for s, t in brute_targets(sizes).items():
        assert abs(taken[s] - t) <= 1
        assert all(r["target"] == pytest.approx(t) for r in got if r["source"] == s)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"], str(r["source"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_in_ranges(spark, monkeypatch):
    """Prefix sums over many nested ranges are those of one sort."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "FANOUT_BITS", 2)
    rng = random.Random(2)
    rows = [(i, rng_words(rng, rng.randint(0, 9)), "s" if i % 3 else "t", "k") for i in range(300)]
    got = mixing.mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in ("s", "t"):
        at = 0
        for r in sorted((r for r in got if r["source"] == s), key=lambda r: (r["mix_key"], r["doc_id"])):
            assert r["words_before"] == at
            at += r["size"]


def test_mixed_documents(spark, docs):
    mix = mixing.mix_sources(docs)
    words = mix.agg(F.sum("taken")).first()[0]
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len((r["text"] or "").encode().split()) for r in out.collect()) == words
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


# --- packing


def check_packing(pieces, size):
    bins = defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= size
    return len(bins)


def test_sum_of_squares_takes_the_best_place():
    rng = np.random.default_rng(3)
    size, lengths = 20, rng.integers(1, 20, 60)
    where, offset = packing.sum_of_squares(lengths, size)
    used: dict[int, int] = {}

    def squares(state):
        return sum(c * c for c in Counter(size - u for u in state.values() if u < size).values())

    for n, b, o in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        assert used.get(b, 0) == o
        options = [squares({**used, k: used.get(k, 0) + n}) for k in [*used, -1] if used.get(k, 0) + n <= size]
        after = {**used, b: o + n}
        assert squares(after) == min(options)
        used = after


def test_pack_documents(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 128)):
            part = ids[a : a + 128]
            want[(r["doc_id"], k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = packing.pack_documents(docs, size=128).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    n = check_packing(got, 128)
    assert n <= -(-sum(r["length"] for r in got) // 128) + 2
    grouped = packing.pack_pieces(packing.token_pieces(docs, size=128), 128, group=8).collect()
    assert len(grouped) == len(got)
    check_packing(grouped, 128)
    whole = packing.sequences(docs, size=128).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in got)
    assert packing.pack_documents(docs.limit(0)).count() == 0


# --- SimHash


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    for r in docs.collect():
        assert simhash.fingerprint(r["text"] or "") == brute_fingerprint(r["text"])


def test_allocation_is_valid_and_cheapest():
    from itertools import product

    rng = random.Random(1)
    for m, distance in ((1, 2), (3, 2), (4, 5)):
        costs = [sorted(rng.random() for _ in range(distance + 1)) for _ in range(m)]
        cost, thresholds = simhash.allocate(costs, distance)
        every = [t for t in product(range(-1, distance + 1), repeat=m) if sum(x + 1 for x in t) == distance + 1]
        assert cost == pytest.approx(min(sum(costs[i][x] for i, x in enumerate(t) if x >= 0) for t in every))
        assert sum(t + 1 for t in thresholds) == distance + 1


def clustered(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.choice(out) if out and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("distance", "cap"), [(2, 2048), (2, 3), (8, 2048), (8, 5)])
def test_near_links(spark, distance, cap):
    fps = clustered(distance, 150)
    nodes = spark.createDataFrame([(i, i, simhash.signed(x)) for i, x in enumerate(fps)], "node long, rank long, fp long")
    true = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance]
    want = union(true, range(len(fps)))
    for chosen in (None, [(list(range(64)), 2)] if distance == 2 else None):
        got = {(r["a"], r["b"]) for r in simhash.near_links(nodes, distance, cap=cap, chosen=chosen).collect()}
        assert union(got, range(len(fps))) == want


def test_simhash_components(spark, docs):
    rows = docs.collect()
    fps = [simhash.fingerprint(r["text"] or "") for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = union(links, range(len(rows)))
    smallest = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            smallest[root[i]] = min(smallest.get(root[i], 10**9), r["doc_id"])
    want = Counter((r["doc_id"], simhash.signed(fps[i]), smallest.get(root[i])) for i, r in enumerate(rows))
    got = Counter((r["doc_id"], r["fp"], r["component_id"]) for r in simhash.simhash_components(docs).collect())
    assert got == want
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_one_of_each(spark, docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert max(ids.values()) == 1 or ids[None] >= 1
    assert 0 in ids and 40 not in ids and 41 not in ids and 42 not in ids and ids[5] == 1  # exact copies of 0, 1 and a repeated row
    sets = {r["doc_id"]: set(simhash.shingle_set(r["text"] or "")) for r in docs.collect()}
    for i in range(43, 49):  # near copies of 2 to 7, if similar enough
        base = i - 41
        j = len(sets[i] & sets[base]) / len(sets[i] | sets[base])
        if j < 0.8:
            assert i in ids


# --- suffixes


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "k", "cap"), [(200, 64, suffixes.KEY_CAP), (40, 16, suffixes.KEY_CAP), (40, 16, 1)])
def test_suffix_dedup(spark, docs, length, k, cap):
    rows = docs.collect()
    want = Counter((r["doc_id"], *w) for r, w in zip(rows, brute_removed([r["text"] for r in rows], length), strict=True))
    got = suffixes.suffix_dedup(docs, length, k, cap).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert suffixes.suffix_dedup(docs.limit(0), length, k, cap).count() == 0


def test_merged_transforms_sort_all_suffixes():
    """The interleave equals a direct sort of all suffixes to the same depth."""
    rng = np.random.default_rng(1)
    shards = [np.concatenate([rng.integers(10, 13, n), [i]]) for i, n in enumerate((30, 50, 1, 20))]
    depth = 8
    orders = [suffixes.suffix_array(t, depth) for t in shards]
    which, interval = suffixes.merge_transforms([t[o - 1] for t, o in zip(shards, orders, strict=True)], depth)
    rows = [iter(o.tolist()) for o in orders]
    merged = [tuple(np.take(shards[j], range(p, p + depth), mode="wrap").tolist()) for j in which.tolist() for p in [next(rows[j])]]
    assert merged == sorted(merged)
    assert [a == b for a, b in zip(merged, merged[1:], strict=False)] == [a == b for a, b in zip(interval.tolist(), interval.tolist()[1:], strict=False)]


@pytest.mark.parametrize("least", [3, 10, 46])
@pytest.mark.parametrize("n", [2, 46, 300])
def test_compact_windows(n, least):
    v = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    want = []
    for c in range(n):
        left = right = c
        while left and v[left - 1] > v[c]:
            left -= 1
        while right < n - 1 and v[right + 1] > v[c]:
            right += 1
        if right - left + 1 >= least:
            want.append((left, c, right))
    assert sorted(zip(*(x.tolist() for x in passages.compact_windows(v, least)), strict=True)) == sorted(want)


def test_similar_runs():
    rng = random.Random(8)
    for _ in range(20):
        x = [rng.randrange(30) for _ in range(rng.randint(0, 60))]
        y = [v if rng.random() < 0.9 else rng.randrange(30) for v in x]
        good = [a for a in range(len(x) - 9) if len(set(x[a : a + 10]) & set(y[a : a + 10])) >= 0.8 * len(set(x[a : a + 10]) | set(y[a : a + 10]))]
        got = [(int(a), int(n)) for _, a, n in zip(*passages.similar_runs(np.array(x), np.array(y), np.array([0, len(x)]), 10, 0.8), strict=True)]
        assert [a for s, n in got for a in range(s, s + n - 9)] == good
        assert all(s + n - 9 < t for (s, n), (t, _) in zip(got, got[1:], strict=False))


def test_near_passages(spark, docs):
    got = {r["doc_id"]: r for r in passages.near_passages(docs).collect() if r["doc_id"] is not None}
    assert len(got) == docs.filter("doc_id is not null").select("doc_id").distinct().count()
    shared = range(49, 53)  # four documents with one passage of 70 words from word 30 on
    assert {got[i]["class_id"] for i in shared} == {49} and all(got[i]["n_verified"] >= 1 for i in shared)
    for i in shared:
        (s,) = got[i]["spans"]
        assert 25 <= s["a"] <= 40 and 90 <= s["b"] <= 105
    texts = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    for i in range(8, 40):  # texts of their own
        assert got[i]["n_verified"] == 0 and got[i]["class_id"] == i
    if len(texts[0]) >= 50:
        assert got[40]["class_id"] == 0 and got[40]["n_copies"] == 3
    assert passages.near_passages(docs.limit(0)).count() == 0


def test_shingle_runs():
    """Equal word sequences have equal hashes wherever they stand, and different ones different hashes; texts do not run into each other."""
    texts = ["", "One two  three\tfour five six", "a b", "é two three four five six seven", "x one TWO three\nfour five six ", "abcab cab"]
    data = [t.encode() for t in texts]
    h, edges = passages.shingle_runs(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = [[tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (t.lower().split() for t in texts)]
    assert np.diff(edges).tolist() == [len(w) for w in want]
    seen = dict(zip([s for w in want for s in w], h.tolist(), strict=True))
    assert [seen[s] for w in want for s in w] == h.tolist() and len(set(seen.values())) == len(seen)
    assert all(passages.shingles(t).tolist() == h[a:b].tolist() for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True))
