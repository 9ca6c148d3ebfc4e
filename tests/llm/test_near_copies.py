"""Near copies of the pipeline against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark import SparkContext

from strataforge.llm import simhash


def brute(texts: list[str]) -> list[int]:
    """The first text of each text's class by all pairs' Jaccard similarity."""
    sets = [set(simhash.shingle_set(t)) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared >= simhash.SIMILARITY * (len(sets[i]) + len(sets[j]) - shared):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return label


def keepers(spark, texts: list[str], **given) -> list[int]:
    rows = simhash.one_of_each(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **given)
    return sorted(r["doc_id"] for r in rows.collect())


def crowd() -> list[str]:
    """Texts of the same words in many orders: all fingerprints equal, few texts alike; each order's near copy comes last."""
    rng = random.Random(7)
    words = [f"ordinary{i:03d}" for i in range(80)]
    orders = [rng.sample(words, len(words)) for _ in range(40)]
    return [" ".join(o) for o in orders] + [" ".join([*o[:-2], o[-1], o[-2]]) for o in orders]


@pytest.mark.parametrize("cap", [8, 512])
def test_all_within_the_distance(spark, cap, monkeypatch):
    texts = crowd()
    if hasattr(simhash, "_alike"):
        monkeypatch.setattr(simhash._alike, "__defaults__", (cap,))
    want = brute(texts)
    assert want == [*range(40), *range(40)]
    assert keepers(spark, texts) == sorted(set(want))


def edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    """A near copy: words replaced, dropped, inserted or added at the end, so many of all."""
    out = list(words)
    how = rng.choice(["replace", "drop", "insert", "tail"])
    for _ in range(max(1, round(share * len(words) / (1 if how == "tail" else 5)))):
        at = rng.randrange(len(out))
        fresh = f"other{rng.randrange(10**6)}"
        if how == "replace":
            out[at] = fresh
        elif how == "drop":
            del out[at]
        else:
            out.insert(len(out) if how == "tail" else at, fresh)
    return out


def clusters(size: int, n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    lexicon = ["".join(rng.choices("abcdefghijklmnoprstuvz", k=rng.randint(2, 11))) for _ in range(4_000)]
    out = []
    for _ in range(n):
        base = [lexicon[min(int(rng.paretovariate(0.6)) - 1, len(lexicon) - 1)] for _ in range(rng.choice([40, 100, 300]))]
        out += [" ".join(base)] + [" ".join(edited(rng, base, rng.choice([0.02, 0.06, 0.1]))) for _ in range(size - 1)]
    return out


@pytest.mark.parametrize(("size", "n"), [(4, 60), (150, 2)])
def test_recall(spark, size, n):
    """Of the texts that brute force over all pairs removes, nine in ten go; none else does."""
    texts = clusters(size, n, size)
    want = brute(texts)
    removable = {i for i, k in enumerate(want) if k != i}
    gone = set(range(len(texts))) - set(keepers(spark, texts))
    assert len(removable) > 0.3 * len(texts)
    assert len(gone & removable) >= 0.9 * len(removable)
    assert all(any(want[j] == want[i] for j in range(len(texts)) if j != i) for i in gone)
    print("near-dedup recall", size, len(gone & removable) / len(removable))


def linked(x: list[str], y: list[str]) -> bool:
    """Whether runs of 46 five-word shingles at some places of two texts have a Jaccard similarity of 0.8: every pair of starts whose shingles agree somewhere is tried."""
    sx, sy = ([tuple(w[i : i + 5]) for i in range(len(w) - 4)] for w in (x, y))
    places: dict = {}
    for j, s in enumerate(sy):
        places.setdefault(s, []).append(j)
    for d in {i - j for i, s in enumerate(sx) for j in places.get(s, ())}:
        for i in range(max(0, d), min(len(sx), len(sy) + d) - 45):
            a, b = set(sx[i : i + 46]), set(sy[i - d : i - d + 46])
            if len(a & b) >= 0.8 * len(a | b):
                return True
    return False


def test_passages_recall(spark):
    """Classes of near passages against brute force over all pairs: a passage in 60 texts, each time with a changed word or two, and pairs of texts with a passage of their own."""
    from strataforge.llm import passages

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7)))
    some = lambda n: [word() for _ in range(n)]
    shared, texts = some(80), []
    for k in range(100):
        if k >= 60 and k % 2 == 0:
            own = some(70)
        core = list(shared if k < 60 else own)
        for _ in range(rng.randint(0, 2)):
            core[rng.randrange(len(core))] = word()
        texts.append(some(rng.randint(0, 60)) + core + some(rng.randint(0, 60)))
    texts += [some(rng.randint(0, 150)) for _ in range(40)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if linked(texts[i], texts[j]):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if label[i] == label[j]]
    found = sum(got[i] == got[j] for i, j in pairs)
    print("passage class recall", found / len(pairs))
    assert found >= 0.9 * len(pairs)
    assert not any(got[i] == got[j] for i in range(len(texts)) for j in range(i) if label[i] != label[j])


def test_passages_in_a_crowd(spark, monkeypatch):
    """Classes of passages of one length, all cut from one original, against all pairs: hundreds have equal smallest hashes, few are similar enough."""
    from strataforge.llm import passages

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7)))
    base, other = [word() for _ in range(50)], [word() for _ in range(50)]
    texts = sorted({tuple(other[i] if i % 5 == 2 and rng.random() < 0.5 else w for i, w in enumerate(base)) for _ in range(150)})
    hashes = [passages.shingles(" ".join(t)) for t in texts]
    least = [[passages.mixed(h, j).min() for j in range(passages.FUNCTIONS)] for h in hashes]
    sets = [set(h.tolist()) for h in hashes]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sum(x == y for x, y in zip(least[i], least[j], strict=True)) >= passages.AGREE and shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared):
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    assert 10 < len(set(label)) < len(texts) - 10
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for block in (1024, 16):
        monkeypatch.setattr(passages, "BLOCK", block, raising=False)
        got = {r["doc_id"]: r["class_id"] for r in passages.near_passages(docs).collect()}
        assert [got[i] for i in range(len(texts))] == label


def test_texts_without_copies_stay_where_they_are(spark, tmp_path):
    """Texts that no join is to find are not shuffled: with joins that are not broadcast, what is written between stages does not grow with them."""
    rng = random.Random(5)
    alone = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) for _ in range(150)]
    texts = alone + [alone[0]] + clusters(4, 5, 3)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = brute(texts)
        store = spark.sparkContext._jsc.sc().statusStore()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        docs.write.parquet(f"{tmp_path}/docs")
        start = max(s.stageId() for s in _stages(store))
        got = sorted(r["doc_id"] for r in simhash.one_of_each(spark.read.parquet(f"{tmp_path}/docs")).collect())
        written = sum(s.shuffleWriteBytes() for s in _stages(store) if s.stageId() > start)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == sorted(set(want))
    assert written < 0.5 * sum(map(len, texts))


def _stages(store) -> list:
    gateway = SparkContext._gateway
    empty = gateway.jvm.java.util.ArrayList()
    stages = store.stageList(empty, False, False, gateway.new_array(gateway.jvm.double, 0), empty)
    return [stages.apply(i) for i in range(stages.size())]


def python_in_a_stage(df) -> int:
    """The most Python evaluations that a task of df's plan runs at once."""
    most = 0

    def walk(node, above: int) -> None:
        nonlocal most
        name = node.nodeName()
        own = 0 if "Exchange" in name else above + any(x in name for x in ("Python", "InArrow", "InPandas"))
        most = max(most, own)
        if name == "AdaptiveSparkPlan":
            return walk(node.initialPlan(), above)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), own)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return most


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """Workers live on with all that later stages load, so a stage that needs two a task doubles an executor's memory."""
    found, stored = {}, simhash.stored

    def seen(df, name, *a):
        found[name] = max(found.get(name, 0), python_in_a_stage(df))
        return stored(df, name, *a)

    monkeypatch.setattr(simhash, "stored", seen)
    rows = spark.createDataFrame(list(enumerate(crowd())), "doc_id long, text string")
    out = simhash.one_of_each(stored(rows, "rows"))
    assert out.count() == 40
    found["result"] = python_in_a_stage(out)
    assert found["shingles"] == 1 and max(found.values()) == 1, found
