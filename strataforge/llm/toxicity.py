"""Toxicity: noisy-channel deobfuscation, then scoring of the restored text.

A character language model is counted over all documents. Tokens that look disguised (signs and digits among letters, drawn-out
letters, letters spelled apart) become lattices: each sign may stand for letters, a repeated letter or a separator for nothing. Viterbi decoding
finds the likeliest word under model and channel. The classifier is a logistic model over a short list of words and stems (a stem counts as seen once, twice or
three times), chosen greedily from labelled documents so that a word is not blamed for what another one explains.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.common import documents, forget, id_and_text, labels, map_rows, stored, struct

THRESHOLD = 0.3
SAMPLE = 20_000
#: The model's alphabet: 0 is a word's edge, 1 any letter not named here.
ALPHABET = "\0?abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
CODE = {c: i for i, c in enumerate(ALPHABET)}
A = len(ALPHABET)
#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou", "#": "h"}
SIGN_COST, REPEAT_COST, DOUBLE_COST, GAP_COST = 1.0, 0.7, 0.1, 0.1
STEMS = range(3, 9)
TIMES = 3
MOST_FEATURES = 300
#: Characters counted at a time.
SLICE = 1 << 22
LETTERS = re.compile(r"[^\W\d_]+")
MARKS = ".,;:?!\"'()[]¡¿«»“”‘’…"
TRIPLE = re.compile(r"([^\W\d_])\1\1")
APART = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*~]{1,2}[^\W_](?!\w)){3,}")
#: Two lone letters in a row: every run of APART has them in its midst.
LONE = re.compile(r"[ .\-_*~][^\W_][ .\-_*~]{1,2}[^\W_][ .\-_*~]")
#: What a token falls into at marks that stand for no letter, and letters with such a mark between them.
_SIGN = "[" + re.escape("".join(c for c in SIGNS if not c.isalnum())) + "]"
PARTS = re.compile(rf"(?:[^\W_]|{_SIGN})+")
BROKEN = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[.\-_*~·][^\W\d_]++)++")


def _table() -> np.ndarray:
    """Code of each code point after lower-casing; letters outside the alphabet share one code."""
    out = np.zeros(0x250, np.int64)
    for i in range(0x250):
        if chr(i).isalpha():
            out[i] = CODE.get(chr(i).lower(), 1)
    return out


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of three characters in a row (a word starts and ends with the edge) over all documents, A x A x A.

    A task sends one row a trigram it has seen, at most A**3, whatever it reads; sums are made by key on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _table(), np.zeros(A**3, np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                text = "\n\n".join(t for t in b.column(0).slice(a, 256).to_pylist() if t)
                carried = np.zeros(1, np.int64)
                for at in range(0, len(text), SLICE):
                    points = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
                    c = table[np.minimum(points, 0x24F)]
                    c[(points > 0x24F)] = 0
                    last = at + SLICE >= len(text)
                    c = np.concatenate([carried, c, np.zeros(2 * last, np.int64)])
                    carried = c[-2:]  # a slice goes on where the one before ends
                    key = (c[:-2] * A + c[1:-1]) * A + c[2:]
                    total += np.bincount(key[(c[1:-1] > 0) | (c[:-2] > 0)], minlength=A**3)
                    first = key[(c[:-2] == 0) & (c[1:-1] > 0)] // A  # the edge twice, then a word's first letter
                    total += np.bincount(first, minlength=A**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["k", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(A**3)
    for r in sums:
        out[r["k"]] = r["n"]
    return out.reshape(A, A, A)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), trigrams backed by bigrams backed by single characters."""
    one = counts.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = counts.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    three = (counts + 5 * two[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return -np.log(three).astype(np.float32)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each observed character what it may stand for ('' for nothing) and the cost."""
    out: list[list[tuple[str, float]]] = []
    for c, run in groupby(token):
        times = len(list(run))
        for i in range(times):
            if c.isalpha():
                here = [(c, 0.0)]
                if i:
                    here = [(c, REPEAT_COST), ("", DOUBLE_COST)] if times > 2 else [(c, 0.0), ("", 4.0)]
            elif c in SIGNS:
                here = [(x, SIGN_COST) for x in SIGNS[c]]
                if i:
                    here.append(("", REPEAT_COST))
                if not c.isdigit():
                    here.append(("", 4.0))
            else:
                here = [("", GAP_COST)]
            out.append(here)
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The cheapest path of letters through the token's lattice, by Viterbi over the last two letters; of equal ones the first. Time goes with the token's length."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for options in lattice(token.lower()):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, path) in states.items():
            for letter, price in options:
                if letter:
                    c = CODE.get(letter, 1)
                    key, total = (b, c), cost + price + float(model[a, b, c])
                else:
                    key, total = (a, b), cost + price
                if key not in after or total < after[key][0]:
                    after[key] = (total, (letter, path) if letter else path)
        states = after
    path = min(((cost + float(model[a, b, 0]), path) for (a, b), (cost, path) in states.items()), key=lambda x: x[0])[1]
    letters = []
    while path:
        letter, path = path
        letters.append(letter)
    return "".join(reversed(letters))


def drawn_out(text: str) -> bool:
    """Whether some character of a text stands three times in a row, white space aside."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return bool(((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & (c[2:] > 32)).any())


def suspicious(token: str, triples: bool) -> Iterator[str]:
    """What of a token looks disguised: parts between marks with signs among their letters (runs of one sign at their end aside) or a letter three times in a row."""
    token = token.strip(MARKS)
    if token.isalpha():
        if triples and TRIPLE.search(token):
            yield token
        return
    for part in PARTS.findall(token):
        if part[-3:] == part[-1:] * 3 and not part[-1].isalpha():
            part = part.rstrip(part[-1])
        if part.isalpha():
            if triples and TRIPLE.search(part):
                yield part
        elif any(c in SIGNS for c in part) and any(c.isalpha() for c in part):
            yield part


def spelled_apart(text: str) -> list[tuple[str, str, int]]:
    """Letters spelled apart, without and with what stands between them, each once."""
    if not LONE.search(text):
        return []
    return [(re.sub(r"[ .\-_*~]", "", m[0]), m[0], 1) for m in APART.finditer(text)]


def disguised(text: str) -> list[tuple[str, str, int]]:
    """(what to decode, what stands in the text, how often): suspicious tokens and letters spelled apart, the latter without what stands between them."""
    return read(text)[1]


def read(text: str) -> tuple[dict[str, int], list[tuple[str, str, int]]]:
    """A text's words as they stand, lower-cased, words that a mark breaks in two also joined; and what is disguised. Each distinct token is looked at once."""
    triples = drawn_out(text)
    words: dict[str, int] = defaultdict(int)
    parts: dict[str, int] = defaultdict(int)
    for w, n in Counter(text.split()).items():
        core = w if w.isalpha() else w.strip(MARKS)
        if core.isalpha():
            words[core.lower()] += n
            if triples and len(core) >= 3 and TRIPLE.search(core):
                parts[core] += n
            continue
        low = w.lower()
        for piece in LETTERS.findall(low):
            words[piece] += n
        for m in BROKEN.findall(low):
            words[re.sub(r"[\W_]", "", m)] += n
        for part in suspicious(w, triples):
            if len(part) >= 3:
                parts[part] += n
    return words, [(t, t, n) for t, n in parts.items()] + spelled_apart(text)


def restore(text: str, model: np.ndarray) -> list[str]:
    """The decoded words of what is disguised in a text."""
    return [w for w in (decode(t, model) for t, _, _ in disguised(text)) if w]


def words_in(text: str, model: np.ndarray) -> dict[str, int]:
    """All words of the restored text, lower-cased, with their numbers: what is disguised is replaced by what it decodes to.

    Words that a mark breaks in two stay as they are, and count joined as well.
    """
    out, hidden = read(text)
    for token, shown, n in hidden:
        if word := decode(token, model):
            for piece in LETTERS.findall(shown.lower()):
                out[piece] -= n
            out[word] += n
    return {w: n for w, n in out.items() if n > 0} if hidden else out


def features(words: dict[str, int]) -> set[str]:
    """Whole words, and 'stem-m' for every stem that starts m words or more, m to TIMES."""
    stems: dict[str, int] = defaultdict(int)
    for w, n in words.items():
        for k in range(STEMS[0], min(len(w) - 1, STEMS[-1]) + 1):
            stems[w[:k]] += n
    out = set(words)
    for m in range(1, TIMES + 1):
        end = f"-{m}"
        out.update([s + end for s, n in stems.items() if n >= m])
    return out


@dataclass
class Lexicon:
    """Weights of words and stems, and the log-odds of a text without any."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -2.0

    def __post_init__(self) -> None:
        self.heads = {f[: STEMS[0]] for f in self.weights}

    def score(self, words: dict[str, int]) -> float:
        """Probability of label 1 from a text's words."""
        some = {w: n for w, n in words.items() if w[: STEMS[0]] in self.heads}
        hits = features(some).intersection(self.weights) if some else ()
        z = self.bias + sum(self.weights[h] for h in sorted(hits))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model by Newton steps with a small ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id):
    """Rows of which no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, marks: DataFrame, model: np.ndarray, sample: int = SAMPLE, least: int = 5, precision: float = 0.7, most: int = MOST_FEATURES) -> Lexicon:
    """Learn from at most `sample` labelled rows that are not held out, those with the smallest hash of their id.

    Equal texts count once. A word or stem is a candidate if `least` positive texts have it and `precision` of all texts with it are
    positive; the candidate that explains most unexplained positive texts is taken, again and again, as long as it explains `least` of them, `most` of them at most. Features are
    counted on the executors, first of positive texts, then of the others for those that can still be candidates.
    """
    marks = marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(~held_out(F.col("doc_id")))
    ids = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas()
    spark = docs.sparkSession
    # broadcast: at most `sample` rows of 12 bytes
    picked = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))
    joined = id_and_text(docs).join(picked, "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))
    texts = stored(joined.groupBy(F.xxhash64("text").alias("k")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")), "labelled")
    sent = spark.sparkContext.broadcast(model)

    def counted(of: DataFrame, among: set[str] | None) -> dict[str, int]:
        only = None if among is None else spark.sparkContext.broadcast(among)  # features of at most `sample` texts

        def rows(it):
            total: Counter = Counter()
            for r in it:
                f = features(words_in(r["text"], sent.value))
                total.update(f if only is None else f & only.value)
            yield from total.items()

        sums = map_rows(of.select("text"), rows, struct("f string, n long")).groupBy("f").agg(F.sum("n").alias("n"))
        return {r["f"]: r["n"] for r in sums.filter(F.col("n") >= (least if among is None else 1)).collect()}

    p = counted(texts.filter("toxic = 1"), None)
    n = counted(texts.filter("toxic = 0"), set(p))
    chosen = {f for f in p if p[f] >= precision * (p[f] + n.get(f, 0))}
    listed = spark.sparkContext.broadcast((chosen, {f[: STEMS[0]] for f in chosen}))

    def present(it):
        among, heads = listed.value
        for r in it:
            some = {w: n for w, n in words_in(r["text"], sent.value).items() if w[: STEMS[0]] in heads}
            yield r["toxic"], sorted(features(some) & among)

    got = map_rows(texts.select("toxic", "text"), present, struct("toxic int, f array<string>")).collect()
    forget(texts)
    positive: dict[str, set[int]] = defaultdict(set)
    for i, r in enumerate(got):
        if r["toxic"]:
            for f in r["f"]:
                positive[f].add(i)
    forest = sorted(positive)
    known: set[int] = set()
    taken: list[str] = []
    while forest and len(taken) < most:
        # unexplained texts first, fewer negatives, then the longer word or stem, which is the narrower claim
        best = max(forest, key=lambda f: ((len(positive[f]) - len(positive[f] & known)) * p[f] / (p[f] + 10 * n.get(f, 0)), len(f), f))
        if len(positive[best] - known) < least:
            break
        known |= positive[best]
        forest.remove(best)
        forest = [f for f in forest if len(positive[f] - known) >= least]
        taken.append(best)
    y = np.array([r["toxic"] for r in got], float)
    at = {f: j for j, f in enumerate(taken)}
    x = np.zeros((len(got), len(taken)))
    for i, r in enumerate(got):
        for f in r["f"]:
            if f in at:
                x[i, at[f]] = 1
    if not len(got):
        return Lexicon()
    order = np.lexsort([*x.T, y])  # the same sums whatever order the rows came in
    w, bias = logistic(x[order], y[order])
    return Lexicon(dict(zip(taken, w.tolist(), strict=True)), bias)


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def toxicity(docs: DataFrame, model: np.ndarray, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each document.

    Null or empty text scores as a text without words. Repeated rows give repeated results; null ids stay (not held out); no
    column but text enters a score, and other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # A**3 floats, fixed by the alphabet

    def rows(it):
        for r in it:
            s = lexicon.score(words_in(r["text"] or "", sent.value))
            yield r["doc_id"], r["held_out"], s, int(s >= threshold)

    return map_rows(id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id"))), rows, struct(SCORES))


def scored(docs: DataFrame, marks: DataFrame) -> DataFrame:
    model = language_model(trigram_counts(docs))
    return toxicity(docs, model, fit(docs, marks, model))


def without_toxic(docs: DataFrame, marks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs that are not rejected, all their columns, of whatever names and types; every row is judged by its own whole text.

    Null and empty texts score as texts without words and stay unless such texts are toxic by the labels; repeated rows stay or go together; null ids stay; an empty table gives no rows.
    """
    model = language_model(trigram_counts(docs))
    lexicon = fit(docs, marks, model)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def clean(texts):
        return texts.map(lambda t: lexicon.score(words_in(t or "", sent.value)) < threshold)

    return docs.filter(clean(F.col("text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), labels(spark, sf_dir))
