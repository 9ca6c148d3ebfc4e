"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown here on binned statistics with logistic loss; a feature with a monotonic constraint may
only move the score one way, along every path. The trees are flattened into node arrays (feature, threshold, left,
right, value), and a batch of documents descends all of them at once with numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strataforge.llm.common import documents, id_and_text, labels, map_rows, struct

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Statistic, and the direction that the quality score must keep in it (-1: may only fall, 0: free).
STATISTICS = (
    ("log_words", 0),
    ("mean_word_length", 0),
    ("symbols_per_word", -1),
    ("duplicate_line_share", -1),
    ("repeated_word_share", -1),
    ("top_word_share", 0),
    ("distinct_share", 0),
    ("adjacent_repeat_share", -1),
    ("upper_share", 0),
    ("digit_share", 0),
    ("exclamation_per_word", -1),
    ("words_per_line", 0),
)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (words by ASCII white space)."""
    return _measure(text)[0]


def _measure(text: str) -> tuple[tuple[int, int, int, int, int], list[float]]:
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(x for x in text.split("\n") if x.strip(SPACES))
    n_lines = sum(lines.values())
    dup_lines = n_lines - len(lines)
    repeated = 0
    if n > WINDOW:
        grams = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) < len(grams):
            count = Counter(grams)
            end = 0
            for i, g in enumerate(grams):
                if count[g] > 1:
                    repeated += i + WINDOW - max(i, end)
                    end = i + WINDOW
    tally = Counter(words)
    m = max(n, 1)
    upper = sum(map(str.isupper, text)) if not text.isascii() else sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    stats = [
        np.log1p(n),
        chars / m,
        symbols / m,
        dup_lines / max(n_lines, 1),
        repeated / m,
        max(tally.values(), default=0) / m,
        len(tally) / m,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        upper / max(chars, 1),
        sum(map(text.count, "0123456789")) / max(chars, 1),
        text.count("!") / m,
        n / max(n_lines, 1),
    ]
    return (n, chars, symbols, dup_lines, repeated), stats


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@dataclass
class Forest:
    """All trees in one set of node arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Probability of good quality for each row of x."""
        out = np.empty(len(x))
        for a in range(0, len(x), block):
            part = x[a : a + block]
            rows = np.arange(len(part))[:, None]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                at = np.where(part[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out[a : a + block] = self.bias + self.value[at].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def train(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 4.0) -> Forest:
    """Boost `trees` trees of at most `depth` levels on x (rows by statistics) and y (0 or 1); signs: -1, 0 or +1 a column.

    Without both classes the forest is its bias alone, which keeps (or rejects) everything.
    """
    nodes: list[list[float]] = []
    roots: list[int] = []
    p = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(p / (1 - p)))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        f = np.full(len(y), bias)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            roots.append(_grow(nodes, coded, cuts, p - y, np.maximum(p * (1 - p), 1e-6), signs, depth, rate, l2, least, f))
    if not nodes:
        nodes, roots = [[0, np.inf, 0, 0, 0.0]], [0]
    table = np.array(nodes)
    return Forest(table[:, 0].astype(np.int32), table[:, 1], table[:, 2].astype(np.int32), table[:, 3].astype(np.int32), table[:, 4], np.array(roots, np.int32), depth, bias)


def _grow(nodes, coded, cuts, grad, hess, signs, depth, rate, l2, least, f) -> int:
    def leaf(rows, lo, hi) -> float:
        return float(np.clip(-grad[rows].sum() / (hess[rows].sum() + l2), lo, hi))

    def best(rows, lo, hi):
        g0, h0 = grad[rows].sum(), hess[rows].sum()
        top = (1e-9, -1, -1)
        for j, cut in enumerate(cuts):
            if not len(cut):
                continue
            k = coded[rows, j]
            g = np.cumsum(np.bincount(k, grad[rows], len(cut) + 1))[:-1]
            h = np.cumsum(np.bincount(k, hess[rows], len(cut) + 1))[:-1]
            wl = np.clip(-g / (h + l2), lo, hi)
            wr = np.clip(-(g0 - g) / (h0 - h + l2), lo, hi)
            gain = -(2 * g * wl + (h + l2) * wl**2) - (2 * (g0 - g) * wr + (h0 - h + l2) * wr**2)
            gain = np.where((h < least) | (h0 - h < least) | (signs[j] * (wr - wl) < 0), -np.inf, gain)
            i = int(np.argmax(gain))
            w0 = np.clip(-g0 / (h0 + l2), lo, hi)
            if (won := gain[i] + 2 * g0 * w0 + (h0 + l2) * w0**2) > top[0]:
                top = (won, j, i)
        return top

    def build(rows, level, lo, hi) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, 0.0])
        _, j, i = best(rows, lo, hi) if level and len(rows) > 1 else (0, -1, -1)
        if j < 0:
            w = leaf(rows, lo, hi)
            nodes[at][4] = rate * w
            f[rows] += rate * w
            return at
        goes = coded[rows, j] <= i
        a, b = rows[goes], rows[~goes]
        mid = (leaf(a, lo, hi) + leaf(b, lo, hi)) / 2
        la, ha, lb, hb = lo, hi, lo, hi
        if signs[j] > 0:
            ha, lb = mid, mid
        elif signs[j] < 0:
            la, hb = mid, mid
        left = build(a, level - 1, la, ha)
        right = build(b, level - 1, lb, hb)
        nodes[at] = [j, cuts[j][i], left, right, 0.0]
        return at

    return build(np.arange(len(coded)), depth, -np.inf, np.inf)


def fit(docs: DataFrame, marks: DataFrame, sample: int = 20_000, **how) -> Forest:
    """Train on at most `sample` labelled documents, those with the smallest hash of their id; statistics are made on the executors.

    Only the statistics of the sample (a few dozen numbers a row) reach the driver. Null ids or labels are left out.
    """
    marks = marks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    chosen = marks.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = chosen.toPandas()
    spark = docs.sparkSession
    picked = spark.createDataFrame(ids, "doc_id long, quality int")

    def rows(it):
        for r in it:
            yield r["quality"], [float(v) for v in _measure(r["text"] or "")[1]]

    # broadcast: at most `sample` rows of 12 bytes
    got = map_rows(id_and_text(docs).join(F.broadcast(picked), "doc_id"), rows, struct("quality int, stats array<double>")).collect()
    x = np.array([r["stats"] for r in got]).reshape(-1, len(STATISTICS))
    y = np.array([r["quality"] for r in got], float)
    order = np.lexsort([*x.T, y]) if len(y) else slice(None)  # the same forest whatever order the rows came in
    return train(x[order], y[order], np.array([s for _, s in STATISTICS]), **how)


RULES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality_score double, kept boolean"


def quality_rules(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """Counts, score and verdict for each document; `kept` is false where the base rule fails or the score is below `least`.

    Null or empty text: all counts 0, base_failed, not kept. Repeated rows give repeated results; null ids stay; other columns are not read.
    """
    schema = struct(RULES)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for a in range(0, b.num_rows, 2048):
                part = texts.slice(a, 2048)
                both = [_measure(part[i].as_py() or "") for i in range(len(part))]
                base = [x for x, _ in both]
                failed = [base_fails(x[0], x[4]) for x in base]
                score = forest.score(np.array([s for _, s in both]).reshape(-1, len(STATISTICS)))
                kept = [not f and bool(s >= least) for f, s in zip(failed, score, strict=True)]
                cols = [ids.slice(a, 2048), *zip(*base, strict=True), failed, score, kept]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return id_and_text(docs).mapInArrow(run, schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules(docs, fit(docs, labels(spark, sf_dir)))
