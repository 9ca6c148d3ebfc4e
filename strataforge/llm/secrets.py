"""Secret scans: fixed patterns, and values in a credential context that would be hard to guess.

The cost of a value is the smallest number of guesses (log10) over all its segmentations into dictionary words, dates,
repeats, keyboard walks, runs of consecutive characters and brute-force spans, by dynamic programming over its positions.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.common import documents, id_and_text, map_rows, struct

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: A credential word, then a linking word or sign, then a value.
CONTEXT = re.compile(
    r"""(?ai)\b(?:pass\ ?(?:word|wd|phrase|code)|pwd|secret(?:\ key)?|token|api[\ _-]?key|credentials?|private[\ _-]?key|bearer|login\ pin)["'`]?
    \s{0,3}(?:[:=]>?|\bis\b|\bwas\b|->)\s{0,3}["'`]?([^\s"'`<>,;]{6,})""".replace("\n", "").replace("    ", ""),
)

#: Common words of chosen passwords and placeholders, by rank.
COMMON = (
    "password admin welcome letmein login master dragon monkey football baseball sunshine princess shadow michael "
    "superman batman trustno starwars freedom whatever secret test guest root user default changeme example sample dummy "
    "placeholder hello world love summer winter spring autumn monday friday january october company server system manager "
    "access token key pass word private public value string here your none null true false qwerty redacted hidden the and "
    "for with this that from house mouse green black white orange purple silver golden happy lucky charlie thomas jordan "
    "george andrew daniel robert jessica ashley hunter killer pepper ginger cookie cheese flower secure change"
).split()
#: Rows of a common keyboard.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@8301!5$7", "aabeoiisst")
DATE = re.compile(r"(?a)(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._](?:0?[1-9]|1[0-2])[-/._](?:\d{4}|\d\d)")
LEAST_COST = 8.0
#: Words that the corpus adds to the dictionary: so many at most, of letters, each in so many documents.
VOCABULARY, LEAST_TEXTS = 20_000, 5
LETTERS = re.compile(r"[^\W\d_]{3,}")
#: Walks, runs and repeats end at most so many characters after they start, or where they cannot go on.
LONGEST_PART = 256


def _neighbours() -> frozenset[tuple[str, str]]:
    """Pairs of keys that touch: in a row, and one row below at the same or the next place to the left."""
    out = set()
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            if i + 1 < len(row):
                out |= {(c, row[i + 1]), (row[i + 1], c)}
            if r + 1 < len(ROWS):
                for j in (i, i - 1):
                    if 0 <= j < len(ROWS[r + 1]):
                        out |= {(c, ROWS[r + 1][j]), (ROWS[r + 1][j], c)}
    return frozenset(out)


TOUCH = _neighbours()


def _class_size(s: str) -> int:
    return 10 * any(c.isdigit() for c in s) + 26 * any("a" <= c <= "z" for c in s) + 26 * any("A" <= c <= "Z" for c in s) + 33 * any(not c.isalnum() for c in s) + 100 * (not s.isascii()) or 1


class Guesser:
    """Guess costs under a dictionary of words, the likeliest first."""

    def __init__(self, words: Iterable[str] = COMMON) -> None:
        self.rank: dict[str, int] = {}
        for w in words:
            self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank), default=0)
        self.known: dict[str, float] = {}

    def cost(self, value: str) -> float:
        """log10 of the guesses that the cheapest segmentation of value needs; 0 for an empty value.

        Walks, runs and repeats are tried at every length up to LONGEST_PART and in full, so the number of spans stays linear in a value of any length.
        """
        if value not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            self.known[value] = self._cost(value)
        return self.known[value]

    def _cost(self, value: str) -> float:
        n = len(value)
        low = value.lower()
        plain = low.translate(LEET) if len(low) == n else low
        low = low if len(low) == n else value
        per_char = math.log10(_class_size(value))
        spans: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]

        def add(a: int, b: int, guesses: float) -> None:
            spans[b].append((a, math.log10(max(guesses, 1))))

        def ends(a: int, b: int) -> list[int]:
            return [*range(a + 3, min(b, a + LONGEST_PART) + 1), *([b] if b > a + LONGEST_PART else [])]

        # where the walk or run from each place ends
        walk, run = [*range(1, n + 1)], [*range(1, n + 1)]
        step = [ord(y) - ord(x) for x, y in zip(value, value[1:])]
        for a in range(n - 2, -1, -1):
            if (low[a], low[a + 1]) in TOUCH:
                walk[a] = walk[a + 1]
            if abs(step[a]) == 1:
                run[a] = run[a + 1] if a + 2 < n and step[a + 1] == step[a] else a + 2
        for a in range(n):
            for b in range(a + 3, min(n, a + self.longest) + 1):
                rank = self.rank.get(low[a:b]) or self.rank.get(plain[a:b])
                if rank:
                    add(a, b, rank * (1 if value[a:b] == low[a:b] else 2) * (1 if low[a:b] in self.rank else 2) * 2)
            if m := DATE.match(value, a):
                add(a, m.end(), 365 * 120 * (4 if re.search(r"[-/._]", m[0]) else 1))
            for e in ends(a, walk[a]):
                add(a, e, 47 * (e - a) * 2.3**2)
            for e in ends(a, run[a]):
                add(a, e, 26 * 2 * (e - a))
        for size, a, k in self._repeats(value):
            unit = self.cost(value[a : a + size]) if size > 1 else per_char
            few = min(k, max(2, LONGEST_PART // size))
            for times in {*range(2 + (size == 1), few + 1), k}:
                spans[a + times * size].append((a, unit + math.log10(times)))
        best = [0.0] * (n + 1)
        for b in range(1, n + 1):
            best[b] = best[b - 1] + per_char  # a brute-force character
            for a, cost in spans[b]:
                best[b] = min(best[b], best[a] + cost + 0.3)  # which pattern stands here is itself a guess
        return best[n]

    @staticmethod
    def _repeats(value: str) -> Iterator[tuple[int, int, int]]:
        """(size, start, times) of every unit of up to half the value, LONGEST_PART characters at most, that is repeated from its start on and no repeat of a shorter one."""
        codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
        covered = np.zeros(len(codes), np.int64)  # where the repeats of shorter units end
        for size in range(1, min(LONGEST_PART, len(codes) // 2) + 1):
            same = codes[:-size] == codes[size:]
            if not same.any():
                continue
            # how many characters from each place on equal those `size` later
            at = np.arange(len(same))
            stop = np.minimum.accumulate(np.where(same, len(same), at)[::-1])[::-1]
            length = stop - at
            new = (length >= size * (1 + (size == 1))) & (covered[: len(at)] < at + 2 * size)
            for a in np.flatnonzero(new).tolist():
                yield size, a, 1 + int(length[a]) // size
            covered[: len(at)] = np.maximum(covered[: len(at)], np.where(new, at + size + length, 0))


DEFAULT = Guesser()
guess_cost = DEFAULT.cost


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points, by start and then kind."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if re.search(r"[:=]", text) else []
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def added_spans(text: str, base: list[tuple[int, int, str]], least: float = LEAST_COST, guesser: Guesser = DEFAULT) -> list[tuple[int, int, str]]:
    """Values in a credential context whose guess cost is `least` or more and that no base span covers."""
    out = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        value = m[1].rstrip(".!?:)]}")
        b = a + len(value)
        if len(value) >= 6 and not any(s <= a and b <= e for s, e, _ in base) and guesser.cost(value) >= least:
            out.append((a, b, "guess"))
    return out


def find_secrets(text: str, least: float = LEAST_COST, guesser: Guesser = DEFAULT) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then kind."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, least, guesser), key=lambda s: (s[0], KINDS.index(s[2])))


def corpus_guesser(docs: DataFrame, size: int = VOCABULARY, least: int = LEAST_TEXTS) -> Guesser:
    """A guesser that knows the common words and the `size` words that most documents hold outside of credential contexts, `least` documents or more.

    Ordinary words that follow "password is" are cheap to guess that way. Counted over all documents; at most `size` words reach the driver.
    """

    def rows(it):
        total: Counter = Counter()
        for r in it:
            total.update(set(LETTERS.findall(CONTEXT.sub(" ", r["text"] or "").lower())))
            if len(total) > 1 << 18:
                yield from total.items()
                total.clear()
        yield from total.items()

    counts = map_rows(id_and_text(docs).select("text"), rows, struct("word string, n long")).groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(size).collect()
    return Guesser([*COMMON, *(r["word"] for r in found)])


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long,cost:double>>"
DIGESTS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"


def secret_spans(docs: DataFrame, least: float = LEAST_COST) -> DataFrame:
    """The spans of each document with their kinds and guess costs.

    Null or empty text: no spans; values of any length are taken whole. Repeated rows give repeated results; null ids stay; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(corpus_guesser(docs))  # VOCABULARY words at most

    def rows(it):
        for r in it:
            text = r["text"] or ""
            yield r["doc_id"], [{"kind": k, "start": a, "end": b, "cost": sent.value.cost(text[a:b])} for a, b, k in find_secrets(text, least, sent.value)[1]]

    return map_rows(id_and_text(docs), rows, struct(SPANS))


def secret_digests(docs: DataFrame, least: float = LEAST_COST) -> DataFrame:
    """Counts by kind, a hash of the base spans and all spans as text, one row a document."""
    sent = docs.sparkSession.sparkContext.broadcast(corpus_guesser(docs))

    def rows(it):
        for r in it:
            base, both = find_secrets(r["text"] or "", least, sent.value)
            kinds = [k for *_, k in both]
            yield r["doc_id"], *(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(both), kinds.count("guess")

    return map_rows(id_and_text(docs), rows, struct(DIGESTS))


def masked(text: str, mark: str = "[secret]", least: float = LEAST_COST, guesser: Guesser = DEFAULT) -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at = [], 0
    spans = [(a, b) for a, b, _ in find_secrets(text, least, guesser)[1]]
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, least: float = LEAST_COST) -> DataFrame:
    """docs with secrets masked in `text`; n_chars follows where there is such a column.

    Every row stays, repeated ones and those with null ids too; null text stays null and empty text empty; texts and values of any length are masked whole; other columns, of whatever
    names and types, stay as they are; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(corpus_guesser(docs))

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: t if t is None else masked(t, least=least, guesser=sent.value))

    out = docs.withColumn("text", mask(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(documents(spark, sf_dir))
