"""Best-fit packing by sum of squares.

Documents are tokenised where they are read; only the lengths of their pieces travel. Pieces are dealt into groups of a
bounded size, and each group is packed by the sum-of-squares rule: of all places a piece can go to, it takes the one after which
the sum over residual gaps of the squared number of open sequences with that gap is smallest. Sequences that a group leaves
poorly filled are dealt out once more, so what is wasted at the end of a group does not grow with the number of groups.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.common import documents, id_and_text, map_rows, stored, struct

SEQUENCE = 2048
SEPARATOR = 0
GROUP_PIECES = 8192
#: Sequences below this share of SEQUENCE are opened again in the second round.
POOR = 0.995
#: Words whose ids a worker keeps, about 100 MB of them.
MOST_WORDS = 500_000
TOKENIZER_FILE = "word_bpe_49k.json"

#: Letters below this are told the same by every Unicode version.
LAST_PLAIN = "\u0250"
#: Byte-level models spell each byte as a letter: visible ones as themselves, the others as the letters from 256 on, in order.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Words(dict):
    """Ids of words by their bytes, as little-endian 32-bit numbers; the first MOST_WORDS words met are kept.

    The tokenizer never joins across white space, lower-cases letter by letter, and ends a token between a letter and the mark after it. So words can be
    encoded one by one, in lower case, and without their full stop or comma.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if word[-1:] in (b".", b",") and b"a" <= word[-2:-1] <= b"z":
            return self[word[:-1]] + self[word[-1:]]
        ids = np.array(self._encode(word), "<u4").tobytes()
        if len(self) < MOST_WORDS:
            self[word] = ids
        return ids

    def _encode(self, word: bytes) -> list[int]:
        text = word.decode()
        if text.isalpha() and max(text) < LAST_PLAIN and text == text.lower() and unicodedata.is_normalized("NFC", text):
            # a run of letters is one piece for the model, and normalising leaves it as it is
            return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_LETTERS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=4)
def _words(path: str) -> _Words:
    return _Words(path)


def token_ids(text: str, path: str) -> bytes:
    """The ids of a text with the separator at the end, as little-endian unsigned 32-bit numbers."""
    if "<|" in text:  # may hold the name of a special token, which is found before anything else
        ids = _tokenizer(path).encode(text, add_special_tokens=False).ids
        return np.array([*ids, SEPARATOR], "<u4").tobytes()
    words = _words(path)
    return b"".join(map(words.__getitem__, text.encode().lower().split())) + SEPARATOR.to_bytes(4, "little")


def pieces_of(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: only longer ones are cut."""
    return [(a, min(size, n - a)) for a in range(0, n, size)]


def token_pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document with a checksum of their ids (and the ids themselves if asked for).

    Null or empty text: one piece that is the separator alone. Repeated rows give repeated pieces; other columns are not read.
    """
    path = path or tokenizer_path()

    def rows(it):
        deal = 0
        for r in it:
            ids = token_ids(r["text"] or "", path)
            for k, (a, n) in enumerate(pieces_of(len(ids) // 4, size)):
                deal += 1
                part = ids[4 * a : 4 * (a + n)]
                yield (r["doc_id"], k, a, n, zlib.crc32(part), deal, *([np.frombuffer(part, "<u4").tolist()] if keep_ids else []))

    return map_rows(id_and_text(docs), rows, struct(PIECES + ", ids array<long>" * keep_ids))


def sum_of_squares(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the order given.

    Going from gap g to gap g - n changes the sum of squares by 2 (N[g - n] - N[g]) + 2, and by 1 - 2 N[g] where the piece fills the
    sequence; opening one changes it by 2 N[size - n] + 1. Of equal changes the smallest gap is taken, and an open sequence before a new one.
    """
    count = np.zeros(size + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened = 0
    for i, n in enumerate(lengths.tolist()):
        change = None
        if n < size:
            here = count[n:size]
            step = 2 * (count[: size - n] - here) + 2
            step[0] = 1 - 2 * here[0]
            step[here == 0] = np.iinfo(np.int64).max
            g = int(step.argmin())
            change = step[g] if here[g] else None
        new = 2 * count[size - n] + 1 if n < size else 0
        if change is not None and change <= new:
            g += n
            b = stacks[g].pop()
            count[g] -= 1
        else:
            g, b = size, opened
            opened += 1
        where[i], offset[i] = b, size - g
        if g > n:
            stacks[g - n].append(b)
            count[g - n] += 1
    return where, offset


def pack(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """sum_of_squares() over the lengths from long to short; ties keep their order."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    where[order], offset[order] = sum_of_squares(lengths[order], size)
    return where, offset


def _packed(groups: DataFrame, size: int, base: int) -> DataFrame:
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32", "deal"], kind="stable", ignore_index=True)
        where, offset = pack(pdf["length"].to_numpy(), size)
        full = np.bincount(where, weights=pdf["length"].to_numpy()) if len(where) else np.zeros(0)
        return pdf.drop(columns="dealt_to").assign(sequence_id=(base + int(key[0])) * 2**24 + where, offset=offset, filled=full[where].astype(np.int64))

    return groups.groupBy("dealt_to").applyInPandas(one, struct(PIECES + ", sequence_id long, offset long, filled long"))


def _dealt(pieces: DataFrame, n: int, group: int, seed: int) -> tuple[DataFrame, int]:
    groups = max(1, -(-n // group))
    return pieces.withColumn("dealt_to", F.pmod(F.xxhash64("doc_id", "piece", "start", "deal", F.lit(seed)), F.lit(groups))), groups


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, group: int = GROUP_PIECES, poor: float = POOR) -> DataFrame:
    """Each piece of token_pieces() with its sequence and its place there.

    Pieces are dealt by a hash that also holds a running number, so repeated rows spread like any others. Pieces of full length are sequences of their own and
    are never dealt.
    """
    cols = [c.split()[0] for c in PIECES.split(", ")]
    table = stored(pieces.select(*cols), "pieces")
    short = table.filter(F.col("length") < size)
    groups, n = _dealt(short, short.count(), group, 1)
    first = stored(_packed(groups, size, 0), "packed")
    good = F.col("filled") >= poor * size
    again = first.filter(~good)
    left, m = _dealt(again.select(*cols), again.count(), group, 2)
    second = _packed(left, size, n)
    base = (n + m) * 2**24
    whole = table.filter(F.col("length") == size).select(*cols, (F.monotonically_increasing_id() + base).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = [c.split()[0] for c in PLACED.split(", ")]
    return first.filter(good).select(*out).unionByName(second.select(*out)).unionByName(whole.select(*out))


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. An empty table gives no rows."""
    return pack_pieces(token_pieces(docs, path, size), size)


def sequences(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. A sequence has at most `size` ids, so a group here is bounded."""
    full = stored(token_pieces(docs, path, size, keep_ids=True), "pieces-ids")
    placed = pack_pieces(full.drop("ids"), size).dropDuplicates(["sequence_id", "offset"])
    # repeated rows have equal ids, so one row of each (id, piece, checksum) is enough
    ids = full.select(F.col("doc_id").alias("of"), "piece", "start", "ids_crc32", "ids").dropDuplicates(["of", "piece", "start", "ids_crc32"])
    both = placed.join(ids, placed["doc_id"].eqNullSafe(ids["of"]) & (placed["piece"] == ids["piece"]) & (placed["start"] == ids["start"]) & (placed["ids_crc32"] == ids["ids_crc32"]))
    ordered = both.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.flatten("parts.ids").alias("ids"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
