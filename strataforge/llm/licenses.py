"""License scans: exact set-similarity join of text lines with license notices, with DataFrame functions only.

The templates are a fixed list, so the join's small side is known beforehand and stands in the plan itself: a line meets it where it is read and nothing
is shuffled. Their tokens are ordered by how often the whole corpus holds them, rarest first. A line whose token set holds at least
`threshold` of a template's tokens must hold one of the template's first (rarest) tokens (prefix filter), must have enough
template tokens at all (length filter), and must have enough of them from the first shared token on (position filter); what is left is
counted exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.common import documents, id_and_text

#: Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License notices by identifier.
TEMPLATES = {
    "AGPL-3.0": "this program is licensed under the gnu affero general public license version 3",
    "Apache-2.0": "licensed under the apache license version 2 0",
    "BSD-3-Clause": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "CC-BY-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "CC-BY-NC-4.0": "licensed under cc by nc 4 0",
    "GPL-2.0": "this work is licensed under the gnu general public license version 2",
    "GPL-3.0": "this work is licensed under the gnu general public license version 3",
    "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "MIT-notice": "released under the mit license",
    "MPL-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
}
THRESHOLD = 0.95

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, and what words are made of, before A-Z are lower-cased; (?i) has ASCII letters in mind only.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _any_of(words: list[str]) -> str:
    """A pattern for any of these words (or phrases of words) standing as whole words."""
    return rf"(?i)(?<!{LETTER})(?>{'|'.join((GAP + '++').join(w.split()) for w in sorted(words, key=len, reverse=True))})(?!{LETTER})"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTER + "++"), 0)


def token_order(docs: DataFrame, templates: dict[str, str]) -> list[str]:
    """All template tokens, those that stand least often in the texts first; equal counts by code point.

    One count a template token reaches the driver; the tokens are summed by executor before the shuffle.
    """
    tokens = sorted({w for t in templates.values() for w in t.split()})
    found = docs.select(F.explode(F.regexp_extract_all("text", F.lit(_any_of(tokens)), 0)).alias("token")).select(F.translate("token", UPPER, LOWER).alias("token"))
    count = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(tokens, key=lambda t: (count.get(t, 0), t))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def prefix_of(tokens: list[str], threshold: float) -> list[str]:
    """The tokens of which a set with `threshold` of all of them must hold one: all but the last ceil(threshold n) - 1."""
    return tokens[: len(tokens) - math.ceil(threshold * len(tokens) - 1e-9) + 1]


def _containment(held: Column, tokens: list[str], threshold: float) -> Column:
    """Share of tokens in held (both rarest first) where it is at least threshold, else null."""
    n, least = len(tokens), math.ceil(threshold * len(tokens) - 1e-9)
    head = _strings(prefix_of(tokens, threshold))
    shared = F.get(F.array_intersect(head, held), F.lit(0))
    room = 1 + F.least(n - F.array_position(_strings(tokens), shared), F.size(held) - F.array_position(held, shared))
    found = F.size(F.array_intersect(held, _strings(tokens)))
    return F.when((F.size(held) >= least) & F.arrays_overlap(held, head), F.when(room >= least, F.when(found >= least, found / F.lit(float(n)))))


def _starts(phrase: list[str]):
    """For F.transform over column `words`: the place of a word that begins the phrase, else null."""

    def at(word: Column, i: Column) -> Column:
        here = word == phrase[0]
        for d, x in enumerate(phrase[1:], 1):
            here = here & (F.coalesce(F.get(F.col("words"), i + d), F.lit("")) == x)
        return F.when(here, i.cast("long"))

    return at


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    blocks: (line number from 0, label, containment) of every line that meets a template. score: 1 where a base phrase stands, else the
    largest containment found, else 0. Null or empty text: counts and score 0, no labels, null word places. Repeated rows give
    repeated results; null ids stay; other columns are not read.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    docs = id_and_text(docs).withColumn("text", F.coalesce("text", F.lit("")))
    order = token_order(docs, templates)
    by_rarity = {k: sorted(set(t.split()), key=order.index) for k, t in templates.items()}
    heads = sorted({w for t in by_rarity.values() for w in prefix_of(t, threshold)})
    head_pattern = _any_of(heads)

    counted = docs.withColumn("n_words", F.regexp_count("text", F.lit(LETTER + "++")).cast("long"))

    # base phrases: whole texts are cut into words only where a phrase stands
    words = F.when(F.col("text").rlike(_any_of(list(phrases))), words_of(F.col("text")))
    places = {}
    with_words = counted.withColumn("words", words)
    for k, phrase in enumerate(phrases):
        places[phrase] = f"at_{k}"
        at = F.filter(F.transform("words", _starts(phrase.split())), lambda x: x.isNotNull())
        with_words = with_words.withColumn(places[phrase], F.coalesce(at, F.array().cast("array<bigint>")))
    found = with_words.drop("words").withColumn("at", F.concat(*places.values()))

    # lines against templates: texts without any prefix token are passed over whole, then lines; a line's template tokens are found once
    held = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.cast("long").alias("line"), F.when(x.rlike(head_pattern), F.array_intersect(_strings(order), words_of(x))).alias("held")))
    found = found.withColumn("lines", F.when(F.col("text").rlike(head_pattern), F.filter(held, lambda b: b["held"].isNotNull())))

    def meets(b: Column) -> Column:
        each = (F.struct(b["line"].alias("line"), F.lit(k).alias("label"), _containment(b["held"], t, threshold).alias("containment")) for k, t in by_rarity.items())
        return F.filter(F.array(*each), lambda m: m["containment"].isNotNull())

    none = F.array().cast("array<struct<line:bigint,label:string,containment:double>>")
    found = found.withColumn("blocks", F.coalesce(F.flatten(F.transform("lines", meets)), none))

    base = F.filter(F.array(*(F.when(F.size(places[p]) > 0, F.lit(label)) for p, label in phrases.items())), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_distinct(F.concat(base, F.col("blocks.label"))))
    score = F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("blocks.containment"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").alias("first_word"), F.array_max("at").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "blocks",
    )


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir)).withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks")


def _oracle(templates: dict[str, str], phrases: dict[str, str], threshold: float) -> str:
    """The same result in SQL: every line against every template, without filters."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    text = lambda s: "'" + s + "'"
    at = []
    for p in phrases:
        rest = " AND ".join(f"words[i + {d}] = {text(x)}" if d else f"words[i] = {text(x)}" for d, x in enumerate(p.split()))
        at.append(f"list_filter(range(1, len(words) + 1), lambda i: {rest})")
    base = ", ".join(f"CASE WHEN len(starts[{k}]) > 0 THEN {text(label)} END" for k, label in enumerate(phrases.values(), 1))
    shares = []
    for label, t in templates.items():
        own = sorted(set(t.split()))
        shares.append(f"struct_pack(label := {text(label)}, share := len(list_intersect(l, [{', '.join(map(text, own))}])) / {len(own)}.0::DOUBLE)")
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS words, list_transform(string_split(text, chr(10)), lambda l: list_distinct(regexp_extract_all(l, '{word}'))) AS lines FROM d),
p AS (SELECT doc_id, words, [{", ".join(at)}] AS starts, list_filter(flatten(list_transform(lines, lambda l: [{", ".join(shares)}])), lambda b: b.share >= {threshold}) AS blocks FROM w),
q AS (SELECT *, flatten(starts) AS places, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM p)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
       array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, list_transform(blocks, lambda b: b.label)))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform(blocks, lambda b: b.share)), 0.0::DOUBLE) END AS score, CAST(len(blocks) AS BIGINT) AS n_blocks
FROM q
"""


ORACLE = _oracle(TEMPLATES, PHRASES, THRESHOLD)
