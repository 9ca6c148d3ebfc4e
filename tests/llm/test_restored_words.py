"""Words read token by token against the same rules applied to the whole text."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from strataforge.llm import toxicity as T


def _by_whole_text(text: str) -> tuple[Counter, Counter]:
    words = Counter(T.LETTERS.findall(text.lower()))
    words.update(re.sub(r"[\W_]", "", m) for m in T.BROKEN.findall(text.lower()))
    triples = T.drawn_out(text)
    hidden: Counter = Counter()
    for token in text.split():
        hidden.update((p, p) for p in T.suspicious(token, triples) if len(p) >= 3)
    hidden.update((re.sub(r"[ .\-_*~]", "", m[0]), m[0]) for m in T.APART.finditer(text))
    return words, hidden


def test_tokens_one_by_one_tell_what_the_whole_text_tells():
    r = random.Random(5)
    letters = "aabbsk$3!10@*. .-_~\n\tΣσ·(),é;AK²"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(20000)]
    texts += ["", " ", "i d i o t", "x i-d-i.o.t.", "a" * 5000, "s t " * 3000, "w.o.r.d", "soooo  b4d!!!", "1.2.3.4", "\x00\x1f\x85  a b c d"]
    for text in texts:
        words, hidden = T.read(text)
        got: Counter = Counter()
        for token, shown, n in hidden:
            got[token, shown] += n
        assert (Counter(words), got) == _by_whole_text(text), repr(text)


def test_restored_words_replace_their_pieces_and_long_tokens_stay_whole():
    flat = np.zeros((T.A, T.A, T.A), np.float32)
    assert T.words_in("k3k", flat) == {"kek": 1}
    assert T.words_in("plain words, plain", flat) == {"plain": 2, "words": 1}
    assert sum(T.words_in("b4d" * 4000, flat).values()) == 1
