"""Values in a credential context that are longer than a span of the guess-cost programme."""

from __future__ import annotations

import random
import string
import time

import pytest

from strataforge.llm import secrets


@pytest.mark.parametrize("n", [255, 256, 257, 300, 5000])
def test_whole_value(n):
    rng = random.Random(n)
    value = "".join(rng.choices(string.ascii_letters + string.digits, k=n))
    text = f"bearer: {value} and more"
    a = len("bearer: ")
    assert secrets.added_spans(text, []) == [(a, a + n, "guess")]
    assert secrets.masked(text) == "bearer: [secret] and more"


def test_long_and_cheap():
    # long repeats, runs and walks stay cheap and take time in proportion
    begun = time.monotonic()
    for value in ("a1" * 1_000, "A" + "a" * 2_000, "qw" * 1_000):
        assert secrets.guess_cost(value) < secrets.LEAST_COST + 3
    assert secrets.guess_cost("kX9#vq2LmZ" * 200) < secrets.guess_cost("kX9#vq2LmZ") + 5
    assert time.monotonic() - begun < 20
