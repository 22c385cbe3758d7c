"""Truncation against the longest prefix by the library's own counts."""

import pytest

from spanlake.llm import tokens
from tests.llm.test_tokens import PATH, counter, library, made_up  # noqa: F401

WORDS = [" unbelievableness", "it'll've", "a" + " " * 30 + "b", "  \n\n  x", "!<|endoftext|>!<|endoftext|>", " antidisestablishmentarianism" * 4, "z" * 90 + "é" * 40, "日本" * 20, " " * 90, "\t" * 9 + " a"]


def longest(text, budget):
    return max(n for n in range(len(text) + 1) if library(text[:n]) <= budget)


def test_fit_is_the_longest_prefix(counter):  # noqa: F811
    for text in WORDS + made_up(40, 8):
        ends, counts, _ = counter.table([text])
        so_far = counts.cumsum().tolist()
        plain = [library(text[:n]) for n in range(len(text) + 1)]
        for budget in range(0, plain[-1] + 2):
            want = max(n for n, c in enumerate(plain) if c <= budget)
            assert counter.fit(text, ends.tolist(), so_far, budget) == want, (text, budget)


@pytest.mark.parametrize("budget", [2, 3])
def test_counts_that_fall_inside_a_piece(spark, budget):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(WORDS)], "doc_id long, text string")
    for r in tokens.truncate(tokens.prefix_counts(docs, PATH), PATH, budget).collect():
        assert r.fits == longest(r.text, budget)
