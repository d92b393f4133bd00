"""Greedy string tiling against the plain definition, and on texts that repeat themselves."""

import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlint.llm import decontaminate as D


def plain(pattern, text, least):
    """Longest common run of unmarked tokens, first in the pattern, then in the text; mark; again."""
    least, tiles = min(least, len(pattern)), []
    p_free, t_free = [True] * len(pattern), [True] * len(text)
    while least:
        best = (0, 0, 0)
        for a in range(len(pattern)):
            for b in range(len(text)):
                n = 0
                while (a + n < len(pattern) and b + n < len(text) and p_free[a + n] and t_free[b + n] and pattern[a + n] == text[b + n]):
                    n += 1
                if n > best[2]:
                    best = (a, b, n)
        a, b, n = best
        if n < least:
            break
        tiles.append(best)
        p_free[a:a + n], t_free[b:b + n] = [False] * n, [False] * n
    return tiles


def codes(xs):
    return D.tokens(pa.array([" ".join(f"w{x}" for x in xs)]))[0]


@settings(max_examples=250, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=24), st.lists(st.integers(0, 2), max_size=40), st.integers(1, 6))
def test_tiles_equal_the_definition(a, b, least):
    assert D.tile(codes(a), codes(b), least) == plain(a, b, least)


@pytest.mark.parametrize("seed", range(6))
def test_reordered_passages_equal_the_definition(seed):
    rng = np.random.default_rng(seed)
    item = rng.integers(0, 12, 60).tolist()
    text = rng.integers(0, 12, 20).tolist() + item[40:] + rng.integers(0, 12, 5).tolist() + item[:25] + item[10:40]
    assert D.tile(codes(item), codes(text), 5) == plain(item, text, 5)


@pytest.mark.parametrize("period,n_item,n_text", [(1, 2_000, 40_000), (2, 2_000, 40_000), (7, 5_000, 40_000), (1, 20_000, 20_000)])
def test_repeating_texts_take_a_moment(period, n_item, n_text):
    item, text = (codes([i % period for i in range(n)]) for n in (n_item, n_text))
    start = time.process_time()
    tiles = D.tile(item, text, 5)
    assert time.process_time() - start < 5 and tiles == [(0, 0, n_item)]


def test_repeating_texts_with_breaks():
    """Runs of one word with a break every 50 words: a pair for each run and place."""
    item, text = (codes([0] * n) for n in (400, 8_000))
    text[np.arange(0, 8_000, 50)] = np.uint64(1)
    start = time.process_time()
    tiles = D.tile(item, text, 5)
    assert time.process_time() - start < 10
    assert [t[2] for t in tiles] == [49] * 8 + [8]
