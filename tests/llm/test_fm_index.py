"""The index against plain search."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadloom.llm.fm_index import FMIndex, suffix_array

runs = st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=30), min_size=1, max_size=5)


def flat(lists):
    return np.concatenate([np.array(x, np.uint64) for x in lists]), np.array([len(x) for x in lists])


@settings(max_examples=200, deadline=None)
@given(runs, runs, st.integers(1, 6))
def test_matches(sources, queries, least):
    words, lengths = flat(queries)
    got = FMIndex(*flat(sources)).matches(words, lengths, least)
    held = {tuple(s[i : i + least]) for s in sources for i in range(len(s) - least + 1)}
    expected = [len(q) - i >= least and tuple(q[i : i + least]) in held for q in queries for i in range(len(q))]
    assert got.tolist() == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_suffixes(text):
    assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
