import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from civiclake.llm.words import Words, pieces

TEXT = st.one_of(st.none(), st.text(alphabet="ab éß字\n\t\x0b.,😀", max_size=40))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8), st.integers(1, 4))
def test_words_and_windows_as_a_pattern_finds_them(texts, size):
    w = Words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = [[w.text(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == want
    names = [x for d in want for x in d]
    assert len(set(names)) == len(set(w.hash.tolist())) and len({(a, b) for a, b in zip(names, w.hash.tolist())}) == len(set(names))
    start, h = w.windows(size)
    windows = [tuple(d[i:i + size]) for d in want for i in range(len(d) - size + 1)]
    assert len(windows) == len(h) and len({*zip(windows, h.tolist())}) == len(set(windows))


def test_a_hash_does_not_depend_on_the_place():
    a, b = Words(pa.array(["x yy", "yy"])), Words(pa.array(["long text before yy"] * 3))
    assert a.hash[1] == a.hash[2] == b.hash[3] == b.hash[-1]
    assert len(Words(pa.array([], pa.string()))) == 0


def test_pieces_cover_all_rows():
    column = pa.array(["a" * 10, None, "b" * 50, "", "c"])
    for target in (1, 12, 1000):
        spans = list(pieces(column, target))
        assert [i for a, b in spans for i in range(a, b)] == list(range(5))
    assert np.all([b > a for a, b in pieces(column, 1)])
