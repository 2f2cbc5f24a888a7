"""Words, hashes and winnowing against plain Python."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from inkstream.llm import textcore as tc

TEXT = st.text(st.sampled_from("aAbZ0 \n\t.é漢-_"), max_size=60)


@settings(max_examples=150)
@given(st.lists(TEXT, max_size=5))
def test_words(texts):
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    for kind, pattern in ((tc.ALNUM, tc.ALNUM_RE), (tc.SPACED, tc.SPACED_RE)):
        w = tc.Words(raw, offsets, kind, lower=True)
        seen = {}
        for d, t in enumerate(texts):
            expected = pattern.findall(tc.fold(t))
            own = slice(w.first[d], w.first[d + 1])
            assert [tc.fold(raw[a:b].tobytes().decode()) for a, b in zip(w.start[own], w.end[own], strict=True)] == expected
            for word, h in zip(expected, w.hash[own].tolist(), strict=True):
                assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(f"word{i}é" for i in range(500))
    one = tc.text_words(text).hash
    monkeypatch.setattr(tc, "_PIECE", 64)
    assert (tc.text_words(text).hash == one).all()


@given(st.lists(st.integers(0, 6), max_size=40), st.integers(1, 8))
def test_winnowing_keeps_a_hash_of_every_window(values, window):
    h = np.array(values, np.uint64)
    at = set(tc.winnow(h, window).tolist())
    for i in range(max(1, len(h) - window + 1) if len(h) else 0):
        part = values[i : i + window]
        assert i + len(part) - 1 - part[::-1].index(min(part)) in at


def test_grams_tell_sequences_apart():
    w = tc.text_words("a b c a b c d")
    g = tc.grams(w.hash, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4 and tc.gram(w.hash[:3]) == g[0]
    assert Counter(re.findall("a", "a b c a")) == {"a": 2}
