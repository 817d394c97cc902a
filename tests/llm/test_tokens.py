import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from deltagraph.llm import tokens
from tests.llm.conftest import plain_words

TEXTS = st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("aA b.é\n", max_size=40)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_expressions(texts):
    for kind, table in (("spaced", tokens.SPACED), ("alnum", tokens.ALNUM)):
        got = [[w.decode() for w in row] for row in tokens.word_lists(pa.array(texts, pa.string()), table)]
        assert got == [[w for w in plain_words(t, kind)] for t in texts]


def test_hashes_follow_words_across_pieces(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE", 16)
    texts = ["Alpha beta", None, "beta", "gamma alpha " * 5, "", "BETA"]
    seen = {}
    row = 0
    for w in tokens.words(pa.array(texts), tokens.SPACED):
        assert w.lo == row
        row = w.hi
        for i in range(w.hi - w.lo):
            for h, word in zip(w.hash[w.first[i] : w.first[i + 1]], plain_words(texts[w.lo + i], "spaced"), strict=True):
                assert seen.setdefault(word, h) == h
    assert row == len(texts) and len(set(map(int, seen.values()))) == len(seen) and seen["beta"] == tokens.hash_word("beta")


def test_sliced_arrays_and_long_words():
    arr = pa.array(["skip", "x" * 9000 + " y", "z"]).slice(1)
    (w,) = tokens.words(arr, tokens.SPACED)
    assert w.length.tolist() == [9000, 1, 1] and np.diff(w.first).tolist() == [2, 1]
