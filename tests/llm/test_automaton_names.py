from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm.automaton import WordTrie, distance
from rollbook.llm.names import generic, read_name, repair

WORDS = st.text(alphabet="abc", max_size=8)


def brute(a: str, b: str) -> int:
    """Optimal string alignment distance by the textbook table."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS, st.integers(0, 3))
def test_distance(a, b, limit):
    assert distance(a, b, limit) == min(brute(a, b), limit + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(WORDS, max_size=20), WORDS, st.integers(0, 3))
def test_trie_finds_all_words_within_distance(words, query, limit):
    got = dict(WordTrie(words).search(query, limit))
    assert got == {w: brute(w, query) for w in words if w and brute(w, query) <= limit}


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("The Univ. of Oldtown*", ("univ", "oldtown")),
        ("Law School, Uni of Oldtown", ("uni", "oldtown")),
        ("Oldtown, University of", ("oldtown", "university")),
        ("Stone &amp; Field Capital S.A.", ("stone", "field", "capital")),
        ("Harbour Institute – Brussels office", ("harbour", "institute")),
        ("Q90012", ()),
        ("", ()),
        (" -", ()),
        ("Uni KÃ¶ln (PhD)", ("uni", "koln")),
        ("Fdn. f. Eur. Policy", ("fdn", "eur", "policy")),
    ],
)
def test_read_name(text, words):
    assert read_name(text).words == words


def test_generic_words_with_errors():
    assert generic("univeristy") == "university"
    assert generic("econ") == "economics"
    assert generic("oldtown") is None
    assert repair("PrÃ¶rne") == "Prörne"
