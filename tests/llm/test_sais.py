import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import sais


def check(text: bytes):
    s = np.concatenate([np.frombuffer(text, np.uint8).astype(np.uint16) + 1, [0]]).astype(np.uint16)
    sa = sais.suffix_array(s)
    want = sorted(range(len(s)), key=lambda i: (text + b"")[i:] if i < len(text) else b"")
    assert sa.tolist() == want
    lcp = sais.permuted_lcp(s, sa)
    for a, b in zip(want, want[1:], strict=False):
        k = 0
        while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        assert lcp[b] == k


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300) | st.text("ab", max_size=300).map(str.encode) | st.text("abc", max_size=12).map(lambda x: x.encode() * 20))
def test_against_sorting(text):
    check(text)


@pytest.mark.parametrize("induce", ["_induce_buckets", "_induce_each"])
def test_both_inductions(monkeypatch, induce):
    other = getattr(sais, induce)
    monkeypatch.setattr(sais, "_induce_buckets", other)
    monkeypatch.setattr(sais, "_induce_each", other)
    rng = np.random.default_rng(0)
    for k in (1, 2, 5, 200):
        for n in (1, 2, 3, 50, 700):
            check(bytes(rng.integers(0, k, n).astype(np.uint8)))
    check(b"the cat sat on the mat " * 30)
    check(b"mississippi" * 10)
