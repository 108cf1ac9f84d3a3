import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import textops as T

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="ab Z9.,\n\tÉß漢-\x1c", max_size=40)), max_size=8)


def split(text, kind):
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    if kind is T.SPACED:
        return low.split()
    return [w for w in bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in low).split(b" ") if w]


@pytest.mark.parametrize("kind", [T.SPACED, T.ALNUM], ids=["spaced", "alnum"])
@given(texts=TEXT)
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_a_plain_split(kind, texts):
    hashes = {}
    for _, data, offsets in T.pieces(pa.array(texts, pa.string())):
        h, s, e, first = T.words(data, offsets, kind)
        for i in range(len(offsets) - 1):
            own = slice(first[i], first[i + 1])
            raw = data.tobytes()
            got = [bytes(b + 32 if 65 <= b <= 90 else b for b in raw[a:b]) for a, b in zip(s[own], e[own], strict=True)]
            for w, x in zip(got, h[own].tolist(), strict=True):
                assert hashes.setdefault(w, x) == x
            assert got == split(raw[offsets[i] : offsets[i + 1]].decode(), kind)
    assert len(set(hashes.values())) == len(hashes)


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + "x" * 5000 + " end"
    plain = T.words(*next(T.pieces(pa.array([text])))[1:], T.SPACED)
    monkeypatch.setattr(T, "SEGMENT", 512)
    cut = T.words(*next(T.pieces(pa.array([text])))[1:], T.SPACED)
    for a, b in zip(plain, cut, strict=True):
        assert np.array_equal(a, b)


def test_shingles_of_short_and_repeating_texts():
    got = []
    for _, data, offsets in T.pieces(pa.array(["", "a b", "a b c d e", "a a a a a a a a", None])):
        h, _, _, first = T.words(data, offsets, T.SPACED)
        got += [len(x) for x in T.shingles(h, first, 5)]
    assert got == [0, 1, 1, 1, 0]
