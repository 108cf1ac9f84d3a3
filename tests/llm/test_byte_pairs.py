"""Ids and texts against the library that defines them."""

import base64
from hashlib import sha256

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import byte_pairs as B

PATH, SPLIT = B.ranks_path(), B.pattern()
TEXTS = [
    None, "", " ", "\n\n  \t x", "It's DON'T we'll  they've\r\n", "naïve façade — 漢字 кириллица עברית 🙂👍🏽 é", "12 345 ½ ² Ⅷ ٣", "a▁b <|endoftext|> \x00\x1c\x85​　.",
    "x" * 5000, "ab" * 40 + " " + "zq" * 700, " " * 3000 + "end", "word " * 50_000, "retitioning ouen the of, nterti " * 100, "é" * 333, "!?" * 600,
]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return coded(B.coder(PATH, SPLIT), [text])[0]


def coded(own, texts):
    """Ids of each text, coded in one go."""
    raw = [t.encode() for t in texts]
    ids, n = own(b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_ids_are_the_librarys(library):
    assert SPLIT == B.USUAL
    assert coded(B.coder(PATH, SPLIT), [t or "" for t in TEXTS]) == [library.encode_ordinary(t or "") for t in TEXTS]
    for t in TEXTS:
        assert ids_of(t or "") == library.encode_ordinary(t or "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text() | st.text(alphabet="ab c'srevlmdt\n .1"), min_size=1, max_size=4))
def test_any_texts(texts):
    ranks = B.read_ranks(PATH)
    global _LIBRARY
    _LIBRARY = globals().get("_LIBRARY") or tiktoken.Encoding("any", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    want = [_LIBRARY.encode_ordinary(t) for t in texts]
    assert coded(B.coder(PATH, SPLIT), texts) == want
    assert [b"".join(B.coder(PATH, SPLIT).decoded(np.array(ids, np.int32))) for ids in want] == [t.encode() for t in texts]
    raw = [t.encode() for t in texts]  # as the pattern splits them
    ends, before = B.coder(PATH, SPLIT).ends(b"".join(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    sizes = [len(m.encode()) for t in texts for m in B.coder(PATH, SPLIT).split.findall(t)]
    assert np.diff(ends, prepend=0).tolist() == sizes and before[-1] == len(sizes)


def test_every_token_is_found_whole_by_the_hash():
    own = B.coder(PATH, SPLIT)
    tokens = [own.bytes_of[i] for i in own.ids.tolist()]
    raw = b"".join(tokens)
    ids, n = own.counted(raw, np.frombuffer(raw + bytes(8), np.uint8), np.cumsum([len(t) for t in tokens]))
    assert ids.tolist() == own.ids.tolist() and (n == 1).all()
    assert sorted(own._slot(own._hashes(B._spelled(np.frombuffer(raw + bytes(8), np.uint8), np.cumsum([len(t) for t in tokens]) - [len(t) for t in tokens], np.array([len(t) for t in tokens])), np.array([len(t) for t in tokens]))).tolist()) == list(range(len(tokens)))


def test_the_heap_merges_as_the_scan_does(library):
    ranks = B.read_ranks(PATH)
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 400):
        for letters in (2, 5, 256):
            word = rng.integers(0, letters, n).astype(np.uint8).tobytes() if letters == 256 else bytes(rng.choice(list(b"aeinst"[:letters]), n).tolist())
            parts = [word[i : i + 1] for i in range(n)]
            while True:
                pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
                if not pairs:
                    break
                i = min(pairs)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert B.merged(word, ranks) == [ranks[p] for p in parts]


def test_stretches_and_forgetting_change_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "STRETCH", 40)
    own = B.Coder(B.read_ranks(PATH), SPLIT)
    own.known.most = 3
    for t in TEXTS * 2:
        assert coded(own, [t or ""])[0] == library.encode_ordinary(t or "")


def test_another_pattern():
    split = r"\p{L}+|[^\p{L}]"
    own = B.Coder(B.read_ranks(PATH), split)
    library = tiktoken.Encoding("other", pat_str=split, mergeable_ranks=own.ranks, special_tokens={})
    assert coded(own, [t or "" for t in TEXTS]) == [library.encode_ordinary(t or "") for t in TEXTS]


def test_query_rows(spark, make, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in B.op12_byte_pairs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty_tables_and_names_that_clash(spark, make):
    from pyspark.sql import functions as F

    assert B.encoded(make([]), PATH, SPLIT).collect() == []
    docs = make([(1, "a b")]).withColumn("ids", F.lit("x")).withColumn("bytes", F.lit(7))
    out = B.decoded(B.encoded(docs, PATH, SPLIT), PATH, SPLIT)
    assert sorted(out.columns) == sorted(["doc_id", "lang", "source", "n_chars", "score", "ids", "bytes"])
    assert bytes(out.head()["bytes"]) == b"a b"
