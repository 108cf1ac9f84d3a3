"""Alignments against the libraries' tokens, joined by hand, and by windows and joins."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import alignment as A

PATHS = A.paths()
TEXTS = [
    None, "", " ", "a", "Hello, world!\n\nIt's  DON'T", "naïve façade — 漢字 кириллица 🙂👍🏽 é\t x", "with ▁ mark", "retitioning ouen the of, nterti " * 20, "\n", "\n\n x\n y ", "a \n b", "x\r\ny);\r\n",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "nb\xa0sp　wide\x85 \x1c", "x" * 300, " " * 90 + "z", "漢" * 200, "ab" * 3000, "123456 ½ ²", "\x00 \x00", "word " * 30_000,
]


class Library:
    def __init__(self):
        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.spell = {v: k for k, v in A.coder(PATHS[0], A.USUAL).ranks.items()}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, self.spell[i]) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, self.b.id_to_piece(i)) for i in self.b.encode(text))]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def groups(self, text):
        a, b = self.tokens(text)
        out, ia, ib, end_a, end_b = [], 0, 0, 0, 0
        while ia < len(a):
            ga, gb = [], []
            while not ga or end_a != end_b:
                if end_a <= end_b and ia < len(a):
                    ga.append(a[ia][0])
                    end_a += len(a[ia][1])
                    ia += 1
                else:
                    gb.append(b[ib][0])
                    end_b += len(b[ib][1])
                    ib += 1
            out.append((ga, gb))
        return out


@pytest.fixture(scope="module")
def library():
    return Library()


def brute(library, rows):
    groups = [library.groups(t) for _, t in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in groups]
    docs = Counter(p for c in links for p in c)
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (key, _), g, c in zip(rows, groups, links, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        best = sum(k for p, k in c.items() if docs[p] == most[p[0]])
        out.append((key, sum(len(x) for x, _ in g), sum(len(x) for _, x in g), len(g), sum(c.values()), best, sum(docs[p] * k for p, k in c.items()), sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


def test_tokens_and_groups_are_the_librarys(library):
    own = A.aligner(*PATHS)
    for some in ([t or "" for t in TEXTS], *[[t or ""] for t in TEXTS]):
        found = own([t.encode() for t in some])
        want = [library.groups(t) for t in some]
        assert found["n_groups"].tolist() == [len(g) for g in want]
        assert [g.decode() for g in found["groups"]] == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for g in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text() | st.text(alphabet="ab \n\r\t▁.'s;)漢"), min_size=1, max_size=4))
def test_any_texts(texts):
    global _LIBRARY
    _LIBRARY = globals().get("_LIBRARY") or Library()
    found = A.aligner(*PATHS)([t.encode() for t in texts])
    want = [_LIBRARY.groups(t) for t in texts]
    assert [g.decode() for g in found["groups"]] == [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for g in want]
    assert found["n_links"].tolist() == [sum(len(x) * len(y) for x, y in g) for g in want]


def test_query_rows(spark, make, library, tmp_path, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(library, rows)
    assert sorted((tuple(r) for r in A.op11_alignment(spark, str(tmp_path)).collect()), key=str) == want
    monkeypatch.setattr(A, "BROADCAST_PAIRS", 3)  # the shuffled way
    monkeypatch.setattr(A, "LAID_OUT", 2)
    assert sorted((tuple(r) for r in A.op11_alignment(spark, str(tmp_path)).collect()), key=str) == want


def test_given_documents_by_brute_force_and_by_relations(spark, library, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in A.op11_alignment(spark, sf).collect()), key=str) == brute(library, rows)
    some = rows[:40]
    tokens = [(k, side, i, t, len(b)) for k, text in some for side, found in zip("ab", library.tokens(text), strict=True) for i, (t, b) in enumerate(found)]
    got = A.by_relations(spark.createDataFrame(tokens, "doc long, side string, position int, id int, size int")).collect()
    want = {(k, a, b): n for k, text in some for (a, b), n in Counter((a, b) for ga, gb in library.groups(text) for a in ga for b in gb).items()}
    assert {(r.doc, r.a, r.b): r.times for r in got} == want


def test_empty_tables_long_groups_and_forgetting(spark, make, library, monkeypatch):
    rows = A.with_counts(A.aligned(make([]), *PATHS))
    assert rows.collect() == [] and rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    own = A.Aligner(*PATHS)
    own.b.known.most = 2
    for t in ["the cat sat", "on the mat.", "the cat, the mat"] * 2:
        assert own([t.encode()])["n_groups"].tolist() == [len(library.groups(t))]
    assert np.diff(A._ranges(np.array([5, 0]), np.array([3, 2]))).tolist() == [1, 1, -7, 1]
