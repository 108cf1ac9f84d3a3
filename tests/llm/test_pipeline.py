"""Each stage against brute force on what it is given, and odd rows through all of them."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as C
from starloom.llm import mixing, token_index
from starloom.llm.common import read, written


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = read(spark, sf, "documents")
    out = [docs]
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, sf), name.replace(" ", "-").replace("/", ""))
        out.append(docs)
    return [x.collect() for x in out]


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_all_but_the_last_return_documents(stages):
    for rows in stages[:5]:
        assert rows and set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert set(after) <= set(before)


def test_quality_stage_keeps_good_and_rejects_bad(spark, sf, stages):
    label = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in stages[1]}
    assert all((i in kept) == (q == 1) for i, q in label.items())


def test_one_of_each_group_stays(stages):
    s = {r.doc_id: shingles(r.text) for r in stages[1]}
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(s)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            n = len(s[i] & s[j])
            if n and 100 * n >= 75 * len(s[i] | s[j]):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    assert {r.doc_id for r in stages[2]} == {i for i in ids if top(i) == i}
    assert len(stages[2]) < len(stages[1])


def test_documents_with_benchmark_windows_go(spark, sf, stages):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = set()
    for r in read(spark, sf, "benchmark").collect():
        w = split(r.text)
        n = min(10, len(w))
        grams |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    sizes = {len(g) for g in grams}
    bad = {r.doc_id for r in stages[2] for w in [split(r.text)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams}
    assert {r.doc_id for r in stages[3]} == {r.doc_id for r in stages[2]} - bad


def test_the_mix_takes_documents_as_often_as_it_says(spark, stages):
    docs = spark.createDataFrame(stages[3])
    want = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 1 for r in mixing.mix(docs).collect()}
    assert Counter(r.doc_id for r in stages[4]) == Counter({i: n for i, n in want.items() if n})


def test_the_store_has_every_document_in_order(stages):
    t = Tokenizer.from_file(token_index.tokenizer_path())
    at, want = 0, []
    for r in sorted(stages[4], key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in stages[5]) == want


def test_texts_that_share_an_id_are_judged_apart(spark, sf, make):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    text = {n: " ".join(f"{n}{w}" for w in words) for n in "ABC"}
    near = text["B"] + " more"
    stage = lambda rows: sorted((r.doc_id, r.text) for r in C.one_of_each(spark, make(rows), sf).collect())
    assert stage([(1, text["A"]), (2, text["A"]), (2, text["B"]), (3, text["C"])]) == [(1, text["A"]), (2, text["B"]), (3, text["C"])]
    assert stage([(2, near), (1, text["A"]), (2, text["B"]), (2, text["B"])]) in ([(1, text["A"]), (2, text["B"])], [(1, text["A"]), (2, near)])
    assert stage([(5, text["A"]), (4, text["A"]), (4, text["C"]), (4, text["C"])]) == [(4, text["A"]), (4, text["C"])]
    docs = make([(1, "one two three", "en", "s"), (1, "four", "en", "s"), (None, "five six", "en", "s"), (1, "", "en", "t"), (7, "x " * 50, "en", "t")])
    got = Counter((r.doc_id, r.text) for r in C.mixed(spark, docs, sf).collect())
    assert set(got) <= {(r.doc_id, r.text) for r in docs.collect()} and got[1, ""] == 1
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    taken = mixing.mix(rows.drop("doc_id").withColumnRenamed("row", "doc_id")).collect()
    assert sum(got.values()) == sum(int(r.taken / r.size + 0.5) if r.size else 1 for r in taken)


def test_odd_rows_go_through_every_stage(spark, sf, make):
    text = "The first of the words that are here and the last of them."
    docs = make([(1, text), (1, text), (2, None), (3, ""), (None, text), (None, None), (4, "x" * 2_000_000), (5, text.upper(), None, None)])
    docs = docs.withColumnRenamed("score", "kept").withColumnRenamed("n_chars", "taken")
    for name, stage in C.STAGES[:4]:
        docs = written(stage(spark, docs, sf), re.sub(r"\W", "-", name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "taken", "kept"]
    assert C.token_store(spark, docs, sf).count() == docs.count()
    empty = make([])
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf).collect() == []
