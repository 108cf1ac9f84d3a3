import re

import pytest

from starloom.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for i, text in docs:
        w = split(text)
        hit, found = set(), set()
        for item, t in items:
            q = split(t)
            n = min(10, len(q))
            grams = {tuple(q[s : s + n]) for s in range(len(q) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s : s + n]) in grams:
                    hit |= set(range(s, s + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found))
    return out


def run(docs_df, items_df, **k):
    return {r.doc_id: (r.n_words, sum(s.b - s.a for s in r.spans), r["items"]) for r in D.contamination(docs_df, items_df, **k).collect()}


ITEM = "The Quick brown fox jumps over the lazy dog, and then it sleeps all day long."
ITEMS = [(1, ITEM), (2, "Rare words here"), (3, ""), (4, None), (5, "ü-Ö 漢字"), (12, ITEM), (7, "a a a a a a a a a a a a")]
DOCS = [
    (1, f"Intro. {ITEM.upper()} end"), (2, "quick brown fox jumps over the lazy dog and then stop"), (3, "quick brown fox jumps over the lazy dog and stop"),
    (4, "RARE\nwords--here, rare words here"), (5, None), (6, ""), (7, "ü ö 漢字"), (8, "Ü Ö 漢字"), (9, "a " * 30), (10, "x " * 5000 + ITEM), (11, "words here rare"),
]


@pytest.mark.parametrize("most", [10**6, 1])
def test_hits_are_those_of_brute_force(spark, make, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert run(make(DOCS), items, most=most) == brute(DOCS, ITEMS)


def test_one_block_of_items_is_held_at_a_time(spark):
    items = spark.createDataFrame([(i, f"w{i} " * 40) for i in range(30)] + [(3, "w3 " * 40)], "item_id string, text string")
    got = list(D._blocks(items, 200))
    assert sorted(i for b, _ in got for i, _ in b) == sorted(str(i) for i in range(30)) and [last for _, last in got] == [False] * (len(got) - 1) + [True]
    assert len(got) >= 8 and all(len(b) <= 4 for b, _ in got)


def test_no_items_no_documents_and_clashing_columns(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {v[1] for v in run(make(DOCS), items.limit(0)).values()} == {0}
    assert run(make([]), items) == {}
    clash = make(DOCS).withColumnRenamed("score", "spans")
    out = D.contamination(clash, items, names=("w", "s", "i"))
    assert out.columns == [*clash.columns, "w", "s", "i"] and out.count() == len(DOCS)


def test_intervals_unite():
    import numpy as np

    assert D.merged(np.array([5, 0, 2, 9]), np.array([7, 3, 4, 10])) == [(0, 4), (5, 7), (9, 10)]
    assert D.merged(np.array([], int), np.array([], int)) == []


def test_results_take_the_place_of_columns_of_their_names(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plain = {r.doc_id: (r.n_words, r["items"]) for r in D.contamination(make(DOCS), items).collect()}
    clash = make(DOCS).withColumnRenamed("score", "N_words").withColumnRenamed("lang", "items")
    out = D.contamination(clash, items)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "n_words", "spans", "items"]
    assert {r.doc_id: (r.n_words, r["items"]) for r in out.collect()} == plain
