import random

import pytest

from starloom.llm import near_duplicates as N
from starloom.llm.common import components


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    ids = sorted({r[0] for r in rows})
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    s = [(i, sets(t)) for i, t in rows]
    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            n = len(x & y)
            if n and 100 * n >= 75 * len(x | y):
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(n // 6):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(6):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.randrange(10**6) * 1000 + len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


def check(make, rows):
    got = {r.doc_id: r for r in N.near_duplicates(make(rows)).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    return got


def test_components_are_those_of_brute_force(make):
    got = check(make, corpus(1))
    assert sum(not r.kept for r in got.values()) > 10


@pytest.mark.parametrize("limit", [2, 8])
def test_large_nodes_branch_and_end_in_parts(make, monkeypatch, limit):
    monkeypatch.setattr(N, "LIMIT", limit)
    check(make, corpus(2, 48))


def test_a_hot_group_of_copies_and_near_copies(make):
    base = [f"x{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(30)] + [(100 + i, " ".join([*base[:40], f"y{i}", *base[41:]])) for i in range(30)] + [(200 + i, " ".join(f"z{i}_{k}" for k in range(30))) for i in range(20)]
    got = check(make, rows)
    assert sum(r.kept for r in got.values()) == 21


def test_threshold_is_exact(make):
    # 40 words have 36 shingles; one changed word at the end spares 35 of 37, five runs apart fewer
    a = [f"a{i}" for i in range(20)]
    rows = [(1, " ".join(a)), (2, " ".join([*a[:-1], "b"])), (3, " ".join([*a[:-3], "c", "d", "e"])), (4, " ".join(a[:10]))]
    check(make, rows)


def test_nulls_empty_texts_repeats_and_short_texts(make):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, "q")]
    got = N.near_duplicates(make(rows)).collect()
    assert len(got) == 10
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert by[1].kept and by[2].kept and by[5].component_id == 4 and not by[5].kept and by[6].kept
    assert [r.kept for r in got if r.doc_id == 7] == [True, True]
    nulls = [(r.component_id, r.kept) for r in got if r.doc_id is None]
    assert sorted(nulls, key=str) == sorted([(7, False), (None, False)], key=str)


def test_a_row_repeated_a_thousand_times_costs_as_one(make):
    base = [f"x{i}" for i in range(80)]
    near = [" ".join([*base[: 20 + k], f"y{k}", *base[21 + k :]]) for k in range(40)]
    half = [" ".join([*base[:45], *(f"z{k}_{i}" for i in range(40))]) for k in range(20)]
    rows = [(5, " ".join(base))] * 1000 + [(10 + k, t) for k, t in enumerate(near)] + [(100 + k, t) for k, t in enumerate(half)] + [(3, near[7])] * 200
    got = N.near_duplicates(make(rows)).collect()
    assert len(got) == len(rows)
    want = brute([(r, t) for r, t in dict(rows).items()])
    assert all(r.component_id == want[r.doc_id] for r in got)
    assert {r.doc_id for r in got if r.kept} == {3, *range(100, 120)}


def test_an_id_with_two_texts(make):
    a, b, c = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    got = sorted((r.doc_id, r.component_id) for r in N.near_duplicates(make([(7, a), (7, b), (3, a), (9, b), (1, b + " x"), (1, c)])).collect())
    assert got == [(1, 1), (1, 1), (3, 3), (7, 1), (7, 3), (9, 1)]


def test_nothing_is_left_behind_but_what_the_result_reads(make, monkeypatch, tmp_path):
    from starloom.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark, name: f"file://{tmp_path}/{name}-{len(list(tmp_path.iterdir()))}{next(counter)}")
    counter = iter(range(1000))
    out = N.near_duplicates(make(corpus(4, 30)))
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} <= {"features", "classes", "labels"}
    assert out.count() == 30


def test_empty_table(make):
    assert N.near_duplicates(make([])).collect() == []


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_both_ways_of_joining_up_agree(spark, one_task):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {k: v for k, v in up.items() if k != 500}
    assert components(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_key_filter_passes_all_keys(spark):
    from starloom.llm.common import key_filter

    df = spark.range(10_000).withColumnRenamed("id", "k")
    got = {r.k for r in key_filter(df, "k", df.where("k % 500 = 3")).collect()}
    assert {k for k in range(3, 10_000, 500)} <= got and len(got) < 40
