import random
from fractions import Fraction

import pytest
from starloom.llm import mixing as M


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, total, out = set(names), Fraction(sum(sizes.values())), {}
    while left:
        w = sum(weight[s] for s in left)
        over = [s for s in left if total * weight[s] / w > 3 * sizes[s]]
        for s in over or list(left):
            out[s] = 3 * Fraction(sizes[s]) if over else total * weight[s] / w
        for s in over:
            total -= out[s]
        left = left - set(over) if over else set()
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 20, 200])), "en", rng.choice(["a", "a", "a", "b", "c", "Z", None])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 3, 40, 700])
def test_targets_and_what_is_taken(make, n):
    rows = corpus(n, n)
    got = M.mix(make(rows)).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    source = {r[0]: r[3] for r in rows}
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    assert len(got) == n
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and r.taken <= 3 * r.size and r.target == pytest.approx(float(want[s]))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(4, 0.02 * float(want[s])), s


def test_reruns_agree_and_seeds_differ(make):
    docs = make(corpus(9, 300))
    one, two, three = ({r.doc_id: r.taken for r in M.mix(docs.repartition(k), seed=s).collect()} for k, s in ((1, 1), (7, 1), (1, 2)))
    assert one == two != three


def test_edge_cases(make):
    assert M.mix(make([])).collect() == []
    got = M.mix(make([(1, None), (2, ""), (3, " \t")])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 3
    got = M.mix(make([(None, "a b"), (None, "a b"), (5, "c")])).collect()
    assert sum(r.taken for r in got) == 5


@pytest.mark.parametrize("seats", [0, 1, 7, 100])
def test_seats_go_to_the_highest_quotients(spark, seats):
    weights = {"a": [53, 24, 23, 0], "b": [1] * 9 + [400], "c": [0, 0], "d": [5]}
    df = spark.createDataFrame([(p, i, float(w), seats) for p, ws in weights.items() for i, w in enumerate(ws)], "p string, c long, w double, h long")
    got = {(r.p, r.c): r.quota for r in M.apportion(df, ["p"], ["c"], "w", "h").collect()}
    for p, ws in weights.items():
        quotients = sorted(((-Fraction(w, 2 * k + 1), i, k) for i, w in enumerate(ws) if w for k in range(seats)))[:seats]
        for i in range(len(ws)):
            assert got[p, i] == sum(x[1] == i for x in quotients), (p, i)


def test_no_python_in_the_plan(make, capsys):
    M.mix(make(corpus(1, 20))).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
