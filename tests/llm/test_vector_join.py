import random

import numpy as np
import pytest

from starloom.llm import vector_join as V

KIND = "vec_id long, embedding array<float>, label int, extra string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], g, "x") for i, e, g in rows], KIND)


def brute(rows):
    ids = [i for i, _, _ in rows]
    n, up = dict.fromkeys(ids, 0), {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    good = [(i, np.array(e, np.float32).astype(float), g) for i, e, g in rows if g is not None and e is not None and None not in e and np.isfinite(np.array(e, float)).all() and np.any(np.array(e, float))]
    for k, (i, x, g) in enumerate(good):
        for j, y, h in good[:k]:
            if g == h and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                n[i] += 1
                n[j] += 1
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    return {i: (n[i], top(i)) for i in ids}


def cluster(seed, n, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    x = centres[rng.integers(0, 8, n)] * rng.uniform(0.5, 3, (n, 1)) + rng.normal(scale=0.12, size=(n, d))
    order = random.Random(seed).sample(range(10 * n), n)
    return [(order[i], x[i].tolist(), int(i % 3)) for i in range(n)]


@pytest.mark.parametrize("block", [4, 1024])
def test_links_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "FAN", 3)
    rows = cluster(1, 150)
    rows += [(10_000 + k, rows[0][1], rows[0][2]) for k in range(20)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.vector_links(frame(spark, rows)).collect()}
    want = brute(rows)
    assert got == want
    assert sum(n for n, _ in want.values()) > 100


def test_vectors_that_cannot_be_compared(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 0), (2, one, 0), (3, one, None), (4, one, None), (5, None, 0), (6, [0.0, -0.0, 0.0], 0), (7, [0.0] * 3, 0), (8, [1.0, None, 3.0], 0), (9, [float("nan"), 1, 1], 0), (10, [float("inf"), 1, 1], 0), (11, [1.0, 2.0], 0), (12, [], 0), (13, [2.0, 4.0, 6.0], 0), (14, one, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.vector_links(frame(spark, rows)).collect()}
    assert got == {i: ({1: 2, 2: 2, 13: 2}.get(i, 0), 1 if i in (2, 13) else i, i not in (2, 13)) for i, _, _ in rows}
    twice = V.vector_links(frame(spark, [(1, one, 0), (1, one, 0), (None, one, 0)])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in twice) == [(0, 0, False), (1, 1, True), (1, 1, True)]


def test_empty_table(spark):
    assert V.vector_links(frame(spark, [])).collect() == []
