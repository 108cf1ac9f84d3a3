import zlib

import numpy as np

import __spark_entry__ as entry
from starloom.llm import quality as Q
from starloom.llm.textops import pieces


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_statistics_of_single_texts():
    import pyarrow as pa

    texts = ["", None, "Hello hello WORLD.\nHello hello WORLD.\n", "a a a a a a", "%%% ### $$$"]
    got = np.concatenate([Q.statistics(d, o) for _, d, o in pieces(pa.array(texts, pa.string()))])
    x = {f: got[:, k] for k, f in enumerate(Q.FEATURES)}
    assert (got[:2] == 0).all() and np.isfinite(got).all()
    assert x["log_words"][2] == np.log1p(6) and x["distinct_lines"][2] == 0.5 and x["repeat_next"][3] == 5 / 6
    assert x["top_word"][3] == 1 and x["symbols"][4] == 9 / 11 and x["upper_words"][2] == 2 / 6


def test_the_model_learns_single_and_paired_features():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 5))
    y = ((x[:, 0] > 0.7) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    y = (np.sin(6 * x[:, 2]) > 0).astype(float)
    assert ((Q.fit(x[:3000], y[:3000]).score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    # A score is the sum of table entries.
    one = model.base + sum(t[np.searchsorted(e, v, "right")] for e, t, v in zip(model.edges, model.tables, x[0], strict=True)) + sum(t[np.searchsorted(model.coarse[i], x[0, i], "right"), np.searchsorted(model.coarse[j], x[0, j], "right")] for i, j, t in model.pairs)
    assert np.isclose(model.score(x[:1])[0], 1 / (1 + np.exp(-one)))


def test_without_both_labels_scores_are_constant():
    x = np.random.default_rng(2).uniform(size=(50, 3))
    assert np.ptp(Q.fit(x, np.ones(50)).score(x)) == 0
    assert Q.fit(np.zeros((0, 3)), np.zeros(0)).score(x).tolist() == [0.5] * 50


def test_edge_cases(spark, make):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    docs = make([(1, "good text here"), (2, "%%% $$$"), (2, "%%% $$$"), (3, None), (None, ""), (9, "x" * 3_000_000)])
    got = Q.scored(docs, Q.train(docs, labels), docs.columns).collect()
    assert len(got) == 6 and all(0 <= r["__starloom_score"] <= 1 for r in got)
    assert Q.scored(make([]), Q.train(make([]), labels.limit(0)), ["doc_id"]).collect() == []


def test_query_is_right_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = entry.queries()["op10_quality"](spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if crc(r.doc_id, 5) == 0}
    known = [r for r in held if r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in known]) > 0.95
    assert np.mean([r.predicted for r in known if quality[r.doc_id] == 1]) > 0.98
    assert all(r.predicted == (r.score >= 0.3) for r in got)


TEXTS = ["A b", "", "Hello world. Hello world.\nHello", "x", "ñandú Ünï\n\nfoo foo foo", "TOTAL CAPS 123 %%", "a", "the end. " * 40, "a b c\n" * 9]


def plain_statistics(text):
    b = text.encode()
    return Q.statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0]


def test_neighbours_of_a_text_leave_its_statistics_alone():
    at = np.cumsum([0, *(len(t.encode()) for t in TEXTS)])
    whole = Q.statistics(np.frombuffer("".join(TEXTS).encode(), np.uint8), at)
    for row, text in zip(whole, TEXTS, strict=True):
        assert np.allclose(row, plain_statistics(text), rtol=1e-9, atol=1e-9)


def test_scores_are_sums_of_looked_up_bins(make):
    rng = np.random.default_rng(4)
    x = np.array([plain_statistics(" ".join(rng.choice(["The", "cat", "sat.", "%%", "AND", "fine\n"], rng.integers(1, 60)))) for _ in range(600)])
    model = Q.fit(x, (x[:, Q.FEATURES.index("log_words")] > 3).astype(float))
    assert model.pairs

    def bin_of(edges, v):
        return sum(bool(e <= v) for e in edges)

    got = {r.doc_id: r["__starloom_score"] for r in Q.scored(make(list(enumerate([*TEXTS, None]))), model, ["doc_id"]).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate([*TEXTS, None]):
        v = plain_statistics(text or "")
        total = model.base + sum(t[bin_of(e, v[k])] for k, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
        total += sum(t[bin_of(model.coarse[a], v[a]), bin_of(model.coarse[b], v[b])] for a, b, t in model.pairs)
        assert abs(got[i] - 1 / (1 + np.exp(-min(30.0, max(-30.0, total))))) < 1e-9
