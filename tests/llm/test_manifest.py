"""The manifest's rows against a tree built by hand, and odd tables."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from starloom.llm import manifest as M

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(digests, at):
    """(root, siblings by level, slots) of the node at a place."""
    steps = []
    while len(digests) > 1:
        run = digests[at // 16 * 16 : at // 16 * 16 + 16]
        steps.append((at % 16, run))
        digests = [h(*digests[i : i + 16]) for i in range(0, len(digests), 16)]
        at //= 16
    return digests[0], steps


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    subroots = [climb([leaf(r) for r in trees[s]], 0)[0] for s in names]
    out = []
    for n, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            low, steps = climb([leaf(x) for x in trees[s]], i)
            root, more = climb(subroots, n)
            steps = steps + more
            proof = h(*["".join(run[:slot] + run[slot + 1 :]) for slot, run in steps])
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            up = leaf((*r[:4], lowered(r[4]))) if tampered else leaf(r)
            for slot, run in steps:
                up = h(*run[:slot], up, *run[slot + 1 :])
            out.append((r[0], leaf(r), low, root, proof, up, up == root))
    return sorted(out, key=str)


def proved(spark, tmp_path, rows, more=""):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    docs.withColumn("root", F.lit("x")).withColumn("place", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    found = M.op13_manifest(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_rows_are_those_of_a_tree_by_hand(spark, tmp_path):
    rows = [(i * 7 % 5000, "hot" if i % 3 else f"s{i % 11}", ("en", None)[i % 2], i, f"Text {i} É" if i % 4 else f"text {i}") for i in range(700)]
    rows += [(7000, None, None, None, None), (7001, "", "en", 0, ""), (7002, "lone", "de", 3, "ABC")]
    got = proved(spark, tmp_path, rows)
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}


def test_more_groups_than_one_run_and_sizes_at_the_edges(spark, tmp_path):
    rows = [(1000 * g + i, f"g{g}", "en", i, f"Doc {g} {i}") for g, n in enumerate([1, 2, 15, 16, 17, 32, 33, 255, 256, 257, *[1] * 30]) for i in range(n)]
    assert proved(spark, tmp_path, rows) == brute(rows)


def test_nulls_repeats_ties_and_long_texts(spark, tmp_path):
    rows = [(None, "a", "en", 1, "X"), (None, "a", "en", 1, "X"), (None, "a", None, None, None), (5, "a", "en", 1, "B"), (5, "a", "en", 1, "A"), (5, "a", "en", 1, "A"), (-3, "ü", "en", 1, ""), (9, "Z", "en", 9, "Ab " * 400_000)]
    rows += [(6, "a", "en", 1, "same")] * 40
    got = proved(spark, tmp_path, rows)
    assert got == brute(rows)


@pytest.mark.parametrize("rows", [[], [(10, "s", "en", 1, "Only")], [(10, None, None, None, None)]])
def test_the_smallest_tables(spark, tmp_path, rows):
    got = proved(spark, tmp_path, rows)
    assert got == brute(rows)
    if rows:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")


def test_levels_cut_apart_by_batches_and_files_come_together(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = [(i, "abc"[i % 2], "en", i, f"t{i}") for i in range(600)]
        assert proved(spark, tmp_path, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
