import math
import re
from collections import Counter

from pyspark.sql import functions as F

from starloom.llm import licences as L

FILES = "path string, text string, size long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))


def brute(files):
    lines = [tokens(x) for _, t, _ in files for x in (t or "").split("\n")]
    lines = [x for x in lines if x]
    df = Counter(w for x in lines for w in set(x))
    idf = lambda w: math.log((len(lines) + 1) / (df[w] + 1)) + 1
    vec = lambda x: {w: math.log1p(n) * idf(w) for w, n in Counter(x).items()}
    norm = lambda v: math.sqrt(sum(a * a for a in v.values()))
    out = {}
    for path, text, _ in files:
        best = (0.0, None)
        parts, held = [], []
        for x in [*(text or "").split("\n"), ""]:
            if tokens(x):
                held.append(x)
            else:
                parts.append(" ".join(held))
                held = []
        for x in [*(text or "").split("\n"), *parts, text or ""]:
            v = vec(tokens(x))
            for k, (name, t) in enumerate(L.TEMPLATES):
                u = vec(tokens(t))
                s = sum(a * u.get(w, 0) for w, a in v.items()) / (norm(u) * norm(v)) if v else 0
                if s >= L.COSINE and (round(s, 9), -k) > (best[0], -best[1] if best[1] is not None else -math.inf):
                    best = (round(s, 9), k)
        out[path] = (L.TEMPLATES[best[1]][0] if best[1] is not None else None, round(best[0], 6))
    return out


TREE = [
    ("LICENSE", "Some words.\nReleased under the MIT License.\nmore of the words", 1), ("a.txt", "nothing here", 1), ("src/b.txt", "the the of and", 1), ("src/x/LICENSE.md", "x\nlicensed under the apache license version 2.0", 1),
    ("src/x/c.txt", None, 1), ("src/x/y/d.txt", "", 1), ("src/x/y/e.txt", "Licensed under CC BY-NC 4.0.", 1), ("src/xy/f.txt", "all rights withheld", 1), ("src/z/COPYING", "no licence in it", 1), ("src/z/g.txt", "q", 1), ("src/w/license", "GNU General Public License version 3", 1), ("src/w/h", "All rights reserved.\nThis work is licensed under the GNU General Public License, version 3.", 1),
]


def test_scores_are_those_of_brute_force(spark):
    got = {r.path: (r.own_license, round(r.own_score, 6)) for r in L.scan(spark.createDataFrame(TREE, FILES)).collect()}
    assert got == brute(TREE)
    assert got["LICENSE"][0] == "MIT" and got["src/x/LICENSE.md"][0] == "Apache-2.0" and got["src/w/license"][0] == "GPL-3.0"


def wrapped(text, width=60, prefix="# "):
    import textwrap

    return "\n".join(prefix + x for x in textwrap.wrap(text, width))


def test_wrapped_headers_and_whole_files_are_found(spark):
    full = {n: t for n, t in L.TEMPLATES if len(t) > 300}
    rows = [(f"{n}.py", f"#!/usr/bin/env python\n\n{wrapped(t)}\n\nimport os\nprint(os.name)\n", 1) for n, t in full.items()]
    rows += [(f"{n}/LICENSE", "The licence\n\nCopyright (c) 2020 Some One\n\n" + wrapped(t, 70, "") + "\n", 1) for n, t in full.items()]
    rows += [("other.py", "# " + " ".join(f"word{i} of the software and a copy" for i in range(40)), 1), ("long.txt", "the software is a thing of use\n" * 40_000, 1)]
    got = {r.path: (r.own_license, round(r.own_score, 6)) for r in L.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got["other.py"][0] is None and got["long.txt"][0] is None
    assert all(got[f"{n}.py"][0] == got[f"{n}/LICENSE"][0] == n for n in full)
    assert {k: v for k, v in got.items() if k != "long.txt"} == {k: v for k, v in brute(rows).items() if k != "long.txt"}


def test_a_licence_line_is_found_in_a_small_and_in_a_large_table(spark):
    line = "Released under the MIT License, see LICENSE for details."
    for n in (10, 20_000):
        rows = [("a", line, 1)] + [(f"f{i}", f"see for details of the thing {i % 977} and this is for more", 1) for i in range(n)]
        got = {r.path: r.own_license for r in L.scan(spark.createDataFrame(rows, FILES)).where("path = 'a' or path = 'f3'").collect()}
        assert got == {"a": "MIT", "f3": None}


def test_ties_fall_by_path_and_clashing_columns_stay(spark):
    rows = [("d/COPYING", 0.9, "AAA", "x", "y"), ("d/LICENSE", 0.9, "ZZZ", "x", "y"), ("d/a", 0.0, None, "x", "y")]
    out = L.inherited(spark.createDataFrame(rows, "path string, own_score double, own_license string, dir string, above string"))
    assert {(r.path, r.license, r.dir, r.above) for r in out.collect()} == {("d/COPYING", "AAA", "x", "y"), ("d/LICENSE", "ZZZ", "x", "y"), ("d/a", "AAA", "x", "y")}


def test_the_nearest_directory_counts(spark):
    got = {r.path: (r.license, r.license_from) for r in L.inherited(L.scan(spark.createDataFrame(TREE, FILES))).collect()}
    assert got["a.txt"] == got["src/b.txt"] == got["src/xy/f.txt"] == got["src/z/g.txt"] == got["src/z/COPYING"] == ("MIT", "")
    assert got["src/x/c.txt"] == got["src/x/y/d.txt"] == ("Apache-2.0", "src/x")
    assert got["src/x/y/e.txt"] == ("CC-BY-NC-4.0", "src/x/y/e.txt")


def test_null_paths_repeats_and_empty_tables(spark):
    rows = [("d/LICENSE", "Released under the MIT License.", 1), ("d/LICENSE", "All rights reserved.", 1), ("d/a", "q", 1), ("d/a", "q", 1), (None, "q", 1), (None, "All rights reserved.", 1)]
    got = Counter((r.path, r.license) for r in L.inherited(L.scan(spark.createDataFrame(rows, FILES))).collect())
    assert got[None, None] == 1 and got[None, "proprietary"] == 1 and sum(got.values()) == 6
    assert got["d/a", "MIT"] + got["d/a", "proprietary"] == 2
    assert L.inherited(L.scan(spark.createDataFrame([], FILES))).collect() == []


def test_documents_as_files(make):
    docs = make([(5, "q", "en", "a"), (1234, "q", "en", None), (120, "q", "en", "a")])
    got = {r.doc_id: r.path for r in L.as_files(docs).select("doc_id", F.col("path")).collect()}
    assert got == {5: "src/a/t0/LICENSE", 1234: "src/none/t1/h12/1234.txt", 120: "src/a/t0/h1/120.txt"}
