"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

A document is the set of its distinct runs of five words.  Independent random trees branch it by chosen coordinates of
its minwise signature: a tree's node picks one or two coordinates at random, and the document goes down to the child
named by its minwise value there, so that documents alike meet in many nodes.  Nodes of up to LIMIT documents are
compared exhaustively by sketches; larger ones branch further.  Every link found is confirmed on the full sets.

Only connectivity is asked for, which spares most pairs: at each level a document is first held against the smallest
document of its node, and only nodes whose documents are then still in different components are compared within.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, key_filter, read, scratch, tidy, written
from .textops import SPACED, mix, pieces, shingles, words

WIDTH, PERCENT = 5, 75
#: Minwise values of a signature, trees, documents of a node compared exhaustively, levels of a tree.
VALUES, TREES, LIMIT, DEPTH = 128, 10, 2000, 3
#: Sketch bytes (of VALUES) that two documents at the threshold share but for one pair in 100,000.
ALIKE = 74
_rng = np.random.Generator(np.random.PCG64(7))
_A, _B = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1), _rng.integers(0, 2**32, VALUES, dtype=np.uint32)
_ROOTS = _rng.integers(0, 2**64, TREES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, VALUES) minwise values; sets must not be empty."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out, work = np.empty((len(sets), VALUES), np.uint32), np.empty_like(x)
    for i in range(VALUES):
        np.multiply(x, _A[i], out=work)
        work += _B[i]
        out[:, i] = np.minimum.reduceat(work, at)
    return out


def branch(node: np.ndarray, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for rows of tree nodes with their documents' signatures: 4/3 children on average, so that a pair at
    the threshold keeps on average one node in common from level to level."""
    rows = np.arange(len(node))
    one = (mix(node ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(VALUES)).astype(np.int64)
    step = (mix(node ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(VALUES - 1)).astype(np.int64)
    two = (one + 1 + step) % VALUES
    both = mix(node ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(3) == 0
    row, coordinate = np.concatenate([rows, rows[both]]), np.concatenate([one, two[both]])
    value = signature[row, coordinate].astype(np.uint64) | (coordinate.astype(np.uint64) << np.uint64(32))
    return row, mix(node[row] ^ mix(value + np.uint64(1)))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, k1 and k2 (hash of the set), signature, sketch (its low bytes) and nodes (children of all roots)."""

    def make(batches):
        for batch in batches:
            for row, data, offsets in pieces(batch.column(1), 1 << 21):
                h, _, _, first = words(data, offsets, SPACED)
                sets = list(shingles(h, first, WIDTH))
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                k1, k2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
                sig = sk = nodes = [None] * len(sets)
                if len(full):
                    some = [sets[i] for i in full.tolist()]
                    at = np.cumsum([0, *map(len, some[:-1])])
                    every = np.concatenate(some)
                    k1[full] = np.add.reduceat(mix(every), at).view(np.int64)
                    k2[full] = np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), at).view(np.int64)
                    s = signatures(some)
                    r, child = zip(*(branch(np.full(len(s), root), s) for root in _ROOTS), strict=True)
                    r, child = np.concatenate(r), np.concatenate(child)
                    order = np.argsort(r, kind="stable")
                    cut = np.searchsorted(r[order], np.arange(len(s) + 1))
                    signed = child[order].view(np.int64)
                    sig, sk, nodes = list(sig), list(sk), list(nodes)
                    for k, i in enumerate(full.tolist()):
                        sig[i], sk[i], nodes[i] = s[k].tobytes(), s[k].astype(np.uint8).tobytes(), signed[cut[k] : cut[k + 1]]
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).slice(row, len(sets)),
                        "n_shingles": pa.array(size),
                        "k1": pa.array(k1),
                        "k2": pa.array(k2),
                        "signature": pa.array(sig, pa.binary()),
                        "sketch": pa.array(sk, pa.binary()),
                        "nodes": pa.array(nodes, pa.list_(pa.int64())),
                    }
                )

    kinds = "doc_id long, n_shingles long, k1 long, k2 long, signature binary, sketch binary, nodes array<long>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidy(make), kinds)


def _sets(column):
    for _, data, offsets in pieces(column):
        h, _, _, first = words(data, offsets, SPACED)
        yield from shingles(h, first, WIDTH)


def _matrix(column, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), VALUES)


def _alike(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sketches are alike."""

    def test(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (_matrix(batch.column(c), np.uint8) for c in (2, 3))
                good = (x == y).sum(axis=1) >= ALIKE
                yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(good))

    s = [sketch.select(F.col("doc_id").alias(k), F.col("sketch").alias(f"s{k}")) for k in "ab"]
    return pairs.join(s[1], "b").join(s[0], "a").select("a", "b", "sa", "sb").mapInArrow(tidy(test), "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Those of pairs (a, b: document ids) with 100 * intersection >= percent * union of their full shingle sets."""

    def test(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 200):
                both = [list(_sets(batch.column(c).slice(at, 200))) for c in (2, 3)]
                for k, (x, y) in enumerate(zip(*both, strict=True)):
                    n = len(np.intersect1d(x, y, assume_unique=True))
                    good[at + k] = n > 0 and 100 * n >= percent * (len(x) + len(y) - n)
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(good))

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ids = pairs.select("a").union(pairs.select("b"))
    d = written(key_filter(d, "doc_id", ids).distinct(), "texts")
    t = [d.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab"]
    return pairs.join(t[1], "b").join(t[0], "a").select("a", "b", "ta", "tb").mapInArrow(tidy(test), "a long, b long")


def _grouped(batches):
    """(key, rows of all columns) of each run of equal keys in the first column of sorted batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.table(batch.columns, names=[str(i) for i in range(batch.num_columns)])
        held = t if held is None else pa.concat_tables([held, t])
        key = held.column(0).to_numpy()
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        at = 0
        for to in cut.tolist():
            yield held.slice(at, to - at)
            at = to
        held = held.slice(at)
    if held is not None:
        yield held


def _meeting(rows: DataFrame, sketch: DataFrame) -> DataFrame:
    """Those of rows (key, node, label, tree, part) that have one of another label and part, alike by sketch, with their key.

    A key has few rows: those of a tree's node, or of two parts of it; without parts, part is null.  Where two documents
    share several of the trees' nodes, they meet under the least of these alone.
    """

    def compare(batches):
        held = None
        for batch in batches:
            t = pa.table(batch.columns, names=["key", "node", "label", "tree", "part", "sketch", "nodes"])
            held = t if held is None else pa.concat_tables([held, t])
            key = held.column("key").to_numpy()
            end = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if end:
                yield _partners(held.slice(0, end))
            held = held.slice(end)  # the last key's rows may go on
        if held is not None and len(held):
            yield _partners(held)

    rows = written(rows.select("key", "node", "label", "tree", "part"), "within", True)
    keys = rows.groupBy("node").agg(F.collect_set("tree").alias("nodes"))  # a document has about TREES of them
    wide = rows.join(keys, "node").join(sketch.withColumnRenamed("doc_id", "node"), "node").select("key", "node", "label", "tree", "part", "sketch", "nodes")
    return wide.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(compare), "key long, node long")


def _partners(rows) -> pa.RecordBatch:
    key, node, label, tree = (rows.column(c).to_numpy() for c in ("key", "node", "label", "tree"))
    part = rows.column("part").combine_chunks().fill_null(-1).to_numpy()
    sketch = _matrix(rows.column("sketch"), np.uint8)
    lists = rows.column("nodes").combine_chunks()
    size = lists.value_lengths().to_numpy()
    mine = np.full((len(key), int(size.max())), np.iinfo(np.int64).max)
    mine[np.repeat(np.arange(len(key)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    theirs = np.where(mine == np.iinfo(np.int64).max, np.iinfo(np.int64).min, mine)
    meets = np.zeros(len(key), bool)
    for step in range(1, len(key)):
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        i = i[(label[i] != label[i + step]) & ((part[i] != part[i + step]) | (part[i] < 0)) & ~(meets[i] & meets[i + step])]
        for at in range(0, len(i), 4096):
            k = i[at : at + 4096]
            k = k[(sketch[k] == sketch[k + step]).sum(axis=1) >= ALIKE]
            shared = (mine[k][:, :, None] == theirs[k + step][:, None, :]).any(axis=2)
            k = k[np.where(shared, mine[k], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == tree[k]]
            meets[k] = meets[k + step] = True
    return pa.record_batch({"key": pa.array(key[meets]), "node": pa.array(node[meets])})


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of membership matrices over parts of the shingles."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    place = np.cumsum(np.concatenate([[True], every[1:] != every[:-1]])) - 1
    keep = np.bincount(place)[place] > 1
    place, owner = place[keep], owner[keep]
    place = np.cumsum(np.concatenate([[False], place[1:] != place[:-1]])) if len(place) else place
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[a:b], place[a:b] - lo] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _linked(meeting: DataFrame, docs: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """(a, b): links among the documents of each key of meeting (key, node) by their full sets, each to the smallest one it reaches there."""

    def test(batches):
        for rows in _grouped(batches):
            node = rows.column(1).to_numpy()
            sets = list(_sets(rows.column(2)))
            size = np.array([len(x) for x in sets])
            both = _common(sets)
            links = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (both > 0)
            root = node
            while True:
                low = np.minimum(root, np.where(links, root[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (low == root).all():
                    break
                root = low
            if (root != node).any():
                yield pa.record_batch({"a": pa.array(node[root != node]), "b": pa.array(root[root != node])})

    d = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("text"))
    d = written(key_filter(d, "node", meeting.select("node")).distinct(), "texts")
    whole = meeting.join(d, "node").select("key", "node", "text")
    return whole.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(test), "a long, b long")


def _deeper(rows: DataFrame, feat: DataFrame) -> DataFrame:
    """Children (node, key) of rows' tree nodes."""

    def make(batches):
        for batch in batches:
            if batch.num_rows:
                row, child = branch(batch.column(1).to_numpy().view(np.uint64), _matrix(batch.column(2), np.uint32))
                yield pa.record_batch({"node": pa.array(batch.column(0).to_numpy()[row]), "key": pa.array(child.view(np.int64))})

    return rows.select("node", "key").join(feat.select("node", "signature"), "node").select("node", "key", "signature").mapInArrow(tidy(make), "node long, key long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each document.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a text of fewer than five words is one
    shingle.  A null text or one without words has an empty set, n_shingles 0, links with nothing and stays.
    Documents with equal sets are one class, stood for by one row with its smallest id, from the start; so rows that are
    repeated cost and get the same each.  Rows that repeat an id with other texts belong to their texts' classes; two
    classes with the same smallest id are one node that links as either does.  A row without an id takes its class's smallest id as component and is never kept.
    Columns other than the two aren't read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with scratch() as keep:
        feat = written(features(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "features")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f")
        classes = written(feat.where("n_shingles > 0").groupBy("k1", "k2").agg(first).select("k1", "k2", F.col("f.doc_id").alias("node"), "f.row"), "classes", True)
        reps = feat.select("row", "signature", "sketch", "nodes").join(classes.where("node is not null").select("row", "node"), "row")
        sketch = written(reps.select(F.col("node").alias("doc_id"), "sketch"), "sketches")
        rows = reps.select("node", F.explode("nodes").alias("key"))
        links: list[DataFrame] = []
        labels: DataFrame | None = None

        def labelled(df: DataFrame) -> DataFrame:
            if labels is None:
                return df.withColumn("label", F.col("node"))
            return df.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

        def confirm(candidates: DataFrame, test) -> None:
            """Adds the links that test finds for candidates, and brings the labels up to date."""
            nonlocal labels
            candidates = written(candidates, "candidates", True)
            if candidates.isEmpty():
                return
            found = written(test(candidates, docs, percent, doc_id, text), "links", True)
            if not found.isEmpty():
                links.append(found)
                labels = written(components(reduce(DataFrame.union, links)), "labels", True)

        for level in range(1, DEPTH + 1):
            rows = written(rows, "nodes", True)
            stats = written(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1"), "stats", True)
            multi = written(rows.join(stats, "key"), "multi", True)
            pairs = labelled(multi).where("node <> leader and label <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
            if level in (1, DEPTH):
                confirm(_alike(pairs, sketch).groupBy("a").agg(F.min("b").alias("b")), confirmed)
            multi = labelled(multi)
            unlike = written(multi.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "unlike", True)
            multi = multi.join(unlike, "key")
            small = multi.where(F.col("n") <= LIMIT).withColumn("tree", F.col("key")).withColumn("part", F.lit(None).cast("long"))
            confirm(_meeting(small, sketch), _linked)
            rest = written(multi.where(F.col("n") > LIMIT).select("node", "key", "n"), "rest", True)
            if rest.isEmpty():
                break
            if level < DEPTH:
                rows = _deeper(rest, reps)
        else:  # nodes that stay large: pairs of parts of them, each of bounded size
            parts = F.ceil(F.col("n") / (LIMIT // 2))
            mine = F.pmod(F.xxhash64("node"), parts)
            split = labelled(rest).select("node", "label", F.col("key").alias("tree"), mine.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("o"))
            # Under its own number a part is held against itself, so that its rows count as parts of their own there.
            part = F.when(F.col("c") != F.col("o"), F.col("c"))
            split = split.select("node", "label", "tree", part.alias("part"), F.xxhash64("tree", F.least("c", "o"), F.greatest("c", "o")).alias("key"))
            confirm(_meeting(split, sketch), _linked)

        keep(feat, classes, labels)
        found = labels if labels is not None else spark.createDataFrame([], "node long, component long")
        named = feat.select("doc_id", "n_shingles", "k1", "k2").join(classes.drop("row"), ["k1", "k2"], "left").join(found, "node", "left")
        component = F.coalesce("component", "node", "doc_id")
        return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


#: Brute force: all pairs that share a shingle, and the closure of the links.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[s:s + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS s FROM w)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
