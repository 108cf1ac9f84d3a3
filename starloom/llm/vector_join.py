"""Near-duplicate embeddings by an epsilon grid order join.

Vectors are turned to their principal axes and sorted by the cells of a grid on the leading ones, label by label; blocks
are runs of that order.  The sequence is joined with itself interval by interval: pairs of intervals whose boxes lie
further apart than the threshold allows are skipped, the others are opened into pairs of their parts, down to pairs of
blocks, whose vectors are compared by one matrix product.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, written
from .textops import mix

COSINE = 0.98
#: Vectors the axes are found from at most; they decide how much is skipped, never what is found.
AXES_ROWS = 10_000
#: Leading axes in the grid, vectors of a block, parts of an interval.
AXES, BLOCK, FAN = 8, 1024, 16


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cleaned(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple:
    """vec_id, label, dim, k1, k2 (hash of the vector) and raw (its bytes); the last four null if the vector can't be compared; and the kind of its numbers."""
    flow = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("v"))
    kind = np.float32 if flow.schema["v"].dataType.elementType.simpleString() == "float" else np.float64
    flow = flow.withColumn("v", F.col("v").cast("array<float>" if kind is np.float32 else "array<double>"))
    word = np.uint32 if kind is np.float32 else np.uint64

    def clean(batches):
        for batch in batches:
            v = batch.column(2)
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)
            at = np.cumsum(size) - size
            finite = np.concatenate([[0], np.cumsum(np.isfinite(flat))])
            nonzero = np.concatenate([[0], np.cumsum(flat != 0)])
            good = (size > 0) & (finite[at + size] - finite[at] == size) & (nonzero[at + size] - nonzero[at] > 0)
            good &= batch.column(0).is_valid().to_numpy(zero_copy_only=False) & batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            place = np.arange(len(flat)) - np.repeat(at, size)
            salted = mix(flat.view(word).astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (salted, mix(salted))]
            k1, k2 = ((s[at + size] - s[at]).view(np.int64) for s in sums)
            raw = [flat[a : a + n].tobytes() if ok else None for a, n, ok in zip(at.tolist(), size.tolist(), good.tolist(), strict=True)]
            yield pa.record_batch({"vec_id": batch.column(0), "label": batch.column(1), "dim": pa.array(size, mask=~good), "k1": pa.array(k1, mask=~good), "k2": pa.array(k2, mask=~good), "raw": pa.array(raw, pa.binary())})

    return flow.mapInArrow(clean, "vec_id long, label string, dim long, k1 long, k2 long, raw binary"), kind


def _axes(distinct: DataFrame, kind, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension (mean, leading axes) from the most vectors with the smallest hashes of their ids."""
    some = distinct.orderBy(F.xxhash64("node"), "node").limit(most).select("dim", "raw").toArrow()
    dim, raw = some.column("dim").to_numpy(), some.column("raw").to_pylist()
    out = {}
    for d in np.unique(dim).tolist():
        x = _unit(np.frombuffer(b"".join(r for r, k in zip(raw, dim, strict=True) if k == d), kind).reshape(-1, d))
        _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        out[d] = (x.mean(axis=0), axes[:AXES])
    return out


def _project(x: np.ndarray, axes) -> np.ndarray:
    out = np.zeros((len(x), AXES))
    if axes is not None:
        out[:, : len(axes[1])] = (x - axes[0]) @ axes[1].T
    return out


def _box(prefix: str = "") -> list[str]:
    return [f"{prefix}{side}{k}" for side in ("lo", "hi") for k in range(AXES)]


def _near(reach: float):
    """Whether boxes a and b may hold vectors within reach of each other."""
    gap = [F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}")) for k in range(AXES)]
    return sum((g * g for g in gap[1:]), gap[0] * gap[0]) <= reach * reach * (1 + 1e-9) + 1e-12


def _block_pairs(blocks: DataFrame, parts: int, reach: float) -> DataFrame:
    """(a, b) with a <= b: pairs of blocks that may hold vectors within reach, by opening pairs of intervals from the whole sequence down."""
    lo_hi = [F.min(c).alias(c) if c.startswith("lo") else F.max(c).alias(c) for c in _box()]
    levels = [blocks.select("label", "dim", F.col("block").alias("id"), F.col("part").alias("parent"), *_box())]
    steps = max(1, math.ceil(math.log(max(parts, 2), FAN)))
    span = 1
    for _ in range(steps):
        boxes = blocks.groupBy("label", "dim", F.floor(F.col("part") / span).alias("id")).agg(*lo_hi)
        span *= FAN
        levels.append(boxes.withColumn("parent", F.floor(F.col("id") / FAN)))
    levels = [written(x, "intervals", True) for x in levels]
    pairs = levels[-1].select("label", "dim", F.col("parent").alias("a"), F.col("parent").alias("b")).distinct()
    for boxes in reversed(levels):
        side = {s: boxes.select("label", "dim", F.col("parent").alias(s), F.col("id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in _box()]) for s in "ab"}
        opened = pairs.join(side["a"], ["label", "dim", "a"]).join(side["b"], ["label", "dim", "b"]).where("a_id <= b_id").where(_near(reach))
        pairs = written(opened.select("label", "dim", F.col("a_id").alias("a"), F.col("b_id").alias("b")), "interval-pairs", True)
    return pairs.select("a", "b")


def _roots(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest node reachable within a pair of blocks, for the rows and the columns of the links."""
    big = np.iinfo(np.int64).max
    while True:
        down = np.minimum(b, np.where(linked, a[:, None], big).min(axis=0, initial=big))
        across = np.minimum(a, np.where(linked, down[None, :], big).min(axis=1, initial=big))
        if (down == b).all() and (across == a).all():
            return a, b
        a, b = across, down


def vector_links(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) for each vector.

    Vectors link if their labels are equal and their cosine in double precision is at least the threshold (which must be
    positive).  A vector that is null, empty, zero or has a null or non-finite component, or has no label or no id, links
    with nothing: n_links 0, component its own id, kept (if it has an id).  Vectors of different lengths never link.
    Equal vectors are one class with its smallest id standing for it; repeated rows count as vectors of their own.
    """
    spark = vectors.sparkSession
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7
    flow, kind = _cleaned(vectors, vec_id, embedding, label)
    base = written(flow, "vectors")
    key = ["label", "dim", "k1", "k2"]
    classes = written(base.where("raw is not null").groupBy(*key).agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes", True)
    distinct = written(base.withColumnRenamed("vec_id", "node").join(classes, [*key, "node"]).select("node", "n", "label", "dim", "k1", "k2", "raw").dropDuplicates(["node", *key]), "distinct")
    axes = spark.sparkContext.broadcast(_axes(distinct, kind, AXES_ROWS))
    size = reach
    cells = [f"c{k}" for k in range(AXES)]

    def place(batches):
        for batch in batches:
            dim = batch.column(3).to_numpy()
            at = np.zeros((len(dim), AXES))
            raw = batch.column(4).to_pylist()
            for d in np.unique(dim).tolist():
                mine = np.flatnonzero(dim == d)
                at[mine] = _project(_unit(np.frombuffer(b"".join(raw[i] for i in mine), kind).reshape(-1, d)), axes.value.get(d))
            grid = np.floor(at / size).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(grid[:, k])) for k in range(AXES))], names=[*batch.schema.names, *cells])

    placed = distinct.select("node", "n", "label", "dim", "raw").mapInArrow(place, "node long, n long, label string, dim long, raw binary, " + ", ".join(f"{c} long" for c in cells))
    parts = max(1, -(-distinct.count() // BLOCK))
    ordered = placed.repartitionByRange(parts, "label", "dim", *cells, "node").sortWithinPartitions("label", "dim", *cells, "node").select("node", "n", "label", "dim", "raw")

    def cut(batches):
        from pyspark import TaskContext

        part, number, held = TaskContext.get().partitionId(), 0, []

        def block():
            nonlocal number
            name, d = held[0][2:4]
            x = _unit(np.frombuffer(b"".join(r[4] for r in held), kind).reshape(-1, d))
            at = _project(x, axes.value.get(d))
            row = {"label": [name], "dim": [d], "part": [part], "block": [part << 24 | number], "nodes": [np.array([r[0] for r in held], np.int64).tobytes()], "times": [np.array([r[1] for r in held], np.int64).tobytes()], "raw": [b"".join(r[4] for r in held)]}
            row |= {f"{s}{k}": [float(f(at[:, k]))] for s, f in (("lo", np.min), ("hi", np.max)) for k in range(AXES)}
            number += 1
            held.clear()
            return pa.record_batch(row)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][2:4] != row[2:4] or len(held) == BLOCK):
                    yield block()
                held.append(row)
        if held:
            yield block()

    kinds = "label string, dim long, part long, block long, nodes binary, times binary, raw binary, " + ", ".join(f"{c} double" for c in _box())
    blocks = written(ordered.mapInArrow(cut, kinds), "blocks")
    last = blocks.agg(F.max("part")).head()[0]
    pairs = _block_pairs(blocks, (last or 0) + 1, reach)

    def compare(batches):
        for batch in batches:
            for _, _, d, na, ta, ra, nb, tb, rb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = np.frombuffer(na, np.int64), np.frombuffer(nb, np.int64)
                x, y = (_unit(np.frombuffer(r, kind).reshape(-1, d)) for r in (ra, rb))
                own = na == nb
                linked = x @ y.T >= cosine
                if own:
                    np.fill_diagonal(linked, False)
                    linked |= linked.T
                if not linked.any():
                    continue
                root_a, root_b = _roots(linked, a, b)
                sides = [(a, linked @ np.frombuffer(tb, np.int64), root_a)]
                if not own:
                    sides.append((b, np.frombuffer(ta, np.int64) @ linked, root_b))
                for node, n, root in sides:
                    some = n > 0
                    yield pa.record_batch({"node": pa.array(node[some]), "links": pa.array(n[some].astype(np.int64)), "root": pa.array(root[some])})

    side = {s: blocks.select(F.col("block").alias(s), "dim", *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "times", "raw")]) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"].drop("dim"), "b").select("a", "b", "dim", "nodes_a", "times_a", "raw_a", "nodes_b", "times_b", "raw_b")
    links = written(both.mapInArrow(compare, "node long, links long, root long"), "links")
    counts = written(links.groupBy("node").agg(F.sum("links").alias("links")), "counts", True)
    found = written(components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))), "components", True)
    named = base.select("vec_id", *key).join(classes, key, "left").join(counts, "node", "left").join(found, "node", "left")
    component = F.coalesce("component", "node", "vec_id")
    n_links = F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return named.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read(spark, sf_dir, "embeddings"))


#: Brute force over all pairs of a label, and the closure of the links.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1) c USING (vec_id)
"""
