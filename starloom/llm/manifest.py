"""Merkle manifest of a dataset: a tree of hashes a group, a tree over the groups' roots, and proofs for every row.

The node store is Parquet in the shared folder, one folder a level (``level=0`` has the leaves), so no tree is ever held in
memory.  Leaves are sorted into runs by range; a run's place in its group comes from the counts of the runs before it.
Each level is made by one scan over the level below in the order of its files: FAN consecutive nodes that lie together are
gathered as they pass, and only those that a file or batch has cut apart meet by a shuffle.  Proofs are joins of the levels by
coordinate (tree, place div FAN) from the top down, so that rows of one group are never gathered: a task holds FAN nodes.

A digest is kept as 32 bytes and hashed as lower-case hexadecimal text.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, shared_folder, written

#: Nodes that become one.
FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, place long, n_nodes long, digest binary, kids binary, keys array<long>, claims array<binary>"


class Tree(NamedTuple):
    """A folder of levels, and their number."""

    store: str
    levels: int

    def level(self, spark: SparkSession, k: int) -> DataFrame:
        return spark.read.schema(_NODE).parquet(f"{self.store}/level={k}")


def field(value: Column) -> Column:
    """A value as the leaf's hash takes it: its bytes' number, a colon and its text; a null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def _joined(digests: Column) -> Column:
    """Hash of digests that stand in a row."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)).cast("binary"), 256))


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """Adds place (0, 1, ... within each tree by order) and n_nodes (of the tree) to rows of (tree, ...).

    Rows are sorted by range, so that a tree spans as many tasks as it needs; rows that are alike in order are split by
    their number, which makes no difference to any hash if they have the same digest.
    """
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    by = ["tree", *[F.col(c).asc_nulls_first() for c in order], "_row"]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    runs = written(ordered.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "runs")  # numbers go up within a run
    run = F.shiftright("_at", 33).alias("_run")
    counts = written(runs.groupBy("tree", run).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "counts", True)
    # A tree has a row a run here; what stands before a run in its tree is summed up within the tree.
    before = F.expr("sum(_n) over (partition by tree order by _run rows between unbounded preceding and current row) - _n")
    starts = counts.select("tree", "_run", "_first", before.alias("_before"), F.expr("sum(_n) over (partition by tree)").alias("n_nodes"))
    rows = runs.withColumn("_run", run).join(starts, ["tree", "_run"])
    return rows.withColumn("place", F.col("_before") + F.col("_at") - F.col("_first")).drop("_run", "_at", "_first", "_before")


def _passing(batches):
    """Nodes of a batch that lie together under one parent as a row: (tree, parent, slot of the first, n_nodes, kids, keys, claims)."""
    for b in batches:
        if not (n := b.num_rows):
            continue
        tree = b.column("tree").dictionary_encode().indices.to_numpy()
        place = b.column("place").to_numpy()
        new = np.ones(n, bool)
        new[1:] = (tree[1:] != tree[:-1]) | (place[1:] != place[:-1] + 1) | (place[1:] % FAN == 0)
        at = np.flatnonzero(new)
        ends = np.append(at, n)
        kids = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((ends * 32).astype(np.int32)), _values(b.column("digest"))])
        lists = []
        for name in ("keys", "claims"):
            c = b.column(name)
            if c.null_count == n:
                lists.append(pa.nulls(len(at), c.type))
            else:  # lists of rows that lie together are themselves together
                lists.append(pa.ListArray.from_arrays(pa.array(np.asarray(c.offsets)[ends] - c.offsets[0].as_py(), pa.int32()), c.flatten()))
        slot = pa.array((place[at] % FAN).astype(np.int32))
        yield pa.record_batch([b.column("tree").take(pa.array(at)), pa.array(place[at] // FAN), slot, b.column("n_nodes").take(pa.array(at)), kids, *lists], names=["tree", "place", "slot", "n_nodes", "kids", "keys", "claims"])


def _values(digests) -> pa.Buffer:
    """The bytes of digests in a row."""
    first = np.frombuffer(digests.buffers()[1], np.int32)[digests.offset]
    return digests.buffers()[2].slice(int(first), 32 * len(digests))


def _level_above(nodes: DataFrame) -> DataFrame:
    """Nodes over those of a level that isn't its trees' last."""
    parts = written(nodes.mapInArrow(_passing, "tree string, place long, slot int, n_nodes long, kids binary, keys array<long>, claims array<binary>"), "parts")
    whole = f"octet_length(kids) = {32 * FAN}"
    cut = parts.where(f"not ({whole})").groupBy("tree", "place").agg(F.max("n_nodes").alias("n_nodes"), F.array_sort(F.collect_list(F.struct("slot", "kids", "keys", "claims"))).alias("p"))
    bytes_of = F.unhex(F.array_join(F.transform("p.kids", F.hex), ""))
    lists = [F.when(F.col("p")[0][c].isNotNull(), F.flatten(f"p.{c}")).alias(c) for c in ("keys", "claims")]
    every = parts.where(whole).select("tree", "place", "n_nodes", "kids", "keys", "claims").union(cut.select("tree", "place", "n_nodes", bytes_of.alias("kids"), *lists))
    above = F.ceil(F.col("n_nodes") / FAN).cast("long")
    return every.select("tree", "place", above.alias("n_nodes"), _joined(F.col("kids")).alias("digest"), "kids", "keys", "claims")


def build(rows: DataFrame, order: list[str], store: str) -> Tree:
    """Writes the trees over rows of (tree, digest, keys, claims, and what order names) at store, level by level.

    Within a tree nodes follow one another by order; while a tree has several nodes, every FAN consecutive ones (the last
    of them: fewer) become one.  No rows give no nodes.
    """
    spark = rows.sparkSession
    names = [c.split()[0] for c in _NODE.split(", ")]
    with scratch():
        leaves = _placed(rows, *order).withColumn("kids", F.lit(None).cast("binary"))
        leaves.select(names).sortWithinPartitions("tree", "place").write.parquet(f"{store}/level=0")
    most = Tree(store, 1).level(spark, 0).agg(F.max("n_nodes")).head()[0] or 1
    levels = 1
    while most > 1:
        with scratch():
            below = Tree(store, levels).level(spark, levels - 1).where("n_nodes > 1")
            _level_above(below).select(names).write.parquet(f"{store}/level={levels}")
        most, levels = -(-most // FAN), levels + 1
    return Tree(store, levels)


def roots(spark: SparkSession, tree: Tree) -> DataFrame:
    """(tree, digest) of each tree's last node."""
    out = None
    for k in range(tree.levels):
        found = tree.level(spark, k).where("n_nodes = 1").select("tree", "digest")
        out = found if out is None else out.union(found)
    return out


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def descend(spark: SparkSession, tree: Tree, over: DataFrame, to: int) -> DataFrame:
    """Nodes of level to (and of lower ones that are roots already), with path, the levels above them as (slot, kids).

    over (tree, path, ...) says what is above each tree's root; its further columns come along.  The paths of the levels
    above are kept in the store, each a FAN-th of the level below it.
    """
    rest = [c for c in over.columns if c != "tree"]
    low = [tree.level(spark, k).where("n_nodes = 1").join(over, "tree") for k in range(to)]
    found = None
    for k in range(tree.levels - 1, to - 1, -1):
        nodes = tree.level(spark, k).where("n_nodes = 1").join(over, "tree")
        if found is not None:
            parent = found.select("tree", F.col("place").alias("_parent"), F.col("kids").alias("_kids"), *rest)
            below = tree.level(spark, k).where("n_nodes > 1").withColumn("_parent", F.expr(f"place div {FAN}")).join(parent, ["tree", "_parent"])
            step = F.array(F.struct(F.pmod("place", F.lit(FAN)).cast("int").alias("slot"), F.col("_kids").alias("kids")))
            nodes = nodes.unionByName(below.withColumn("path", F.concat(step, "path")).drop("_parent", "_kids"))
        found = _kept(nodes, f"{tree.store}/paths={k}") if k > to else nodes
    for nodes in low:
        found = nodes if found is None else found.unionByName(nodes)
    return found


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _hexes(kids: bytes) -> list[str]:
    text = kids.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _proved(batches):
    """For each key of a node over leaves (or of a lone leaf): its proof's hash and the root that its claim folds to."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for b in batches:
        out: list[tuple] = []
        for node in b.to_pylist():
            steps = [(s["slot"], _hexes(s["kids"])) for s in node["path"]]
            above = "".join("".join(kids[:slot] + kids[slot + 1 :]) for slot, kids in steps)
            subroot, root = node["subroot"].hex(), node["root"].hex()
            folded: dict[str, str] = {}

            def fold(digest: str, steps=steps, folded=folded) -> str:
                """The root over a digest at this node; equal digests, as most leaves of a node give, are folded once."""
                if digest not in folded:
                    up = digest
                    for slot, kids in steps:
                        up = _hash("".join([*kids[:slot], up, *kids[slot + 1 :]]))
                    folded[digest] = up
                return folded[digest]

            leaves = _hexes(node["kids"] or node["digest"])
            for i, (key, claim) in enumerate(zip(node["keys"], node["claims"], strict=True)):
                own = claim.hex() if claim is not None else leaves[i]
                if node["kids"] is None:
                    proof, end = _hash(above), fold(own)
                else:
                    before, after = "".join(leaves[:i]), "".join(leaves[i + 1 :])
                    proof, end = _hash(before + after + above), fold(_hash(before + own + after))
                out.append((key, leaves[i], subroot, root, proof, end, end == root))
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def manifest(docs: DataFrame, claimed: Column | None = None, store: str | None = None, columns: tuple = COLUMNS, key: str = "doc_id", group: str = "source") -> tuple[DataFrame, str]:
    """Builds the manifest of docs and proves every row; (one row per row of docs, the store's URI).

    A leaf hashes columns in their order.  Groups have a tree each, whose leaves ascend by key (nulls first, then by digest,
    so that rows that repeat a key have a defined place, and equal rows equal leaves); the groups' roots, by group (null
    first, then by bytes), have a tree over them.  claimed is the leaf that someone presents for a row, where it isn't null
    in place of the row's own: folded_root is what it comes to with the row's siblings, verified whether that is the root.
    Proofs hash the siblings from the leaf's to the root's level; a row alone in the only group has none, the hash of
    nothing.  Nulls and empty texts are told apart, long texts are hashed whole, other columns are not read, and an empty
    table has no rows and no root.
    """
    spark = docs.sparkSession
    store = store or shared_folder(spark, "manifest")
    digest = leaf(*[F.col(c) for c in columns])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null goes first, an empty name next
    claim = F.lit(None).cast("binary") if claimed is None else claimed
    rows = docs.select(tree.alias("tree"), digest.alias("digest"), F.array(F.col(key).cast("long")).alias("keys"), F.array(claim).alias("claims"), F.col(key).cast("long").alias("key"))
    low = build(rows, ["key", "digest"], f"{store}/rows")
    none = {"keys": F.lit(None).cast("array<long>"), "claims": F.lit(None).cast("array<binary>")}
    high = build(roots(spark, low).select(F.lit("").alias("tree"), "digest", F.col("tree").alias("group")).withColumns(none | {"keys": F.array(F.lit(None).cast("long")), "claims": F.array(F.col("group").cast("binary"))}), ["group"], f"{store}/groups")
    path = F.array().cast("array<struct<slot:int,kids:binary>>")
    # One row: the root over all groups.
    top = roots(spark, high).select("tree", path.alias("path"), F.col("digest").alias("root"))
    over = descend(spark, high, top, 0).select(F.decode(F.col("claims")[0], "UTF-8").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    over = _kept(over, f"{store}/group-paths")
    nodes = descend(spark, low, over, 1).select("digest", "kids", "keys", "claims", "path", "subroot", "root")
    return nodes.mapInArrow(_proved, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"), store


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proved against the manifest; of those whose id's CRC divides by 5, a text with A-Z lower-cased is presented."""
    docs = read(spark, sf_dir, "documents")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", letters, letters.lower())
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(tampered, leaf(*[lowered if c == "text" else F.col(c) for c in COLUMNS]))
    return manifest(docs, claimed)[0]


def _sql(leaf_levels: int = 5, group_levels: int = 3) -> str:
    """The same in SQL with a fixed number of levels (FAN ** 5 documents a source, FAN ** 3 sources): a tree that is done stays as it is."""

    def values(text: str) -> str:
        return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text))

    bits = "list_reduce(range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b))"
    codes = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    crc = f"xor(list_reduce({codes}, lambda c, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"leaf AS (SELECT doc_id, source, sha256({values('text')}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({values(lowered)}) END AS claim FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS d, coalesce(claim, leaf) AS f, '' AS sib FROM leaf)",
        "l0 AS (SELECT source, p, leaf AS d FROM a0)",
    ]

    def up(name: str, k: int, level: str, group: str) -> None:
        parts.append(f"k{level}{k} AS (SELECT {group}, p // {FAN} AS p, list(d ORDER BY p) AS kids, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {level}{k}) GROUP BY {group}, p // {FAN})")
        parts.append(f"{level}{k + 1} AS (SELECT {group}, p, CASE WHEN n = 1 THEN kids[1] ELSE sha256(list_aggregate(kids, 'string_agg', '')) END AS d FROM k{level}{k})")
        before, after = f"coalesce(list_aggregate(k.kids[1 : a.p % {FAN}], 'string_agg', ''), '')", f"coalesce(list_aggregate(k.kids[a.p % {FAN} + 2 : {FAN}], 'string_agg', ''), '')"
        parts.append(
            f"{name}{k + 1} AS (SELECT a.* EXCLUDE (p, f, sib), a.p // {FAN} AS p, CASE WHEN k.n = 1 THEN a.f ELSE sha256({before} || a.f || {after}) END AS f,"
            f" CASE WHEN k.n = 1 THEN a.sib ELSE a.sib || {before} || {after} END AS sib FROM {name}{k} a JOIN k{level}{k} k ON a.{group} IS NOT DISTINCT FROM k.{group} AND a.p // {FAN} = k.p)"
        )

    for k in range(leaf_levels):
        up("a", k, "l", "source")
    parts.append(f"m0 AS (SELECT 0 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, d FROM l{leaf_levels})")
    parts.append(f"b0 AS (SELECT a.* EXCLUDE (p, d), m.one, m.p, m.d AS subroot FROM a{leaf_levels} a JOIN m0 m ON a.source IS NOT DISTINCT FROM m.source)")
    for k in range(group_levels):
        up("b", k, "m", "one")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, m.d AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = m.d AS verified FROM b{group_levels} b, m{group_levels} m"


OP13_SQL = _sql()
