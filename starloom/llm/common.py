"""Shared folders, written tables, key bitmaps and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of 64 bits in a key bitmap: at most 2 MB to broadcast, whatever the data.
BITMAP_WORDS = 1 << 17
#: Edges that one task joins up (3 MB); a larger graph takes the distributed way.
ONE_TASK = 200_000
#: Bytes of its sources that a task reads at most where a narrow table is written.
NARROW_BYTES = 1 << 26


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the one that the session names in spark.checkpoint.dir.

    Only where that setting is absent (a local session, as in tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "starloom-checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def unclashing(columns: list[str], made: tuple[str, ...]) -> list[str]:
    """The columns, without repeats, whose names none of the made ones takes; Spark's names don't tell cases apart."""
    taken = {m.lower() for m in made}
    return [c for c in dict.fromkeys(columns) if c.lower() not in taken]


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs no recomputation.

    A narrow table (a few numbers a row) is written by four tasks a core, which spares many small files, or by as many as
    it takes to read NARROW_BYTES of its sources each.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    if narrow:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, min(size // NARROW_BYTES, 1 << 20)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._starloom_path = path
    if _scratch.open:
        _scratch.open[-1].append(out)
    return out


class _Scratch(threading.local):
    def __init__(self):
        self.open: list[list[DataFrame]] = []


_scratch = _Scratch()


@contextlib.contextmanager
def scratch():
    """What written makes within it goes at its end, but for the tables that the given function was called with."""
    kept: list[DataFrame] = []
    _scratch.open.append([])
    try:
        yield lambda *tables: kept.extend(tables)
    finally:
        made = _scratch.open.pop()
        discard(*(t for t in made if not any(t is k for k in kept)))
        if _scratch.open:
            _scratch.open[-1].extend(kept)


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that written made, once all that was read from them has been written itself."""
    for t in tables:
        if path := getattr(t, "_starloom_path", None):
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets the driver collect what it no longer refers to; Spark then deletes the shuffle files of steps that are over, which
    would else wait for the driver's memory to fill."""
    spark._jvm.System.gc()


def tidy(work):
    """work (a function over a task's batches) that hands free memory back at its end, as a Python worker lives on between tasks."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def key_filter(df: DataFrame, column: str, keys: DataFrame, size: int = BITMAP_WORDS) -> DataFrame:
    """Rows of df whose column may be among keys (one bigint column), by a bitmap of fixed size; the join that follows settles it.

    With many keys the bitmap fills and lets more rows pass, none too few.
    """
    slot = keys.select(F.pmod(F.xxhash64(keys.columns[0]), F.lit(size * 64)).alias("_slot"))
    bits = slot.groupBy(F.expr("cast(_slot div 64 as int)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_slot % 64 as int)))").alias("_bits"))
    at = F.pmod(F.xxhash64(column), F.lit(size * 64))
    kept = df.withColumn("_at", at).withColumn("_word", F.expr("cast(_at div 64 as int)"))
    return kept.join(F.broadcast(bits), "_word").where("shiftright(_bits, cast(_at % 64 as int)) & 1 = 1").drop("_word", "_at", "_bits").select(df.columns)


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node in edges (a, b: bigint): component is the smallest node reachable.

    Up to one_task distinct edges are joined up by one task, in memory of bounded size.  More go through large-star and
    small-star steps in turn until the edges are stars; every step is an aggregate by key and an equi-join, so that no
    component is ever gathered anywhere.  Loops and repeated edges are allowed; the result is the same either way.
    """
    star = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", True)
    before = _state(star)
    if before[0] <= one_task:
        return star.coalesce(1).mapInArrow(_united, "node long, component long")
    for _ in range(most_rounds):
        star = written(_small_star(_large_star(star)), "edges", True)
        after = _state(star)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return star.select(F.col("a").alias("node"), F.col("b").alias("component")).union(star.select("b", "b").distinct())


def _united(batches):
    """The same for the edges of one task, by a union of sets."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "component": pa.array([top(x) for x in nodes], pa.int64())})


def _state(star: DataFrame) -> tuple:
    row = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
    return row[0], row[1]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    return e.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
