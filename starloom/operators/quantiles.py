"""Exact quantiles without a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import folder, removed

#: Values that are sorted in one place at most, pivots of a pass, and the precision of the sketch that proposes them.
GATHERED, PIVOTS, PRECISION = 10_000, 1_000, 10_000


def quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, a column for each name of wanted): the exact quantiles of (column, fraction), between two ranks on the line between them.

    Sketches of bounded size propose two pivots around each rank; rows below, at, between and above them are counted, which
    says where the rank is, whatever the sketch was worth.  Each pass leaves about a 300th of the values; up to GATHERED
    are sorted.  Nulls don't count, NaN is above all numbers, null is a group of its own, and a group without values gives
    nulls; without by there is one row, of nulls if the table is empty.
    """
    spark, made = df.sparkSession, []

    def kept(rows: DataFrame, name: str) -> DataFrame:
        made.append(folder(spark, name))
        rows.write.parquet(made[-1])
        return spark.read.schema(rows.schema).parquet(made[-1])

    each = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in sorted({c for c, _ in wanted.values()})])
    rows = kept(df.select(F.struct(F.lit(0).alias("_"), *by).alias("k"), F.explode(each).alias("p")).select("k", "p.c", "p.v"), "values")
    asked = spark.createDataFrame([(name, c, float(q)) for name, (c, q) in wanted.items()], "name string, c string, q double")
    goals = rows.groupBy("k", "c").agg(F.count("v").alias("n")).join(F.broadcast(asked), "c").withColumn("at", F.col("q") * (F.col("n") - 1))
    goal = ["k", "c", "name", "n", "at", "rank"]
    bounds = {"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "below": F.lit(0).cast("long"), "inside": F.col("n"), "x": F.lit(None).cast("double")}
    goals = kept(goals.withColumn("rank", F.floor("at")).select(*goal, *[c.alias(n) for n, c in bounds.items()]), "goals")

    def within(some: DataFrame) -> DataFrame:
        return rows.where("v is not null").join(some, ["k", "c"]).where("(lo is null or v > lo) and (hi is null or v < hi)")

    left, settled = goals.where("n > 0"), []
    while True:
        few = within(left.where(F.col("inside") <= GATHERED)).groupBy(*goal, "below").agg(F.sort_array(F.collect_list("v")).alias("all"))
        settled.append(few.select(*goal, F.expr("element_at(all, cast(rank - below + 1 as int))").alias("x")))
        many = left.where(F.col("inside") > GATHERED)
        if many.isEmpty():
            break
        passed = kept(_narrowed(within, many, goal), "passed")
        settled.append(passed.where("x is not null").select(*goal, "x"))
        left = passed.where("x is null")
    low = settled[0]
    for s in settled[1:]:
        low = low.union(s)
    low = kept(low, "ranks")
    pairs = rows.where("v is not null").join(low, ["k", "c"]).groupBy(*goal, "x").agg(F.count_if(F.col("v") <= F.col("x")).alias("upto"), F.min(F.when(F.col("v") > F.col("x"), F.col("v"))).alias("next"))
    high = F.when(F.col("upto") > F.col("rank") + 1, F.col("x")).otherwise(F.col("next"))
    line = (F.col("rank") + 1 - F.col("at")) * F.col("x") + (F.col("at") - F.col("rank")) * high
    value = F.when((F.col("at") == F.col("rank")) | (F.col("x") == high), F.col("x")).otherwise(line)
    one = goals.select("k", "name").join(pairs.select("k", "name", value.alias("value")), ["k", "name"], "left")
    out = one.groupBy("k").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in wanted])
    names = [F.col("k")[c].alias(c) for c in by]
    if not by:
        out = spark.range(1).select(F.struct(F.lit(0).alias("_")).alias("k")).join(out, "k", "left")
    path = folder(spark, "quantiles")
    out = out.select(*names, *wanted)
    out.write.parquet(path)
    for p in made:
        removed(spark, p)
    return spark.read.schema(out.schema).parquet(path)


def _narrowed(within, many: DataFrame, goal: list[str]) -> DataFrame:
    """Goals with the bounds that one pass gives: between, below or above two pivots, or x where the rank is a pivot."""
    state = [*goal, "below", "inside"]
    sketch = within(many).groupBy(*state, "lo", "hi").agg(F.percentile_approx("v", [i / PIVOTS for i in range(PIVOTS + 1)], PRECISION).alias("g"))
    place = (F.col("rank") - F.col("below")) / (F.col("inside") - 1) * PIVOTS
    at = lambda i: F.get("g", i.cast("int"))
    two = sketch.select(*state, "lo", "hi", at(F.greatest(F.floor(place) - 1, F.lit(0))).alias("p"), at(F.least(F.ceil(place) + 1, F.lit(PIVOTS))).alias("r"))
    v, p, r = F.col("v"), F.col("p"), F.col("r")
    tests = {"n0": v < p, "n1": v == p, "n2": (v > p) & (v < r), "n3": (v == r) & (r > p), "n4": (v > p) & (v > r)}
    n = within(two).groupBy(*state, "lo", "hi", "p", "r").agg(*[F.count_if(t).alias(c) for c, t in tests.items()])
    upto = F.lit(0).cast("long")
    for i in range(5):
        n = n.withColumn(f"b{i}", F.col("below") + upto)
        upto = upto + F.col(f"n{i}")
    part: Column = F.lit(4)
    for i in (3, 2, 1, 0):
        part = F.when(F.col("rank") < F.col(f"b{i}") + F.col(f"n{i}"), i).otherwise(part)
    n = n.withColumn("part", part)
    by_part = lambda *c: F.element_at(F.array(*c), F.col("part") + 1)
    none = F.lit(None).cast("double")
    return n.select(*goal, by_part(F.col("lo"), none, p, none, r).alias("lo"), by_part(p, none, r, none, F.col("hi")).alias("hi"), by_part(*[F.col(f"b{i}") for i in range(5)]).alias("below"), by_part(*[F.col(f"n{i}") for i in range(5)]).alias("inside"), by_part(none, p, none, r, none).alias("x"))
