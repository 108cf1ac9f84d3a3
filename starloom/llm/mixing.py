"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, written

#: A document's words may be taken so often at most.
REPEATS = 3
#: Blocks have so many words at most; fewer where a source would get under BLOCKS of them on average.
BLOCK, BLOCKS = 64, 1000
#: Documents of a shard, about.
SHARD = 256
SEED = 20240607
_PRIME = 2147483647
_SPACED = "[^\\\\x20\\\\x09-\\\\x0D]+"


def _spread(key: Column, factor: int, shift: int) -> Column:
    return F.pmod(F.pmod(F.coalesce(key, F.lit(0)), F.lit(_PRIME)) * factor + shift, F.lit(_PRIME))


def apportion(df: DataFrame, parent: list[str], child: list[str], weight: str, seats: str) -> DataFrame:
    """(parent, child, quota): each parent's seats to its children by highest quotients weight / (2k + 1); ties go to the lower child.

    The last seat's divisor lies between W / (H + S/2) and W / (H - S/2) for W weights of S children and H seats, which
    settles all but about S seats at once; only these are ranked.
    """
    w = W.partitionBy(*parent)
    total, n, h = F.sum(weight).over(w), F.count("*").over(w), F.col(seats)
    share = F.col(weight) / total
    lo = F.when((total > 0) & (h > n / 2), F.greatest(F.lit(0), F.ceil(share * (h - n / 2) - 0.5))).otherwise(0).cast("long")
    hi = F.when(total > 0, F.floor(share * (h + n / 2) + 0.5) + 1).otherwise(0).cast("long")
    found = df.select(*parent, *child, F.col(weight).alias("_w"), h.alias("_h"), lo.alias("_lo"), hi.alias("_hi"))
    settled = found.withColumn("_open", F.col("_h") - F.sum("_lo").over(w))
    quotients = settled.select("*", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence("_lo", F.col("_hi") - 1))).alias("_k"))
    order = W.partitionBy(*parent).orderBy(F.desc_nulls_last(F.col("_w") / (2 * F.col("_k") + 1)), *child, "_k")
    ranked = quotients.withColumn("_won", (F.col("_k").isNotNull() & (F.row_number().over(order) <= F.col("_open"))).cast("long"))
    return ranked.groupBy(*parent, *child).agg((F.first("_lo") + F.sum("_won")).alias("quota"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS) -> DataFrame:
    """Adds source_no, weight and target to (source, source_size, n): shares by weight of all words, none above repeats
    times its source's size, the excess reshared by weight.  Its windows see one row for each source."""
    number = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    by_no = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("source_no", number.cast("long")).withColumn("weight", by_no).withColumn("cap", F.col("source_size") * float(repeats))
    order = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - before) / rest)
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy())
    return s.withColumn("target", F.least("cap", F.col("weight") * level)).drop("cap", "level")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken) for each of docs (doc_id, text, source).

    The words of all sources' targets are dealt out in blocks of equal length: to the sources, to groups of shards and to
    shards in turn, each time by highest quotients.  In a shard documents stand in a seeded order, and from a seeded
    block on the quota of blocks is taken, round and round.  A source whose target is above its size is repeated.

    Null text: size 0, nothing taken.  Null source: a source of its own, after all others.  Null doc_id counts as 0 in
    seeded choices.  Repeated rows are documents of their own; rows alike in doc_id and size may trade places, which
    changes no result row's values as a set.  An empty table gives an empty result.  Other columns aren't read.
    """
    h = _spread(F.col("doc_id"), 1103515245, 12345)
    sized = written(docs.select("doc_id", "source", F.expr(f"regexp_count(coalesce(text, ''), '{_SPACED}')").cast("long").alias("size"), h.alias("h")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = written(targets(per_source, weights, repeats).withColumn("fan", F.ceil(F.sqrt(F.col("n") / SHARD)).cast("long")), "sources")
    words, sources = plan.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).head()
    block = max(1, min(BLOCK, words // (max(sources, 1) * BLOCKS)))
    plan = plan.withColumn("block", F.lit(block).cast("long")).withColumn("all", F.lit(0)).withColumn("seats", F.lit(int(words / block + 0.5)).cast("long"))
    seats = apportion(plan, ["all"], ["source_no"], "target", "seats").withColumnRenamed("quota", "seats")
    plan = written(plan.drop("seats", "all").join(seats, "source_no"), "targets")

    same = sized["source"].eqNullSafe(plan["source"])
    placed = sized.join(plan, same).select("doc_id", "size", "source_no", F.pmod("h", "fan").alias("g"), F.pmod(F.floor(F.col("h") / F.col("fan")), F.col("fan")).alias("shard"))
    placed = written(placed, "placed")
    shard = written(placed.groupBy("source_no", "g", "shard").agg(F.sum("size").alias("shard_size")), "shards")
    group = shard.groupBy("source_no", "g").agg(F.sum("shard_size").alias("group_size")).join(plan.select("source_no", "seats"), "source_no")
    to_group = apportion(group, ["source_no"], ["g"], "group_size", "seats").withColumnRenamed("quota", "seats")
    to_shard = apportion(shard.join(to_group, ["source_no", "g"]), ["source_no", "g"], ["shard"], "shard_size", "seats")
    of_source = plan.select("source_no", "source_size", "target", "block")
    rule = shard.join(to_shard, ["source_no", "g", "shard"]).join(of_source, "source_no")
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block")))
    rule = rule.withColumn("n", n.cast("long")).withColumn("quota", F.least("quota", F.col("n") * repeats))
    rule = rule.withColumn("from", F.pmod(F.col("source_no") * 7919 + F.col("g") * 104729 + F.col("shard") * 1299709 + seed, F.col("n")))
    rule = written(rule, "rules")

    order = W.partitionBy("source_no", "g", "shard").orderBy(_spread(F.col("doc_id"), 48271, seed), "doc_id", "size")
    end = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    at = placed.withColumn("e", end).withColumn("s", F.col("e") - F.col("size")).join(rule, ["source_no", "g", "shard"])
    times, more = F.floor(F.col("quota") / F.col("n")), F.pmod("quota", "n")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least("e", hi) - F.greatest("s", lo))

    first = overlap(F.col("from") * F.col("block"), (F.col("from") + more) * F.col("block"))
    wrapped = overlap(F.lit(0), (F.col("from") + more - F.col("n")) * F.col("block"))
    return at.select("doc_id", "size", "source_size", "target", (times * F.col("size") + first + wrapped).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).withColumn("target", F.round("target", 4))


#: The same apportionment in SQL: sources, groups of shards and shards, by highest quotients without the short cut.
OP7_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         (((((coalesce(doc_id, 0) % {_PRIME}) + {_PRIME}) % {_PRIME}) * 1103515245 + 12345) % {_PRIME})::BIGINT AS h,
         (((((coalesce(doc_id, 0) % {_PRIME}) + {_PRIME}) % {_PRIME}) * 48271 + {SEED}) % {_PRIME})::BIGINT AS o
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*)::BIGINT AS n, row_number() OVER (ORDER BY source IS NULL, source)::BIGINT AS source_no
  FROM docs GROUP BY source),
wt AS (SELECT *, (1 + (source_no - 1) % 3)::DOUBLE AS weight, 3e0 * source_size AS cap, ceil(sqrt(n / 256e0))::BIGINT AS fan,
  (sum(source_size) OVER ())::BIGINT AS words, greatest(1, least(64, floor((sum(source_size) OVER ()) / (1000e0 * count(*) OVER ()))))::BIGINT AS block FROM src),
lv AS (SELECT *, (words - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wt),
tg AS (SELECT *, least(cap, weight * max(CASE WHEN level * weight <= cap THEN level END) OVER ()) AS target FROM lv),
sq AS (SELECT source_no, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source_no, k) AS place, floor(words::DOUBLE / block + 0.5)::BIGINT AS seats
  FROM (SELECT *, unnest(range(0, floor(target / block)::BIGINT + 3)) AS k FROM tg)),
ss AS (SELECT tg.*, coalesce(x.seats, 0)::BIGINT AS seats FROM tg LEFT JOIN (SELECT source_no, count(*) AS seats FROM sq WHERE place <= seats GROUP BY 1) x USING (source_no)),
pl AS (SELECT d.doc_id, d.size, d.o, s.source_no, d.h % s.fan AS g, (d.h // s.fan) % s.fan AS shard FROM docs d JOIN ss s ON d.source IS NOT DISTINCT FROM s.source),
sh AS (SELECT source_no, g, shard, sum(size)::BIGINT AS shard_size FROM pl GROUP BY ALL),
gr AS (SELECT source_no, g, sum(shard_size)::BIGINT AS group_size, any_value(seats) AS seats, any_value(source_size) AS source_size FROM sh JOIN ss USING (source_no) GROUP BY ALL),
gq AS (SELECT source_no, g, seats, row_number() OVER (PARTITION BY source_no ORDER BY group_size::DOUBLE / (2 * k + 1) DESC, g, k) AS place
  FROM (SELECT *, unnest(range(0, CASE WHEN source_size > 0 THEN floor(seats * group_size::DOUBLE / source_size)::BIGINT + 30 ELSE 0 END)) AS k FROM gr)),
gs AS (SELECT gr.source_no, gr.g, gr.group_size, coalesce(x.seats, 0) AS seats FROM gr LEFT JOIN
  (SELECT source_no, g, count(*) AS seats FROM gq WHERE place <= seats GROUP BY 1, 2) x ON x.source_no = gr.source_no AND x.g = gr.g),
hq AS (SELECT source_no, g, shard, seats, row_number() OVER (PARTITION BY source_no, g ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
  FROM (SELECT sh.*, gs.seats, unnest(range(0, CASE WHEN group_size > 0 THEN floor(gs.seats * shard_size::DOUBLE / group_size)::BIGINT + 30 ELSE 0 END)) AS k FROM sh JOIN gs USING (source_no, g))),
rl AS (SELECT sh.*, ss.source_size, ss.target, ss.block, greatest(1, ceil(shard_size / ss.block::DOUBLE))::BIGINT AS n, coalesce(x.quota, 0) AS won
  FROM sh JOIN ss USING (source_no) LEFT JOIN (SELECT source_no, g, shard, count(*) AS quota FROM hq WHERE place <= seats GROUP BY ALL) x USING (source_no, g, shard)),
ru AS (SELECT *, least(won, 3 * n)::BIGINT AS quota, (source_no * 7919 + g * 104729 + shard * 1299709 + {SEED}) % n AS f FROM rl),
pos AS (SELECT pl.doc_id, pl.size, ru.*, sum(pl.size) OVER (PARTITION BY source_no, g, shard ORDER BY o, doc_id NULLS FIRST, pl.size ROWS UNBOUNDED PRECEDING) AS e
  FROM pl JOIN ru USING (source_no, g, shard))
SELECT doc_id, size, source_size, round(target, 4) AS target,
  ((quota // n) * size + greatest(0, least(e, (f + quota % n) * block) - greatest(e - size, f * block))
   + greatest(0, least(e, (f + quota % n - n) * block) - greatest(e - size, 0)))::BIGINT AS taken
FROM pos
"""
