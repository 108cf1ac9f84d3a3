"""A corpus from raw documents to token shards, in five stages; each calls one operator of starloom.llm.

Every stage takes the documents that the one before it kept, with all their columns, and returns them as a DataFrame; the
last returns a row for each document of the token store.  Documents with a null text are empty documents, those without
an id are never taken for copies, rows that share an id are documents of their own, and columns beyond the known ones travel
along unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import decontaminate, mixing, near_duplicates, quality, token_index
from starloom.llm.common import read, written

#: The column that tells rows apart where ids don't.
ROW = "__starloom_row"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, doesn't reject."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    found = quality.scored(docs, model, docs.columns)
    return found.where(F.col("__starloom_score") >= quality.THRESHOLD).drop("__starloom_score")


def told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that tells its rows apart: doc_id if it does, else their number in a written copy.

    Ids that several rows have, or rows without one, thus never stand for one another's texts.
    """
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if shared.isEmpty():
        return docs, "doc_id"
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows"), ROW


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id, and the first of its rows if several are alike.

    Each row is judged by its own text: one whose id another text shares stays if nothing is like it.  Rows without an id stay.
    """
    rows, key = told_apart(docs)
    found = near_duplicates.near_duplicates(rows, doc_id=key).withColumnRenamed("doc_id", key)
    if key == "doc_id":
        gone = written(found.where("not kept").select(key), "copies")
        return docs.join(gone, key, "left_anti").select(docs.columns)
    members = written(found.select(key, "component_id").join(rows.select(key, "doc_id"), key), "members")
    first = members.where("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", key)).alias("__starloom_first"))
    gone = members.where("doc_id is not null").join(first, "component_id").where(F.col(key) != F.col(f"__starloom_first.{key}"))
    return rows.join(written(gone.select(key), "copies"), key, "left_anti").select(docs.columns)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    names = ("__starloom_n", "__starloom_spans", "__starloom_items")
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), keep=docs.columns, names=names)
    return found.where(F.size(names[1]) == 0).drop(*names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: their words taken by their size, to the nearest whole number.

    Documents without words count as taken once.  Rows that share an id, or have none, are taken each by its own size.
    """
    rows, key = told_apart(docs)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(1).cast("int")
    sizes = rows.select(F.col(key).alias("doc_id"), "source", "text")
    taken = written(mixing.mix(sizes).select(F.col("doc_id").alias(key), times.alias("__starloom_times")), "taken")
    # Both sides grow with the documents: the join is a shuffled one at every size.
    joined = rows.join(taken.hint("merge"), key).where("__starloom_times > 0")
    copies = joined.withColumn("__starloom_copy", F.explode(F.sequence(F.lit(1), "__starloom_times")))
    return copies.select(docs.columns)


def token_store(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the token store: doc_id, start, n_tokens, ids_crc32; rows that share an id follow one another by their texts' hashes,
    each with a row of its own, and the store's index leads to the first of them."""
    return token_index.token_index(docs)[0]


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", clean_of_benchmarks),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_store),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each on what the one before has written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").replace("/", ""))
    return docs


#: No SQL: a trained classifier and a tokenizer take part.
ORACLE_SQL = None
