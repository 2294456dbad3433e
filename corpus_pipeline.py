"""A corpus pipeline of four stages over ``documents``: each stage works on all that the one before
it kept, and its result is written as Parquet and read again.

1. quality: documents that the passage classifier scores below the cut go.
2. near_duplicates: of documents linked by shingles of five words at a similarity of 0.8 or more
   one stays, that with the smallest id. Different texts of one id are different documents.
3. mixing: documents are chosen to the target weights of domains, languages and sources.
4. encoding: whole texts become token ids, and are decoded again.

All but the last return the columns of documents. A null or empty text is scored as such, has no
near duplicate, no tokens to mix (it rides along where its leaf is taken whole) and no ids.
Rows without an id are kept by the second stage. Empty tables give empty results.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelens.llm import minhash, mixing, passage_quality, queries
from hirelens.llm.common import among, checkpoint_folder, checkpointed, small_batches

#: A document is taken once at most, and this share of all words is kept.
SHARE, EPOCHS = 0.8, 1
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What tells rows apart that share an id.
ROW = ["doc_id", "mark"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from ``docs`` outside the fold
    held out, by the labels beside them."""
    docs = docs.select(*COLUMNS)
    model = passage_quality.train(docs, queries.table(spark, sf_dir, "labels"))
    return docs.filter(passage_quality.score(F.col("text"), model) >= queries.QUALITY_CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. Different texts of one id are documents of
    their own; of rows that agree in id and text, or share an id and have no words, one stays."""
    docs = docs.select(*COLUMNS)
    small_batches(spark)
    found = checkpointed(minhash.near_duplicates(docs, words=5, percent=80, detail=True))
    dropped = found.filter("not kept").select(*ROW).distinct()
    again = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    again = checkpointed(again.filter("n > 1").select("doc_id"))
    marked = docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    if not again.isEmpty():
        alone = among(marked, "doc_id", again, "left_anti")
        once = _once(among(marked, "doc_id", again), among(found, "doc_id", again))
        return among(alone, ROW, dropped, "left_anti").unionByName(once).select(*COLUMNS)
    return among(marked, ROW, dropped, "left_anti").select(*COLUMNS)


def _once(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Of rows that share their ids with others one of each group, the first by its mark; only such
    rows are moved."""
    stay = found.filter("kept").groupBy("doc_id", "group").agg(F.min("mark").alias("mark")).select(*ROW).distinct()
    first = among(rows, ROW, stay).groupBy(*ROW).agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return first.select(*ROW, "row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen by the weights of the query op7."""
    return mixing.mix(
        docs, queries.mix_levels(), queries.MIX_WEIGHTS, SHARE, EPOCHS, queries.MIX_SEED, keep=COLUMNS
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document left."""
    small_batches(spark)
    return queries.digests(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mix), ("encoding", encode)]

#: A trained classifier, signatures and byte-level merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is kept in the checkpoint folder."""
    docs = queries.table(spark, sf_dir, "documents")
    folder = posixpath.join(checkpoint_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
