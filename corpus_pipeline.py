"""From raw documents to token digests: five operators, each working on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents, further ones included, whatever
their names. Rows with a null doc_id or text pass through by the operators' own rules; repeated rows go or stay together;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograin.llm import op1_jaccard, op2_quality, op4_bpe, op7_mixing, op9_exact_dedup
from lithograin.llm.common import scratch, stash, sweep, table

#: Documents keep at most one copy here, so that the mix never undoes the deduplication before it.
MOST = 1.0
#: Target weights of the domains of op7_mixing: without clean documents being the ones to give way.
WEIGHTS = (0.1, 0.006, 0.83, 0.064)


def _free(docs: DataFrame) -> str:
    """A column name that docs doesn't have, whatever its case."""
    taken, name = {c.lower() for c in docs.columns}, "keep"
    while name in taken:
        name += "_"
    return name


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id (null included) is among ids; rows that share a kept doc_id all stay, columns of any name pass."""
    key = _free(docs)
    ids = ids.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_quality.keep_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, op9_exact_dedup.exact_dedup(spark, docs).filter("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest doc_id stays."""
    groups = op1_jaccard.jaccard_join(spark, docs)
    return _only(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose rate, rounded by a hash of (doc_id, text), is one copy; equal rows share that hash and go or stay together."""
    rated = op7_mixing.mix(spark, docs, table(spark, sf_dir, "labels"), weights=WEIGHTS, most=MOST)
    key = _free(docs)
    kept = rated.filter(op7_mixing.copies(F.col("rate"), F.col("row_key")) >= 1).select(F.col("row_key").alias(key)).distinct()
    return docs.join(kept, F.xxhash64(F.col("doc_id").cast("long"), F.col("text")) == F.col(key), "left_semi")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_bpe.digest(op4_bpe.bpe(spark, docs, *op4_bpe.default_vocabulary()))


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("ngram_jaccard", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: The mixing stage fits a classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has written for itself goes as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = scratch()
        kept = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
        sweep(before, kept)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
