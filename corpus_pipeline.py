"""A training-data pipeline over ``documents``: each stage reads what its predecessor wrote.

1. language ID: documents without a recognised language, or with an unsure one, go;
2. quality classifier: documents that it predicts to be of low quality go;
3. near-dedup: of each class of near copies the document with the smallest id stays; rows without a text have no copies;
4. mixing: sources are mixed to their target weights, so a document may leave or stay up to twice;
5. BPE encoding: each document with its token ids.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe_codec, language_id, mixing, probminhash, quality_fm, queries
from quillgrid.llm.common import ensure_checkpoint_dir, table

#: Probability of the best language from which a document is kept.
SURE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, s = language_id.with_language(docs, queries.language_model(docs))
    return out.where((F.col(f"{s}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{s}.score") >= SURE)).select(*docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out, s = quality_fm.with_quality(docs, queries.quality_machine(spark, docs, sf_dir))
    return out.where(F.col(f"{s}.predicted") == 1).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(docs.select("doc_id", "source", "lang", "text"), queries.vocabulary_path()).select("doc_id", "source", "lang", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("language ID", by_language), ("quality classifier", by_quality), ("near-dedup", near_dedup), ("mixing", mix), ("BPE encoding", encode)]

#: Models, near copies and seeded draws can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the cluster's shared folder and read again.

    A stage's rows are deleted once the next one's are written; the last stage's stay, as the result is read from them.
    """
    ensure_checkpoint_dir(spark)
    top = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{k - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
