"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. run() writes
each stage's result as Parquet under spark.checkpoint.dir and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granula.llm import decontamination, mixing, sharding, simhash_dedup, toxicity
from granula.llm.common import columns, fresh, kept_until_exit, shared_folder, table

#: SQL can express neither the compression distances nor the fingerprints: each stage is tested by itself.
ORACLE_SQL = None
TOXIC_AT = 0.7
#: Near copies: Jaccard similarity of five-word shingles.
SIMILARITY, SHINGLE = 0.8, 5
#: Bits within which the pigeonring looks for them.
RADIUS = 6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. The model learns from the labels of `sf_dir`, all folds but the held-out one.

    Null and empty texts get the curve's value at zero distance, very long ones are scored whole; repeated rows stay or go alike;
    an empty table stays empty; all columns are carried, whatever they are called.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    (score,) = fresh(docs, "__score")
    return toxicity.scored(docs, model, score).where(F.col(score) < TOXIC_AT).select(*columns(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that with the least doc_id (null last), then the least text hash.

    Candidates are SimHashes of the five-word shingle sets within RADIUS bits, found by pigeonring chains and checked exactly; copies
    that lie further apart are found by shared shingles.
    Texts without words, null ones too, are copies of each other; of rows equal in doc_id and text one stays, the least by a hash
    of all columns; very long texts are compared whole; an empty table stays empty; all columns are carried.
    """
    return simhash_dedup.keep_similar(docs, SIMILARITY, SHINGLE, RADIUS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; very long ones are searched whole; repeated rows stay or go alike; an empty table
    stays empty; all columns are carried, whatever they are called.
    """
    (hits,) = fresh(docs, "__hits")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), whole=True, name=hits).where(F.size(hits) == 0).select(*columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: none, once or twice. The unit is a whole document.

    Documents without words, null texts too, have nothing to take and go; a null source is a source; repeated rows are drawn
    alike; a very long document is one unit; an empty table stays empty; all columns are carried.
    """
    return mixing.mixed_documents(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `shard`, 0 to 15, by the hash tree over doc_id.

    Null ids share a shard, so do repeated rows; texts do not matter; an empty table stays empty; all columns are carried but
    one called shard, which is replaced.
    """
    return sharding.with_shard(docs, 16)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, job = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{job}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        kept_until_exit(spark, path)
        docs = spark.read.parquet(path)
    return docs
