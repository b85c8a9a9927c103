"""A corpus from documents: good texts, one of each near-duplicate group, none from the benchmark, mixed and sharded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. What a stage needs on disk goes with it: run() drops a
stage's input once its output is written, and the operators drop their own tables. The mix draws at random (reproducibly),
which SQL does not express: every stage is tested on the output of the one before, the first three against brute-force
versions, the mix against its targets and the documents' sizes, the shards against the hash rule in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import Staged, passing, table
from quernstone.llm.decontam import decontaminate
from quernstone.llm.mixing import repeat_rows
from quernstone.llm.ngram_join import keep_one
from quernstone.llm.quality import POLICIES, keep_good
from quernstone.llm.sharding import equal_weights, shard

SHARDS = 24
#: Near duplicates share this part of their shingles of so many words.
SHINGLE, SIMILAR = 5, (8, 10)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, POLICIES["v1"])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, SHINGLE, *SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the shard of each; copies of a document share its shard."""
    return shard(docs, "doc_id", equal_weights(SHARDS))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with passing() as scope:
            made = Staged(stage(spark, docs, sf_dir))
            docs = scope.keep(made)
        if last:
            last.drop()
        last = made
    return docs
