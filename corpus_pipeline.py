"""From documents to shards of a training corpus, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents with the columns they came with; the
last one adds ``shard``. Stages are written as Parquet and read again one after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rtflow.llm.common import kept
from rtflow.llm.decontamination import without_contaminated
from rtflow.llm.mixing import mix
from rtflow.llm.near_join import without_near_copies
from rtflow.llm.sharding import with_shard
from rtflow.llm.toxicity import without_toxic

SHARDS = 24
#: Near copies: words of a shingle, and hundredths of Jaccard from which on documents link.
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores as toxic go."""
    return without_toxic(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id stays."""
    return without_near_copies(docs, SHINGLE, PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks for, some more than once."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document gets the shard of its id."""
    return with_shard(docs, ["doc_id"], SHARDS)


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL expresses neither the network nor the join's components nor random rounding; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = kept(docs)
    return docs
