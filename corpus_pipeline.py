"""A corpus-cleaning pipeline of training-data operators, each stage written and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but
the last return the columns of documents. run() applies them to the documents of a folder.

1. toxicity: documents that the model rejects go.
2. near-duplicates: the first document of each class stays.
3. decontamination: documents that hold too much of the benchmark go.
4. secrets: findings are cut out of the texts; every document stays.
5. packing: the texts' pieces with their sequence and place.

No SQL says the same (fitted models, alignment, a tokenizer's merges), so ORACLE_SQL is None and
the stages are tested against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import materialise, ship_package
from folioscope.llm.contamination import without_contaminated
from folioscope.llm.near_duplicates import without_near_duplicates
from folioscope.llm.packing import pack
from folioscope.llm.secrets import redacted
from folioscope.llm.toxicity import without_toxic

ORACLE_SQL: str | None = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, spaced=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
