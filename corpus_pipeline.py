"""The corpus pipeline: quality rules, exact and near de-duplication, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows that the next stage reads, with the columns of ``documents``.
The last stage returns the placement of every piece of every document that is
left.  ``ORACLE_SQL`` is None: SQL has no XXH64, so the tests hold ``run`` against a
brute-force version.

Every stage decides per row: a row with a null doc_id, or with the id of another,
is a document like any other.  A null text is an empty one and fails the quality
rules.  Repeated rows are copies; of equal ones, one stays.  Columns beyond those of
``documents`` go through, whatever their names.  An empty table gives an empty
placement.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillet.llm import block_naming, mixing, packing, quality_rules, simhash
from quillet.llm.common import delete_folder, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return block_naming.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written as Parquet and read again.

    A stage's table goes once the next one is written; the last one stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_folder(spark, before)
        before = path
    return docs
