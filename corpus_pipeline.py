"""A corpus pipeline: quality, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``. A stage's
table is deleted once the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moraine.llm.common import alone, remove, table
from moraine.llm.language import filter_language
from moraine.llm.mixing import mixed_rows
from moraine.llm.packing import pack_documents
from moraine.llm.quality import filter_quality
from moraine.llm.token_groups import drop_near_duplicates

#: Languages and near duplicates can't be decided by SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, cache_words=250_000)  # workers keep memory of the stages before


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)  # still reads the table of the stage before
        docs, now = alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            remove(before)
        before = now
