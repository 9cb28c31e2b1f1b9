"""A pipeline over `documents`: quality rules, line dedup, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame. All but the
last return the columns of `documents`; n_chars follows the text.

Null and empty texts have too few words and go with the first stage. Rows with a null doc_id are documents of their
own; rows with one doc_id are one document to line dedup, and near-duplicates keep one row of equal ones. Of a group of
near-duplicates the smallest doc_id stays, a null one counting as the smallest. Texts of any length pass whole. An
empty table gives no rows. Extra columns pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinetable.llm import line_dedup, packing, pii, quality, simhash
from cinetable.llm.common import discard, settled
from cinetable.llm.queries import documents, tokenizer_file


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters in at least 3 documents stay in the last of these only."""
    return _recounted(line_dedup.drop_shared_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id."""
    return simhash.keep_one_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the name of its kind."""
    return _recounted(pii.redact_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and the sequences of at most 1024 tokens that hold them."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", drop_lines), ("near_dedup", near_duplicates), ("pii", redact), ("packing", pack)]
#: The conditional random field and the tokenizer can't be put in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    done: DataFrame | None = None
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if done is not None:
            discard(before)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
