"""From raw documents to packed training sequences, stage by stage.

Every stage reads all that the one before kept. The last returns a row for each piece of a
sequence, with its token ids; the others return documents.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agentmeter.llm import decontaminate, nearcopies, packing, quality, secrets
from agentmeter.llm.common import land, table

#: The quality classifier, the tokenizer and the learnt models follow the input, so SQL can't state the rows.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    return quality.accepted(docs, table(spark, directory, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return nearcopies.one_of_each(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents without the passages they share with test items."""
    return decontaminate.remove(docs, table(spark, directory, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Documents with a mark in the place of every secret."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """Token sequences of at most 4096 ids, a row for each piece of a document."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmarks", remove_benchmarks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, directory: str) -> DataFrame:
    """All stages over the documents; each stage's rows are landed before the next reads them."""
    docs = table(spark, directory, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, directory), name)
    return docs
