"""From raw documents to packed training sequences, stage by stage.

Every stage takes the rows that the one before kept, with all their columns, and
all but the last return the columns of documents, extra ones among them, whatever
their names. A doc_id that is no integer is refused; an empty table passes
through empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import mixing, packing, quality, simhash, substring
from tidelog.llm.common import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail their own rules or whose host is refused.

    A null or empty text has no words and goes; a null source has no host to be
    refused with; repeated rows are judged one by one, a null doc_id like any other.
    """
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of similar documents: five-word shingles, Jaccard 0.8 or more.

    Rows without a doc_id stay; rows of one doc_id stay or go each by its own text,
    equal rows together; texts without a word are similar to each other.
    """
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words and more that a document with a smaller doc_id has out of the text; who loses every word goes.

    A null doc_id is larger than any other; rows of one doc_id cut nothing from each
    other; null and short texts stay as they are.
    """
    return substring.cut_repeats(docs)


def target_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so often that domains have their target shares of tokens; toxic text has none.

    A null or empty text has no tokens and the rate of its style; a null doc_id has
    its rate rounded; without labels every rate is 1.
    """
    return mixing.mix(docs, mixing.label_domains(table(spark, sf_dir, "labels")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document into sequences of the model's length, as `packing.pack_documents` does: a null text is its closing id alone, repeated rows are documents of their own."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing to target weights", target_mixing),
    ("best-fit packing", best_fit_packing),
]

#: SimHash, the classifier and the tokeniser are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each result is a table in the shared folder that the next stage reads, and goes once that one is written; the last of them stays, as the result reads it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
