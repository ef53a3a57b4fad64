"""A corpus pipeline of five stages: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes all that its predecessor kept, written as Parquet and read again; all but the last return the columns of ``documents``.

Defined results: a null or empty text fails the quality rules; rows without a doc_id, a language or a source go through all stages like others
(without a language they are compared with the whole corpus, and they are never near duplicates without a doc_id); rows that repeat a doc_id are documents of
their own, and of equal rows one stays; an empty table gives no rows; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm import line_dedup, mixing, near_duplicates, packing, quality
from hushlake.llm.queries import tokenizer_path
from hushlake.llm.shared import release, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counted rules and are not far from their language."""
    return quality.judge_quality(docs).where("kept").select(docs.columns)


def frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more hold; ``n_chars`` follows the text."""
    kept = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    new = {"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}
    return kept.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])


def near_duplicate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the first by doc_id."""
    return near_duplicates.one_of_each_class(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks, in random order: all sources weigh the same."""
    return mixing.mix_sources(docs).select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", frequent_lines),
    ("n-gram Jaccard join", near_duplicate_documents),
    ("mixing sources to target weights", source_mixture),
    ("best-fit packing", packed_sequences),
]

#: SQL has no MinHash bands, tokenizer or packing: the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the rows of the last one."""
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not source:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
