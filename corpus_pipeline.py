"""The corpus pipeline: quality rules, near duplicates, benchmark leaks, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.byte_bpe import encode_digests
from waymark.llm.common import read_table, written
from waymark.llm.decontaminate import without_leaks
from waymark.llm.host_quality import keep_good
from waymark.llm.pii_crf import mask_pii
from waymark.llm.simhash import keep_one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: their own rules and their host's verdict.

    A null, empty or blank text has no words and goes. Equal rows have one verdict, so all stay or go. A null source is a
    host of its own. An empty table stays empty.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, of equal ids the smallest text hash.

    Of equal rows one stays. Null, empty and blank texts are one group. A null doc_id stays only in a group without any
    other. An empty table stays empty.
    """
    return keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, by question and answer.

    Null and empty texts hold none and stay; equal rows stay or go together. Empty items match nothing. With an empty
    table on either side the documents stay as they are.
    """
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets masked; n_chars is the new length.

    A null text stays null, an empty one empty; every row stays, repeated ones too. Of spans that overlap, the first gives
    the mask. An empty table stays empty.
    """
    return mask_pii(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids and of what they decode to: a row for each row.

    A null text counts as empty and has no ids. A null doc_id stays null; repeated rows each give a row. An empty table
    gives none.
    """
    return encode_digests(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("pii", masked),
    ("byte_bpe", tokens),
]
#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
