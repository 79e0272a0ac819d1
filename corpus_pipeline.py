"""From raw documents to token ids: quality, exact copies, near copies, source mixing, BPE.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents.

Every stage works on all rows that its predecessor kept. Defined results: a null text counts as empty, and empty texts are scored, deduplicated,
mixed (size 0) and encoded (no ids) like any other; a null doc_id is a document of its own; different texts that share a doc_id are different
documents; of rows that repeat both, one stays, the same on each run; ties go to the smallest doc_id; very long texts are read whole; an empty
table gives an empty result with the same columns; extra columns pass through, whatever their names, but for token_ids and decoded, which the last
stage sets. After mixing, a document's row may come twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jagspark.llm import bpe, exact_dedup, mixing, quality, simhash
from jagspark.llm.common import stored, table

def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labels and the documents given."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id.

    Near copies are texts whose five-word shingles agree to four fifths or more. One fingerprint within op1's 3 bits finds one such pair in
    ten; eight fingerprints of the distinct words, each within 3 bits, propose nearly all (figures in the README), and the similarity of the
    whole texts' five-word shingles then decides each link.
    """
    return simhash.keep_one_of_each(docs, simhash.near_copies(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with token_ids and decoded, the text that these ids decode to."""
    return bpe.encoded(docs, decoded="decoded")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: The classifier's scores are not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
