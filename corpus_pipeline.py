"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``. Each stage works on every row that its predecessor kept, over whole texts. Empty
tables give empty results, extra columns are carried along whatever their names, and null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aerolattice.llm import bpe, exact_dedup, mixing, setsketch, toxicity
from aerolattice.llm.common import stored, table
from aerolattice.llm.queries import tokenizer_path

#: Similarity from which the near-duplicate stage links documents, in percent.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Rows are judged one by one: repeated ones alike, null and empty
    texts stay, and a probability of exactly the threshold stays."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays: the longest original, then the smallest id, null last. Of rows
    repeated with one id and text one stays; of all empty texts one stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Texts without words and null ids
    have no near copies and stay; rows repeated with one id and text stay or go together."""
    return setsketch.drop_near_copies(docs, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times. Ties are broken by seeded keys of the ids; null
    sources and languages are leaves of their own."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each row; an empty text has no tokens."""
    return bpe.encode(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact),
    ("minhash_near_dedup", drop_near),
    ("source_mixing", mix_sources),
    ("bpe", encode),
]
#: Trained weights, near-duplicate components and BPE merges aren't expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
