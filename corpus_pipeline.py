"""A corpus pipeline over documents: language, lines, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, whatever others it is given. SQL can't express the first stage, so there is no ORACLE_SQL; the tests
hold the stages against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm import bpe, language, lines, minhash, mixing
from keepstone.llm.common import stash

#: Near-duplicates here have a similarity of 0.8 or more; at 0.8 buckets of 4 values miss 5e-8 of the links.
NEAR = {"percent": 80, "bands": 32, "rows": 4}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters or too far from every centroid go.

    Null and empty texts go. Texts are judged whole and each row alone, so repeated rows share a fate; null ids and
    languages stay as they are. Ties go to the language first in the alphabet. From an empty table, or one
    without a labelled row to learn from, nothing stays.
    """
    judged = language.identify(docs, language.fit_model(docs), keep=COLUMNS)
    return judged.where("NOT rejected").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that many sources share, but for their first place; documents of which nothing is left go.

    Null texts, and texts without such lines, stay as they are, n_chars too. A line stays at its first place in the
    document of the smallest id (null ids last; repeated rows of that id all keep it). Null sources are no sources.
    """
    cleaned = lines.remove_boilerplate(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one of the smallest id.

    Rows of one id all stay or all go; rows without an id stay. Null and empty texts are linked with nothing and stay.
    Whole texts are compared; a similarity of exactly 0.8 links.
    """
    return minhash.keep_one(docs, **NEAR).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the Poisson draw for their source says, in random order.

    The draw follows from the id, so repeated rows are drawn alike, and a null id counts as the empty text. A null
    source is one of its own. Texts aren't looked at.
    """
    return mixing.mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to.

    Whole texts, row by row: repeated rows give repeated results; null and empty texts have no tokens; null ids stay null.
    """
    return bpe.encode_documents(docs, bpe.default_tokenizer(), decoded=False)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("source_mix", mix_sources),
    ("bpe_encode", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
