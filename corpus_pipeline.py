"""A training corpus from ``documents``: five stages, each the operator of one module of ``ledgerlens.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm.decontamination import clean_texts
from ledgerlens.llm.language_id import keep_known_language
from ledgerlens.llm.mixing import mixed_documents
from ledgerlens.llm.ngram_join import one_text_of_each
from ledgerlens.llm.runtime import cut, table
from ledgerlens.llm.token_output import token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; the others go."""
    return keep_known_language(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_text_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return clean_texts(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture, as often as its epochs take them."""
    return mixed_documents(docs)


#: Chunks and words a tokenizing worker keeps, and bytes it encodes at once: it shares its executor with
#: a heap that earlier stages have filled.
TOKEN_CACHE, TOKEN_PIECE = (30_000, 60_000), 1 << 18


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, described by document."""
    return token_output(spark, docs, cache=TOKEN_CACHE, piece_bytes=TOKEN_PIECE)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", tokens),
]

#: Language models, near duplicates and a tokenizer have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
