"""A corpus pipeline: quality, exact copies, near copies, mixing, tokens.

Ids may repeat or be null: stages that decide about rows number them first and hand decisions back by number.
Each stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. Rows keep the columns of
documents until the last stage, which gives one row per document of the mix (as often as the mix takes it).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe, exact, mixing, quality, simhash
from kestrel.llm.queries import bpe_digests
from kestrel.llm.shared import ROW, keep, numbered


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good; whole texts of all rows are scored.

    A null text counts as empty, null language, source and n_chars are values of their own, rows without an id are scored
    like any other, equal rows fare alike, and an empty table gives none. Columns are those of docs, whatever they
    are called.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(quality.good()).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (runs of spaces count as one): of those with the smallest id.

    A null text counts as empty. A null id comes after all others. Of rows that repeat id and text one stays. An
    empty table gives none. Columns are those of docs.
    """
    rows = numbered(docs, "exact-rows")
    return exact.first_copies(rows, exact.exact_duplicates(rows), by=ROW).drop(ROW)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id.

    Texts without words are near copies of each other. A null id comes after all others, of rows that repeat an id one
    stays, and an empty table gives none. Columns are those of docs.
    """
    rows = numbered(docs, "simhash-rows")
    return simhash.one_of_each(rows, simhash.near_duplicates(rows), by=ROW).drop(ROW)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to weights 5, 2, 1 takes them; one cut in part is taken whole.

    A null source is one of its own, the last; a document without words is not taken; rows that repeat are taken row by
    row; null ids share a random key; an empty table gives none. Columns are those of docs.
    """
    rows = numbered(docs, "mix-rows")
    return mixing.mixed_documents(rows, mixing.mix_sources(rows), by=ROW).drop(ROW)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, one row for each row.

    A null or empty text has no tokens; ids may repeat or be null; an empty table gives none.
    """
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe_digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mix_to_weights),
    ("byte-level BPE encoding and decoding", byte_bpe),
]

#: SQL has neither the classifier's fit nor XXH64 and BPE; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = keep(docs, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
