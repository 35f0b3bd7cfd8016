"""Training-data pipeline over the documents table.

``STAGES`` are applied in order; each gets what the one before wrote as
Parquet.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, bwt_dedup, mixing, ngram_join, toxicity
from tracelake.llm.queries import documents, table
from tracelake.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer does not reject; labels are learnt from this stage's input."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.withColumnsRenamed({c: f"_kept_{c}" for c in ("score", "predicted") if c in docs.columns}), model).where("predicted = 0").select(*[F.col(f"`_kept_{c}`").alias(c) if c in ("score", "predicted") else F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at 0.8 or more."""
    return ngram_join.one_of_each(docs, n=5, threshold=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings of 200 bytes that occur more than once; n_chars follows."""
    cut = bwt_dedup.dedup_texts(docs, width=200)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix uses a document."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids in token_ids."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("bwt_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_texts),
]

#: SQL can't express the toxicity scorer or the encoder; tests hold the stages against brute force, each on what the one before kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
