"""A training corpus from raw documents: five stages, each written and read again.

Each stage takes what the one before it kept, with the columns of ``documents`` and any
others. Nulls: a null text is an empty one, which the quality stage drops; a null doc_id
sorts first and is an id as any other. Rows that repeat doc_id and text are one document:
near_copies keeps all or none of them. Empty tables stay empty; long texts go through whole.
Tables that a stage writes on its way are deleted once its result is written.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from populace.llm import packing, quality, simhash, substring, toxicity
from populace.llm.common import collecting, discard, save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5 stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the verdict on their host stay."""
    return quality.passing(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first text of each near-copy component stays, under its smallest doc_id."""
    return simhash.without_near_copies(docs, similarity=0.8, width=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated paragraphs and passages go; a document that nothing is left of goes too."""
    cut = substring.cut(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = F.when(F.col("n_removed") == 0, F.col("doc.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": size}
    return left.select(*(new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences."""
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024, cache=60_000), capacity=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier, fingerprint components, MinHash or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        with collecting() as made:
            docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*made[:-1], *before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
