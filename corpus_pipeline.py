"""A training corpus in five stages, each an operator of ``freshet.llm``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame.  Its result is written
as Parquet and read again as the next stage's documents.  All but the last return
the columns of documents; the last returns the place of every token piece.

Defined results: a stage given no documents returns none; null texts have no
language and go in the first stage; the other cases are those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm import language_id, mixing, near_dedup, packing, tokens
from freshet.llm.common import landed, table
from freshet.llm.exact_dedup import DigestIndex
from freshet.llm.queries import gpt2_tokenizer

CAPACITY = 2048

#: Units that a packing worker remembers in a generation, and the text it cuts at once: an idle
#: worker keeps them beside the executor's other stages, so less than ``tokens`` does alone.
REMEMBERED, SLICE_BYTES = 100_000, 2 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter, or no language that is likelier than all others together."""
    judged = language_id.predict(docs, language_id.learn(docs), names=("__lang", "__score"))
    known = judged.filter((F.col("__lang") != language_id.UNKNOWN) & (F.col("__score") > 0.5))
    return known.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, white space aside."""
    return DigestIndex(spark).survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8 or more stays."""
    return near_dedup.survivors(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target of words; a document comes once for each pass over it."""
    return mixing.documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixed documents and their places in sequences of 2048 tokens."""
    cut = tokens.pieces(docs, gpt2_tokenizer(), CAPACITY, remembered=REMEMBERED, slice_bytes=SLICE_BYTES)
    return packing.pack(cut, CAPACITY, ["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Code lengths, MinHash and byte-pair tokens cannot be said in SQL; the tests
#: compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
