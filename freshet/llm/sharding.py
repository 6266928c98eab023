"""Reproducible shuffle into shards by a keyed permutation of row numbers.

Rows are numbered in the order of (id, size, checksum) over the whole table; the
permuted number p gives shard ``p % shards`` and slot ``p // shards``, so shard
and slot of any row can be computed, and undone, from its number alone.  The law
is ``rows``: shard counts differ by one at most and slots have no gaps.

Defined results: a null text has no bytes and checksum of the empty text; null
ids sort first; rows that agree in id, size and checksum may swap places; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import numbered
from freshet.llm.feistel import permute


def shard(docs: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    facts = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    rows = numbered(facts, ["doc_id", "size", "text_crc32"])
    total = rows.count()
    p = permute(F.col("row_number"), F.lit(total), F.lit(seed))
    placed = rows.withColumn("_p", p)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("_p") % shards).cast("int").alias("shard"),
        ((F.col("_p") - F.col("_p") % shards) / shards).cast("long").alias("slot"),
    )
