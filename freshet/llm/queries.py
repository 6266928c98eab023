"""One query per operator over its whole table, with SQL where it can be said.

Every query reads all rows and whole texts and derives the columns of its
contract from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.llm import exact_dedup, hard_negatives, language_id, mixing, near_dedup, neighbours, packing, pii, quality, runs, sentence_pieces, sharding
from freshet.llm import tokens, url_filter
from freshet.llm.common import WORD, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = exact_dedup.DigestIndex(spark).ingest(table(spark, sf_dir, "documents"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    return judged.select("doc_id", "keep_id", "group_size", "kept", sha)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept,
  text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = quality.learn(docs, labels.filter(~language_id.held_out("doc_id", 4, 2)))
    out = quality.predict(docs, field)
    held = F.coalesce(language_id.held_out("doc_id", 4, 2), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~language_id.held_out("doc_id", 5, 0)))
    out = language_id.predict(docs, model, keep=["doc_id"])
    held = F.coalesce(language_id.held_out("doc_id", 5, 0), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.groups(table(spark, sf_dir, "documents"), width=2, percent=80)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def gpt2_tokenizer() -> str:
    """The public byte-level tokenizer's JSON, read on the driver; about 1 MB."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = tokens.pieces(table(spark, sf_dir, "documents"), gpt2_tokenizer(), 2048)
    packed = packing.pack(cut, 2048, ["doc_id", "piece", "ids_crc32"])
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_pii(spark: SparkSession, sf_dir: str, key: str = "op9") -> DataFrame:
    out = pii.apply(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key)
    kinds = F.array_join(F.array_sort(F.array_distinct("spans.kind")), ",")
    return out.select("doc_id", "text", F.size("spans").cast("long").alias("n_values"), kinds.alias("kinds"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256)


def piece_model() -> bytes:
    """The public sentencepiece model, read on the driver; about 0.5 MB."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentence_pieces.decode(sentence_pieces.encode(docs, model).select("doc_id", "ids"), model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; one document in ten repeats its words from a place on (``op13``'s contract)."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
        return F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), F.flatten(again)), F.lit(1), n), " ")

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find(with_planted_runs(table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_neighbours": op3_neighbours,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_near_dedup": op7_near_dedup,
    "op8_packing": op8_packing,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_runs": op13_runs,
}

SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL}
