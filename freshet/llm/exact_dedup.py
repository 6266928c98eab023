"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch is reduced to one
row per digest, anti-joined with the index by sort-merge (the index side is
neither shuffled nor sorted again) and what is new is appended.

Texts are equal when they are identical after deleting the characters space and
9 to 13.  Defined results: null text counts as empty; of equal texts the row with
the most code points in the original text stays, then the smallest id, a null id
last; of rows that agree in all of this exactly one stays; an empty batch gives
no rows; other columns of the batch are ignored by ``ingest`` and kept as they
are by ``survivors``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from freshet.llm.common import SPACE, landed, lookup, once
from freshet.session import run_path


def normalised(text: str | Column) -> Column:
    """The text without white space; null becomes empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", "")


def digest(text: str | Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


class DigestIndex:
    """Digests seen so far: (digest, keep_id, batch), bucketed and sorted by digest.

    ``path`` is the table's folder and must be seen by all executors; by default it
    lies in the shared folder, under a new name.  ``buckets`` is fixed when the index
    is made and kept beside the folder, so an index that another session made is
    opened as it is: opening only tells this session's catalog of the files.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        self.path = path or run_path(spark, self.name)
        self.buckets = self._settled(buckets)
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
            )

    def _settled(self, wanted: int | None) -> int:
        """The bucket count kept beside the index; a new index keeps the one wanted."""
        beside = f"{self.path}.buckets"
        if _exists(self.spark, beside):
            kept = self.spark.read.schema("buckets int").parquet(beside).first()["buckets"]
            if wanted not in (None, kept):
                raise ValueError(f"the index has {kept} buckets")
            return kept
        if _exists(self.spark, self.path):
            raise ValueError(f"{self.path} holds files but no bucket count stands beside it")
        wanted = wanted or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.createDataFrame([(wanted,)], "buckets int").write.parquet(beside)
        return wanted

    def drop(self) -> None:
        """Forget the index and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        for path in (self.path, f"{self.path}.buckets"):
            _file_system(self.spark, path)[0].delete(_file_system(self.spark, path)[1], True)

    def _append(self, rows: DataFrame) -> None:
        dealt = rows.repartition(self.buckets, "digest")
        writer = dealt.write.format("parquet").mode("append").option("path", self.path)
        writer.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_id: str | None = None) -> DataFrame:
        """One row per row of the batch: id, keep_id, group_size, kept, digest.

        ``group_size`` counts the batch's rows of that digest.  A digest that an
        earlier batch brought keeps that batch's ``keep_id`` and no row of this
        one.  Repeating a batch under its ``batch_id`` gives the same rows.
        """
        batch_id = batch_id or uuid.uuid4().hex
        facts = landed(
            batch.select(
                F.col(id_col).alias("doc_id"),
                digest(text_col).alias("digest"),
                F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
                F.monotonically_increasing_id().alias("_row"),
            ),
            "digests",
        )
        best = F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))
        groups = facts.groupBy("digest").agg(best.alias("_best"), F.count("*").alias("group_size"))
        groups = landed(
            groups.select("digest", "group_size", F.col("_best.doc_id").alias("_id"), F.col("_best._row").alias("_keep_row")),
            "digest-groups",
        )
        new = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        self._append(new.select("digest", F.col("_id").alias("keep_id"), F.lit(batch_id).alias("batch")))
        known = groups.join(self.rows().hint("merge"), "digest").select(
            "digest",
            "keep_id",
            "group_size",
            F.when(F.col("batch") == batch_id, F.col("_keep_row")).alias("_keep_row"),
        )
        judged = lookup(facts, known, ["digest"], "group_size")
        kept = F.coalesce(F.col("_row") == F.col("_keep_row"), F.lit(False))
        return judged.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")

    def survivors(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_id: str | None = None) -> DataFrame:
        """The rows of the batch that stay, with all their columns."""
        kept = self.ingest(batch, id_col, text_col, batch_id).filter("kept")
        kept = kept.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_key"))
        most = [F.length(F.coalesce(F.col(text_col), F.lit(""))).desc()]
        return once(batch, kept, id_col, digest(text_col), most)
