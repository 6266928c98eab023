"""Hard negatives from labelled vectors by exact integer products.

Components are scaled and floored to integers.  A block of rows is Kronecker-packed:
the same component of several rows, biased to be non-negative, lies in separated
fields of one wide integer.  One multiplication by an anchor's component serves all
fields; the sums over the components, with an offset that makes every field
non-negative, are unpacked into exact scores.  The fields are as wide as the largest
score needs, so as many rows share an integer as fit.  Where two fields do not fit
into 63 bits the same steps run on Python's integers of any width.

Anchors and rows are dealt out in chunks of a bounded number of components, and one
task at a time scores a chunk of anchors against a chunk of rows, so every anchor
meets every row without a join on a label or id that may be hot.  A chunk gives the
few best per anchor; these are merged by rank.  The positives come first (rows of an
anchor's label only), then the negatives, whose range depends on the positive's score.

Defined results: rows with a null label, a null or empty vector, a null or non-finite
component, or another number of components than most rows (of two lengths as frequent
the smaller) take no part; only an anchor's own row is left out of its candidates, so
repeated rows are candidates for each other and repeated anchors count one by one; ties
go to the smaller id, a null id last; scaled components and scores that no long holds
count as the nearest long; fewer candidates give all of them and an anchor without
positives or negatives no rows; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.llm.common import landed, lookup
from freshet.session import spread

#: Components in a chunk of rows, and of anchors; rows that are scored at once.
ROW_CHUNK, ANCHOR_CHUNK, TILE = 1 << 19, 1 << 15, 16
#: Fields of an integer of any width.
WIDE_FIELDS = 32
LIMIT = (1 << 63) - 1
NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Fields:
    """How rows share an integer: the bias, a field's width in bits, their number, and the largest sum in a field."""

    low: int
    width: int
    count: int
    most: int

    @staticmethod
    def fitting(low: int, high: int, weight: int) -> Fields:
        """For rows with components from low to high and anchors whose components sum to at most ``weight``, signs aside."""
        most = max(1, weight * (high - low))
        width = (2 * most).bit_length()
        plain = width <= 63 and weight * max(abs(low), abs(high)) < 1 << 62
        return Fields(low, width, 63 // width if plain else WIDE_FIELDS, most)

    @property
    def kind(self) -> type:
        return np.int64 if self.width * self.count <= 63 else object

    def pack(self, rows: np.ndarray) -> np.ndarray:
        """Components x integers; field f of integer j holds row f * integers + j."""
        n, dims = rows.shape
        words = -(-n // self.count)
        biased = np.zeros((self.count * words, dims), self.kind)
        biased[:n] = rows.astype(self.kind) - self.low
        out = np.zeros((dims, words), self.kind)
        for f in range(self.count):
            out += biased[f * words : (f + 1) * words].T << (f * self.width)
        return out

    def scores(self, anchors: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
        """The inner products of anchors and the n packed rows."""
        anchors = anchors.astype(self.kind)
        total = np.full((len(anchors), packed.shape[1]), sum(self.most << (f * self.width) for f in range(self.count)), self.kind)
        product = np.empty_like(total)
        for d in range(packed.shape[0]):
            np.multiply(anchors[:, d, None], packed[d], out=product)
            total += product
        mask = (1 << self.width) - 1
        parts = [(total >> (f * self.width)) & mask for f in range(self.count)]
        out = np.concatenate(parts, axis=1)[:, :n]
        out += (anchors.sum(axis=1) * self.low - self.most)[:, None]
        return out if self.kind is np.int64 else _long(out)


def _long(values: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(values, -LIMIT), LIMIT).astype(np.int64)


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of both columns, equal where the values are."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    code = both.indices.to_numpy()
    return code[: len(a)], code[len(a) :]


def _best(scores: np.ndarray, k: int):
    """(line, column, score) of the k largest of each line, ``NONE`` aside; the first column of equal ones.  Empties them."""
    lines = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        value = scores[lines, at]
        found = np.flatnonzero(value != NONE)
        if not len(found):
            return
        yield found, at[found], value[found]
        scores[lines, at] = NONE


def _chunk_step(fields: Fields, id_type: pa.DataType, pick, names: list[str]):
    """The step on one chunk of anchors and one of rows; ``pick`` chooses from a block of scores."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        got: list[tuple] = []
        if anchors.num_rows and rows.num_rows:
            rows = rows.sort_by([("_id", "ascending"), ("_row", "ascending")])
            n = rows.num_rows
            packed = fields.pack(_matrix(rows["_v"], n))
            asked = _matrix(anchors["_v"], anchors.num_rows)
            own = anchors["_row"].to_numpy()
            labels = _codes(anchors["_label"], rows["_label"])
            other = rows["_row"].to_numpy()
            lists = anchors["_positive_scores"].to_pylist() if "_positive_scores" in anchors.column_names else None
            for first in range(0, len(own), TILE):
                part = slice(first, first + TILE)
                block = fields.scores(asked[part], packed, n)
                same = labels[0][part, None] == labels[1][None]
                for line, column, score, nth in pick(block, same, own[part, None] == other[None], lists and lists[part]):
                    got.append((own[part][line], nth, column, score))
        join = lambda i: np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64)
        at = pa.array(join(2))
        taken = [rows["_id"].take(at), rows["_row"].take(at)] if got else [pa.array([], id_type), pa.array([], pa.int64())]
        return pa.Table.from_arrays([pa.array(join(0), pa.int64()), pa.array(join(1), pa.int32()), *taken, pa.array(join(3), pa.int64())], names=names)

    return run


def _positives(k: int):
    def pick(block, same, own, _):
        block[~same | own] = NONE
        for line, column, score in _best(block, k):
            yield line, column, score, np.zeros(len(line), np.int32)

    return pick


def _negatives(k: int, low: int, high: int):
    def pick(block, same, own, lists):
        block[same | own] = NONE
        for nth in range(max(map(len, lists))):
            has = np.array([i for i, p in enumerate(lists) if len(p) > nth])
            p = np.array([lists[i][nth] for i in has], object)
            least, most = _long(-(-low * p // 100)), _long(high * p // 100)
            mine = block[has]
            mine[(mine < least[:, None]) | (mine > most[:, None])] = NONE
            for line, column, score in _best(mine, k):
                yield has[line], column, score, np.full(len(line), nth, np.int32)

    return pick


def _dealt(df: DataFrame, parts: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64("_row"), parts).cast("int"))


def _each(df: DataFrame, parts: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))


def _scored(anchors: DataFrame, rows: DataFrame, keys: list[str], step, schema: str) -> DataFrame:
    anchors = anchors.toDF(*anchors.columns)  # both sides come from one table
    return spread(anchors, keys).groupBy(*keys).cogroup(spread(rows, keys).groupBy(*keys)).applyInArrow(step, schema)


def _first(partial: DataFrame, by: list[str], k: int) -> DataFrame:
    """Rank 1 to k by score, ties to the smaller id."""
    window = Window.partitionBy(*by).orderBy(F.desc("_score"), F.asc_nulls_last("_id"), "_other")
    return partial.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= k)


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of the same label; for each of them
    come the best rows of other labels whose score is ``low`` to ``high`` percent of
    the positive's.
    """
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    fit = F.col(label_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & finite
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    found = rows.filter(fit).select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(id_col).alias("_id"),
        F.col(label_col).alias("_label"),
        scaled.alias("_v"),
        F.coalesce(is_anchor, F.lit(False)).alias("_anchor"),
    )
    found = landed(found, "scaled")
    id_kind = found.schema["_id"].dataType.simpleString()
    schema = f"anchor_id {id_kind}, positive_id {id_kind}, rank int, negative_id {id_kind}, positive_score long, negative_score long"
    usual = found.groupBy(F.size("_v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if usual is None:
        return rows.sparkSession.createDataFrame([], schema)
    found = found.filter(F.size("_v") == usual["dims"])
    weight = F.when(F.col("_anchor"), F.aggregate("_v", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + F.abs(x.cast("decimal(20,0)"))).cast("decimal(38,0)")))
    facts = found.agg(
        F.min(F.array_min("_v")).alias("low"), F.max(F.array_max("_v")).alias("high"), F.max(weight).alias("weight"),
        F.count("*").alias("n"), F.count_if("_anchor").alias("anchors"),
    ).first()
    if not facts["anchors"]:
        return rows.sparkSession.createDataFrame([], schema)
    fields = Fields.fitting(facts["low"], facts["high"], int(facts["weight"]))
    row_chunk, anchor_chunk = max(64, ROW_CHUNK // usual["dims"]), max(TILE, ANCHOR_CHUNK // usual["dims"])

    partial = f"_row long, _nth int, _id {id_kind}, _other long, _score long"
    id_type = _arrow_type(found, "_id")
    names = ["_row", "_nth", "_id", "_other", "_score"]
    chunks = lambda n, size: F.ceil(n / size).cast("int")

    sizes = found.groupBy("_label").agg(F.count("*").alias("_n"), F.count_if("_anchor").alias("_m"))
    sized = lookup(found, sizes.filter("_m > 0"), ["_label"], "_n").filter("_m > 0")
    r, a = chunks(F.col("_n"), row_chunk), chunks(F.col("_m"), anchor_chunk)
    kin = _each(_dealt(sized, r, "_r"), a, "_a")
    askers = _each(_dealt(sized.filter("_anchor"), a, "_a"), r, "_r")
    columns = ["_row", "_id", "_label", "_v", "_r", "_a"]
    step = _chunk_step(fields, id_type, _positives(positives), names)
    best = _first(_scored(askers.select(columns), kin.select(columns), ["_label", "_a", "_r"], step, partial), ["_row"], positives)
    best = landed(best.select("_row", F.col("_id").alias("_positive"), F.col("_score").alias("_positive_score"), (F.col("_rank") - 1).alias("_nth")), "positives")

    lists = best.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_nth", "_positive_score"))).alias("_l"))
    lists = lists.select("_row", F.col("_l._positive_score").alias("_positive_scores"))
    r, a = F.lit(-(-facts["n"] // row_chunk)), F.lit(-(-facts["anchors"] // anchor_chunk))
    others = _each(_dealt(found, r, "_r"), a, "_a").select(columns)
    askers = _each(_dealt(found.filter("_anchor").join(lists, "_row"), a, "_a"), r, "_r").select(*columns, "_positive_scores")
    step = _chunk_step(fields, id_type, _negatives(negatives, low, high), names)
    hard = _first(_scored(askers, others, ["_a", "_r"], step, partial), ["_row", "_nth"], negatives)
    hard = hard.join(best, ["_row", "_nth"]).join(found.filter("_anchor").select("_row", F.col("_id").alias("_anchor_id")), "_row")
    return hard.select(
        F.col("_anchor_id").alias("anchor_id"), F.col("_positive").alias("positive_id"), F.col("_rank").alias("rank"),
        F.col("_id").alias("negative_id"), F.col("_positive_score").alias("positive_score"), F.col("_score").alias("negative_score"),
    )


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)
