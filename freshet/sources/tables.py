"""JSON, grid and table inputs and the sinks (inventory A8 to A13)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from freshet.functions.scalars import null_if
from freshet.session import shared_dir

ARRAY_PAYLOAD = "data array<struct<meta: struct<name: string>, data: array<array<string>>>>"
ELEMENT_PAYLOAD = (
    "array<struct<stationTriplet: string, data: array<struct<stationElement: struct<elementCode: string>, "
    "values: array<struct<date: string, value: double>>>>>>"
)
ATTRIBUTE_PAYLOAD = "data array<struct<attributes: struct<dateTime: string, result: double>>>"


def flatten_station_json(df: DataFrame, payload: str, start: str, names: Sequence[str] = ("precip", "maxt")) -> DataFrame:
    """Station arrays whose dates are implied by position from ``start``.

    ``M`` is missing and ``T`` a trace.
    """
    parsed = df.withColumn("_j", F.from_json(payload, ARRAY_PAYLOAD))
    stations = parsed.withColumn("_s", F.explode("_j.data"))
    days = stations.select(
        *[c for c in df.columns if c not in (payload, start)],
        F.col("_s.meta.name").alias("station"),
        F.col(start).alias("_start"),
        F.posexplode("_s.data").alias("_pos", "_v"),
    )
    return days.select(
        *[c for c in days.columns if not c.startswith("_")],
        F.date_add("_start", F.col("_pos")).alias("date"),
        *[null_if(F.get("_v", i)).alias(n) for i, n in enumerate(names)],
    )


def flatten_element_json(df: DataFrame, payload: str) -> DataFrame:
    """Per station and element a list of dated values, as long rows."""
    parsed = df.select(F.explode(F.from_json(payload, ELEMENT_PAYLOAD)).alias("_s"))
    elements = parsed.select(F.col("_s.stationTriplet").alias("station"), F.explode("_s.data").alias("_e"))
    return elements.select(
        "station", F.col("_e.stationElement.elementCode").alias("element"), F.explode("_e.values").alias("_v")
    ).select("station", "element", F.to_date("_v.date").alias("date"), F.col("_v.value").alias("value"))


def flatten_attribute_json(df: DataFrame, payload: str, keep: Sequence[str] = ()) -> DataFrame:
    """``data[].attributes`` as long rows."""
    rows = df.select(*keep, F.explode(F.from_json(payload, ATTRIBUTE_PAYLOAD)["data"]).alias("_r"))
    return rows.select(*keep, F.to_date("_r.attributes.dateTime").alias("date"), F.col("_r.attributes.result").alias("value"))


def crop_grid(grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells inside a box; the bounds reach the scan as pushed filters."""
    return grid.where(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def scan_grid(spark: SparkSession, path: str, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """A9 from landed parquet."""
    return crop_grid(spark.read.parquet(path), lat, lon)


def read_history(prior: DataFrame, cv: DataFrame, value: str, key: str = "site", proxies: dict | None = None) -> DataFrame:
    """A10: prior and cross-validation rows without null values; a site may be
    replaced by a proxy id."""
    rows = prior.unionByName(cv, allowMissingColumns=True).dropna(subset=[value])
    for site, proxy in (proxies or {}).items():
        rows = rows.withColumn(key, F.when(F.col(key) == site, F.lit(proxy)).otherwise(F.col(key)))
    return rows


def read_metadata(meta: DataFrame, id_col: str, overrides: DataFrame | None = None, key: str = "site", width: int = 8) -> DataFrame:
    """Ids as zero-padded strings, with point updates by key."""
    out = meta.withColumn(id_col, F.lpad(F.col(id_col).cast("string"), width, "0"))
    if overrides is None:
        return out
    cols = [c for c in overrides.columns if c != key]
    new = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return (
        out.join(new, key, "left")
        .withColumns({c: F.coalesce(f"_{c}", c) for c in cols})
        .drop(*[f"_{c}" for c in cols])
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Parquet, partitioned for later pruning."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def _complete(spark: SparkSession, path: str) -> bool:
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _input_state(df: DataFrame) -> str:
    """Names, sizes and times of the files a plan reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    state = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        state.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(state)


def read_or_build(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    partition_by: Sequence[str] = (),
    version: str = "",
) -> DataFrame:
    """Reuse a complete table only when it came from the same plan and inputs.

    The path carries a hash of the plan and of the names, sizes and times of its
    input files, so neither a changed computation nor a rewritten input meets a
    stale table.  ``version`` stands for inputs that are not files.
    """
    df = build()
    said = f"{df.semanticHash()}\n{version}\n{_input_state(df)}"
    path = f"{shared_dir(spark)}/{name}-{hashlib.sha256(said.encode()).hexdigest()[:24]}"
    if not _complete(spark, path):
        write_table(df, path, partition_by)
    return spark.read.parquet(path)


def submission(pred: DataFrame, wanted: DataFrame, keys: Sequence[str], ordinal: str, how: str = "left") -> DataFrame:
    """Predictions on the requested rows, in the requested order."""
    cols = [*keys, "q10", "q50", "q90"]
    out = wanted.select(*keys, ordinal).join(pred.select(*cols), list(keys), how)
    return out.orderBy(ordinal)


def write_submission(pred: DataFrame, wanted: DataFrame, keys: Sequence[str], ordinal: str, path: str) -> str:
    """A13 to csv; range-sorted parts keep the requested order by file name."""
    submission(pred, wanted, keys, ordinal).drop(ordinal).write.mode("overwrite").csv(path, header=True)
    return path
