"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "freshet", **conf) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named in ``spark.checkpoint.dir``.

    Only where the setting is absent (a local test session) is a temporary
    folder made and remembered on the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def run_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives executor loss."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


#: Bytes of a stored table that one task of a shuffle takes.
PART_BYTES = 8 << 20


def parts_of(spark: SparkSession, path: str) -> int:
    """Tasks for a shuffle of a stored table's rows, by its size, so that a task's memory does not grow with the table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    size = files.getContentSummary(place).getLength()
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def spread(df: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """Hash-partition by key before a Python step over groups or a step that holds many short rows.

    Python work and memory are not proportional to bytes, so these shuffles must not
    be coalesced by size; the grouping reuses this partitioning. ``least``: tasks that
    the rows' table asks for (:func:`parts_of`).
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)
    return df.repartition(n, *by)
