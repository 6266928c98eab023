"""Steps that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from freshet.session import run_path

#: White space of the word and text contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: A key counts as hot when it holds more than one part in so many of the rows.
HOT_PARTS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write to a new table in the shared folder and read it back.

    Cuts the lineage with files that every executor sees, so a lost executor
    costs a reread and never another result of a nondeterministic step.
    """
    path = run_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Left join of ``rows`` to ``found`` (one row per key) that no hot key can stall.

    ``weight`` counts the rows of each key.  Keys with more than 1/1000 of all
    rows number less than 1000 and are broadcast; their rows then carry a salt
    that matches nothing, which deals them evenly through the ordinary join of
    the other keys.  Keys compare null-safe.  ``weight`` stays in the result.
    """
    values = [c for c in found.columns if c not in keys]
    total = found.agg(F.sum(weight)).first()[0] or 0
    hot = found.filter(F.col(weight) * HOT_PARTS > F.lit(total))
    hot = hot.select(
        *[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)],
        F.struct(*values).alias("_hot"),
    )
    cold = found.select(
        *[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)],
        F.struct(*values).alias("_cold"),
        F.lit(0).cast("long").alias("_none"),
    )
    same_hot = _all(F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys))
    same_cold = _all(F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys))
    salt = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(1 + F.monotonically_increasing_id() % 1_000_003)
    marked = rows.join(F.broadcast(hot), same_hot, "left").withColumn("_salt", salt.cast("long"))
    both = marked.join(cold, same_cold & (F.col("_salt") == F.col("_none")), "left")
    got = F.coalesce("_hot", "_cold")
    return both.select(*[F.col(c) for c in rows.columns], *[got[v].alias(v) for v in values])


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def numbered(df: DataFrame, order: list[str | Column], name: str = "row_number") -> DataFrame:
    """Global row numbers 0, 1, ... in the order given, without a global window.

    A range shuffle sorts the rows over all tasks; each task numbers its own and
    a broadcast of one offset per task makes the numbers global.  Equal rows are
    told apart by their place in the input, so a value that a third of the rows
    share is split like any other range.  The sorted rows are written first, so
    the ranges are drawn once.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    at = landed(df.withColumn("_at", F.monotonically_increasing_id()), "unnumbered")  # read twice: for the ranges, then to sort
    dealt = at.repartitionByRange(n, *by, F.col("_at")).sortWithinPartitions(*by, F.col("_at"))
    put = landed(dealt.drop("_at").withColumn("_mono", F.monotonically_increasing_id()), "numbered")
    put = put.withColumn("_task", F.shiftright("_mono", 33).cast("int"))
    counts = sorted(put.groupBy("_task").count().collect())
    offsets, total = [], 0
    for task, count in counts:
        offsets.append((task, total))
        total += count
    known = spark.createDataFrame(offsets, "_task int, _offset long")
    place = F.col("_offset") + F.col("_mono").bitwiseAND((1 << 33) - 1)
    return put.join(F.broadcast(known), "_task").select(*df.columns, place.alias(name))


def once(rows: DataFrame, wanted: DataFrame, id_col: str, key: Column, order: list[Column] | None = None) -> DataFrame:
    """Rows of ``rows`` whose (id, key) is in ``wanted`` (_id, _key, ...), one for each, with the further columns of ``wanted``.

    Repeated rows are thinned out before the shuffle, task by task; the shuffle
    for this serves the join as well.  A null id equals a null id.
    """
    none = F.lit(0).cast("long")
    mine = rows.withColumns({"__k0": F.coalesce(F.col(id_col).cast("long"), none), "__k1": F.col(id_col).isNull(), "__k2": key})
    window = Window.partitionBy("__k0", "__k1", "__k2").orderBy(*(order or [F.lit(0)]))
    mine = mine.withColumn("__nth", F.row_number().over(window)).filter("__nth = 1").drop("__nth")
    extra = [c for c in wanted.columns if c not in ("_id", "_key")]
    theirs = wanted.select(F.coalesce("_id", none).alias("__k0"), F.col("_id").isNull().alias("__k1"), F.col("_key").alias("__k2"), *extra)
    return mine.join(theirs, ["__k0", "__k1", "__k2"]).select(*[mine[c] for c in rows.columns], *extra)
