"""Best-fit packing in bulk-synchronous rounds.

Spark sorts the documents by length over all tasks and numbers them; documents of
one length, and open sequences with one gap, are interchangeable, so the rounds
work on tables of ranges of numbers per length and per gap, never on single
documents.  A round deals documents and gaps to ranges of sizes.  Each task sweeps
its range from the largest size down: every length, the longest first, meets its
successor, the smallest gap met so far; of the documents that want the same gaps the
lower ranks get them and the rest go on to the next larger gap.  What a range leaves
over meets in a second sweep, in which documents go on to the gaps of larger ranges;
matching of sorted documents and gaps is that of brackets, so both sweeps together
give the pairs that one long sweep would.  A sequence takes one document a round;
then the gaps are updated.  When nothing fits any more, new sequences are opened, as
many as the tokens left need at the least or as documents have more than half of the
capacity.  The ranges found are joined back to the documents.

Each round's table is written to the shared folder and read by the next; the driver
sees four totals of it.  A round adds at most one range per length to the state, so
that is bounded by the capacity and the rounds, not by the number of documents.

Defined results: an empty table gives no rows; documents of length 0 or less, or
above the capacity, are an error; rows that agree in all of ``order`` may swap
their places; other columns are kept.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from freshet.llm.common import numbered
from freshet.session import run_path

#: Ranks in one block of the join of documents with their ranges.
BLOCK = 4096

#: Ranges of sizes that are swept side by side.
PARTS = 8

GAP, WAITING, PLACED = 0, 1, 2

#: A gap: ``first`` is its first sequence; documents: their first rank; both for those placed.
STATE = "part int, kind int, size long, first long, n long, sequence long, gap long"


def sweep(table: pa.Table) -> pa.Table:
    """Match the documents of these rows with their successors among the gaps; the rest stay."""
    rows = table.to_pydict()
    open_gaps: list[list[int]] = []
    out: list[tuple] = []
    for i in sorted(range(table.num_rows), key=lambda i: (-rows["size"][i], rows["kind"][i], rows["first"][i])):
        kind, size, first, n = (rows[c][i] for c in ("kind", "size", "first", "n"))
        if kind == GAP:
            open_gaps.append([size, first, n])
        elif kind == PLACED:
            out.append((kind, size, first, n, rows["sequence"][i], rows["gap"][i]))
        else:
            while n and open_gaps:
                best = open_gaps[-1]
                k = min(n, best[2])
                out.append((PLACED, size, first, k, best[1], best[0]))
                first, n = first + k, n - k
                best[1], best[2] = best[1] + k, best[2] - k
                if not best[2]:
                    open_gaps.pop()
            if n:
                out.append((WAITING, size, first, n, None, None))
    out += [(GAP, *g, None, None) for g in open_gaps]
    kinds = [pa.int32(), *[pa.int64()] * 5]
    columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
    return pa.Table.from_arrays([pa.array([0] * len(out), pa.int32()), *columns], names=["part", "kind", "size", "first", "n", "sequence", "gap"])


def plan(counts: DataFrame, capacity: int) -> DataFrame:
    """_length, _rank, _n, _sequence, offset from (length, n): documents of that length and
    these ranks go, one each, to the sequences from the first on."""
    spark = counts.sparkSession
    folder = run_path(spark, "packing")
    tables: list[str] = []

    def written(state: DataFrame) -> DataFrame:
        tables.append(f"{folder}/{len(tables)}")
        state.write.parquet(tables[-1])
        return spark.read.schema(STATE).parquet(tables[-1])

    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    state = written(counts.select(F.lit(0).alias("part"), F.lit(WAITING).alias("kind"), F.col("length").alias("size"), zero.alias("first"), "n", none.alias("sequence"), none.alias("gap")))
    ends = state.agg(F.min("size").alias("least"), F.max("size").alias("most")).first()
    if ends["most"] is not None and not 0 < ends["least"] <= ends["most"] <= capacity:
        raise ValueError("a length lies outside 1 .. capacity")

    part = F.floor(F.col("size") * PARTS / (capacity + 1)).cast("int").alias("part")
    rest = ["first", "n", "sequence", "gap"]
    waits = F.when(F.col("kind") == WAITING, F.col("n"))
    totals = [
        F.coalesce(F.sum(c), zero)
        for c in (F.when(F.col("kind") == PLACED, F.col("n")), waits, waits * F.col("size"), F.when(2 * F.col("size") > capacity, waits))
    ]
    opened = 0
    while True:
        placed, waiting, tokens, halves = state.agg(*totals).first()
        if not waiting:
            break
        left = state.filter(F.col("kind") != PLACED)
        if placed:
            narrower = state.filter((F.col("kind") == PLACED) & (F.col("gap") > F.col("size")))
            left = left.unionByName(narrower.select("part", F.lit(GAP).alias("kind"), (F.col("gap") - F.col("size")).alias("size"), F.col("sequence").alias("first"), "n", none.alias("sequence"), none.alias("gap")))
        else:
            more = max(-(-tokens // capacity), halves)
            left = left.unionByName(spark.createDataFrame([(0, GAP, capacity, opened, more, None, None)], STATE))
            opened += more
        dealt = left.select(part, "kind", "size", *rest)
        state = written(dealt.groupBy("part").applyInArrow(sweep, STATE).groupBy("part").applyInArrow(sweep, STATE))
    every = spark.read.schema(STATE).parquet(*tables).filter(F.col("kind") == PLACED)
    return every.select(F.col("size").alias("_length"), F.col("first").alias("_rank"), F.col("n").alias("_n"), F.col("sequence").alias("_sequence"), (F.lit(capacity) - F.col("gap")).alias("offset"))


def pack(items: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length``."""
    rows = numbered(items, [F.desc("length"), *order], "_place")
    lengths = rows.groupBy("length").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    ranges = plan(lengths.select(F.col("length").cast("long").alias("length"), "n"), capacity)
    blocks = F.sequence(F.floor(F.col("_rank") / BLOCK), F.floor((F.col("_rank") + F.col("_n") - 1) / BLOCK))
    ranges = ranges.withColumn("_block", F.explode(blocks))
    starts = lengths.select("length", "_first")  # at most one row per token of the capacity
    ranked = rows.join(F.broadcast(starts), "length").withColumn("_r", F.col("_place") - F.col("_first"))
    ranked = ranked.withColumn("_b", F.floor(F.col("_r") / BLOCK))
    inside = (F.col("_r") >= F.col("_rank")) & (F.col("_r") < F.col("_rank") + F.col("_n"))
    joined = ranked.join(ranges, (F.col("length") == F.col("_length")) & (F.col("_b") == F.col("_block")) & inside)
    sequence = F.col("_sequence") + F.col("_r") - F.col("_rank")
    return joined.select(*items.columns, sequence.alias("sequence_id"), "offset")
