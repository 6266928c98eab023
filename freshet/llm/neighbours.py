"""Nearest neighbours by inner product with a hierarchical k-means tree.

Equal vectors form one class, which holds its smallest row ids; only classes are
indexed and searched.  A further coordinate, sqrt(M**2 - |x|**2) with M the largest
norm, turns the largest inner product into the smallest distance (a query has 0
there), and k-means splits the space again and again into a tree of leaves.

A query walks the tree best bin first: a priority queue holds the nodes met so far
by their centre's distance, and the nearest is opened next.  How many leaves it
visits is calibrated: for a few queries the true neighbours are found in all rows,
block by block, and visits widen until the wanted share of true neighbours lies in
the leaves visited.

The tree is fitted on at most ``sample`` classes (drawn by hash, the bound holds in
expectation), which also bounds its leaves; every class is then put into its leaf.
Leaves that follow each other in the tree are searched together up to ``BLOCK``
rows, which saves partial results; a larger leaf, and the queries that visit one
place, are dealt out in parts of about that size, so neither meets in one task.

Defined results: vectors that are null, zero, hold null or non-finite components,
or have another length than most take no part; rows of equal id and vector count
once, and rows with a query's id are its own; fewer than k candidates give all of
them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.llm.common import landed, lookup

BRANCH, LEAF_ROWS, BLOCK = 8, 256, 4096


@dataclass
class Tree:
    """Nodes by number, 0 the root: centres, children (empty for a leaf), leaf numbers (-1 inside)."""

    centres: np.ndarray
    children: list
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (self.centres**2).sum(axis=1)[None] - 2 * x @ self.centres.T

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        far, at = self.distances(x), np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[at] < 0)
            if not len(inner):
                return self.leaf[at]
            for node in np.unique(at[inner]):
                rows, kids = inner[at[inner] == node], self.children[node]
                at[rows] = kids[far[np.ix_(rows, kids)].argmin(axis=1)]

    def visit_order(self, far: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order, at most so many; ``far``: the query's distance to all centres."""
        queue, out = [(far[0], 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
            for kid in self.children[node]:
                heapq.heappush(queue, (far[kid], int(kid)))
        return out


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """k-means with BRANCH centres: the centres that hold rows, and each row's centre."""
    centres = x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)]
    for _ in range(8):
        of = ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
        used = np.unique(of)
        centres = np.stack([x[of == c].mean(axis=0) for c in used])
    of = ((centres**2).sum(axis=1)[None] - 2 * x @ centres.T).argmin(axis=1)
    return centres, of


def fit_tree(x: np.ndarray, leaf_rows: int, seed: int = 3) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, leaf = [x.mean(axis=0)], [np.zeros(0, np.int64)], [-1]
    work, n_leaves = [(0, np.arange(len(x)))], 0
    while work:
        node, rows = work.pop()
        own, of = _split(x[rows], rng) if len(rows) > leaf_rows else (None, np.zeros(1))
        if len(np.unique(of)) < 2:
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            continue
        kids = []
        for c in np.unique(of):
            kids.append(len(centres))
            centres.append(own[c])
            children.append(np.zeros(0, np.int64))
            leaf.append(-1)
            work.append((kids[-1], rows[of == c]))
        children[node] = np.array(kids)
    return Tree(np.stack(centres), children, np.array(leaf))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with the coordinate that makes all norms equal."""
    return np.hstack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(axis=1), 0))[:, None]])


def _asked(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), 1))])


def _best(ask: np.ndarray, have: np.ndarray, lowest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the k best candidates of each query, ties to the smaller id."""
    rows, cols, scores = [], [], []
    longest = np.linalg.norm(have, axis=1).max(initial=0)
    for a in range(0, len(ask), 512):
        near = ask[a : a + 512] @ have.T
        m = near.shape[1] - min(k, near.shape[1])
        # All that reach the k-th best score but for rounding: ties are told apart below, however many.
        slack = 8 * have.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(ask[a : a + 512], axis=1) * longest
        cut = np.partition(near, m, axis=1)[:, m] - slack
        for i in range(len(near)):
            top = np.flatnonzero(near[i] >= cut[i])
            # One order of summation, wherever a pair stands.
            exact = (ask[a + i] * have[top]).sum(axis=1)
            order = np.lexsort((lowest[top], -exact))[:k]
            rows.append(np.full(len(order), a + i))
            cols.append(top[order])
            scores.append(exact[order])
    return (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, cols, scores))


def _places(sizes: dict[int, int], n_leaves: int) -> list[tuple[int, int, int]]:
    """(leaf, place, parts): neighbouring leaves share a place up to BLOCK rows."""
    out, place, held = [], 0, 0
    for leaf in range(n_leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > BLOCK:
            place, held = place + 1, 0
        held += n
        out.append((leaf, place, max(1, -(-n // BLOCK))))
    return out


def usable(v: Column) -> Column:
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """node, vec, ids (the smallest ``keep``), copies; one row per distinct vector."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    ids = rows.withColumn("_nth", nth).filter(F.col("_nth") <= keep)
    out = ids.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return landed(out.select(F.monotonically_increasing_id().alias("node"), "vec", "ids", F.col("ids")[0].alias("lowest")), "vector-classes")


def _scan(classes: DataFrame, queries: np.ndarray, k: int) -> DataFrame:
    """(q, node, score): the true k best classes of each of a few queries, all rows in blocks."""
    shared = classes.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                q, i, s = _best(shared.value, _matrix(batch.column(1), batch.num_rows), batch.column(2).to_numpy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(q), batch.column(0).take(pa.array(i)), pa.array(s), batch.column(2).take(pa.array(i))], names=["q", "node", "score", "lowest"])

    found = classes.select("node", "vec", "lowest").mapInArrow(run, "q long, node long, score double, lowest long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "lowest"))
    return found.withColumn("_nth", nth).filter(F.col("_nth") <= k).select("q", "node", "score")


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.96,
    sample: int = 20_000,
    calibration: int = 128,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row among all other rows."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.filter(usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = rows.filter("id IS NOT NULL")
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return empty
    rows = landed(rows.filter(F.size("vec") == size["d"]).distinct(), "vectors")
    classes = _classes(rows, k + 1)
    facts = classes.agg(F.count("*").alias("n"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)).alias("square")).first()
    n, longest = facts["n"], float(np.sqrt(facts["square"]))

    def drawn(name: str, bound: int) -> np.ndarray:
        draw = F.pmod(F.xxhash64(F.lit(name), "vec"), F.lit(1_000_000)) * F.lit(n) < F.lit(bound * 1_000_000)
        got = classes.filter(draw).orderBy("lowest").select("vec").toArrow()
        return _matrix(got.column(0), got.num_rows) if got.num_rows else np.zeros((0, size["d"]))

    fitted = drawn("fit", sample)
    if not len(fitted):
        return empty
    tree = fit_tree(_lifted(fitted, longest), max(8, round(LEAF_ROWS * len(fitted) / n)))
    shared = spark.sparkContext.broadcast(tree)

    def put(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.leaf_of(_lifted(_matrix(batch.column(1), batch.num_rows), longest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["node", "vec", "lowest", "leaf"])

    index = landed(classes.select("node", "vec", "lowest").mapInArrow(put, "node long, vec array<double>, lowest long, leaf long"), "vector-leaves")

    probes = drawn("calibrate", calibration)
    visits = tree.n_leaves
    if len(probes):
        true = _scan(index, probes, k).join(index.select("node", "leaf"), "node").select("q", "leaf").collect()
        far = tree.distances(_asked(probes))
        order = [{leaf: i for i, leaf in enumerate(tree.visit_order(far[q], tree.n_leaves))} for q in range(len(probes))]
        late = np.sort([order[r["q"]][r["leaf"]] for r in true])
        visits = 1
        while visits < tree.n_leaves and (late < visits).mean() < recall:
            visits += 1

    sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row per leaf
    places = _places(sizes, tree.n_leaves)
    place_of = np.array([p for _, p, _ in places])

    asked = rows.filter("asks").select("id", "vec")
    uses = asked.groupBy("vec").agg(F.count("*").alias("uses"))
    ask = landed(classes.join(uses, "vec").select("node", "vec", "uses"), "queries")

    def walk(batches):
        tree = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            far = tree.distances(_asked(_matrix(batch.column(1), batch.num_rows)))
            leaves = [np.unique(place_of[tree.visit_order(f, visits)]) for f in far]
            of = np.repeat(np.arange(batch.num_rows), [len(x) for x in leaves])
            picked = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(np.concatenate(leaves))], names=["node", "vec", "place"])

    walked = landed(ask.select("node", "vec").mapInArrow(walk, "node long, vec array<double>, place long"), "walks")
    known = spark.createDataFrame(places, "leaf long, place long, _c int")
    met = walked.groupBy("place").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_q"))
    blocks = F.broadcast(landed(known.groupBy("place").agg(F.max("_c").alias("_c")).join(met, "place"), "places"))
    index = index.join(F.broadcast(known.select("leaf", "place")), "leaf")  # a row per leaf, as in blocks
    spread = lambda own, n: F.pmod(F.xxhash64(own), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    have = index.join(blocks, "place").withColumn("c", spread("node", "_c")).withColumn("q", every("_q"))
    wants = walked.join(blocks, "place").withColumn("q", spread("node", "_q")).withColumn("c", every("_c"))

    def meet(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("score", pa.float64()), ("lowest", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        asks, haves = _matrix(right.column("vec"), right.num_rows), _matrix(left.column("vec"), left.num_rows)
        lowest = left.column("lowest").to_numpy()
        q, i, s = _best(asks, haves, lowest, k + 1)
        return pa.Table.from_arrays([right.column("query").take(pa.array(q)), left.column("node").take(pa.array(i)), pa.array(s), pa.array(lowest[i])], schema=schema)

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["place", "c", "q"]
    left = have.select(*keys, "node", "vec", "lowest").repartition(n_parts, *keys).groupBy(*keys)
    right = wants.select(*keys, F.col("node").alias("query"), "vec").repartition(n_parts, *keys).groupBy(*keys)
    found = left.cogroup(right).applyInArrow(meet, "query long, node long, score double, lowest long")

    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "lowest"))
    best = landed(found.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1).select("query", "node", "score"), "best-classes")
    met = best.groupBy("node").agg(F.count("*").alias("_n"))
    known = classes.select("node", "ids").join(met, "node")
    full = lookup(best, known, ["node"], "_n").select("query", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    full = full.withColumn("_nth", nth).filter(F.col("_nth") <= k + 1)
    lists = full.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_nth", "score", "vec_id"))).alias("found"))
    lists = landed(ask.join(lists.withColumnRenamed("query", "node"), "node").select("node", "found", "uses"), "found")
    nodes = ask.select("vec", "node", "uses")
    asked = lookup(asked, nodes, ["vec"], "uses").select("id", "node")
    mine = lookup(asked, lists, ["node"], "uses").select(
        F.col("id").alias("query_id"), F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k).alias("found")
    )
    out = mine.select("query_id", F.posexplode("found").alias("_pos", "_f"))
    return out.select("query_id", (F.col("_pos") + 1).cast("int").alias("rank"), F.col("_f.vec_id").alias("vec_id"), F.col("_f.score").alias("score"))
