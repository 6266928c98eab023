"""Near-duplicate groups by MinHash: one-permutation hashing, bands, stars.

A document's set holds its distinct shingles of ``width`` words (A to Z in lower
case); one with fewer words is a single shingle, one without words has no set and
no links.  Documents with equal sets form a class, and only classes are compared,
so copies are never expanded into pairs.

Each class gets one signature from a single hash per shingle: the hash's leading
part names the bin, the smallest hash of a bin is its value, and an empty bin
takes the value of another one in an order drawn for that bin (optimal
densification).  Bands of the signature put classes into buckets.

Within a bucket the first class is linked as a candidate to all others, a star, so
candidates grow with the bucket's size and not with its square.  Candidates are
confirmed on the full sets.  Where a bucket's classes do not end up in one
component, further rounds of stars follow until none is left: classes outside the
largest component of such a bucket become centres, CENTRES of them in a bucket in
the first round and GROWTH times as many in each next one, and meet the classes of
other components there.  A bucket is settled when it is one component or all its
classes outside the largest one have been centres; so every pair that shares a
bucket is compared or already linked.

Before sets are joined, a pair must pass a bound that is exact: of two sets'
parity bits (how many members fall on a bit, odd or even) at most as many differ
as members do.  A bucket of many components still takes work that grows with the
square of their number, on these bits alone, dealt over tasks by PAIRS.

With 32 bands of 5 rows a pair of similarity 0.8 shares no bucket with a chance of
3 in a million, and ten buckets on average, each a chance to meet in a star.

Defined results: a null text is empty; rows of equal id are separate documents; a
null id counts as the largest; an empty table gives no rows; other columns are
ignored by ``groups`` and kept by ``survivors``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from freshet.llm.common import landed, lookup, once
from freshet.llm.textbytes import lowered, mixed, slices, span_hashes, words

BANDS, ROWS = 32, 5
#: Further rounds: centres of a bucket in the first, and how they grow.
CENTRES, GROWTH = 4, 4
#: Pairs of a bucket that one task compares.
PAIRS = 1 << 22
#: Words of 64 parity bits of a set.
PARITY = 8
BITS = [f"p{j}" for j in range(PARITY)]


def _orders(bins: int) -> np.ndarray:
    """ranks[i, j]: how late bin i asks bin j for its value; fixed by the number of bins."""
    keys = mixed(np.arange(bins * bins, dtype=np.uint64), salt=5).reshape(bins, bins)
    return np.argsort(np.argsort(keys, axis=1), axis=1).astype(np.int32)


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    low = lowered(data)
    starts, ends, first = words(low, at)
    h = span_hashes(low, starts, ends)
    n = len(h) - width + 1
    long = h[: max(n, 0)].copy()
    for j in range(1, width):
        long = mixed(long * np.uint64(3) + h[j : j + max(n, 0)], salt=j)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            out.append(np.unique(long[a : b - width + 1]))
        elif b > a:
            one = h[a : a + 1].copy()
            for j in range(1, b - a):
                one = mixed(one * np.uint64(3) + h[a + j], salt=j)
            out.append(mixed(one, salt=1000 + int(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray, bins: int, ranks: np.ndarray) -> np.ndarray:
    """One value per bin of a sorted, non-empty set."""
    bin_of = ((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    full, at = np.unique(bin_of, return_index=True)
    full = full.astype(np.int64)
    out = np.zeros(bins, np.uint64)
    out[full] = s[at]
    empty = np.ones(bins, bool)
    empty[full] = False
    empty = np.flatnonzero(empty)
    if len(empty):
        out[empty] = out[full[ranks[np.ix_(empty, full)].argmin(axis=1)]]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(bands, rows)
    key = mixed(np.arange(bands, dtype=np.uint64), salt=9)
    for j in range(rows):
        key = mixed(key * np.uint64(5) + parts[:, j], salt=j)
    return key.view(np.int64)


def _facts(docs: DataFrame, width: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: size and 128-bit hash of its set, and its band keys."""
    bins = bands * rows

    def run(batches):
        ranks = _orders(bins)
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            both = np.zeros((batch.num_rows, 2), np.int64)
            keys = np.zeros((batch.num_rows, bands), np.int64)
            for begin, end, data, at in slices(batch, "text"):
                for i, s in enumerate(shingles(data, at, width), begin):
                    size[i] = len(s)
                    if len(s):
                        both[i] = [mixed(s, salt=21).sum().view(np.int64), mixed(s, salt=22).sum().view(np.int64)]
                        keys[i] = band_keys(signature(s, bins, ranks), bands, rows)
            some = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(some), pa.array(keys[size > 0].ravel()))
            cols = [batch.column(0), batch.column(2), pa.array(size), pa.array(both[:, 0]), pa.array(both[:, 1]), lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "bands"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    schema = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, bands array<long>"
    return rows_in.mapInArrow(run, schema)


def parity(s: np.ndarray) -> np.ndarray:
    """Parity bits of a set: how many members fall on each, odd or even."""
    odd = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, items, p0, p1, ...) from (node, text)."""

    def run(batches):
        for batch in batches:
            for begin, end, data, at in slices(batch, "text"):
                found = shingles(data, at, width)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
                odd = np.array([parity(s) for s in found]).reshape(-1, PARITY)
                cols = [batch.column(0).slice(begin, end - begin), items, *[pa.array(np.ascontiguousarray(odd[:, j])) for j in range(PARITY)]]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "items", *BITS])

    return texts.select("node", "text").mapInArrow(run, "node long, items array<long>, " + ", ".join(f"{c} long" for c in BITS))


def contract(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (node, root) after joining the components that ``links`` (a, b) connect.

    Each step sends every root to the smallest among itself and its neighbours and
    replaces the links by those between the new roots; the links of a step are a
    fraction of those before, since node numbers are random to the links.  A root
    with very many links or nodes is a hot key of one side only, which Spark's
    adaptive skew join splits.
    """
    edges = _ends(links, labels)
    while not edges.isEmpty():
        sides = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("_least"))
        moved = landed(least.select(F.col("a").alias("node"), F.least("a", "_least").alias("root")), "moved")
        step = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
        labels = landed(labels.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "labels")
        edges = _ends(edges, moved)
    return labels


def _ends(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between the roots of both ends, each once; a node that ``roots`` lacks is its own."""
    a = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left")
    b = a.join(roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left")
    ends = b.select(F.coalesce("_ra", "a").alias("_a"), F.coalesce("_rb", "b").alias("_b")).filter("_a != _b")
    return landed(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")


def classes_and_labels(docs: DataFrame, width: int, percent: int, bands: int, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts per document, classes (node, s1, s2, ...) and component labels (node, root) of linked classes."""
    facts = landed(_facts(docs, width, bands, rows, id_col, text_col), "shingle-facts")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_first")
    classes = facts.filter("n_shingles > 0").groupBy("s1", "s2").agg(
        F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), first
    )
    classes = landed(
        classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "copies", "n_shingles", "bands",
                       F.col("_first.doc_id").alias("first_id"), F.col("_first.text_hash").alias("first_hash")),
        "shingle-classes",
    )
    keys = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1")
    buckets = landed(keys.join(shared, "key").select("key", "node", "n_shingles"), "buckets")

    nodes = buckets.select("node").distinct()
    texts = classes.join(nodes, "node", "left_semi").select(F.col("first_id").alias("_id"), F.col("first_hash").alias("_key"), "node")
    wanted = once(docs.select(id_col, text_col), texts, id_col, F.xxhash64(text_col))
    sets = landed(_sets(wanted.select("node", F.col(text_col).alias("text")), width), "shingle-sets")

    labels = nodes.select("node", F.col("node").alias("root"))
    heads = buckets.groupBy("key").agg(F.min(F.struct("node", "n_shingles")).alias("_t"))
    small, large = F.least("n_shingles", "_t.n_shingles"), F.greatest("n_shingles", "_t.n_shingles")
    pairs = buckets.join(heads, "key").filter((F.col("_t.node") != F.col("node")) & (100 * small >= percent * large))
    pairs = pairs.select(F.col("_t.node").alias("a"), F.col("node").alias("b")).distinct()
    labels = contract(_confirmed(pairs, sets, percent), labels)
    return facts, classes, _settled(buckets, labels, sets, percent)


def _may(percent: int, n_a: Column, n_b: Column, a: str, b: str) -> Column:
    """Whether sets of these sizes and parity bits can be similar enough; never false for a pair that is."""
    differ = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in BITS), F.lit(0))
    both = n_a + n_b
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * (both - differ) >= 2 * percent * both)


def _bits(sets: DataFrame, name: str) -> DataFrame:
    return sets.select(F.col("node").alias(name), F.size("items").cast("long").alias(f"{name}_n"), *[F.col(c).alias(f"{name}_{c}") for c in BITS])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    may = _may(percent, F.col("a_n"), F.col("b_n"), "a_", "b_")
    pairs = pairs.join(_bits(sets, "b"), "b").join(_bits(sets, "a"), "a").filter(may).select("a", "b")
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("_ia"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("_ib"))
    common = F.size(F.array_intersect("_ia", "_ib"))
    union = F.size("_ia") + F.size("_ib") - common
    proof = pairs.join(b, "b").join(a, "a").filter(100 * common.cast("long") >= percent * union)
    return landed(proof.select("a", "b"), "links")


def _settled(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels after rounds of stars until no bucket holds a pair of components that was not compared."""
    rows = buckets.select("key", "node", F.lit(False).alias("done"))
    limit = CENTRES
    while True:
        rows = landed(rows.join(labels, "node").select("key", "node", "done", "root"), "bucket-roots")
        parts = rows.groupBy("key", "root").agg(F.count("*").alias("_n"))
        several = parts.groupBy("key").agg(
            F.max_by("root", F.struct("_n", "root")).alias("_main"), F.count("*").alias("_parts"),
            F.sum("_n").alias("_size"), F.max("_n").alias("_most"),
        )
        several = several.filter("_parts > 1").select("key", "_main", "_size", (F.col("_size") - F.col("_most")).alias("_rest"))
        rows = landed(rows.join(several, "key"), "mixed-buckets")
        nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("node"), "node"))
        heads = rows.filter("NOT done AND root != _main").withColumn("_nth", nth).filter(F.col("_nth") <= limit)
        heads = landed(heads.select("key", "node", F.lit(True).alias("_centre")), "centres")
        if heads.isEmpty():
            return labels
        rows = rows.join(heads, ["key", "node"], "left").withColumn("_centre", F.coalesce("_centre", F.lit(False)))
        shares = (1 + F.expr(f"_size * least(_rest, {limit}L) div {PAIRS}")).cast("int")
        rows = landed(rows.select("key", "node", "done", "root", "_centre", shares.alias("_shares")), "bucket-turn")
        labels = contract(_confirmed(_stars(rows, sets, percent), sets, percent), labels)
        rows = rows.select("key", "node", (F.col("done") | F.col("_centre")).alias("done"))
        limit *= GROWTH


def _stars(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a centre and a class of its bucket that are in two components and may be similar enough.

    A class that was a centre of the bucket before has met all others there, and of
    two centres only one asks.
    """
    ends = rows.filter("NOT done").withColumn("_share", F.pmod(F.xxhash64("node"), F.col("_shares")).cast("int"))
    ends = ends.select("key", "_share", F.col("node").alias("b"), F.col("root").alias("_rb"), F.col("_centre").alias("_cb")).join(_bits(sets, "b"), "b")
    tops = rows.filter("_centre").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    tops = tops.select("key", "_share", F.col("node").alias("a"), F.col("root").alias("_ra")).join(_bits(sets, "a"), "a")
    apart = (F.col("_ra") != F.col("_rb")) & (~F.col("_cb") | (F.col("a") < F.col("b")))
    same = (ends["key"] == tops["key"]) & (ends["_share"] == tops["_share"])
    met = ends.join(tops, same & apart & _may(percent, F.col("a_n"), F.col("b_n"), "a_", "b_"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id of its group), kept, first_hash, text_hash."""
    facts, classes, labels = classes_and_labels(docs, width, percent, bands, rows, id_col, text_col)
    joined = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(F.col("first_id").isNull(), F.col("first_id"), F.col("first_hash"))
    tops = landed(joined.groupBy("root").agg(F.min(order).alias("_top"), F.count("*").alias("_n")), "group-tops")
    named = lookup(joined.select("s1", "s2", "copies", "root"), tops, ["root"], "_n")
    named = named.select("s1", "s2", "copies", F.col("_top.first_id").alias("component_id"), F.col("_top.first_hash").alias("first_hash"))
    out = lookup(facts.select("doc_id", "text_hash", "n_shingles", "s1", "s2"), landed(named, "group-names"), ["s1", "s2"], "copies")
    empty = F.col("n_shingles") == 0
    out = out.withColumns({
        "component_id": F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")),
        "first_hash": F.when(empty, F.col("text_hash")).otherwise(F.col("first_hash")),
    })
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash", "first_hash")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group, with all its columns; of rows that agree in id and text one stays."""
    stay = groups(docs, id_col=id_col, text_col=text_col, **options).filter("kept AND text_hash = first_hash")
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_key")).distinct()
    return once(docs, stay, id_col, F.xxhash64(text_col))
