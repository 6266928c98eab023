import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from freshet.llm import mixing
from freshet.llm.feistel import permute
from freshet.llm.sharding import shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, rank long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 0, 0) for i, t, s in rows], SCHEMA)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(spark, n):
    df = spark.range(n).select("id", permute(F.col("id"), F.lit(n), F.lit(3)).alias("p"))
    df = df.withColumn("back", permute(F.col("p"), F.lit(n), F.lit(3), undo=True))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


def test_shards(spark):
    rows = [(i, "x" * (i % 7), "s") for i in range(203)] + [(None, None, None), (5, "é", "s"), (5, "é", "s"), (9, "", "s")]
    out = shard(docs_of(spark, rows), shards=16).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    counts = [len(v) for v in slots.values()]
    assert len(slots) == 16 and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted(str((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for i, t, _ in rows)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in out) == want
    again = shard(docs_of(spark, rows[::-1]).repartition(3), shards=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_shards_empty(spark):
    assert shard(docs_of(spark, [])).count() == 0


def level(sizes, weights, share=1.5, most=2.0):
    """Targets by the rule of the contract, one source at a time."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        part = {s: budget * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            target |= part
            break
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


def test_mix(spark):
    rows = [(i, "w " * (i * 37 % 91), f"s{i % 11}" if i % 3 else "hot") for i in range(900)]
    rows += [(1000, None, None), (1001, "a b c", None), (1002, " ", "s1"), (1003, "x " * 30_000, "s2"), (7, "w w", "s7"), (7, "w w", "s7")]
    m = mixing.mix(docs_of(spark, rows), block_words=64)
    out = mixing.taken(m).collect()
    assert len(out) == len(rows)
    sizes, got = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = level(sizes, [5.0, 2.0, 1.0])
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        got[r.source] += r.taken
    assert all(abs(got[s] - want[s]) <= 1 for s in sizes)
    again = mixing.taken(mixing.mix(docs_of(spark, rows).repartition(5), block_words=64)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    # Each pass takes a block at most once, and shards get about even parts.
    assert m.plan.groupBy("rank", "pass", "block").count().filter("count > 1").count() == 0
    assert m.plan.agg(F.sum("words")).first()[0] == sum(got.values())


def test_mixed_documents(spark):
    rows = [(i, f"  a{i} b\n\nc{i}\td e " * (i % 5), f"s{i % 3}") for i in range(60)] + [(3, None, "s0")]
    df = docs_of(spark, rows)
    want = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(df)).collect() if r.taken}
    texts, got = {i: t for i, t, _ in rows if t}, defaultdict(int)
    for r in mixing.documents(df).collect():
        got[r.doc_id] += len(r.text.split())
        words = iter(texts[r.doc_id].split())
        assert all(w in words for w in r.text.split())  # in the document's order
    assert dict(got) == want


def test_mix_empty(spark):
    for rows in ([], [(1, None, "a"), (2, " ", None)]):
        out = mixing.taken(mixing.mix(docs_of(spark, rows))).collect()
        assert [r.taken for r in out] == [0] * len(rows)
        assert mixing.documents(docs_of(spark, rows)).count() == 0
