import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import hard_negatives, queries
from freshet.llm.hard_negatives import Fields

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, _row string, score int"


def brute(rows, is_anchor, positives=5, negatives=3):
    """rows: (id, vector, label); the rule said plainly."""
    fit = []
    for i, v, label in rows:
        if label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        fit.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    key = lambda s, i: (-s, i is None, i or 0)
    out = []
    for n, (i, v, label) in enumerate(fit):
        if not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for m, (j, w, other) in enumerate(fit) if m != n]
        near = sorted((s for s in scored if s[2] == label), key=lambda s: key(s[0], s[1]))[:positives]
        for p, j, _ in near:
            hard = sorted((s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p), key=lambda s: key(s[0], s[1]))
            out += [(i, j, r + 1, h[1], p, h[0]) for r, h in enumerate(hard[:negatives])]
    return sorted(out, key=str)


def test_fields_are_exact():
    rng = np.random.default_rng(1)
    for size in (3, 300, 2**28, 2**40):
        a = rng.integers(-size, size + 1, (5, 7))
        b = rng.integers(-size, size + 1, (101, 7))
        a[0], b[0] = -size, -size
        a[1], b[1] = size, size
        want = a.astype(object) @ b.astype(object).T
        fields = Fields.fitting(int(b.min()), int(b.max()), int(np.abs(a).sum(axis=1).max()))
        got = fields.scores(a, fields.pack(b), len(b))
        assert (got == np.minimum(np.maximum(want, -hard_negatives.LIMIT), hard_negatives.LIMIT)).all()
    assert Fields.fitting(-256, 256, 2048).count >= 2


def test_query_equals_brute_force(spark):
    got = queries.op11_hard_negatives(spark, FOLDER)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    rows = [(i, v, None if y is None else (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in rows]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda i: i is not None and i % 50 == 0)


@pytest.mark.parametrize("chunk", [1 << 19, 256])
def test_ties_nulls_and_repeats(spark, monkeypatch, chunk):
    monkeypatch.setattr(hard_negatives, "ROW_CHUNK", chunk)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4) / 4], int(rng.integers(0, 3))) for i in range(300)]
    rows += rows[:40] + [(None, [0.25, 0.5, 0.25, 0.5], 1), (None, [0.5] * 4, None), (401, None, 1), (402, [], 1)]
    rows += [(403, [0.5, None, 0.5, 0.5], 1), (404, [0.5, math.nan, 0.5, 0.5], 1), (405, [math.inf, 0.0, 0.0, 0.0], 0), (0, [0.5] * 4, 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda i: i is not None and i % 10 == 0)


def test_other_lengths_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty, F.lit(True)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.75, 0.0], 1), (4, [0.75], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") == 1)
    assert [tuple(r) for r in got.collect()] == [(1, 2, 1, 3, 65536, 49152)]
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_hot_label_and_wide_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1e6, 8)], 0 if i % 3 else i % 5) for i in range(400)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = hard_negatives.mine(df, F.col("vec_id") % 40 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, lambda i: i % 40 == 0)
