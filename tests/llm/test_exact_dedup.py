import hashlib
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from freshet.llm import queries
from freshet.llm.exact_dedup import DigestIndex

ROOT = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, kept int"
ROWS = [
    (1, "a b", "x", 1), (2, "ab ", "x", 1), (3, "a  b", "x", 1), (4, None, "x", 1), (5, "", None, 1),
    (None, "ab\t\t", "x", 1), (7, "a b", "x", 1), (8, "a b", "y", 2), (8, "a b", "z", 2), (9, "q" * 200_000, None, None),
]


def brute(rows):
    groups = {}
    for k, r in enumerate(rows):
        t = r[1] or ""
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()
        groups.setdefault(key, []).append((-len(t), r[0] is None, r[0] or 0, k))
    out = []
    for key, g in groups.items():
        best = min(g)
        for m in g:
            out.append((rows[m[3]][0], rows[best[3]][0], len(g), m == best, key))
    return sorted(out, key=str)


def test_rule_and_edges(spark):
    got = DigestIndex(spark).ingest(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in got], key=str) == brute(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert DigestIndex(spark).ingest(df).count() == 0
    assert DigestIndex(spark).survivors(df).columns == df.columns


def test_second_batch_meets_the_index(spark):
    index = DigestIndex(spark, buckets=4)
    index.ingest(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string"), batch_id="a")
    second = spark.createDataFrame([(3, "t w o"), (4, "three"), (5, "three")], "doc_id long, text string")
    for _ in range(2):  # a repeated batch changes nothing
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.ingest(second, batch_id="b").collect()}
        assert got == {3: (2, 1, False), 4: (4, 2, True), 5: (4, 2, False)}
    assert index.rows().count() == 3


def test_index_outlives_its_session(spark, tmp_path):
    """Another process fills the index; this one, which knows nothing of it, opens it and goes on."""
    path = f"{tmp_path}/index"
    script = f"""
from freshet.session import local_session
from freshet.llm.exact_dedup import DigestIndex
spark = local_session(2, "first")
index = DigestIndex(spark, "lasting", "{path}", buckets=3)
index.ingest(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string"), batch_id="a")
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(ROOT)}, timeout=120)
    second = spark.createDataFrame([(3, "t w o"), (4, "three")], "doc_id long, text string")
    for _ in range(2):
        index = DigestIndex(spark, "lasting", path)
        assert index.buckets == 3
        got = {r.doc_id: (r.keep_id, r.kept) for r in index.ingest(second, batch_id="b").collect()}
        assert got == {3: (2, False), 4: (4, True)}
        assert index.rows().count() == 3
        spark.sql("DROP TABLE lasting")  # the files stay
    with pytest.raises(ValueError):
        DigestIndex(spark, "lasting", path, buckets=5)
    index = DigestIndex(spark, "lasting", path)
    index.drop()
    assert not list(tmp_path.glob("index*"))


def test_index_is_joined_without_its_own_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = DigestIndex(spark, buckets=4)
        new = spark.createDataFrame([(bytearray(b"x"),)], "digest binary").repartition(4, "digest")
        plan = new.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_survivors_keep_columns_and_one_row(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows = DigestIndex(spark).survivors(df).collect()
    kept = [r for r in brute(ROWS) if r[3]]
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in kept)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.execute(queries.SQL["op1_exact_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op1_exact_dedup(spark, FOLDER).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("n", [3000])
def test_hot_group(spark, n):
    df = spark.range(n).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', concat('t', id)) AS text")
    got = DigestIndex(spark).ingest(df)
    assert got.filter("kept").count() == n - n // 3 + 1
    assert got.filter("keep_id = 0").count() == n // 3
