import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from freshet.llm import queries, runs

FOLDER = "/root/testdata/sf0.001"


def brute(w, shortest=12):
    """All maximal stretches for every period, the smallest period of each stretch."""
    n, found = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(shortest, 2 * q):
                found.setdefault((i, size), q)
            i = j
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda r: (r[0], r[2]))


def own(texts, shortest=12):
    first = np.cumsum([0, *map(len, texts)])
    return runs.of_words(np.array([x for t in texts for x in t], np.int64), first, shortest)


words = st.lists(st.integers(0, 2), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(words, min_size=1, max_size=4), st.sampled_from([4, 6, 12]))
def test_any_words(texts, shortest):
    assert own(texts, shortest) == [brute(t, shortest) for t in texts]


def test_shapes():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    rng = random.Random(5)
    texts = [[0] * 300, [0, 1] * 150 + [2] + [0, 1] * 100, fib[-1], ([0, 0, 1] * 20 + [3]) * 6, [rng.randrange(2) for _ in range(400)], []]
    texts += [[i % 97 for i in range(700)], [5] * 11, [5] * 12]
    assert own(texts) == [brute(t) for t in texts]


def test_long_texts_stay_linear():
    rng = random.Random(6)
    passage = [rng.randrange(1000, 2000) for _ in range(7)]
    spread = [x for i in range(20_000) for x in (*passage, 10_000 + i)]
    for text in ([0] * 200_000, [0, 0, 1] * 60_000, spread):
        start = time.perf_counter()
        own([text])
        assert time.perf_counter() - start < 30


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is None or not n:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted(doc_id, text)
    found = brute(w)
    keep = [True] * len(w)
    for s, size, q in found:
        keep[s + q : s + size] = [False] * (size - q)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(((-size, s, q) for s, size, q in found), default=None)
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (len(found), *head, sha(lines), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_runs(spark, FOLDER).collect()}
    assert len(got) == len(rows)
    for r in rows:
        if len(r.text or "") < 12_000:  # the brute force is quadratic
            assert got[r.doc_id] == expected(r.doc_id, r.text), r.doc_id


def test_edges(spark, tmp_path):
    line = "one two three four five sixé "
    rows = [(1, None, 1), (1, None, 1), (2, "", 1), (3, " \t\n", 2), (None, line * 9, 3), (20, line * 3, 4), (21, "a\x0b" * 30, 5)]
    rows += [(i, " ".join(f"w{j % 50}" for j in range(i)), 0) for i in range(30, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    found = runs.find(df)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    assert found.filter("doc_id is null").first().collapsed == line.strip()
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *expected(i, t)) for i, t, _ in rows), key=str)
    assert runs.find(df.limit(0)).count() == 0
