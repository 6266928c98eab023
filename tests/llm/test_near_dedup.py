import random
import re

import numpy as np
import pytest

from freshet.llm import near_dedup

SCHEMA = "doc_id long, text string, n_shingles int, root string"


def shingle_set(text, width):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent=80):
    sets = [shingle_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = lambda v: min((x for x in v if x is not None), default=None)
    return sorted(((d, len(sets[i]), least(ids[root(i)]) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def got(spark, rows, width):
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.groups(df, width=width).collect()), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(25):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 12, 60, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            own = list(text)
            for _ in range(rng.randrange(0, 1 + len(text) // 25)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1001, " ".join(own) if rng.random() < 0.5 else "\t".join(own).upper()))
    # A chain: each text like the next one, its ends unlike.
    chain = [rng.choice(vocabulary) for _ in range(120)]
    for k in range(8):
        chain = [*chain[5:], *[f"c{k}x{i}" for i in range(5)]]
        rows.append((2000 - k, " ".join(chain)))
    rows += [(3000, None), (3001, ""), (3002, " \n "), (3003, "solo"), (3004, "SOLO"), (3005, "long " + "z" * 100_000), (None, rows[0][1]), (rows[1][0], rows[1][1])]
    assert got(spark, rows, width) == brute(rows, width)


def test_hot_group_and_empty(spark):
    rows = [(i, "a b c d e f g h i j k l m n o p" if i % 3 else f"text number {i} is its own") for i in range(300)]
    out = got(spark, rows, 5)
    assert sum(c == 1 for _, _, c in out) == 200
    assert got(spark, [], 5) == []


def test_one_bucket_of_many_components(spark, monkeypatch):
    # Texts of one template, mutually at 0.70 to 0.75, each with two copies at 0.8 or more; all share the buckets of the template.
    rng = random.Random(11)
    template = [f"t{i}" for i in range(600)]
    rows = []
    for base in range(150):
        own = [f"b{base}x{i}" for i in range(97)]
        for copy in range(2):
            rows.append((len(rows), " ".join([*template, *own, *[f"c{base}y{copy}z{i}" for i in range(3 + 25 * copy)]])))
    rng.shuffle(rows)
    # Every bucket holds every class, so the result rests on the comparisons within one.
    monkeypatch.setattr(near_dedup, "band_keys", lambda sig, bands, rows: np.full(bands, 7, np.int64))
    monkeypatch.setattr(near_dedup, "PAIRS", 5000, raising=False)
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], SCHEMA)
    out = {r.doc_id: r.component_id for r in near_dedup.groups(df, width=1, bands=1, rows=5).collect()}
    want = {d: c for d, _, c in brute(rows, 1)}
    assert len(set(want.values())) == 150 and out == want


def test_parity_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 80, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3 + 1).astype(np.uint64)]))
        differ = np.unpackbits((near_dedup.parity(a) ^ near_dedup.parity(b)).view(np.uint8)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_survivors(spark):
    base = " ".join(f"v{i}" for i in range(100))
    rows = [(5, base), (3, base + " more"), (9, "other words stand in this one"), (9, "other words stand in this one"), (4, ""), (6, None)]
    df = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], SCHEMA)
    out = near_dedup.survivors(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 6, 9]
