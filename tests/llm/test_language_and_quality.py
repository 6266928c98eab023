import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.llm import language_id, queries
from freshet.llm.quality import Field, line_features, marginals, expand, fit, learn, predict, SHARES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, k0 int, score string, lang_pred string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, None, 1, "s", "p") for i, t, g in rows], SCHEMA)


def bits(counts, order, text):
    """Code length by the definition, byte by byte, in 1/1024 bits."""
    total, data = 0, b"\n" * order + text
    for i in range(order, len(data)):
        cost, k = 0, order
        while True:
            if k < 0:
                cost += 8 * 1024
                break
            seen = counts[k].get(data[i - k : i], {})
            n, q = sum(seen.values()), len(seen)
            c = seen.get(data[i], 0)
            if c:
                cost += round(-np.log2(c / (n + q)) * 1024)
                break
            if n:
                cost += round(-np.log2(q / (n + q)) * 1024)
            k -= 1
        total += cost
    return total


def test_code_lengths_against_the_definition():
    train = {"aa": ["abracadabra abra", "bra bra"], "bb": ["hello hollow yellow", "é hello"]}
    grams, counts = [], {}
    for lang, texts in train.items():
        counts[lang] = [{} for _ in range(4)]
        for t in texts:
            data = b"\n\n\n" + t.encode()
            for i in range(3, len(data)):
                grams.append((lang, int.from_bytes(data[i - 3 : i + 1], "big"), 1))
                for k in range(4):
                    seen = counts[lang][k].setdefault(data[i - k : i], {})
                    seen[data[i]] = seen.get(data[i], 0) + 1
    model = language_id.freeze(pd.DataFrame(grams, columns=["lang", "gram", "n"]).groupby(["lang", "gram"], as_index=False).sum())
    texts = [b"abra", b"", b"yellow hello", b"zz\xffz brahello", b"h" * 500, "été".encode()]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language_id.code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), at)
    for t, row in zip(texts, got):
        for j, lang in enumerate(model.languages):
            assert abs(row[j] - bits(counts[lang], 3, t)) <= 4 * len(t)  # each step rounds to 1/1024 bit


def test_language_edges(spark):
    train = docs_of(spark, [(1, "the house and the mouse " * 5, "en"), (2, "das haus und die maus " * 5, "de"), (3, "nope", None)])
    model = language_id.learn(train)
    rows = [(1, "the mouse", None), (2, "die maus", "x"), (3, None, None), (4, "", None), (5, "12 34 !", None), (6, "日本", None),
            (None, "the and", None), (1, "the mouse", None), (7, "the house " * 30_000, None)]
    out = language_id.predict(docs_of(spark, rows), model)
    assert out.columns[:7] == docs_of(spark, rows).columns
    got = [(r[0], r[7]) for r in out.collect()]
    want = {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", None: "en", 7: "en"}
    assert len(got) == len(rows) and all(p == want[i] for i, p in got if i != 6)
    assert next(p for i, p in got if i == 6) != "und"
    assert language_id.predict(docs_of(spark, []), model).count() == 0
    nothing = language_id.learn(docs_of(spark, [(1, "a", None)]))
    assert [r.lang_pred for r in language_id.predict(docs_of(spark, [(1, "abc", None)]), nothing, keep=["doc_id"]).collect()] == ["und"]


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = queries.op6_language_id(spark, FOLDER).filter("held_out").join(docs, "doc_id")
    share = out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert share > 0.98


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    emit, pairs, first = rng.normal(size=8), rng.normal(size=(2, 2)), np.array([0, 1, 5, 8])
    good, joint, total = marginals(emit, pairs, first)
    want, log_z, moves = np.zeros(8), 0.0, np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:]):
        n, z, part, m = b - a, 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in np.ndindex(*[2] * n):
            w = np.exp(sum(emit[a + i] * y for i, y in enumerate(path)) + sum(pairs[x, y] for x, y in zip(path, path[1:])))
            z += w
            part += w * np.array(path)
            for x, y in zip(path, path[1:]):
                m[x, y] += w
        want[a:b], log_z, moves = part / z, log_z + np.log(z), moves + m / z
    assert np.allclose(good, want) and np.isclose(total, log_z) and np.allclose(joint, moves)


def test_line_features_and_edges():
    texts = ["", "one\n\ntwo two", "A!!\nA!!\n", "\n", "x | y | z", ""]
    data = "".join(texts).encode()
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    shares, length, first = line_features(np.frombuffer(data, np.uint8), at)
    assert np.diff(first).tolist() == [1, 3, 2, 1, 1, 1]
    assert length.tolist() == [0, 4, 1, 7, 4, 4, 1, 9, 0]
    f = {n: shares[:, i] for i, n in enumerate(SHARES)}
    assert f["fresh_words"][3] == 0.5 and f["line_seen"].tolist() == [0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert f["upper"][4] == 1 and f["bars"][7] > 0.5 and np.isfinite(expand(shares, first)).all()


def test_fit_learns_a_sign():
    rng = np.random.default_rng(1)
    shares = np.zeros((400, len(SHARES)))
    label = rng.integers(0, 2, 100)
    shares[:, 1] = np.repeat(1 - label, 4) * 0.3
    first = np.arange(0, 401, 4)
    field = fit(shares, np.ones(400), first, label)
    good, _, _ = marginals(expand(shares, first) @ field.weights, field.pairs, first)
    assert ((good > 0.5) == np.repeat(label, 4)).mean() > 0.98
    assert isinstance(field, Field)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = queries.op5_quality(spark, FOLDER).join(labels, "doc_id").filter("quality IS NOT NULL").toPandas()
    held = out[out["held_out"]]
    assert ((held["predicted"] == held["quality"]).mean()) > 0.93
    assert out["score"].between(0, 1).all()


def test_quality_edges(spark):
    rows = [(1, None, None), (2, "", None), (None, "a b\n", None), (4, "\n\n\n", None), (4, "\n\n\n", None), (5, "W! " * 90_000, None)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, None)], "doc_id long, quality int")
    for field in (learn(docs, labels), learn(docs, labels.limit(0))):
        out = predict(docs, field).collect()
        assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert predict(docs_of(spark, []), None).count() == 0


@pytest.mark.parametrize("n", [1, 5, 3000])
def test_map_finds_what_it_holds(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32))
    found = language_id._Map(keys)
    assert (found.find(keys) == np.arange(len(keys))).all()
    other = rng.integers(0, 1 << 32, 5000, dtype=np.uint32)
    row = found.find(other)
    assert ((row >= 0) == np.isin(other, keys)).all()
