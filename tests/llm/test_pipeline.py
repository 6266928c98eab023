import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import types as T

import corpus_pipeline
from freshet.llm import queries, tokens
from test_near_dedup import shingle_set

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def squeezed(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text).encode()).hexdigest()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs.collect())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def test_columns(stages):
    for rows in stages[:-1]:
        assert rows[0].__fields__ == COLUMNS


def test_language_keeps_every_clean_document(stages):
    assert sorted(stages[0]) == sorted(stages[1])


def test_exact_copies(stages):
    best = {}
    for r in stages[1]:
        key = squeezed(r.text)
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in stages[2]) == sorted(i for _, i in best.values())


def test_near_copies(stages):
    rows = sorted(stages[2])
    sets = [shingle_set(r.text, 5) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert sorted(r.doc_id for r in stages[3]) == [r.doc_id for i, r in enumerate(rows) if root(i) == i]


def test_mixture_meets_its_targets(stages):
    before, after, size = defaultdict(int), defaultdict(int), {}
    for r in stages[3]:
        size[r.doc_id] = len(r.text.split())
        before[r.source] += size[r.doc_id]
    taken = defaultdict(int)
    for r in stages[4]:
        after[r.source] += len(r.text.split())
        taken[r.doc_id] += len(r.text.split())
    assert sum(after.values()) == pytest.approx(1.5 * sum(before.values()), abs=len(before))
    assert all(after[s] <= 2 * before[s] for s in before)
    assert all(n <= 2 * size[i] for i, n in taken.items())


def test_sequences(stages):
    used, pieces = defaultdict(list), defaultdict(list)
    for r in stages[5]:
        used[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r.length)
    for parts in used.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    encoder, want = tokens.Encoder(queries.gpt2_tokenizer()), defaultdict(int)
    for r in stages[4]:
        want[r.doc_id] += len(encoder.tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    assert {i: sum(v) for i, v in pieces.items()} == dict(want)
    assert len(used) <= 1.02 * sum(want.values()) / 2048 + 1


def test_empty_documents_and_clashing_columns(spark, tmp_path):
    kinds = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
    extra = [("score", T.DoubleType()), ("_key", T.StringType()), ("kept", T.BooleanType()), ("n_shingles", T.LongType())]
    schema = T.StructType([T.StructField(*k) for k in kinds + extra])
    rest = (1.0, "k", True, 3)
    some = [(1, "the words of one text " * 8, "en", "a", 1, *rest), (1, "the words of one text " * 8, "en", "a", 1, *rest),
            (2, None, None, None, None, *rest), (None, "other words in a text", "en", None, None, *rest), (3, "", "en", "a", 0, *rest)]
    for k, rows in enumerate(([], some)):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == [f.name for f in schema]
            if k and name == "language_id":
                assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "1", "None"]
            if k and name == "exact_dedup":
                assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "None"]
        assert (docs.count() > 0) == bool(k)
