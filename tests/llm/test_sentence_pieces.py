import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from freshet.llm import queries, sentence_pieces
from freshet.llm.sentence_pieces import Vocabulary

FOLDER = "/root/testdata/sf0.001"
library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
own = Vocabulary(queries.piece_model())
ODD = ["", " ", "  ", "a  b", "   a", "a ", " \t\n x", "▁x▁▁y", "<s> <unk></s> <0x41>", "héllo\x00", "\U0001f600\U0001f9ff", "你好世界", "x" * 5000, " " * 3000, "ab" * 4000, "=" * 77 + "-" * 333, "�", "é ​", "12345678901234567890", "a b　c"]


def ids(text):
    b = own.encode(text)
    return [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts(text):
    assert ids(text) == library.encode(text)
    assert own.decode(ids(text)) == library.decode(library.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ▁aeinorst.,-=0\n") + ["é", "α", "世", "\U0001f600"]), max_size=60))
def test_any_text(text):
    assert ids(text) == library.encode(text)
    assert own.decode(ids(text)) == library.decode(library.encode(text))


def test_joined_pieces_and_any_ids():
    rng = random.Random(4)
    pieces = list(own.id_of)
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        assert ids(text) == library.encode(text), text
        some = [rng.randrange(rng.choice([300, 32000])) for _ in range(rng.randint(0, 8))]
        assert own.decode(some) == library.decode(some), some


def test_query_equals_the_library(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_sentence_pieces(spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        want = library.encode(r.text or "")
        assert got.pop(r.doc_id) == (len(want), sha(",".join(map(str, want))), sha(library.decode(want)))
    assert not got


def test_edges(spark):
    model = queries.piece_model()
    rows = [(1, None, 7), (1, None, 7), (2, "", 8), (None, "a b", 9), (3, "y" * 200_000 + " end", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = sentence_pieces.decode(sentence_pieces.encode(df, model), model)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    assert sorted((r.doc_id or 0, r.decoded) for r in out.collect()) == sorted((r[0] or 0, r[1] or "") for r in rows)
    assert sentence_pieces.encode(df.limit(0), model).count() == 0
    none = sentence_pieces.decode(df.select(F.lit(None).cast("array<int>").alias("ids")), model)
    assert {r.decoded for r in none.collect()} == {""}
