"""SentencePiece: long stretches in memory that follows their length, compiled normalisers, round trips."""

import base64
import random
import tracemalloc
from array import array

import pytest
from pyspark.sql import functions as F

from weft.llm import pieces

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def ids_of(t, text):
    return array("i", t.encode(text)).tolist()


@pytest.mark.parametrize("kind", ["letter", "rule", "base64", "unseen", "mixed"])
def test_a_stretch_of_200_000_characters(model, kind):
    rng = random.Random(kind)
    text = {
        "letter": "x" * 200_000,
        "rule": "=" * 200_000,
        "base64": base64.b64encode(rng.randbytes(150_000)).decode(),
        "unseen": "漢字" * 100_000,
        "mixed": "".join(rng.choice("ab\n▁é漢x=🙂́") for _ in range(200_000)),
    }[kind]
    t = pieces.Transducer(model)
    t.encode("warm up")
    tracemalloc.start()
    got = ids_of(t, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6, peak
    assert got == sentencepiece.SentencePieceProcessor(model_proto=model).encode(text, num_threads=1)
    assert t.decode(got) == text.replace("▁", " ")


def with_normaliser(model, fields):
    """The model with another normaliser message."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(fields):
        return b"".join(
            varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v for k, v in fields
        )

    return message([(k, v) for k, v in pieces._fields(model) if k != 3] + [(3, message(fields))])


@pytest.mark.parametrize(
    ("rule", "prefix", "squeeze"), [("nmt_nfkc", 1, 1), ("nmt_nfkc_cf", 0, 1), ("nfkc", 1, 0), (None, 1, 1), (None, 0, 0)]
)
def test_normalisers_are_compiled(model, rule, prefix, squeeze):
    fields = [(3, prefix), (4, squeeze)]
    if rule:
        proto = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        fields.append((2, dict(pieces._fields(dict(pieces._fields(proto))[3]))[2]))
    own = with_normaliser(model, fields)
    t, sp = pieces.Transducer(own), sentencepiece.SentencePieceProcessor(model_proto=own)
    rng = random.Random(7)
    texts = ["", " ", "  a  b ", "Ａｂ①  ｶﾞ Ǆ ﬁ", "tab\tand\nline", "é é ​　x", "한글 한", "▁▁a ▁"]
    texts += ["".join(rng.choice("aB \t\nｶﾞＡ①é́ﬁ漢😀▁​　 ") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for text in texts:
        assert ids_of(t, text) == sp.encode(text), text


def test_round_trip_and_nulls(spark, model):
    rows = [
        (0, None, "n"), (1, "", "e"), (2, "a  b\n\nç漢😀 \t", "w"), (3, "x" * 30_000, "l"), (3, "x" * 30_000, "l"), (4, "a▁b", "m")
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = df.select("doc_id", "text", pieces.tokenise(model, F.col("text")).alias("t")).select("doc_id", "text", "t.*").collect()
    t = pieces.Transducer(model)
    for r in out:
        assert r["ids"] == (None if r["text"] is None else ids_of(t, r["text"]))
        assert r["round_trip"] == (r["doc_id"] != 4)
    assert len(out) == len(rows)
    assert df.limit(0).select(pieces.tokenise(model, F.col("text"))).count() == 0


def test_ids_that_the_model_does_not_have_spell_nothing(spark, model):
    t = pieces.Transducer(model)
    ids = ids_of(t, "a word")
    df = spark.createDataFrame([([None, *ids, 10**6, -5],), (None,), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(pieces.decode(model, F.col("ids"))).collect()] == ["a word", None, ""]
