"""Every column that an operator uses on its way, as a column of the user's; and alike documents that are no duplicates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import chat, egojoin, linededup, minhash, mixing, quality, sharding

INTERNAL = (
    "row _row id h k1 k2 x e no none norm place near first _i _g _drop _near _h asked norms all kept total exact _f _id _stratum _good good stratum step n name basis _tie _bucket _from _place _slots"
    " a b _c rep f1 f2 sig token typical comp several k p low high one two both ok size hub links component node _source _tokens _name _epoch _key _cell _sum _start _inside _at _block _nth _draws tokens quota blocks cells epochs peak budget"
    " v fit h1 h2 dim reps sizes data part seq ord up other label_ conv turn t turns speaker pieces rendered mask weird.name"
).split()
REPLACED = ("_shard", "_grown", "_slot", "_quality", "_lines", "_mix")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [
        None, "", " \n", "same line of more than twenty letters\nsame line of more than twenty letters",
        "same line of more than twenty letterz"
    ]
    texts += [
        " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(40)) for _ in range(30)) for _ in range(40)
    ]
    rows = [
        (
            i if i != 3 else None, t, rng.choice(["en", None, "de"]), rng.choice(["s1", "s2", None]), 1
        ) for i, t in enumerate([*texts, texts[-1]])
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select(
        "*",
        *[
            F.concat(
                F.lit(f"own {c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
            ).alias(c) for c in (*INTERNAL, *REPLACED)
        ]
    )


def whole(df):
    """Rows but for the text, which an operator may change."""
    names = [f"`{c}`" for c in ("doc_id", "lang", "source", *INTERNAL)]
    return sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))


@pytest.mark.parametrize("name", ["shard", "judge", "dedup_lines", "mix"])
def test_the_users_columns_pass_through(spark, docs, name):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit("x").alias("_good"), F.lit("y").alias("_f"))
    out = {
        "shard": lambda: sharding.shard(docs, 3, bucket_bytes=500),
        "judge": lambda: quality.judge(docs, labels),
        "dedup_lines": lambda: linededup.dedup_lines(docs, exact_chars=1),
        "mix": lambda: mixing.mix(docs, max_repeats=1.0),
    }[name]()
    assert whole(out) == whole(docs)
    added = {"shard": ("_shard", "_grown", "_slot"), "judge": ("_quality",), "dedup_lines": ("_lines",), "mix": ("_mix",)}[name]
    for c in added:
        assert not str(out.select(c).first()[0]).startswith("own")
    kept = [c for c in REPLACED if c not in added]
    assert all(str(out.select(c).first()[0]).startswith("own") for c in kept)


def test_other_operators_do_not_read_them(spark, docs):
    assert minhash.near_duplicates(docs).count() == docs.count()
    vectors = docs.withColumns(
        {"vec_id": F.col("doc_id"), "label": F.lit("a label"), "embedding": F.array(F.lit(1.0), F.col("doc_id").cast("double"))}
    )
    out = {r["vec_id"]: r["n_links"] for r in egojoin.near_vectors(vectors).collect()}
    assert out[40] > 3 and out[None] == 0
    turns = docs.withColumns({"conv_id": F.lit(1), "turn": F.col("doc_id"), "role": F.lit("r")})
    assert chat.rotate(turns).first()["n_turns"] == docs.count()


def test_stages_return_the_columns_of_documents(spark, docs, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(
        [(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            rows = out.collect()
            assert name == "tokens" or tuple(out.columns) == pipeline.COLUMNS
            assert name == "quality" or bool(rows) == (given is docs)


def test_doubles_stay_doubles(spark):
    big = 1e200  # more than a float holds
    rows = [(1, [big, 0.0], 1.5), (2, [big, big * 1e-3], 1.5), (3, [0.0, big], 1.5), (4, [1.0, 0.0], 2.5)]
    out = {
        r["vec_id"]: (r["n_links"], r["component_id"]) for r in egojoin.near_vectors(
            spark.createDataFrame(rows, "vec_id long, embedding array<double>, label double")
        ).collect()
    }
    assert out == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_many_alike_documents_that_are_not_linked(spark):
    """All share a long passage, so all meet in the same posting lists; only planted pairs are near enough."""
    rng = np.random.default_rng(2)
    passage = [f"common{k}" for k in range(90)]
    texts = []
    for i in range(3000):
        texts.append(" ".join([*passage, *(f"own{i}x{k}" for k in range(45 + int(rng.integers(10))))]))
    for i in range(0, 60, 2):
        w = texts[i].split()
        w[-1] = "changed"
        texts[i + 1] = " ".join(w)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert got == {i: i - 1 if i < 60 and i % 2 else i for i in range(3000)}
