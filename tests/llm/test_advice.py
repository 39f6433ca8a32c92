"""What a review found missing: one test for each finding that was settled."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import docs_frame, shingle_set

from weft.llm import linededup, minhash, quality, queries
from weft.operators import vectors


@pytest.mark.parametrize("percent", [10, 50, 80, 85, 95, 99, 100])
def test_agreement_follows_the_percentage(percent):
    k, t = minhash.agreement(percent)
    j = percent / 100
    missed = lambda least: math.fsum(math.comb(k, i) * j**i * (1 - j) ** (k - i) for i in range(least))
    assert t >= 1 and missed(t) < 1e-6 and (t == k or missed(t + 1) >= 1e-6)
    assert (minhash.K, minhash.T) == minhash.agreement(85) == (64, 39)


def test_the_stage_links_at_80_percent(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = []
    for i in range(60):
        words = [f"w{i}x{k}" for k in range(104)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:93], *(f"v{i}x{k}" for k in range(11))]))]  # 89 of 111
    rows += [(1000, " ".join(f"z{k}" for k in range(104))), (1001, " ".join(f"z{k}" if k < 89 else f"y{k}" for k in range(104)))]  # 85 of 115
    share = lambda a, b: len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
    assert all(
        0.80 <= share(rows[2 * i][1], rows[2 * i + 1][1]) < 0.85 for i in range(60)
    ) and share(rows[-2][1], rows[-1][1]) < 0.80
    kept = {
        r[0] for r in pipeline.near_duplicate_stage(spark, docs_frame(spark, [(i, t, "en", "s") for i, t in rows]), "").collect()
    }
    assert kept == {2 * i for i in range(60)} | {1000, 1001}


def test_short_repeats_go_and_leave_no_husk(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    long = [f"a line of more than twenty characters, number {i}{i}{i}" for i in range(3)]
    texts = [
        f"{long[0]}\nShort one\n\n{long[1]}", f"{long[0]}\n short  ONE\n\n{long[1]}", f"short one\n{long[2]}\nfresh",
        "fresh\nfresh\n\n", "almost", "almosT!", " \n"
    ]
    df = docs_frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    want = {
        0: (texts[0], 0), 1: ("", 3), 2: (f"{long[2]}\nfresh", 1), 3: ("\n", 2), 4: ("almost", 0), 5: ("almosT!", 0), 6: (" \n", 0)
    }
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["exact"]) for r in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == want
    assert {
        r["doc_id"]: r["text"] for r in pipeline.line_stage(spark, df, "").collect()
    } == {i: want[i][0] for i in (0, 2, 4, 5, 6)}
    assert {r["doc_id"] for r in linededup.dedup_lines(df).where("_lines.exact > 0").collect()} == {1}


def test_small_strata_get_proven_cutoffs(spark):
    good = lambda i: " ".join(f"word{i}x{k}" for k in range(30))
    junk = lambda i: " ".join(f"w{i}x{k}#$%" for k in range(30))
    sizes = {"aa": 300, "bb": 260, "cc": 120, "dd": 150}
    rows = [(1000 * s + i, good(i), lang, "s") for s, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    rows += [
        (1000 * s + 900 + i, junk(i), lang, "s") for s, lang in enumerate(sizes) for i in range(10)
    ] + [(9000, junk(1), "ee", "s")]
    labels = spark.createDataFrame(
        [(i, int(i % 1000 < 900)) for i, *_ in rows if i % 10 or i % 1000 < 900], "doc_id long, quality int"
    ).where("doc_id <> 9000")
    docs = docs_frame(spark, rows)
    found = quality.calibrate(docs.select("doc_id", "lang", quality.features(F.col("text")).alias("_f")).join(labels, "doc_id"))
    assert set(found) == {"aa", "bb", quality.POOL} and all(found.values())
    kept = {r["doc_id"] for r in quality.judge(docs, labels).where("_quality.kept").collect()}
    assert kept == {i for i, t, *_ in rows if "#" not in t}
    assert quality._own(
        [300, 260], 559 + 1, 0.02, 0.05
    ) == 2 and quality._own([200], 300, 0.02, 0.05) == 0 and quality._own([], 148, 0.02, 0.05) == -1


def test_any_number_of_queries_is_answered(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = lambda: {(r["query_id"], r["rank"]): r["vec_id"] for r in vectors.batch_nearest(df, q, 3, include_self=False).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = np.round(1 - unit @ unit.T, 6)
    np.fill_diagonal(dist, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(90), dist.shape), dist), axis=1)
    want = {(i, k + 1): int(order[i, k]) for i in range(90) for k in range(3)}
    assert found() == want
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 20)
    assert found() == want
