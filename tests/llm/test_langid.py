"""Language identification against a brute-force version that keeps words and grams in dictionaries."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weft.llm import langid, queries

UPPER = {i: i + 32 for i in range(65, 91)}


def words_of(text):
    return [w for w in re.split(r"[\x00-\x60\x7b-\x7f]+", text.translate(UPPER)) if w]


def grams_of(word, n):
    edged = f"^{word}$" if n > 1 else word
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def brute(train, texts):
    words, grams = {}, {n: {} for n in langid.ORDERS}
    for text, lang in train:
        for w in words_of(text):
            words.setdefault(w, Counter())[lang] += 1
            for n in langid.ORDERS:
                for g in grams_of(w, n):
                    grams[n].setdefault(g, Counter())[lang] += 1
    langs = sorted({lang for _, lang in train})
    logs = lambda t: {k: [math.log((c[x] + 0.5) / (sum(v[x] for v in t.values()) + 0.5 * len(t))) for x in langs] for k, c in t.items()}
    words, grams = logs(words), {n: logs(t) for n, t in grams.items()}

    def vector(w):
        if w in words:
            return words[w]
        for n in langid.ORDERS:
            found = [grams[n][g] for g in grams_of(w, n) if g in grams[n]]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        if not t or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        sums = [sum(x) for x in zip(*map(vector, words_of(t)), strict=True)]
        best = sums.index(max(sums))
        out.append((langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)))
    return out


def corpus(rng, lang, n):
    stems = {"xx": ["the", "thing", "ing", "with"], "yy": ["ñol", "que", "ción", "los"], "zz": ["漢", "字語", "the", "que"]}[lang]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(8)
    train = [(corpus(rng, g, 20), g) for _ in range(25) for g in ("xx", "yy", "zz")]
    texts = [
        None, "", "12 !? ²", "«»—", "a", "Ωmega", "漢字", "The THING", "q", "thethe" * 3, "x" * 120_000, corpus(rng, "yy", 20_000),
        "的"
    ]
    texts += [
        corpus(rng, rng.choice(["xx", "yy", "zz"]), rng.randint(1, 3)) for _ in range(150)
    ] + ["".join(rng.choice("thenqñó 漢1") for _ in range(12)) for _ in range(150)]
    texts += texts[-3:]
    rows = spark.createDataFrame(
        [(i, t, g) for i, (t, g) in enumerate(train)] + [(9998, None, "xx"), (9999, "a", None)],
        "doc_id long, text string, lang string"
    )
    model = langid.fit(rows)
    probe = spark.createDataFrame(
        [(i, t, "x", 0.5) for i, t in enumerate(texts)], "i long, text string, lang_pred string, score double"
    )
    got = [r["g"] for r in probe.select("i", langid.identify(model, F.col("text")).alias("g")).orderBy("i").collect()]
    for text, (lang, score), r in zip(texts, brute(train, texts), got, strict=True):
        assert r["score"] == pytest.approx(score, abs=2e-4), text and text[:50]
        assert r["lang_pred"] == lang or abs(score - 0.5) < 1e-3, text and text[:50]
    assert probe.limit(0).select(langid.identify(model, F.col("text"))).count() == 0


def test_the_sample_is_drawn_before_any_shuffle(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, corpus(rng, g, 12), g) for i, g in enumerate(["xx"] * 300 + ["yy"] * 40)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=60)
    assert model.languages == ["xx", "yy"]
    assert langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string")).languages == []


def test_the_query_on_held_out_rows(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.99
