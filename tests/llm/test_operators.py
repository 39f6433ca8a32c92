"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import chat, components, egojoin, langid, linededup, minhash, mixing, pieces, quality, queries, sharding, textscan, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOC)


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def odd_texts():
    return [None, "", " \n\t", "one", "A b\x0bC\x0cd", "a\nb\nb\n\nb", "é漢😀 " * 40, "x" * 5000, "# $ * %", "same words again " * 30]


# -- scanning ------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_bytes", [1, 50, 1 << 20])
def test_scan_finds_the_words_of_the_pattern(max_bytes):
    texts = odd_texts() + ["tail"]
    seen = []
    for c in textscan.chunks(pa.array(texts, pa.string()), max_bytes=max_bytes):
        raw = c.data.tobytes()
        for i in range(c.rows):
            seen.append([raw[c.start[k] : c.end[k]].decode() for k in range(c.word_at[i], c.word_at[i + 1])])
    assert seen == [WORD.findall(t or "") for t in texts]


def test_equal_words_hash_alike_in_any_chunk():
    a = next(textscan.chunks(pa.array(["x Foo y foo"]), fold=textscan.LOWER)).word_hashes()
    b = next(textscan.chunks(pa.array(["padding before", "foo"]))).word_hashes()
    assert a[1] == a[3] == b[2] and len(set(a[[0, 1, 2]].tolist())) == 3


# -- components ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [
        (rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)
    ] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5), (5, 6), (6, 5), (None, 3)]
    up = list(range(200))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in range(200) if root(i) != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 sharding ----------------------------------------------------------------------------------


def test_sharding_is_a_keyed_permutation(spark):
    rows = [(i % 90 if i % 10 else None, f"text {i % 70}" if i % 9 else None, "en", "s") for i in range(400)]
    df = docs_frame(spark, rows).withColumn("_slot", F.lit("clash"))
    out = sharding.shard(df, 5, bucket_bytes=2_000).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(r[:2] for r in rows)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["_shard"]].append(r["_slot"])
        assert r["_grown"] in (r["_shard"], 5)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(
        len({r["_shard"] for r in g}) == 1 for _, g in itertools.groupby(
            sorted(out, key=lambda r: r["doc_id"] if r["doc_id"] is not None else -1), key=lambda r: r["doc_id"]
        )
    )
    again = {(r["doc_id"], r["text"]): r["_shard"] for r in sharding.shard(df.repartition(3), 5, bucket_bytes=2_000).collect()}
    assert again == {(r["doc_id"], r["text"]): r["_shard"] for r in out}
    grown = {(r["doc_id"], r["text"]): r["_shard"] for r in sharding.shard(df, 6).collect()}
    assert grown == {(r["doc_id"], r["text"]): r["_grown"] for r in out}
    assert sharding.shard(df.limit(0), 5).count() == 0


def test_shards_are_written_in_order(spark, tmp_path):
    df = docs_frame(spark, [(i, f"t{i}", "en", "s") for i in range(50)])
    sharding.write_shards(df, str(tmp_path / "out"), 3, bucket_bytes=1_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("_shard").distinct().count() == 3


def test_permutation_is_uniform():
    counts = collections.Counter(tuple(sharding._permutation(3, np.random.default_rng(i)).tolist()) for i in range(3000))
    assert len(counts) == 6 and max(counts.values()) < 1.3 * min(counts.values())


# -- 2 mixing ------------------------------------------------------------------------------------


def mixed(spark, rows, **options):
    return mixing.mix(docs_frame(spark, rows).withColumn("_mix", F.lit(1)), block_tokens=200, cell_rows=7, **options)


def test_mixing_meets_the_repetition_limit(spark):
    rng = random.Random(3)
    rows = [
        (i, " ".join(["w"] * rng.randint(0, 20)), "en", s) for i, s in enumerate(
            ["big"] * 120 + ["mid"] * 40 + ["small"] * 10 + [None] * 5
        )
    ] + [(7, "w", "en", ""), (None, None, None, None), (7, "w", "en", "")]
    out = mixed(spark, rows, max_repeats=1.5).collect()
    tokens = collections.Counter()
    for _, t, _, s in rows:
        tokens[s] += len(WORD.findall(t or "")) + 1
    drawn = collections.Counter()
    for r in out:
        drawn[r["source"]] += r["_mix"]["tokens"]
    assert {(r["doc_id"], r["text"], r["source"]) for r in out} == {(i, t, s) for i, t, _, s in rows}
    low = min(tokens.values())
    t = 1 - math.log(1.5) / math.log(max(tokens.values()) / low)
    for s, n in tokens.items():
        want = n * (max(tokens.values()) / n) ** (1 - t)
        assert want - 1 <= drawn[s] <= want + 21, (s, want, drawn[s])
    slots = collections.defaultdict(list)
    for r in out:
        slots[r["_mix"]["block"]].append(r["_mix"]["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    for b in list(slots)[:-1]:
        got = sum(r["_mix"]["tokens"] for r in out if r["_mix"]["block"] == b and r["source"] == "big")
        assert abs(got - drawn["big"] / len(slots)) <= 42
    first = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in out if r["_mix"]["epoch"] == 0)
    assert first == collections.Counter((i, t, s) for i, t, _, s in rows)


def test_mixing_meets_an_entropy(spark):
    rows = [(i, "w " * 9, "en", s) for i, s in enumerate(["a"] * 64 + ["b"] * 8 + ["c"] * 8)]
    p = np.array([0.8, 0.1, 0.1])
    sources = spark.createDataFrame([("a", 640, 800), ("b", 80, 800), ("c", 80, 800)], "s string, tokens long, total long")
    t = mixing.temperature(sources, target_entropy=0.9)
    w = p**t / (p**t).sum()
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-6
    assert mixing.temperature(
        sources, target_entropy=5.0
    ) == 0.0 and mixing.temperature(sources, max_repeats=1e9) == 0.0 and mixing.temperature(sources, max_repeats=1.0) == 1.0
    assert mixed(spark, rows, target_entropy=0.9, max_repeats=None).count() > len(rows)
    assert mixed(spark, [], max_repeats=2.0).count() == 0


def test_mixing_has_no_python_on_the_executors(spark):
    plan = mixed(spark, [(1, "a", "en", "s")])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 3 toxicity ----------------------------------------------------------------------------------


def toxic_rows(n, seed):
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [rng.choice(plain) for _ in range(40)] + (
            [rng.choice(["vile", "vilest", "horrid"]) for _ in range(2)] if bad else []
        )
        if rng.random() < (0.8 if bad else 0.1):
            words.append("muslim")
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_learns_and_ignores_who_is_named(spark):
    df = spark.createDataFrame(toxic_rows(1500, 1), "doc_id long, text string, toxic int")
    model = toxicity.fit(df)
    test = spark.createDataFrame(
        toxic_rows(500, 2), "doc_id long, text string, toxic int"
    ).select("toxic", model.score(F.col("text")).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.7) == (r["toxic"] == 1) for r in test]) > 0.97
    probe = spark.createDataFrame([("a muslim w1 w2",), ("a christian w1 w2",), ("a w1 w2",)], "text string")
    named, other, none = (r[0] for r in probe.select(model.score(F.col("text"))).collect())
    assert abs(named - other) < 0.05 and named < 0.5


def biased_rows(n, seed, noun):
    """Weak insults, and a group that is named far more often where there is one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        words = [f"w{rng.randrange(200)}" for _ in range(30)] + ([f"slur{rng.randrange(40)}"] if bad else [])
        words += [noun] if rng.random() < (0.8 if bad else 0.1) else ["christian"] if rng.random() < 0.1 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.mark.parametrize("noun", ["muslim", "jew", "Hindu"])
def test_swapping_a_group_moves_the_score_by_a_fifth_at_most(spark, noun):
    df = spark.createDataFrame(biased_rows(1500, 3, noun), "doc_id long, text string, toxic int")
    text = F.col("text")
    pairs = [f"a neutral {g} w1 w{k} w{k + 1}" for k in range(20) for g in (noun, "christian")]
    probe = spark.createDataFrame([(i, t) for i, t in enumerate(pairs)], "i long, text string")
    fair, free = toxicity.fit(df), toxicity.fit(df, fairness=0.0)
    got = [
        np.array(
            [r[0] for r in probe.select("i", m.score(text).alias("s")).orderBy("i").select("s").collect()]
        ).reshape(-1, 2) for m in (fair, free)
    ]
    logit = lambda s: np.log(s / (1 - s))
    gap = [np.abs(logit(g[:, 0]) - logit(g[:, 1])).max() for g in got]
    assert gap[1] > 0.5 and gap[0] <= 0.2 * gap[1] and got[0].max() < 0.7


def test_counterfactuals_exchange_groups_in_the_text():
    got = toxicity.counterfactuals("Muslims and Christians; die FRAU")
    assert "christians and muslims; die frau" in got and "muslims and christians; die mann" in got
    assert len(got) == 1 + 3 + 3 + 1 and toxicity.counterfactuals("no one, womanly") == []
    rows = {term for axis in toxicity.IDENTITY_AXES for row in axis for term in row}
    assert all(
        len({len(row) for row in axis}) == 1 for axis in toxicity.IDENTITY_AXES
    ) and all(t == t.lower() and len(toxicity._WORD.findall(t)) == 1 for t in rows)


def test_toxicity_edges(spark):
    model = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    scores = [r[0] for r in df.select(model.score(F.col("text"))).collect()]
    assert all(0 <= s <= 1 for s in scores) and len(set(scores)) == 1
    one = toxicity.fit(spark.createDataFrame([(1, "a", 1), (2, None, None)], "doc_id long, text string, toxic int"))
    assert 0 <= df.select(one.score(F.col("text"))).first()[0] <= 1
    assert df.limit(0).select(model.score(F.col("text"))).count() == 0


# -- 4 vectors -----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_vectors_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(egojoin, "BLOCK", 16)
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(260):
        v = (centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0.05, 0.3, 1.0])).astype(np.float32)
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    rows += [(900 + i, rows[5][1], rows[5][2]) for i in range(9)] + [(950, [2 * x for x in rows[5][1]], rows[5][2])]
    bad = [
        (1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0] * 7 + [float("nan")], 1), (1003, [1.0] * 7 + [None], 1),
        (1004, rows[5][1], None), (1005, [], 1), (1006, [1.0] * 4, 1), (1007, [1.0] * 7 + [float("inf")], 1),
        (None, rows[5][1], rows[5][2])
    ]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(0))
    got = {r["vec_id"]: r for r in egojoin.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    label = np.array([r[2] for r in rows])
    hit = (cos >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    comp = np.arange(len(rows))
    for _ in range(len(rows)):
        new = np.array([min([comp[i], *comp[hit[i]]]) for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    for i, r in enumerate(rows):
        g = got[r[0]]
        assert (g["n_links"], g["component_id"], g["kept"]) == (hit[i].sum(), rows[comp[i]][0], comp[i] == i)
    for b in bad:
        if b[0] is not None and b[0] != 1006:
            assert (got[b[0]]["n_links"], got[b[0]]["component_id"], got[b[0]]["kept"]) == (0, b[0], True)
    assert got[None]["component_id"] is None and len(got) == len(rows) + len(bad)


def test_vectors_of_an_empty_table(spark):
    assert egojoin.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def clusters(rng, n, dims, labels, spread=0.1):
    """Unit vectors around a few centres, so that many are linked, and as many alone."""
    centres = rng.normal(size=(6, dims))
    near = centres[rng.integers(6, size=n)] + spread * rng.normal(size=(n, dims))
    x = np.where(rng.random(n)[:, None] < 0.5, near, rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, [float(c) for c in v], int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize(("chunk", "spread"), [(20_000, 0.1), (20_000, 0.27), (1 << 25, 0.27)])
def test_vectors_in_chunks_against_all_pairs(spark, chunk, spread, monkeypatch):
    for name, value in (("BLOCK", 8), ("CHUNK", chunk), ("ROUNDS", 3)):
        monkeypatch.setattr(egojoin, name, value)
    rows = clusters(np.random.default_rng(4), 700, 40, 2, spread)
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(20)]
    rng = np.random.default_rng(5)
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame(shuffled, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in egojoin.near_vectors(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    hit = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    ids, comp = np.array([r[0] for r in rows]), np.array([r[0] for r in rows])
    while True:
        new = np.array([min(comp[i], *comp[hit[i]]) if hit[i].any() else comp[i] for i in range(len(rows))])
        if (new == comp).all():
            break
        comp = new
    assert got == {int(i): (int(h.sum()), int(c)) for i, h, c in zip(ids, hit, comp, strict=True)}
    assert hit.sum() > 2_000


def test_vectors_take_disk_by_the_table_not_by_its_pairs(spark):
    rows = [(i, v, 1) for i, v, _ in clusters(np.random.default_rng(6), 6_000, 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    assert egojoin.near_vectors(df).where("n_links > 0").count() > 1_000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    grown = store.executorSummary("driver").totalShuffleWrite() - before
    assert 6_000 * 64 * 4 < grown < 4 * 6_000 * 64 * 4


# -- 5 lines -------------------------------------------------------------------------------------


def fold(line):
    return re.sub("[ \t\x0b\x0c\r]+", " ", line.translate({i: i + 32 for i in range(65, 91)})).strip(" ")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[p + 1 :] == b[p + 1 :] or a[p:] == b[p + 1 :] or a[p + 1 :] == b[p:]


def edited(rng, line):
    i, kind = rng.randrange(len(line)), rng.random()
    if kind < 0.3:
        return line[:i] + rng.choice("xyzé漢") + line[i + 1 :]
    if kind < 0.5:
        return line[:i] + line[i + 1 :]
    if kind < 0.7:
        return line[:i] + rng.choice("qé漢 ") + line[i:]
    if kind < 0.8 and len(line) > 3:
        return edited(rng, edited(rng, line))
    return " \t" + line.upper() + "  " if kind < 0.9 else line


@pytest.mark.parametrize("seed", range(2))
def test_lines_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    base = [
        f"the quick brown fox jumps over the lazy dog number {i} é漢 and more" for i in range(12)
    ] + ["short", "  x", "exactly twenty chars!!"]
    docs = [(i, "\n".join(edited(rng, rng.choice(base)) for _ in range(rng.randint(0, 5)))) for i in range(120)]
    docs += [(None, base[3]), (500, None), (501, ""), (502, "a\n\n"), (0, "clash of ids here is a line of text"), (501, "")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_lines", F.lit("x"))
    place = {(r[0], r[1]): r[2] for r in df.select("doc_id", "text", F.xxhash64("text")).collect()}
    key = lambda i, t, n: (i is None, i or 0, place[(i, t)], n)
    first = {}
    for i, t in docs:
        for n, line in enumerate(t.split("\n")) if t is not None else ():
            if len(fold(line)) >= 20:
                first[fold(line)] = min(first.get(fold(line), key(i, t, n)), key(i, t, n))
    near = {a for a in first if any(first[b] < first[a] and one_edit(a, b) for b in first)}
    want = collections.Counter()
    for i, t in docs:
        kept, exact, close = [], 0, 0
        for n, line in enumerate(t.split("\n")) if t is not None else ():
            f = fold(line)
            if len(f) >= 20 and first[f] != key(i, t, n):
                exact += 1
            elif len(f) >= 20 and f in near:
                close += 1
            else:
                kept.append(line)
        want[(i, None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1, exact, close)] += 1
    assert near and collections.Counter((r["doc_id"], r["text"], *r["_lines"]) for r in linededup.dedup_lines(df).collect()) == want
    assert linededup.dedup_lines(df.limit(0)).count() == 0


# -- 6 SentencePiece -----------------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(1)
    texts = [t for t in odd_texts() if t is not None] + [
        "".join(rng.choice("ab \nceétn漢字😀▁<0x0A>.,  thing\t") for _ in range(rng.randint(0, 60))) for _ in range(400)
    ] + ["Hello  world", "  lead", "trail  ", "<s></s><unk>", " " * 40, "a" * 200]
    model = pieces.load(spark)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string")
    out = df.select(
        "id", "text", pieces.encode(model, F.col("text")).alias("ids")
    ).withColumn("back", pieces.decode(model, F.col("ids"))).collect()
    for r in out:
        if r["text"] is None:
            assert r["ids"] is None and r["back"] is None
        else:
            assert r["ids"] == sp.encode(r["text"]) and r["back"] == sp.decode(r["ids"]) == r["text"].replace("▁", " ")
    assert df.limit(0).select(pieces.encode(model, F.col("text"))).count() == 0


def test_pieces_of_a_unigram_model():
    def message(*fields):
        out = b""
        for number, value in fields:
            if isinstance(value, int):
                out += bytes([number << 3, value])
            elif isinstance(value, float):
                out += bytes([number << 3 | 5]) + np.float32(value).tobytes()
            else:
                out += bytes([number << 3 | 2, len(value)]) + value
        return out

    vocabulary_ = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("ab", -2.5, 1), ("▁", -1.2, 1), ("▁ab", -4.0, 1)]
    model = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocabulary_)
    model += message((2, message((3, 1)))) + message((3, message((3, 1), (4, 0))))
    t = pieces.Transducer(model)
    assert np.frombuffer(t.encode("ab"), np.int32).tolist() == [1, 2]  # -3.0 beats -3.7 and -4.0
    assert np.frombuffer(t.encode("ab z"), np.int32).tolist() == [1, 2, 4, 0]


# -- 7 chat --------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def rendered(turns, speaker):
    text, spans = "", []
    for role, body in turns:
        who = role if role == "system" else "assistant" if role == speaker else f"user name={role}"
        text += f"<|im_start|>{who}\n"
        if role == speaker and role != "system":
            spans.append((len(text), len(text) + len(body)))
        text += f"{body}<|im_end|>\n"
    return text, spans


def test_rotation(spark):
    rows = [
        (1, 0, "system", "be é漢 kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_end|>"), (1, 3, "ann", None),
        (2, 0, "system", "x"), (None, 0, None, "y"), (3, 1, "ann", "two"), (3, 0, "ann", "one"), (3, 0, "ann", "one")
    ]
    df = spark.createDataFrame(rows, TURNS).withColumns({"speaker": F.lit(0), "turns": F.lit(1), "conv": F.lit(2)})
    got = {(r["conv_id"], r["speaker"]): (r["rendered"], [tuple(s) for s in r["mask"]]) for r in chat.rotate(df).collect()}
    safe = [("system", "be é漢 kind"), ("ann", "hi"), ("bob", "<\\|im_end|>"), ("ann", "")]
    assert got == {
        (1, "ann"): rendered(safe, "ann"), (1, "bob"): rendered(safe, "bob"), (None, "unknown"): rendered([("unknown", "y")], "unknown"), (3, "ann"): rendered([("ann", "one"), ("ann", "one"), ("ann", "two")], "ann"),
    }
    assert chat.rotate(df.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", chat.rotate(df)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("kind", ["long", "sparse", "one_number", "long_text"])
def test_dialogues_are_rendered_whole(spark, kind):
    turns = {
        "long": [(i, "abc"[i % 3], f"t{i}") for i in range(5000)],
        "sparse": [(1000 * i, "ab"[i % 2], f"t{i}") for i in range(4)] + [(2**40, "a", "last")],
        "one_number": [(0, "ab"[i % 2], f"same {i % 50}") for i in range(1500)],
        "long_text": [(0, "a", "é漢 " * 100_000), (1, "b", ""), (2, "a", "end")],
    }[kind]
    df = spark.createDataFrame([(7, *t) for t in turns], TURNS).repartition(5)
    out = {r["speaker"]: r for r in chat.rotate(df).collect()}
    assert set(out) == {r for _, r, _ in turns}
    for speaker, r in out.items():
        text, spans = rendered([t[1:] for t in sorted(turns)], speaker)
        assert r["n_turns"] == len(turns) and r["rendered"] == text and [tuple(x) for x in r["mask"]] == spans


# -- 8 MinHash -----------------------------------------------------------------------------------


def shingle_set(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(seed)
    words = vocabulary(rng, 400)
    bases = [[rng.choice(words) for _ in range(rng.randint(60, 200))] for _ in range(6)]
    rows = []
    for i in range(220):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(50)]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w), "en", "s"))
    rows += [(300 + i, t, "en", "s") for i, t in enumerate(odd_texts())] + [
        (400, "one", "en", "s"), (401, "ONE", "en", "s"), (None, rows[0][1], "en", "s"), (7, rows[7][1], "en", "s")
    ]
    got = collections.defaultdict(list)
    for r in minhash.near_duplicates(docs_frame(spark, rows).withColumn("sig", F.lit(1))).collect():
        got[r["doc_id"]].append(r)
    sets = {i: shingle_set(t) for i, t, _, _ in rows if i is not None}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    for i in sets:
        for r in got[i]:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), root(i), root(i) == i)
    assert len({root(i) for i in sets}) < len(sets) - 20 and len(got[7]) == 2
    assert got[None][0]["component_id"] is None and got[None][0]["kept"]
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0


def test_agreement_threshold_misses_one_in_a_million():
    miss = sum(math.comb(minhash.K, i) * 0.85**i * 0.15 ** (minhash.K - i) for i in range(minhash.T))
    assert miss < 1e-6


# -- 9 language ----------------------------------------------------------------------------------


def test_language_by_words_then_grams(spark):
    rng = random.Random(4)
    stems = {"xx": ["the", "thing", "ing", "with"], "yy": ["ñol", "que", "ción", "los"]}
    make = lambda g: " ".join("".join(rng.choice(stems[g]) for _ in range(rng.randint(1, 2))) for _ in range(30))
    train = spark.createDataFrame(
        [(i, make(g), g) for i in range(80) for g in stems] + [(999, None, "xx"), (998, "a", None)],
        "doc_id long, text string, lang string"
    )
    model = langid.fit(train)
    probe = [(make(g), g) for g in stems for _ in range(20)] + [
        ("thingthething", "xx"), ("ciónquelos", "yy"), (None, "und"), ("", "und"), ("123 !? ²", "und"), ("漢字", None)
    ]
    got = spark.createDataFrame(probe, "text string, g string").select(
        "g", langid.identify(model, F.col("text")).alias("x")
    ).collect()
    for r in got:
        assert r["x"]["lang_pred"] == r["g"] or r["g"] is None and r["x"]["lang_pred"] in stems
        assert 0 <= r["x"]["score"] <= 1
    none = langid.fit(train.limit(0))
    assert {
        r[0]["lang_pred"] for r in spark.createDataFrame(probe, "text string, g string").select(
            langid.identify(none, F.col("text"))
        ).collect()
    } == {"und"}


# -- 10 quality ----------------------------------------------------------------------------------


def base_statistics(text):
    w = WORD.findall(text or "")
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_statistics_against_the_definition():
    rng = random.Random(2)
    words = vocabulary(rng, 4) + ["#x", "|", "*$"]
    texts = odd_texts() + [rng.choice([" ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    got = quality.scan(pa.array(texts, pa.string())).to_pylist()
    assert [tuple(r.values()) for r in got] == [base_statistics(t) for t in texts]


def test_binomial_bound_is_exact():
    for n, k, p in [(50, 0, 0.05), (200, 3, 0.02), (10, 10, 0.5), (1000, 20, 0.03)]:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(quality.log_binomial_cdf(k, n, p)), exact, rel_tol=1e-9)
    assert not quality.proven(0, 10, 0.01, 0.05) and quality.proven(0, 400, 0.01, 0.05)


def test_cutoffs_limit_false_rejections(spark):
    rng = random.Random(6)
    clean = lambda: " ".join("w" * rng.randint(3, 6) + str(rng.randint(0, 10**6)) for _ in range(40))
    noisy = lambda: " ".join(f"w{i}#$%" for i in range(40))
    rows = [(i, clean(), "en", "s") for i in range(2500)] + [(5000 + i, noisy(), "en", "s") for i in range(200)] + [
        (9000 + i, t, "zz", "s") for i, t in enumerate(odd_texts())
    ] + [(None, clean(), None, "s"), (9000, "again", "zz", "s")]
    labels = spark.createDataFrame(
        [(i, 1) for i in range(2500)] + [(5000 + i, 0) for i in range(100)] + [(3, 1), (None, 1), (4, None)],
        "doc_id long, quality int"
    )
    out = quality.judge(docs_frame(spark, rows).withColumn("_quality", F.lit(1)), labels).collect()
    kept = collections.defaultdict(list)
    for r in out:
        q = r["_quality"]
        assert tuple(q[x] for x in quality.FEATURES) == base_statistics(r["text"])
        assert q["base_failed"] == (
            q["n_words"] < 20 or 100 * q["n_repeat_words"] > 30 * q["n_words"]
        ) and not (q["kept"] and q["base_failed"])
        if r["doc_id"] is not None and r["doc_id"] < 9000:
            kept[r["doc_id"] >= 5000].append(q["kept"])
    assert len(out) == len(rows) and np.mean(kept[False]) > 0.98 and not any(kept[True])
    few = quality.judge(docs_frame(spark, rows[:50]), labels.limit(0)).where("_quality.kept").count()
    assert few == 50 and quality.judge(docs_frame(spark, []), labels).count() == 0


# -- registered queries --------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


def test_queries_have_their_columns(spark):
    want = {
        "op1_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op3_": ["doc_id", "held_out", "score", "predicted"], "op4_": ["vec_id", "n_links", "component_id", "kept"], "op8_": ["doc_id", "n_shingles", "component_id", "kept"], "op9_": ["doc_id", "held_out", "lang_pred", "score"],
        "op10_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for start, columns in want.items():
        (f,) = [f for k, f in queries.queries().items() if k.startswith(start)]
        assert f(spark, SF).columns[: len(columns)] == columns


def test_held_out_rows_are_the_remainder(spark):
    out = queries.op9_language_id(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = SF if name.startswith("op7") else "/root/testdata/sf0.01"
    c = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = queries.queries()[name](spark, folder)
    columns = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))


def test_sql_of_links_on_planted_groups(spark, tmp_path):
    """The tables hold no linked vectors; these do, with copies, ties, nulls and odd labels."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in base[i % 6] + 0.12 * rng.normal(size=8)], int(i % 2) if i % 11 else None) for i in range(120)]
    rows += [(200, [0.0] * 8, 1), (201, None, 1), (202, rows[0][1], rows[0][2]), (203, [float("nan")] * 8, 0), (204, [], 0)]
    spark.createDataFrame(
        rows, "vec_id long, embedding array<double>, label long"
    ).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.execute(
        f"SELECT vec_id, n_links, component_id, kept FROM ({queries.oracle_sql()['op4_embedding_near_dedup']})"
    ).fetchall()
    got = [
        tuple(r) for r in queries.op4_embedding_near_dedup(spark, str(tmp_path)).select(
            "vec_id", "n_links", "component_id", "kept"
        ).collect()
    ]
    assert sorted(got) == sorted(want) and sum(r[1] for r in got) > 50
