"""Whole results of registered queries against brute-force versions: shards, mixture, quality verdicts."""

import collections
import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F
from test_operators import WORD, base_statistics

from weft.llm import mixing, quality, queries

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_shards(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = queries.op1_sharding(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(docs) and {r["law"] for r in out} == {"key"}
    slots = collections.defaultdict(list)
    for r in out:
        raw = (docs[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == (None if docs[r["doc_id"]] is None else zlib.crc32(raw))
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def brute_mixture(docs, limit=1.25, seed=29, block_tokens=500_000):
    groups = collections.defaultdict(list)
    for i, text, source in docs:
        groups[source].append(
            (f"{i}|{hashlib.md5(text.encode()).hexdigest() if text is not None else ''}", len(WORD.findall(text or "")) + 1, i)
        )
    total = {s: sum(n for _, n, _ in g) for s, g in groups.items()}
    peak, low = max(total.values()), min(total.values())
    t = round(max(0.0, 1 - math.log(limit) / math.log(peak / low)), 9)
    quota = {s: math.floor(n * round((peak / n) ** (1 - t), 9) + 1e-6) for s, n in total.items()}
    blocks = max(1, math.ceil(sum(quota.values()) / block_tokens))
    placed = collections.defaultdict(list)
    for s, g in groups.items():
        at = epoch = 0
        while at < quota[s]:
            for name, n, i in sorted(g, key=lambda x: (hashlib.md5(f"{seed}|{epoch}|{x[0]}".encode()).hexdigest()[:15], x[0])):  # noqa: B023
                if at < quota[s]:
                    placed[min(blocks - 1, at * blocks // quota[s])].append(
                        (hashlib.md5(f"{seed}b|{epoch}|{name}".encode()).hexdigest(), name, i, s, n, epoch)
                    )
                at += n
            epoch += 1
    return sorted(
        (i, str(s), n, epoch, b, slot) for b, rows in placed.items() for slot, (_, _, i, s, n, epoch) in enumerate(
            sorted(rows, key=lambda r: r[:2])
        )
    )


@pytest.mark.parametrize("block_tokens", [5_000, 500_000])
def test_mixture_with_its_blocks_and_slots(spark, block_tokens):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    out = queries.op2_source_mixing(spark, SMALL) if block_tokens == 500_000 else mixing.mix(
        docs, max_repeats=1.25, block_tokens=block_tokens
    ).select("doc_id", "source", "_mix.*")
    got = sorted((r["doc_id"], str(r["source"]), r["tokens"], r["epoch"], r["block"], r["slot"]) for r in out.collect())
    assert got == brute_mixture([tuple(r) for r in docs.collect()], block_tokens=block_tokens)


def brute_cutoffs(rows, alpha=0.02, delta=0.05):
    """Cutoffs by stratum from rows (stratum, good, statistics)."""
    rules = [
        (
            r, [r.cutoffs[min(s, 23)] if r.turn == 0 else None if s < 24 else r.cutoffs[s - 24] for s in range(48)]
        ) for r in quality.RULES
    ]

    def rejected(stats, step):
        f = dict(zip(quality.FEATURES, stats, strict=True))
        for r, path in rules:
            value = f[r.over] / f[r.under] if f[r.under] else 0.0
            if path[step] is not None and (value > path[step] if r.sign > 0 else value < path[step]):
                return True
        return False

    def tail(k, n):
        return math.fsum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(k + 1))

    rows = [r for r in rows if not (r[2][0] < 20 or 100 * r[2][4] > 30 * r[2][0])]
    goods = collections.Counter(s for s, good, _ in rows if good)
    order = sorted(goods, key=lambda s: (-goods[s], s))
    enough = lambda n, m: (1 - alpha) ** n <= delta / m
    own = next(
        (
            k for k in range(len(order), -1, -1) for rest in [sum(goods[s] for s in order[k:])] if all(
                enough(goods[s], k + (rest > 0)) for s in order[:k]
            ) and (enough(rest, k + 1) if rest else k > 0)
        ),
        None
    )
    if own is None:
        return {}
    groups = collections.defaultdict(list)
    for s, good, stats in rows:
        groups[s if s in order[:own] else None].append((good, stats))
    tested, out = sum(any(g for g, _ in v) for v in groups.values()), {}
    for name, members in groups.items():
        out[name], most, n = {}, -1, sum(g for g, _ in members)
        for step in range(48):
            hit = [g for g, stats in members if rejected(stats, step)]
            if not n or tail(sum(hit), n) > delta / tested:
                break
            bad = len(hit) - sum(hit)
            if bad > most or all(g for g, _ in members):
                out[name], most = {r.name: path[step] for r, path in rules if path[step] is not None}, bad
    return out


def test_cutoffs_and_verdicts(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text", "lang").collect()]
    verdicts = {}
    for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").where("doc_id is not null and quality is not null").collect():
        verdicts[r["doc_id"]] = min(r["quality"], verdicts.get(r["doc_id"], 1))
    stats = {d["doc_id"]: base_statistics(d["text"]) for d in docs}
    want = brute_cutoffs(
        [(d["lang"] or "", verdicts[d["doc_id"]] == 1, stats[d["doc_id"]]) for d in docs if d["doc_id"] in verdicts]
    )
    table = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang", quality.features(F.col("text")).alias("_f"))
    labels = spark.createDataFrame(list(verdicts.items()), "doc_id long, quality int")
    assert quality.calibrate(table.join(labels, "doc_id")) == want and any(want.values())
    bases = collections.Counter()
    for r in queries.op10_quality_rules(spark, MIDDLE).join(table.select("doc_id", "lang"), "doc_id").collect():
        s = stats[r["doc_id"]]
        f, cut = dict(zip(quality.FEATURES, s, strict=True)), want.get(r["lang"] or "", want.get(None, {}))
        over = any(
            x.name in cut and (f[x.over] / f[x.under] if f[x.under] else 0.0) * x.sign > cut[x.name] * x.sign for x in quality.RULES
        )
        assert r["base_failed"] == (s[0] < 20 or 100 * s[4] > 30 * s[0]) and r["kept"] == (not r["base_failed"] and not over)
        bases[r["basis"]] += 1
    assert set(bases) <= {"stratum", "pool", "none"} and bases["none"] == 0
