"""MinHash near-duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. One scan gives each document its set size, a 128-bit fingerprint of its shingle set and a
   signature of ``K`` minima. Documents with equal sets form one class from here on.
2. Classes are posted under each (coordinate, value). Pairs of similarity ``J`` agree on a
   coordinate with probability ``J``; ``T`` is the most of ``K`` that agree for all but one pair in a
   million at the similarity asked for (39 of 64 at 0.85, 34 of 64 at 0.80). Values that one class alone holds can't count, and a class with fewer than ``T``
   shared values is done. Of its ``m`` shared values it is posted under the ``m - T + 1`` rarest
   only: two classes that agree on ``T`` values meet under one of those (prefix filter).
3. Each posting list first links its members to the most typical one. Pairs that agree on ``T``
   coordinates are confirmed on the full sets; confirmed links merge components. Lists that are
   inside one component by then are skipped.
4. Lists that are not are put together to families (lists that share a class), and a family is cut into
   blocks by list. Every two blocks that have a list in common meet in a place of their own, so that no task
   gets a family: pairs across components that agree on ``T`` coordinates are confirmed on the full sets, the
   likeliest first, and pairs that the links found there connect already are skipped. A pair of blocks
   yields a forest of links, not its pairs.

No list or family is capped. The components are those of confirming every candidate pair, since a pair
inside one component cannot change them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import batched, batches_of, cut, cut_last
from .textscan import LOWER, U64, Chunk, _gram_factors, chunks, list_array, mix64

BLOCK, MISS = 256, 1e-6


def agreement(percent: int) -> tuple[int, int]:
    """``K`` and the largest ``T`` at which a pair of similarity ``percent`` / 100 is missed with a probability below ``MISS``."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    if percent == 100:
        return 64, 64
    j = percent / 100
    k = max(64, math.floor(math.log(MISS) / math.log1p(-j)) + 1)
    missed, least = 0.0, 0
    while (missed := missed + math.comb(k, least) * j**least * (1 - j) ** (k - least)) < MISS:
        least += 1
    return k, least


K, T = agreement(85)


def shingles(c: Chunk, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and where each row's begin."""
    words = c.word_hashes()
    grams, at = c.grams(words, width)
    short = np.flatnonzero((c.n_words > 0) & (c.n_words < width))
    whole = np.zeros(c.rows, U64)
    for size in range(1, width):
        rows = short[c.n_words[short] == size]
        total = np.full(len(rows), size, U64)
        for k in range(size):
            total += words[c.word_at[rows] + k] * _gram_factors(width + size)[k]
        whole[rows] = mix64(total)
    is_short = np.zeros(c.rows, bool)
    is_short[short] = True
    out, sizes = [np.zeros(0, U64)], np.zeros(c.rows, np.int64)
    for i in range(c.rows):
        own = whole[i : i + 1] if is_short[i] else np.sort(grams[at[i] : at[i + 1]])
        if len(own) > 1:
            fresh = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out), np.concatenate(([0], np.cumsum(sizes)))


@functools.cache
def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.random.default_rng(4711).integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1), mix64(np.arange(1, n + 1, dtype=U64))


def signatures(sets: np.ndarray, at: np.ndarray, n: int = K) -> np.ndarray:
    """Rows x ``n`` coordinate values, each already mixed with its coordinate; empty sets give zeros."""
    rows = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, n), U64)
    factors, labels = _coordinates(n)
    if len(rows):
        for k in range(n):
            out[rows, k] = mix64(np.minimum.reduceat(sets * factors[k], at[rows]) ^ labels[k])
    return out


_PRINT = "struct<n_shingles:bigint,f1:bigint,f2:bigint,sig:array<bigint>>"


def _fingerprint(x: pa.Array, width: int, coordinates: int) -> pa.StructArray:
    n, f1, f2, sig = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros((0, coordinates), U64)]
    for c in chunks(x, fold=LOWER):
        sets, at = shingles(c, width)
        n.append(np.diff(at))
        for into, salt in ((f1, 0x51ED27), (f2, 0xC0FFEE)):
            sums = np.zeros(len(sets) + 1, U64)
            np.cumsum(mix64(sets ^ U64(salt)), out=sums[1:])
            into.append(sums[at[1:]] - sums[at[:-1]])
        sig.append(signatures(sets, at, coordinates))
    sig = np.concatenate(sig)
    values = list_array(sig.ravel().view(np.int64), np.arange(0, sig.size + 1, coordinates), pa.int64())
    return pa.StructArray.from_arrays(
        [
            pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(f1).view(np.int64)),
            pa.array(np.concatenate(f2).view(np.int64)), values
        ],
        ["n_shingles", "f1", "f2", "sig"]
    )


def _prints(text, width: int, coordinates: int):
    return batched(_PRINT, lambda x: _fingerprint(x, width, coordinates))(text)


def _set_bytes(text, width: int):
    """The full shingle set of each text as sorted 64-bit hashes."""

    def packed(x: pa.Array) -> pa.Array:
        out = []
        for c in chunks(x, fold=LOWER):
            sets, at = shingles(c, width)
            out += [sets[at[i] : at[i + 1]].tobytes() for i in range(c.rows)]
        return pa.array(out, pa.binary())

    return batched("binary", packed)(text)


def _confirm(a, b, percent: int):
    """Whether ``100 * |A & B| >= percent * |A | B|`` on two packed sets."""

    @F.arrow_udf("boolean")
    def similar(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(
            [
                _similar(
                    np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64), percent
                ) for p, q in zip(x, y, strict=True)
            ],
            pa.bool_()
        )

    return similar.asNondeterministic()(a, b)


def _similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    small, large = (p, q) if len(p) < len(q) else (q, p)
    if 100 * len(small) < percent * len(large):
        return False
    spot = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[spot] == small).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


class _Block:
    """Members of a family: ids, components, full sets and signatures."""

    def __init__(self, ids: list[int], comps: list[int], sets: list[bytes], coordinates: int = K):
        self.ids, self.comps = ids, np.array(comps, np.int64)
        self.sets = [np.frombuffer(x, U64) for x in sets]
        self.sizes = np.array([len(x) for x in self.sets])
        self.sigs = signatures(np.concatenate(self.sets), np.concatenate(([0], np.cumsum(self.sizes))), coordinates)


def _forest(one: _Block, two: _Block, least: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links across components between two blocks, as many as connect what they connect."""
    fit = one.comps[:, None] != two.comps[None, :]
    fit &= 100 * np.minimum(one.sizes[:, None], two.sizes[None, :]) >= percent * np.maximum(one.sizes[:, None], two.sizes[None, :])
    a, b = np.nonzero(np.triu(fit) if one is two else fit)
    agree = (one.sigs[a] == two.sigs[b]).sum(axis=1)
    good = np.flatnonzero(agree >= least)
    good = good[np.argsort(-agree[good], kind="stable")]
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while (above := up.get(c, c)) != c:
            up[c] = up.get(above, above)
            c = above
        return c

    links = []
    for i, j in zip(a[good].tolist(), b[good].tolist(), strict=True):
        p, q = root(int(one.comps[i])), root(int(two.comps[j]))
        if p != q and _similar(one.sets[i], two.sets[j], percent):
            up[max(p, q)] = min(p, q)
            links.append((one.ids[i], two.ids[j]))
    return links


_BLOCK_FIELDS = ("ids", "comps", "sets")


def _compare(blocks: DataFrame, percent: int, sides: tuple[str, ...]) -> DataFrame:
    """Links ``a, b`` found in each row's block, or between its two blocks, named by the ends of its columns."""
    coordinates, least = agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            links = []
            for i in range(x.num_rows):
                got = [_Block(*(x.column(n + side)[i].as_py() for n in _BLOCK_FIELDS), coordinates) for side in sides]
                links += _forest(got[0], got[-1], least, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in zip(*links, strict=True)], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def _open_blocks(lists: DataFrame, of: DataFrame, sizes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of the classes in lists that no single component covers, and which two blocks share a list.

    Classes with the same first list go to the same block, or to as many as hold about ``BLOCK`` of them each.
    """
    placed = _component_of(lists.select("id", "token"), of, "id", "comp")
    mixed = cut(
        placed.groupBy("token").agg(
            F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("id").alias("first")
        ).where("c1 <> c2").select("token", "first")
    )
    open_rows = cut(placed.join(mixed, "token").select("id", "comp", "token", "first"))
    family = components(open_rows, "id", "first")
    rows = open_rows.groupBy("id", "comp").agg(F.min("token").alias("home"))
    rows = _component_of(rows, family, "id", "family").join(sizes, "id")
    rows = cut(rows)
    crowd = cut(
        rows.groupBy("home").agg(
            F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / (BLOCK * 1024))).cast("int").alias("parts")
        )
    )
    several = cut(
        rows.groupBy("family").agg(
            F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / (BLOCK * 1024))).cast("int").alias("several")
        )
    )
    part = F.pmod(F.xxhash64(F.lit(3), "id"), F.col("parts"))
    rows = rows.join(crowd, "home").join(several, "family").withColumn(
        "k", F.pmod(F.xxhash64("home", part), F.col("several")).cast("int")
    )
    rows = cut(rows.select("id", "comp", "family", "k"))
    gathered = [F.collect_list("id").alias("ids"), F.collect_list("comp").alias("comps"), F.collect_list("set").alias("sets")]
    blocks = cut(rows.join(sets, "id").groupBy("family", "k").agg(*gathered))
    met = open_rows.select("id", "token").join(
        rows.select("id", "family", "k"), "id"
    ).groupBy("token", "family").agg(F.collect_set("k").alias("ks")).where("size(ks) > 1")
    pairs = met.select("family", F.explode("ks").alias("k1"), "ks").select(
        "family", "k1", F.explode(F.filter("ks", lambda k: k > F.col("k1"))).alias("k2")
    )
    return blocks, cut(pairs.distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar."""
    both = pairs.join(
        sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a"
    ).join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return both.select("a", "b", _confirm(F.col("x"), F.col("y"), percent).alias("ok")).where("ok").select("a", "b")


def _component_of(rows: DataFrame, of: DataFrame, key: str, name: str) -> DataFrame:
    return rows.join(
        of.select(F.col("node").alias(key), F.col("component").alias("_c")), key, "left"
    ).withColumn(name, F.coalesce(F.col("_c"), F.col(key))).drop("_c")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5
) -> DataFrame:
    """One row ``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their sets of ``width``-word
    shingles (lower-cased A-Z, words between spaces and 0x09-0x0D; with fewer words the whole sequence
    is one shingle). A null or empty text, or one without words, has the empty set and links with
    nothing. Rows that share an id are one document and share its component. A row with a null id can
    not be named by a link: its component is null and it is kept. Repeated rows give repeated results, an
    empty table none. Texts count in full, however long. Other columns of ``docs`` are not read.
    """
    coordinates, _ = agreement(percent)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = cut(source.select("id", _prints(F.col("text"), width, coordinates).alias("p")).select("id", "p.*"))
    component = cut_last(lambda: _components_of(source, prints, percent, width))
    out = prints.select("id", "n_shingles", "f1", "f2").join(component, ["id", "f1", "f2"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _components_of(source: DataFrame, prints: DataFrame, percent: int, width: int) -> DataFrame:
    """``id, f1, f2, component_id`` of each distinct id and shingle set."""
    _, least = agreement(percent)
    named = prints.where("id is not null and n_shingles > 0")
    # As a table, so that a join with a hot class has two plain sides and its large partitions can be split.
    grouped = cut(named.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep")))
    member = cut(
        named.select("id", "f1", "f2", "n_shingles").join(
            grouped, ["f1", "f2", "n_shingles"]
        ).select("id", "rep", "f1", "f2").distinct()
    )
    twice = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("id", "a")
    same_id = member.join(twice, "id").select("a", F.col("rep").alias("b")).where("a <> b")
    reps = member.where("id = rep").join(
        named.select("id", "f1", "f2", "n_shingles", "sig"), ["id", "f1", "f2"]
    ).select("id", "f1", "f2", "n_shingles", "sig").dropDuplicates(["id", "f1", "f2"])

    posted = reps.select("id", "n_shingles", F.explode("sig").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    hits = posted.join(shared, "token").groupBy("id", "n_shingles").agg(
        F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t")
    ).where(F.size("t") >= least)
    hits = cut(hits.select("id", "n_shingles", "t", F.aggregate("t", F.lit(0.0), lambda s, x: s + F.log(x["n"])).alias("typical")))
    lists = hits.select(
        "id", "typical", F.explode(F.expr(f"slice(t, 1, size(t) - {least - 1})")).alias("x")
    ).select("id", "typical", F.col("x.token").alias("token"))
    lists = cut(lists)

    # Full sets of the classes that have any candidate, once.
    wanted = hits.select("id")
    texts = source.where("id is not null").withColumn("h", F.xxhash64("text")).join(
        wanted, "id", "left_semi"
    ).dropDuplicates(["id", "h"])
    sets = cut(texts.select("id", _set_bytes(F.col("text"), width).alias("set")).where(F.length("set") > 0))

    signature = hits.select("id", "n_shingles", F.expr("transform(t, x -> x.token)").alias("tokens"))
    hub = lists.groupBy("token").agg(
        F.max(F.struct("typical", "id")).alias("h"), F.count("*").alias("members")
    ).where("members > 1").select("token", F.col("h.id").alias("hub"))
    star = lists.join(hub, "token").where("id <> hub").select(
        F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")
    ).distinct()
    for end in "ab":
        star = star.join(
            signature.select(F.col("id").alias(end), F.col("tokens").alias(f"t{end}"), F.col("n_shingles").alias(f"n{end}")), end
        )
    alike = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    star = star.where(alike & (F.size(F.array_intersect("ta", "tb")) >= least)).select("a", "b")
    links = cut(_confirmed(star, sets, percent).unionAll(same_id))
    of = components(links)

    blocks, pairs = _open_blocks(lists, of, hits.select("id", F.col("n_shingles").alias("size")).distinct(), sets)
    inside = _compare(blocks.select(*_BLOCK_FIELDS), percent, ("",))
    for i in (1, 2):
        pairs = pairs.join(
            blocks.select("family", *[F.col(c).alias(f"{c}{i}") for c in ("k", *_BLOCK_FIELDS)]), ["family", f"k{i}"]
        )
    with batches_of(source.sparkSession, 16):
        found = cut(inside.unionAll(_compare(pairs, percent, ("1", "2"))))
    of = components(links.unionAll(found))
    return _component_of(member.select("id", "f1", "f2", "rep"), of, "rep", "component_id").select("id", "f1", "f2", "component_id")
