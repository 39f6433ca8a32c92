"""Quality rules with risk-controlled cutoffs.

Each rule compares one text statistic with a cutoff. Cutoffs may be used in a stratum only if the
labelled holdout proves, by an exact binomial test, that all of them together falsely reject at most
``alpha`` of the stratum's good documents. They are tried along one path fixed beforehand, from the most
lenient to the strictest: first the rules on words and symbols, in step, then those on repetition, which
good prose has too. The walk ends at the first step that can't be proven (fixed-sequence testing), so the
walk itself costs no level; ``delta`` is divided over strata (Bonferroni). With probability ``1 - delta``
every proven step rejects at most ``alpha``, so any may be taken: the most lenient of those that reject
the most labelled-bad documents.

Strata with too few labels to prove any step are put together to one pool, which has cutoffs of its own;
it takes in larger ones, the smallest first, until it can be proven. Its bound is on the whole pool. Where
even all labels are too few, no stratum has a cutoff and only the base rule holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import batched, carried, cut
from .textscan import Chunk, chunks

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_TYPE = "struct<" + ",".join(f"{x}:bigint" for x in FEATURES) + ">"
_SYMBOLS = np.zeros(256, np.int8)
_SYMBOLS[list(b"#*$%&|<>")] = 1


def _dup_lines(c: Chunk) -> np.ndarray:
    """Per row, lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(c.data == 10)
    start = np.unique(np.concatenate((c.bounds[:-1], breaks + 1)))
    start = start[start < len(c.data)]
    if not len(start):
        return np.zeros(c.rows, np.int64)
    end = np.minimum(np.append(start[1:], len(c.data)), len(c.data))
    row = np.searchsorted(c.bounds, start, "right") - 1
    ends_in_break = c.data[end - 1] == 10
    words = np.searchsorted(c.start, end) > np.searchsorted(c.start, start)
    start, end, row = start[words], (end - ends_in_break)[words], row[words]
    if not len(start):
        return np.zeros(c.rows, np.int64)
    h = c.hash_ranges(start, end)
    order = np.lexsort((h, row))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return np.bincount(row[order][again], minlength=c.rows)


def _repeat_words(c: Chunk, width: int = 8) -> np.ndarray:
    """Per row, words inside a window of ``width`` words that occurs twice or more in the row."""
    out = np.zeros(c.rows, np.int64)
    grams, at = c.grams(c.word_hashes(), width)
    for i in np.flatnonzero(np.diff(at) > 1):
        own = grams[at[i] : at[i + 1]]
        ranked = np.sort(own)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(own, twice))
            edges = np.zeros(len(own) + width, np.int32)
            edges[hit] += 1
            edges[hit + width] -= 1
            out[i] = int((np.cumsum(edges) > 0).sum())
    return out


def scan(texts: pa.Array) -> pa.StructArray:
    parts = {x: [] for x in FEATURES}
    for c in chunks(texts):
        lead = ((c.data & 0xC0) != 0x80) & c.solid
        parts["n_words"].append(c.n_words)
        parts["word_chars"].append(c.per_row(lead))
        parts["n_symbols"].append(c.per_row(_SYMBOLS[c.data]))
        parts["n_dup_lines"].append(_dup_lines(c))
        parts["n_repeat_words"].append(_repeat_words(c))
    none = np.zeros(0, np.int64)
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate([none, *parts[x]]).astype(np.int64)) for x in FEATURES], list(FEATURES)
    )


def features(text: Column) -> Column:
    """The five base statistics of a text as one struct; a null text has no words and counts 0."""
    return batched(_TYPE, scan)(text)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


@dataclass(frozen=True)
class Rule:
    """Reject when ``over / under`` exceeds the cutoff (``sign`` 1) or is below it (``sign`` -1)."""

    name: str
    over: str
    under: str
    sign: int
    cutoffs: tuple[float, ...] = field(repr=False)
    turn: int = 0  # rules of an earlier turn are at their strictest before those of a later one begin

    def value(self, f: Column) -> Column:
        return F.when(f[self.under] > 0, f[self.over] / f[self.under]).otherwise(F.lit(0.0)) * self.sign


def _grid(loose: float, strict: float, n: int = 24) -> tuple[float, ...]:
    return tuple(round(loose * (strict / loose) ** (i / (n - 1)), 6) for i in range(n))


#: From lenient to strict. Words of 3 to 12 letters, fewer than one symbol in 20 words and no repeated
#: text are what the strictest cutoffs would ask for; the labels decide how near to that it goes.
RULES = (
    Rule("long_words", "word_chars", "n_words", 1, _grid(40.0, 12.0)),
    Rule("short_words", "word_chars", "n_words", -1, _grid(1.2, 3.0)),
    Rule("symbols", "n_symbols", "n_words", 1, _grid(2.0, 0.05)),
    Rule("dup_lines", "n_dup_lines", "n_words", 1, _grid(0.5, 0.005), 1),
    Rule("repeats", "n_repeat_words", "n_words", 1, _grid(0.3, 0.02), 1),
)


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """log P(Bin(n, p) <= k), summed exactly in logarithms."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    logs = math.lgamma(n + 1) - np.array(
        [math.lgamma(x + 1) + math.lgamma(n - x + 1) for x in i]
    ) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return min(0.0, float(top + math.log(np.exp(logs - top).sum())))


def proven(k: int, n: int, p: float, delta: float) -> bool:
    """Whether k rejections of n good documents prove a rate below p at level delta."""
    return n > 0 and log_binomial_cdf(k, n, p) <= math.log(delta)


#: Stands for the strata that have no cutoffs of their own.
POOL = None


def _turns(rules: tuple[Rule, ...]) -> dict[int, tuple[int, int]]:
    """Of each turn its first step and how many it has."""
    out, at = {}, 0
    for turn in sorted({r.turn for r in rules}):
        out[turn] = (at, max(len(r.cutoffs) for r in rules if r.turn == turn))
        at += out[turn][1]
    return out


def _step(f: Column, rules: tuple[Rule, ...]) -> Column:
    """The first step of the path that rejects a row; as many as there are steps where none does."""
    turns = _turns(rules)
    end = sum(n for _, n in turns.values())
    firsts = []
    for r in rules:
        v = r.value(f)
        i = F.size(F.filter(F.array(*[F.lit(float(c * r.sign)) for c in r.cutoffs]), lambda c: ~(v > c)))  # noqa: B023
        firsts.append(F.when(i < len(r.cutoffs), i + turns[r.turn][0]).otherwise(end))
    return F.least(*firsts, F.lit(end)).cast("int")


def _cutoffs(step: int, rules: tuple[Rule, ...]) -> dict[str, float]:
    turns = _turns(rules)
    return {r.name: r.cutoffs[min(step - turns[r.turn][0], len(r.cutoffs) - 1)] for r in rules if step >= turns[r.turn][0]}


def _own(counts: list[int], total: int, alpha: float, delta: float) -> int:
    """How many of the largest strata are proven by themselves, so that they and the pool of the rest can be; -1 if nothing can."""
    for k in range(len(counts), -1, -1):
        rest = total - sum(counts[:k])
        least = math.log(delta / max(1, k + (rest > 0))) / math.log1p(-alpha)
        if all(n >= least for n in counts[:k]) and (rest >= least or not rest and k):
            return k
    return -1


def calibrate(
    labelled: DataFrame, features_col: str = "_f", stratum_col: str = "lang", good_col: str = "quality", alpha: float = 0.02, delta: float = 0.05, rules: tuple[Rule, ...] = RULES
) -> dict[str | None, dict[str, float]]:
    """Proven cutoffs by stratum and rule from labelled rows; a null stratum is ``""``, ``POOL`` stands for all that are not named.

    Counts cover every labelled row. What reaches the driver is a row per step of the path for each stratum
    that has labels enough for any proof, at most about ``n_labels * alpha`` of them, and for the pool.
    """
    f = F.col(features_col)
    rows = labelled.where(F.col(good_col).isNotNull() & ~base_failed(f)).select(
        F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), (F.col(good_col) == 1).alias("good"),
        _step(f, rules).alias("step")
    )
    counted = cut(rows.groupBy("stratum", "good", "step").agg(F.count("*").alias("n")))
    least = math.log(delta) / math.log1p(-alpha)
    sizes = counted.where("good").groupBy("stratum").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sorted(sizes.where(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["stratum"]))
    own = _own([r["n"] for r in large], total, alpha, delta)
    if own < 0:
        return {}
    names = [r["stratum"] for r in large[:own]]
    name = F.when(F.col("stratum").isin(*names), F.col("stratum")) if names else F.lit(None).cast("string")
    tally: dict[str | None, dict[bool, dict[int, int]]] = {n: {True: {}, False: {}} for n in names}
    for row in counted.groupBy(name.alias("name"), "good", "step").agg(F.sum("n").alias("n")).collect():
        tally.setdefault(row["name"], {True: {}, False: {}})[row["good"]][row["step"]] = row["n"]
    families = sum(1 for t in tally.values() if t[True])
    out: dict[str | None, dict[str, float]] = {}
    for key, t in tally.items():
        out[key], good, bad, most = {}, 0, 0, -1
        n, any_bad = sum(t[True].values()), bool(t[False])
        for step in range(sum(size for _, size in _turns(rules).values())):
            good, bad = good + t[True].get(step, 0), bad + t[False].get(step, 0)
            if not proven(good, n, alpha, delta / families):
                break
            if bad > most or not any_bad:
                out[key], most = _cutoffs(step, rules), bad
    return out


def verdict(f: Column, stratum: Column, cutoffs: dict[str | None, dict[str, float]], rules: tuple[Rule, ...] = RULES) -> Column:
    """True where no proven cutoff of the row's stratum, or of the pool where it has no entry, rejects the features ``f``."""
    stratum = F.coalesce(stratum.cast("string"), F.lit(""))
    bad = F.lit(False)
    for r in rules:
        bound = lambda own: F.lit(float(own[r.name] * r.sign) if r.name in own else math.inf)  # noqa: B023, E731
        table = [x for name, own in sorted((k, v) for k, v in cutoffs.items() if k is not POOL) for x in (F.lit(name), bound(own))]
        pool = bound(cutoffs.get(POOL, {}))
        bad = bad | (r.value(f) > (F.coalesce(F.create_map(*table)[stratum], pool) if table else pool))
    return ~bad


def basis(stratum: Column, cutoffs: dict[str | None, dict[str, float]]) -> Column:
    """What a row's cutoffs were proven on: its own ``stratum``, the ``pool``, or ``none`` where nothing is proven."""
    own = [k for k, v in cutoffs.items() if k is not POOL and v]
    named = [k for k in cutoffs if k is not POOL]
    stratum = F.coalesce(stratum.cast("string"), F.lit(""))
    pool = F.lit("pool" if cutoffs.get(POOL) else "none")
    among = lambda names: stratum.isin(*names) if names else F.lit(False)
    return F.when(among(own), "stratum").when(among(named), "none").otherwise(pool)


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    good_col: str = "quality", **options
) -> DataFrame:
    """``docs`` with a struct column ``_quality``: the base statistics, ``base_failed``, ``kept`` and ``basis``.

    Nulls: a null text has no words and fails the base rule; a null stratum is a stratum of its own;
    labels without an id, or with a null verdict, are left out. A document labelled more than once is
    good only if all its labels say so. Repeated rows each get the same verdict. Empty tables give no
    cutoffs or no rows. Other columns of ``docs`` pass through, whatever their names; one named ``_quality`` is replaced.
    """
    one = labels.where(
        F.col(id_col).isNotNull() & F.col(good_col).isNotNull()
    ).groupBy(F.col(id_col).alias("_id")).agg(F.min(good_col).alias("_good"))
    measured = docs.select(
        F.col(id_col).alias("_id"), F.col(stratum_col).cast("string").alias("_stratum"), features(F.col(text_col)).alias("_f")
    )
    cutoffs = calibrate(measured.join(one, "_id"), "_f", "_stratum", "_good", **options)
    f, stratum = F.col("_f"), F.col("_stratum")
    rows = docs.select(
        carried(docs, ("_quality",)).alias("_row"), F.col(stratum_col).cast("string").alias("_stratum"),
        features(F.col(text_col)).alias("_f")
    )
    told = F.struct(
        *[f[x].alias(x) for x in FEATURES], base_failed(f).alias("base_failed"),
        (~base_failed(f) & verdict(f, stratum, cutoffs)).alias("kept"), basis(stratum, cutoffs).alias("basis")
    )
    return rows.select("_row.*", told.alias("_quality"))
