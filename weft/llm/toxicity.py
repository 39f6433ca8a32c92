"""Toxicity by a counterfactually regularised linear classifier.

A text is the set of its distinct lower-cased words and of their first 5 to 8 bytes (so that an
inflected form is known by its stem), hashed into buckets. The score is a sparse
logistic model. For each labelled text that names an identity group, counterfactuals exchange that group's
terms with those of each other group of the same axis in the text; they are turned into features as any
text is, so that stems change with their words. The loss adds ``fairness`` times the mean of
``(f(x) - f(x'))**2`` over those pairs, so that which group is named cannot move the score, and neutral
mentions are not held against a text.

The model is fitted on the driver, from a bounded sample of the labelled rows (``max_docs``, a
documented parameter); scoring covers every row and whole texts. No feature is left out beforehand: the fit
moves those that the penalty lets carry weight, until none outside could carry any.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import batched
from .textscan import LOWER, NON_ALNUM, U64, chunks, mix64

BITS = 22
PREFIXES = (5, 6, 7, 8)
_JOIN, _ROUNDS = 400, 60  # buckets that join at once, and how often at most

#: Identity terms by axis. A row holds one term of each group of its axis, in the order of the groups, so
#: the terms of a row stand for one another; rows cover English, German, French and Spanish.
IDENTITY_AXES: tuple[tuple[tuple[str, ...], ...], ...] = (
    (
        ("women", "men"), ("woman", "man"), ("girl", "boy"), ("girls", "boys"), ("female", "male"), ("she", "he"), ("her", "his"),
        ("frau", "mann"), ("frauen", "männer"), ("mädchen", "jungen"), ("weiblich", "männlich"),
        ("femme", "homme"), ("femmes", "hommes"), ("fille", "garçon"), ("filles", "garçons"),
        ("mujer", "hombre"), ("mujeres", "hombres"), ("niña", "niño"), ("niñas", "niños"),
    ),
    (
        ("muslim", "christian", "jew", "hindu", "buddhist"), ("muslims", "christians", "jews", "hindus", "buddhists"), ("islamic", "christian", "jewish", "hindu", "buddhist"), ("islam", "christianity", "judaism", "hinduism", "buddhism"),
        ("moslem", "christ", "jude", "hindu", "buddhist"), ("muslime", "christen", "juden", "hindus", "buddhisten"), ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"),
        ("musulman", "chrétien", "juif", "hindou", "bouddhiste"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes"),
        ("musulmán", "cristiano", "judío", "hindú", "budista"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas"),
    ),
    (
        ("gay", "straight", "lesbian", "bisexual", "transgender"), ("homosexual", "heterosexual", "lesbian", "bisexual", "transgender"), ("gays", "straights", "lesbians", "bisexuals", "transgenders"),
        ("schwul", "heterosexuell", "lesbisch", "bisexuell", "transgender"), ("homosexuel", "hétérosexuel", "lesbienne", "bisexuel", "transgenre"), ("homosexual", "heterosexual", "lesbiana", "bisexual", "transgénero"),
    ),
    (
        ("black", "white", "asian", "latino", "arab"), ("blacks", "whites", "asians", "latinos", "arabs"), ("african", "european", "asian", "hispanic", "arab"),
        ("schwarze", "weiße", "asiaten", "latinos", "araber"), ("noirs", "blancs", "asiatiques", "latinos", "arabes"), ("negros", "blancos", "asiáticos", "latinos", "árabes"),
    ),
    (("immigrant", "native"), ("immigrants", "natives"), ("foreigners", "locals"), ("ausländer", "einheimische"), ("immigrés", "natifs"), ("inmigrantes", "nativos")),
    (("old", "young"), ("elderly", "youthful"), ("alte", "junge"), ("vieux", "jeunes"), ("viejos", "jóvenes")),
    (("disabled", "able"), ("deaf", "hearing"), ("blind", "sighted"), ("behinderte", "gesunde"), ("handicapés", "valides"), ("discapacitados", "sanos")),
)
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")  # what lies between the separators of NON_ALNUM
_UPPER = {i: i + 32 for i in range(65, 91)}


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - BITS)).astype(np.int64)


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word buckets of each text, ascending, and where each text's begin."""
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for c in chunks(texts, NON_ALNUM, LOWER):
        row = np.repeat(np.arange(c.rows), c.n_words)
        pairs = [(row << BITS) | _bucket(c.word_hashes())]
        for n in PREFIXES:
            long = c.end - c.start >= n
            pairs.append((row[long] << BITS) | _bucket(mix64(c.hash_ranges(c.start[long], c.start[long] + n) + U64(n))))
        pairs = np.unique(np.concatenate(pairs))
        found.append((pairs & ((1 << BITS) - 1)).astype(np.int32))
        sizes.append(np.bincount(pairs >> BITS, minlength=c.rows))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def _exchanges(axes) -> dict[str, list[tuple[int, int]]]:
    """Term -> the (axis, group) places where it stands."""
    out: dict[str, list[tuple[int, int]]] = {}
    for i, rows in enumerate(axes):
        for row in rows:
            for g, term in enumerate(row):
                if (i, g) not in out.setdefault(term, []):
                    out[term].append((i, g))
    return out


def counterfactuals(text: str, axes=IDENTITY_AXES, places: dict | None = None) -> list[str]:
    """The text with each group that it names exchanged for each other group of the axis, one text for each pair."""
    places = _exchanges(axes) if places is None else places
    text = text.translate(_UPPER)
    named = {place for w in set(_WORD.findall(text)) & places.keys() for place in places[w]}
    out = []
    for i, g, h in sorted({(i, min(g, h), max(g, h)) for i, g in named for h in range(len(axes[i][0])) if h != g}):
        swap: dict[str, str] = {}
        for row in axes[i]:
            swap.setdefault(row[g], row[h])
            swap.setdefault(row[h], row[g])
        other = _WORD.sub(lambda m: swap.get(m[0], m[0]), text)  # noqa: B023
        if other != text:
            out.append(other)
    return out


_EXAMPLE = "struct<words:array<int>,swaps:array<struct<gone:array<int>,come:array<int>>>>"


def _examples(text: Column, axes) -> Column:
    """Of each text its buckets and, for each counterfactual, those that go and those that come."""

    def made(x: pa.Array) -> pa.Array:
        places = _exchanges(axes)
        out = []
        for t in x.to_pylist():
            versions = [t or "", *counterfactuals(t or "", axes, places)]
            buckets, at = _sets(pa.array(versions, pa.string()))
            own = [buckets[at[i] : at[i + 1]] for i in range(len(versions))]
            swaps = [
                {"gone": np.setdiff1d(own[0], other).tolist(), "come": np.setdiff1d(other, own[0]).tolist()} for other in own[1:]
            ]
            out.append({"words": own[0].tolist(), "swaps": swaps})
        return pa.array(
            out,
            pa.struct(
                [
                    ("words", pa.list_(pa.int32())),
                    ("swaps", pa.list_(pa.struct([("gone", pa.list_(pa.int32())), ("come", pa.list_(pa.int32()))])))
                ]
            )
        )

    return batched(_EXAMPLE, made)(text)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32 by bucket
    bias: float

    def score(self, text: Column) -> Column:
        """A score in [0, 1] of each text; null and empty texts get the score of a text without words."""
        weights, bias = self.weights, self.bias

        def scores(x: pa.Array) -> pa.Array:
            out = np.full(len(x), bias)
            buckets, at = _sets(x)
            sums = np.concatenate(([0.0], np.cumsum(weights[buckets], dtype=np.float64)))
            out += sums[at[1:]] - sums[at[:-1]]
            return pa.array(1.0 / (1.0 + np.exp(-np.clip(out, -40, 40))))

        return batched("double", scores)(text)


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -40, 40)))


class _Columns:
    """A sparse matrix by column: the rows of each column and their values."""

    def __init__(self, column: np.ndarray, row: np.ndarray, value: np.ndarray, n: int):
        order = np.argsort(column, kind="stable")
        self.row, self.value = row[order], value[order]
        self.at = np.searchsorted(column[order], np.arange(n + 1))

    def __getitem__(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        return self.row[self.at[j] : self.at[j + 1]], self.value[self.at[j] : self.at[j + 1]]


def fit_sets(
    buckets: np.ndarray, at: np.ndarray, toxic: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]] = (), fairness: float = 10.0,
    sparsity: float = 1e-4, min_docs: int = 4, passes: int = 30
) -> Model:
    """Cyclic coordinate descent on the mean logistic loss, an L1 penalty and the swap penalty.

    ``swaps`` has, for each counterfactual of a text, the buckets that go and those that come. Buckets that
    fewer than ``min_docs`` texts hold tell nothing and carry no weight, but for those of swaps. Of the others
    those without weight are left alone until the rest has settled; then all are looked at, and the steepest of
    those whose gradient exceeds the L1 penalty join, until there is none.
    """
    n, weights = len(toxic), np.zeros(1 << BITS, np.float32)
    ones = toxic.sum()
    bias = float(np.log((ones + 1) / (n - ones + 1)))
    if n == 0 or ones in (0, n):
        return Model(weights, bias)
    m = max(1, len(swaps))
    sides = [np.concatenate([np.zeros(0, np.int64), *(np.asarray(x[k], np.int64) for x in swaps)]) for k in (0, 1)]
    pair = [np.repeat(np.arange(len(swaps)), [len(x[k]) for x in swaps]) for k in (0, 1)]
    sign = np.concatenate((np.full(len(sides[0]), -1.0), np.full(len(sides[1]), 1.0)))
    names = np.unique(np.concatenate((buckets, *sides)))
    text_column, swap_column = np.searchsorted(names, buckets), np.searchsorted(names, np.concatenate(sides))
    row, pair = np.repeat(np.arange(n), np.diff(at)), np.concatenate(pair)
    texts = _Columns(text_column, row, np.ones(len(row)), len(names))
    moves = _Columns(swap_column, pair, sign, len(names))
    w, margin, gap = np.zeros(len(names)), np.full(n, bias), np.zeros(m)
    p = _logistic(margin)

    def step(j: int) -> float:
        rows, (pairs, signs) = texts[j][0], moves[j]
        q = p[rows]
        grad = (q - toxic[rows]).sum() / n + 2 * fairness / m * (signs * gap[pairs]).sum()
        curve = (q * (1 - q)).sum() / n + 2 * fairness / m * len(pairs) + 1e-5
        new = w[j] - np.clip(grad / curve, -2, 2)
        new = np.sign(new) * max(abs(new) - sparsity / curve, 0.0)
        change = float(np.clip(new - w[j], -2, 2))
        if change:
            w[j] += change
            margin[rows] += change
            p[rows] = _logistic(margin[rows])
            gap[pairs] += signs * change
        return abs(change)

    told = (np.bincount(text_column, minlength=len(names)) >= min_docs) | (np.bincount(swap_column, minlength=len(names)) > 0)
    for _ in range(_ROUNDS):
        slope = np.bincount(text_column, (p - toxic)[row], len(names)) / n
        slope += 2 * fairness / m * np.bincount(swap_column, sign * gap[pair], len(names))
        slope = np.where(told & (w == 0), np.abs(slope), 0.0)
        fresh = np.argsort(-slope, kind="stable")[:_JOIN]
        fresh = fresh[slope[fresh] > 1.05 * sparsity]
        if not len(fresh):
            break
        active = np.union1d(np.flatnonzero(w), fresh).tolist()
        for _ in range(passes):
            most = max(map(step, active), default=0.0)
            shift = float(np.clip((p - toxic).sum() / ((p * (1 - p)).sum() + 1e-5 * n), -1, 1))
            bias -= shift
            margin -= shift
            p[:] = _logistic(margin)
            if max(most, abs(shift)) < 2e-3:
                break
    weights[names] = w
    return Model(weights, float(bias))


def fit(
    labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_docs: int = 8_000,
    axes=IDENTITY_AXES, **options
) -> Model:
    """Fit on at most about ``max_docs`` labelled rows, chosen by a seeded hash of the id.

    Rows with a null label are left out; a null text is a text without words. What reaches the driver is
    the features of the sampled rows and of what their counterfactuals change.
    """
    rows = labelled.where(F.col(label_col).isNotNull())
    n = rows.count()
    part = min(1.0, max_docs / max(1, n))
    if part < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1_000_000)) < int(part * 1_000_000))
    table = rows.select(
        _examples(F.col(text_col), axes).alias("x"), F.col(label_col).cast("int").alias("label")
    ).toArrow().combine_chunks()
    if not table.num_rows:
        return fit_sets(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0), **options)
    x = table.column("x").combine_chunks()
    words, swaps = x.field("words"), x.field("swaps").flatten()
    gone, come = ([np.asarray(v, np.int64) for v in swaps.field(k).to_pylist()] for k in ("gone", "come"))
    sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    labels = (table.column("label").to_numpy() > 0).astype(float)
    return fit_sets(
        words.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), labels,
        list(zip(gone, come, strict=True)), **options
    )
