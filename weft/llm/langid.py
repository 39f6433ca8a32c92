"""Language identification by word-first backoff.

A known word adds its log frequency in each language. An unseen word backs off to its character
4-grams (word edges marked), then 3-, 2- and 1-grams: the longest order of which any gram is known
gives the mean log frequency of its known grams. The language with the largest sum wins, the first
in order on ties, and the score is its posterior under equal priors.

Words are runs of ASCII letters and of other characters beyond ASCII, A-Z in lower case. Counts are of
every word of a bounded sample of labelled rows per language (``max_docs``). The model holds, by hashed
key, a log ratio for each language that a word or gram was seen in, over a base that all unseen ones
share, so it grows with the sample and not with words times languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import batched
from .textscan import LOWER, U64, Chunk, chunks, mix64, range_sums

ORDERS = (4, 3, 2, 1)
_UPPER, _LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_LETTER = np.arange(256) < 128
_NOT_LETTER[97:123] = False  # texts are folded first
_EDGES = np.frombuffer(b"^$", np.uint8)
#: More distinct labels than there are languages: what was given is something else.
MOST_LANGUAGES = 10_000


@dataclass
class Entries:
    """Sorted keys and, for each, its (language, log ratio) entries; ``base`` is the log frequency without one."""

    keys: np.ndarray
    at: np.ndarray
    lang: np.ndarray
    ratio: np.ndarray
    base: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are known, and their places."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return self.keys[place] == hashes, place

    def add(self, out: np.ndarray, rows: np.ndarray, places: np.ndarray, weight: np.ndarray) -> None:
        """Add ``weight`` times the log ratios at ``places`` to the given rows of ``out``."""
        counts = self.at[places + 1] - self.at[places]
        entry = np.repeat(self.at[places] - np.concatenate(([0], np.cumsum(counts)))[:-1], counts) + np.arange(counts.sum())
        spot = np.repeat(rows, counts) * out.shape[1] + self.lang[entry]
        out += np.bincount(spot, self.ratio[entry] * np.repeat(weight, counts), out.size).reshape(out.shape)


@dataclass
class Model:
    languages: list[str]
    words: Entries
    grams: dict[int, Entries]


class _Edged:
    """Words between edge marks in one buffer, and the hashes of their character n-grams."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        sizes = end - start
        at = np.concatenate(([0], np.cumsum(sizes + 2)))
        buffer = np.full(at[-1], _EDGES[1], np.uint8)
        buffer[at[:-1]] = _EDGES[0]
        inner = np.repeat(at[:-1] + 1 - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())
        buffer[inner] = data[np.repeat(start - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())]
        self.lead = np.flatnonzero((buffer & 0xC0) != 0x80)  # where characters begin
        self.stop = np.append(self.lead[1:], len(buffer))
        self.word = np.searchsorted(at, self.lead, "right") - 1
        self.edge = np.isin(self.lead, np.concatenate((at[:-1], at[1:] - 1)))
        self.hash = range_sums(buffer)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The word and the hash of every gram of ``n`` characters; edges don't count as a gram of one."""
        last = len(self.lead) - n
        if last < 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        first = np.flatnonzero(self.word[: last + 1] == self.word[n - 1 :]) if n > 1 else np.flatnonzero(~self.edge)
        return self.word[first], mix64(self.hash(self.lead[first], self.stop[first + n - 1]) + U64(n))


def _vectors(model: Model, c: Chunk, hashes: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Log frequencies by language of distinct words, each given by its hash and one place where it stands."""
    out = np.zeros((len(hashes), len(model.languages)))
    known, place = model.words.find(hashes)
    rows = np.flatnonzero(known)
    out[rows] = model.words.base
    model.words.add(out, rows, place[rows], np.ones(len(rows)))
    left = np.flatnonzero(~known)
    for n in ORDERS:
        if not len(left):
            break
        word, gram = _Edged(c.data, c.start[sample[left]], c.end[sample[left]]).grams(n)
        known, place = model.grams[n].find(gram)
        word, place = word[known], place[known]
        found = np.bincount(word, minlength=len(left))
        hit = left[found > 0]
        out[hit] = model.grams[n].base
        model.grams[n].add(out, left[word], place, 1.0 / found[word])
        left = left[found == 0]
    return out


def guess(model: Model, texts: pa.Array) -> pa.StructArray:
    """A struct ``lang_pred, score`` of each text."""
    n, names, scores = len(model.languages), [], []
    for c in chunks(texts, _NOT_LETTER, LOWER):
        lettered = c.per_row((c.data >= 97) & (c.data < 123)) > 0
        for i in np.flatnonzero(~lettered & (c.n_words > 0)):
            lettered[i] = any(map(str.isalpha, c.data[c.bounds[i] : c.bounds[i + 1]].tobytes().decode("utf-8", "replace")))
        sums = np.zeros((c.rows, n))
        if n and len(c.start):
            hashes, sample, inverse = np.unique(c.word_hashes(), return_index=True, return_inverse=True)
            vectors = _vectors(model, c, hashes, sample)
            row = np.repeat(np.arange(c.rows), c.n_words)
            for k in range(n):
                sums[:, k] = np.bincount(row, vectors[inverse, k], c.rows)
        best = sums.argmax(axis=1) if n else np.zeros(c.rows, np.int64)
        for i in range(c.rows):
            sure = n and lettered[i]
            names.append(model.languages[best[i]] if sure else "und")
            scores.append(float(1.0 / np.exp(sums[i] - sums[i, best[i]]).sum()) if sure else 0.0)
    return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])


def identify(model: Model, text: Column) -> Column:
    """A struct ``lang_pred, score`` of each whole text, however long.

    ``und`` and 0 if it is null or has no letter, or if the model has learned nothing. Languages whose sums
    tie: the first in order. A text of words that tell nothing ties all. Repeated rows get equal results.
    """
    return batched("struct<lang_pred:string,score:double>", lambda x: guess(model, x))(text)


def fit(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_docs: int = 2_000
) -> Model:
    """Word and n-gram frequencies per language from about ``max_docs`` hashed rows of each.

    Rows with a null language or text are left out. The driver gets a row per language, then one per distinct
    word and language of the sampled rows. An empty table gives a model that knows no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.lit(9), F.col(id_col)), F.lit(1_000_000)).alias("draw")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has over {MOST_LANGUAGES} values")
    large = [x for k, n in sorted(sizes.items()) if n > max_docs for x in (F.lit(k), F.lit(max_docs / n * 1_000_000))]
    if large:  # a filter of literals, before anything is shuffled
        rows = rows.where(F.col("draw") < F.coalesce(F.create_map(*large)[F.col("lang")], F.lit(1e6)))
    word = F.explode(F.split(F.translate("text", _UPPER, _LETTERS), r"[\x00-\x60\x7b-\x7f]+"))
    words = rows.select("lang", word.alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    got = words.toArrow().combine_chunks()
    if not got.num_rows:
        return build([], pa.array([], pa.string()), np.zeros(0))
    return build(got.column("lang").to_pylist(), got.column("w").combine_chunks(), got.column("n").to_numpy())


def build(langs: list[str], words: pa.Array, counts: np.ndarray) -> Model:
    """The model of counted words: row by row a language, a word and how often it was seen."""
    languages = sorted(set(langs))
    place = {x: i for i, x in enumerate(languages)}
    lang, counts = np.array([place[x] for x in langs], np.int64), np.asarray(counts, float)
    keys, own, grams = [], [], {n: ([], [], []) for n in ORDERS}
    for c in chunks(words, _NOT_LETTER, LOWER):  # each row is one word
        rows = slice(c.lo, c.hi)
        keys.append(c.word_hashes())
        own.append(lang[rows])
        edged = _Edged(c.data, c.start, c.end)
        for n in ORDERS:
            of, gram = edged.grams(n)
            for into, x in zip(grams[n], (gram, lang[rows][of], counts[rows][of]), strict=True):
                into.append(x)
    n = len(languages)
    none = (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0))
    whole = lambda parts: tuple(np.concatenate([z, *p]) for z, p in zip(none, parts, strict=True))
    return Model(languages, _entries(*whole((keys, own, [counts])), n), {k: _entries(*whole(v), n) for k, v in grams.items()})


def _entries(keys: np.ndarray, lang: np.ndarray, counts: np.ndarray, n: int) -> Entries:
    """Smoothed log frequencies, alike for all languages: (count + 1/2) over (total + keys / 2)."""
    order = np.lexsort((lang, keys))
    keys, lang, counts = keys[order], lang[order], counts[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (lang[1:] != lang[:-1])
    first = np.flatnonzero(fresh)
    sums = np.add.reduceat(counts, first) if len(first) else counts
    keys, lang = keys[first], lang[first]
    names, at = np.unique(keys, return_index=True)
    totals = np.bincount(lang, sums, n) if n else np.zeros(0)
    base = np.log(0.5) - np.log(totals + 0.5 * max(1, len(names)))
    return Entries(names, np.append(at, len(keys)), lang.astype(np.int16), np.log((sums + 0.5) / 0.5).astype(np.float32), base)
