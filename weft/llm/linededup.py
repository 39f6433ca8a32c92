"""Line dedup across documents by a deletion-neighbourhood join, keeping the earliest line.

A line (folded: A-Z in lower case, runs of spaces, tabs and the like as one space, none at the ends) of at least ``exact_chars`` characters goes when an earlier line of the corpus equals it, and one of at
least ``min_chars`` also when an earlier line of that length, kept or not, is within one edit of it. Earlier: by document id (null
last), then by hash of the text, then by line number.

Exact repeats are found by hash. For the rest, deletion variants of every line would be as many as
the characters of the corpus, so two exact filters come first. One edit changes four bytes at most,
so it leaves the first or the last ``q`` bytes as they are when ``2 q + 4`` is at most the shorter
length; lines that share neither with another line are done. What is left is cut in eight pieces: one edit leaves
seven as they are, so only lines equal but for one piece go on, and variants are made of that piece.

Variants of one deletion: two lines of a length that agree when the character at the same place is
deleted are one substitution apart; a line that equals a longer one with a character deleted is one
insertion apart. So every group of equal variants needs only its earliest member, never all its
pairs, and a witness is then verified with the edit distance of the whole lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import batched, carried, cut, cut_last
from .textscan import LOWER, SAME, SPACES, U64, chunks, mix64, range_sums

PIECES = 8
_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 32]] = True


class _Folded:
    """The folded lines of a chunk of texts: their bytes, ranges, row and number within the row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        data, n = LOWER[data], len(data)
        breaks = data == 10
        stop = np.zeros(n + 1, bool)  # where a line ends: at a break or before the next row
        stop[:n] = breaks
        stop[bounds[1:]] = True
        first = np.zeros(n + 1, bool)
        first[bounds[:-1]] = True
        first[1:] |= np.append(breaks, False)[:n]
        blank = _BLANK[data]
        before = np.zeros(n, bool)
        before[1:] = blank[:-1]
        opens = blank & (~before | first[:n])
        run = np.cumsum(opens)  # runs of blanks by number
        after = np.append(blank, False)[1:] & ~first[1:]
        ends = np.flatnonzero(blank & ~after)
        trailing = np.zeros(int(run[-1]) + 1 if n else 1, bool)
        trailing[run[ends[stop[ends + 1]]]] = True
        keep = ~blank | (opens & ~first[:n] & ~trailing[run])
        keep &= ~breaks
        place = np.concatenate(([0], np.cumsum(keep)))
        self.data = np.where(blank, np.uint8(32), data)[keep]
        at = np.flatnonzero(breaks)
        row_of_break = np.searchsorted(bounds, at, "right") - 1
        rows = np.concatenate((np.arange(len(bounds) - 1), row_of_break))
        start, end = np.concatenate((bounds[:-1], at + 1)), None
        order = np.lexsort((start, rows))
        self.row, start = rows[order], start[order]
        last = np.append(self.row[1:] != self.row[:-1], True)
        end = np.where(last, bounds[self.row + 1], np.append(start[1:], 0) - 1)
        self.start, self.end = place[start], place[end]
        self.no = np.arange(len(start)) - np.searchsorted(self.row, self.row)
        chars = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        self.chars = chars[self.end] - chars[self.start]


_LINE = "array<struct<no:int,k1:bigint,k2:bigint,ends:array<bigint>>>"


def _keyed_lines(text: Column, min_chars: int, exact_chars: int) -> Column:
    """Of each text its lines of at least ``exact_chars``: number, two hashes and, from ``min_chars`` on, the keys of both ends."""

    def found(x: pa.Array) -> pa.Array:
        counts, no, keys, ends, n_ends = [np.zeros(1, np.int64)], [], ([], []), [], [np.zeros(1, np.int64)]
        for c in chunks(x, SPACES, SAME):
            f = _Folded(c.data, c.bounds)
            asked = f.chars >= exact_chars
            start, end, long = f.start[asked], f.end[asked], f.chars[asked] >= min_chars
            counts.append(np.bincount(f.row[asked], minlength=c.rows))
            no.append(f.no[asked])
            sums = [range_sums(f.data, v) for v in (0, 1)]
            for into, hashed in zip(keys, sums, strict=True):
                into.append(hashed(start, end))
            start, end = start[long], end[long]
            q = [((end - start - cut_) // 8) * 4 for cut_ in (4, 8)]
            both = [
                mix64(
                    sums[0](*(side)) ^ (size.astype(U64) * U64(2) + U64(tag))
                ) for size in q for tag, side in ((0, (start, start + size)), (1, (end - size, end)))
            ]
            ends.append(np.stack(both, axis=1))
            n_ends.append(long * 4)
        whole = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        table = np.concatenate([np.zeros((0, 4), U64), *ends])
        at = pa.array(np.cumsum(np.concatenate(n_ends)).astype(np.int32))
        rows = pa.StructArray.from_arrays(
            [pa.array(whole(no, np.int64).astype(np.int32)), pa.array(whole(keys[0], U64).view(np.int64)), pa.array(whole(keys[1], U64).view(np.int64)), pa.ListArray.from_arrays(at, pa.array(table.ravel().view(np.int64)))], ["no", "k1", "k2", "ends"]
        )
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), rows)

    return batched(_LINE, found)(text)


def _folded_lines(text: Column, numbers: Column) -> Column:
    """The folded lines of the given numbers, in their order."""

    @F.arrow_udf("array<string>")
    def lines(x: pa.Array, wanted: pa.Array) -> pa.Array:
        out: list[list[str]] = []
        wanted = wanted.to_pylist()
        for c in chunks(x, SPACES, SAME):
            f = _Folded(c.data, c.bounds)
            first = np.searchsorted(f.row, np.arange(c.rows))
            raw = f.data.tobytes()
            for i in range(c.rows):
                out.append([raw[f.start[first[i] + n] : f.end[first[i] + n]].decode("utf-8", "replace") for n in wanted[c.lo + i]])
        return pa.array(out, pa.list_(pa.string()))

    return lines.asNondeterministic()(text, numbers)


def _place() -> Column:
    """What orders lines: smaller is earlier."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"), F.col("no").alias("no"))


def _pieces(lines: DataFrame) -> DataFrame:
    """Each line with each of its pieces taken out: ``sk`` names what is left, ``mid`` the piece."""
    n = F.length("norm")
    base = F.explode(F.array(n, n - 1)).alias("base")
    rows = lines.select("*", base).select("*", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))).alias("j"))
    start = F.floor(F.col("base") * F.col("j") / PIECES).cast("int")
    end = F.floor(F.col("base") * (F.col("j") + 1) / PIECES).cast("int") + (n - F.col("base"))
    head = F.substring(F.col("norm"), F.lit(1), start)
    tail = F.substring(F.col("norm"), end + 1, n - end)
    return rows.select(
        "k1", "place", (n - F.col("base")).alias("longer"), F.substring(F.col("norm"), start + 1, end - start).alias("mid"),
        F.xxhash64("base", "j", head, tail).alias("sk")
    )


_SUBSTITUTED, _LONGER, _SHORTER = 0, 1, 2


def _variants(pieces: DataFrame) -> DataFrame:
    """Rows ``vk, role, k1, place``: every deletion variant of a piece as a hashed key."""
    at = F.sequence(F.lit(1), F.length("mid"))
    without = lambda i: F.concat(F.substring(F.col("mid"), F.lit(1), i - 1), F.substring(F.col("mid"), i + 1, F.length("mid")))
    short = pieces.where("longer = 0")
    same = short.where("mid <> ''").select(
        "k1", "place", F.lit(_SUBSTITUTED).alias("role"),
        F.explode(F.transform(at, lambda i: F.xxhash64("sk", F.lit("at"), i, without(i)))).alias("vk")
    )
    centre = short.select("k1", "place", F.lit(_SHORTER).alias("role"), F.xxhash64("sk", F.lit("in"), "mid").alias("vk"))
    longer = pieces.where("longer = 1 and mid <> ''").select(
        "k1", "place", F.lit(_LONGER).alias("role"),
        F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64("sk", F.lit("in"), without(i))))).alias("vk")
    )
    return same.unionAll(centre).unionAll(longer)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key another line has too."""
    keys = rows.groupBy(key).agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select(key)
    return rows.join(keys, key, "left_semi")


def near_lines(lines: DataFrame) -> DataFrame:
    """``k1`` of the distinct lines (``k1, place, norm``) that an earlier one is within one edit of."""
    rows = _variants(_shared(_pieces(lines), "sk"))
    first = [F.min(F.when(F.col("role") == r, F.struct("place", "k1"))).alias(f"m{r}") for r in (_SUBSTITUTED, _LONGER, _SHORTER)]
    seen = F.expr("min(k1) <> max(k1)").alias("several")
    groups = rows.groupBy("vk").agg(*first, seen).where("several").drop("several")
    best = F.when(F.col("role") == _SUBSTITUTED, F.col("m0")).when(F.col("role") == _LONGER, F.col("m2")).otherwise(F.col("m1"))
    found = rows.join(groups, "vk").select(
        "k1", "place", best.alias("w")
    ).where("w.place < place").select("k1", F.col("w.k1").alias("w")).distinct()
    texts = lines.select("k1", "norm")
    pairs = found.join(texts, "k1").join(texts.select(F.col("k1").alias("w"), F.col("norm").alias("other")), "w")
    return pairs.where(F.levenshtein("norm", "other", 1).between(0, 1)).select("k1").distinct()


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, exact_chars: int | None = None
) -> DataFrame:
    """``docs`` with its text less the lines that go, and a struct ``_lines(total, exact, near)``.

    ``total`` counts the lines of a text, ``exact`` those that go as repeats and ``near`` those that
    go as one edit away. Lines count as repeats from ``exact_chars`` characters after folding (by default
    ``min_chars``; 1 takes every line that is not blank) and as near ones from ``min_chars``; the others stay. A null text stays null with counts of 0, an empty text has one line. Rows with equal id and
    text are one document: all keep the same lines. Rows with a null id come last in the order. Other
    columns pass through, whatever their names; one named ``_lines`` is replaced. An empty table gives no rows.
    """
    exact_chars = max(1, min_chars if exact_chars is None else min(exact_chars, min_chars))
    keyed = docs.select(
        carried(docs, ("_lines",)).alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("h")
    )
    source = keyed.select("id", "text", "h").where("text is not null")
    gone = cut_last(lambda: _lines_gone(source, min_chars, exact_chars))
    out = keyed.join(gone, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_g")), "left")
    text = F.col("text")
    stays = F.array_join(F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains("_drop", i)), "\n")
    total = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    near_n = F.coalesce("_near", F.lit(0)).cast("int")
    struct = F.struct(
        total.cast("int").alias("total"), (F.coalesce(F.size("_drop"), F.lit(0)) - near_n).cast("int").alias("exact"),
        near_n.alias("near")
    )
    left = F.when(F.size("_drop") > 0, stays).otherwise(text)
    return out.select(
        *[(left if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c != "_lines"], struct.alias("_lines")
    )


def _lines_gone(source: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """The lines that go from each of the documents ``id, text, h``."""
    lines = source.select(
        "id", "h", F.explode(_keyed_lines(F.col("text"), min_chars, exact_chars)).alias("x")
    ).select("id", "h", "x.*")
    lines = cut(lines)
    first = cut(lines.select("k1", "k2", _place().alias("place")).groupBy("k1", "k2").agg(F.min("place").alias("place")))

    ends = lines.select("k1", F.explode(F.array_distinct("ends")).alias("e"))
    close = _shared(ends, "e").select("k1").distinct()
    wanted = first.join(close, "k1", "left_semi").select(
        "k1", "place", F.col("place.id").alias("_i"), F.col("place.h").alias("_g"), F.col("place.no").alias("no")
    )
    asked = wanted.groupBy("_i", "_g").agg(F.collect_list(F.struct("no", "k1", "place")).alias("asked"))
    got = source.join(
        asked, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_g"))
    ).select("asked", _folded_lines(F.col("text"), F.col("asked.no")).alias("norms"))
    got = got.select(F.explode(F.arrays_zip("asked", "norms")).alias("x")).select(
        "x.asked.k1", "x.asked.place", F.col("x.norms").alias("norm")
    )
    near = cut(near_lines(cut(got.dropDuplicates(["k1"]))))

    marked = first.join(near.withColumn("near", F.lit(True)), "k1", "left").select(
        F.col("place.id").alias("id"), F.col("place.h").alias("h"), F.col("place.no").alias("no"),
        F.coalesce("near", F.lit(False)).alias("near")
    )
    return _gone(lines, marked)


def _gone(lines: DataFrame, marked: DataFrame) -> DataFrame:
    """``_i, _g, _drop, _near``: the line numbers that go from a document, and how many for being near."""
    every = lines.select(
        "id", "h", "no", F.lit(False).alias("first"), F.lit(False).alias("near")
    ).unionAll(marked.select("id", "h", "no", F.lit(True), "near"))
    seen = every.groupBy("id", "h").agg(
        F.collect_set("no").alias("all"), F.collect_set(F.when(F.col("first") & ~F.col("near"), F.col("no"))).alias("kept"),
        F.count_if(F.col("first") & F.col("near")).alias("_near")
    )
    drop = F.array_except("all", "kept")
    return seen.select(F.col("id").alias("_i"), F.col("h").alias("_g"), drop.alias("_drop"), "_near").where(F.size("_drop") > 0)
