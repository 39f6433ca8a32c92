"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled from a model file in three parts: the normaliser (the model's character map,
squeezing of spaces, a dummy prefix, and spaces to the piece space mark), the pieces, and byte fallback for
characters that no piece covers. Composing it with an input gives a lattice whose arcs are the pieces that
spell its parts, and the encoding is its shortest path in the tropical semiring (weights add along a path,
the least wins).

For a unigram model an arc weighs minus the piece's log probability. A BPE model has merge ranks and
no weights that add up, so its transducer keeps the last piece as its state: an arc from piece ``a``
to piece ``b`` weighs 0 if merging the text of ``a b`` alone leaves just these two pieces, and is absent
(infinite) if not. Merging a text leaves the one sequence all of whose neighbours are stable in this way,
so exactly one path has finite weight to each place, and it is the model's own encoding. With weights of
0 and infinity the shortest path is a search from the left that takes the longest arc first and never
enters again a place that it has had to leave.

No piece has the space mark behind another character, so a text falls into stretches that no piece
crosses; each is composed and solved alone, with memory in proportion to its length, and the ids of short
ones are remembered within a task.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .scratch import give_back

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6  # fixed values of the public file format
#: What a worker remembers: so many stretches of at most so many characters, and so many pairs of pieces.
_STRETCHES, _SHORT, _PAIRS = 200_000, 48, 150_000
_AHEAD = 4


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and value (bytes for lengths and fixed widths)."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


def _charsmap(blob: bytes) -> dict[str, str]:
    """The pairs of a compiled character map: a 32-bit size, a double-array trie of that size, and the
    replacements, each ended by a zero byte. A trie unit holds a label, an offset and a leaf mark."""
    if not blob:
        return {}
    size = struct.unpack_from("<I", blob)[0]
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    labels = units & 0x800000FF
    jumps = (units >> 10) << ((units & 512) >> 6)
    out: dict[str, str] = {}
    todo = [(b"", int(jumps[0]))]
    bytes_ = np.arange(1, 256)
    while todo:
        key, base = todo.pop()
        spots = base ^ bytes_
        for c in bytes_[(spots < len(units)) & (labels[np.minimum(spots, len(units) - 1)] == bytes_)].tolist():
            at = base ^ c
            below, own = at ^ int(jumps[at]), key + bytes([c])
            if units[at] >> 8 & 1:
                start = int(units[below] & 0x7FFFFFFF)
                out[own.decode("utf-8", "surrogateescape")] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((own, below))
    return out


class Normaliser:
    """Replaces the longest key of a character map at each place, then squeezes spaces if asked."""

    def __init__(self, pairs: dict[str, str], squeeze: bool):
        self.squeeze = squeeze
        self.single = {ord(k): v for k, v in pairs.items() if len(k) == 1}
        longer = sorted((k for k in pairs if len(k) > 1), key=len, reverse=True)
        self.pairs = pairs
        self.longer = {k[:2] for k in longer}
        self.most = max(map(len, longer), default=1)

    def __call__(self, text: str) -> str:
        if self.pairs and not text.isascii() or any(ord(c) in self.single for c in set(text)):
            text = self._mapped(text)
        if not self.squeeze:
            return text.replace(MARK, " ")
        return re.sub(" +", " ", text).lstrip(" ").replace(MARK, " ").rstrip(" ")  # a mark in a text is not squeezed

    def _mapped(self, text: str) -> str:
        if not any(a + b in self.longer for a, b in set(pairwise(text))):
            return text.translate(self.single)
        out, i, n = [], 0, len(text)
        while i < n:
            size = next(
                (k for k in range(min(self.most, n - i), 1, -1) if text[i : i + k] in self.pairs), 1
            ) if text[i : i + 2] in self.longer else 1
            out.append(self.pairs.get(text[i : i + size], text[i]))
            i += size
        return "".join(out)


class Transducer:
    """The compiled model; ``encode`` composes a text with it and takes the shortest path."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.unigram, self.dummy_prefix, squeeze, charsmap = True, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, _NORMAL))
            elif number == 2:
                own = dict(_fields(value))
                if own.get(3, 1) not in (1, 2) or own.get(24, 0):
                    raise ValueError("only unigram and BPE models with spaces before words are compiled")
                self.unigram = own.get(3, 1) == 1
            elif number == 3:
                own = dict(_fields(value))
                self.dummy_prefix, squeeze = bool(own.get(3, 1)), bool(own.get(4, 1))
                charsmap = own.get(2, b"")
        self.normalised = Normaliser(_charsmap(charsmap), squeeze)
        self.plain = not charsmap and not squeeze
        typed = list(enumerate(zip(self.pieces, self.kinds, strict=True)))
        self.ids = {p: i for i, (p, k) in typed if k in (_NORMAL, _USER, _UNUSED)}
        self.scores = scores
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == _UNKNOWN), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in typed if k == _BYTE}
        self.reach: dict[str, int] = {}  # the longest piece that starts with three characters (or has just these)
        for p in self.ids:
            self.reach[p[:3]] = max(len(p), self.reach.get(p[:3], 1))
        self.least = min(scores, default=0.0) - 10
        whole = all(MARK not in p.lstrip(MARK) for p in self.ids)
        alone = not any("\n" in p for p in self.ids)
        self.stretches = re.compile((r" +[^ \n]*|\n|[^ \n]+" if alone else r" +[^ ]*|[^ ]+") if whole else r"(?s).+")
        self.decoded = [self._bytes_of(p, k) for _, (p, k) in typed]
        self.known: dict[str, bytes] = {}
        self.stable: dict[int, bool] = {}  # by both pieces
        self.edged: dict[str, tuple] = {}  # of pieces
        self.arcs: dict[str, tuple] = {}  # by the next characters
        sizes: dict[str, set[int]] = {}  # of longer pieces by their first characters
        for p in self.ids:
            if len(p) > _AHEAD:
                sizes.setdefault(p[:_AHEAD], set()).add(len(p))
        self.sizes = {k: sorted(v, reverse=True) for k, v in sizes.items()}

    @staticmethod
    def _bytes_of(piece: str, kind: int) -> bytes:
        if kind == _BYTE:
            return bytes([int(piece[1:-1], 16)])
        if kind == _UNKNOWN:
            return b" \xe2\x81\x87 "
        return b"" if kind == _CONTROL else piece.replace(MARK, " ").encode()

    def forget(self) -> None:
        """Drop what was remembered of texts; what is known of the pieces stays."""
        self.known, self.arcs = {}, {}

    def _next_merge(self, parts: list[str]) -> tuple[int, float] | None:
        """Where the best-scored neighbours join next, leftmost on ties, and their score."""
        best, at = None, -1
        for i in range(len(parts) - 1):
            k = self.ids.get(parts[i] + parts[i + 1])
            if k is not None and (best is None or self.scores[k] > best):
                best, at = self.scores[k], i
        return None if best is None else (at, best)

    def edges(self, piece: str) -> tuple[bool, list[tuple[str, float]], list[tuple[str, float]]]:
        """Whether merging a piece's text leaves it whole, and the symbols at its right and left edge in
        the order they stand there, each with the score of the merge that takes it up (the last: none)."""
        got = self.edged.get(piece)
        if got is None:
            parts, right, left = list(piece), [], []
            while (at := self._next_merge(parts)) is not None:
                i, score = at
                if i == 0:
                    left.append((parts[0], score))
                if i == len(parts) - 2:
                    right.append((parts[-1], score))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            never = float("-inf")
            got = self.edged[piece] = (len(parts) == 1, [*right, (parts[-1], never)], [*left, (parts[0], never)])
        return got

    def follows(self, before: int, token: int) -> bool:
        """Whether the arc from one piece to the next has weight 0: merging their text never joins symbols
        across the seam. Merges go from the best score down and a part scores above its whole, so the
        two edges can be walked together; equal scores go to the leftmost. Below 0 stands a character
        that no piece covers, which never joins."""
        if before < 0 or token < 0:
            return True
        key = before * len(self.pieces) + token
        got = self.stable.get(key)
        if got is None:
            if len(self.stable) >= _PAIRS:
                self.stable.clear()
            right, left = self.edges(self.pieces[before])[1], self.edges(self.pieces[token])[2]
            i = j = 0
            got = True
            while True:
                (x, taken), (y, claimed) = right[i], left[j]
                k = self.ids.get(x + y)
                if k is not None and self.scores[k] > taken and self.scores[k] >= claimed:
                    got = False
                    break
                if taken == claimed == float("-inf"):
                    break
                if taken >= claimed:
                    i += 1
                else:
                    j += 1
            self.stable[key] = got
        return got

    def _arcs_from(self, start: str) -> tuple[tuple[int, int], ...]:
        """The arcs of a BPE model at a place where the text goes on with ``start`` (``_AHEAD`` characters, or
        fewer at the end), longest first: size and token, or None for sizes whose token the rest tells."""
        found: list[tuple[int, int | None]] = []
        if len(start) == _AHEAD:
            found += [(k, None) for k in self.sizes.get(start, ())]
        for size in range(len(start), 0, -1):
            token = self.ids.get(start[:size])
            if token is not None and self.edges(start[:size])[0]:
                found.append((size, token))
            elif token is None and size == 1:
                found.append((1, -1 - ord(start[0])))
        if len(self.arcs) >= _PAIRS // 3:
            self.arcs.clear()
        got = self.arcs[start] = tuple(found)
        return got

    def _merged(self, text: str) -> list[int]:
        """The path of finite weight through the lattice of a stretch of a BPE model, longest arcs first.

        One path leads to each place, so a place that can't be left is never of use again. Ids below 0
        are characters that no piece covers.
        """
        get, arcs, stable, follows, width, n = self.ids.get, self.arcs.get, self.stable.get, self.follows, len(self.pieces), len(text)
        ids, begins, left, at, most = [], [], None, 0, n
        while at < n:
            start = text[at : at + _AHEAD]
            row = before * width if ids and (before := ids[-1]) >= 0 else None
            for size, token in arcs(start) or self._arcs_from(start):
                if size > most:
                    continue
                if token is None and ((token := get(text[at : at + size])) is None or not self.edges(self.pieces[token])[0]):
                    continue
                if row is not None and token >= 0:
                    fit = stable(row + token)
                    if not (follows(before, token) if fit is None else fit):
                        continue
                if left is None or at + size not in left:
                    ids.append(token)
                    begins.append(at)
                    at, most = at + size, n
                    break
            else:  # never at the first place, from which the whole path leads
                left = left or set()
                left.add(at)
                ids.pop()
                most, at = at - begins[-1] - 1, begins.pop()
        return ids

    def _likeliest(self, text: str) -> list[int]:
        """The path of least weight through the lattice of a stretch of a unigram model."""
        n = len(text)
        cost, back, arc = [0.0] + [float("inf")] * n, array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
        for i in range(n):
            for size in range(1, min(self.reach.get(text[i : i + 3], 2), n - i) + 1):
                token = self.ids.get(text[i : i + size])
                if token is None and size > 1:
                    continue
                total = cost[i] - (self.least if token is None else self.scores[token])
                if total < cost[i + size]:
                    cost[i + size], back[i + size], arc[i + size] = total, i, -1 - ord(text[i]) if token is None else token
        ids = []
        while n:
            ids.append(arc[n])
            n = back[n]
        return ids[::-1]

    def _ids(self, stretch: str) -> bytes:
        """Packed ids of a stretch; a character that no piece covers becomes its bytes, or a run of such one unknown piece."""
        ids = (self._likeliest if self.unigram else self._merged)(stretch.replace(" ", MARK))
        if ids and min(ids) < 0:
            out: list[int] = []
            for i, k in enumerate(ids):
                if k >= 0:
                    out.append(k)
                elif self.bytes:
                    out += [self.bytes[b] for b in chr(-1 - k).encode()]
                elif not i or ids[i - 1] >= 0:
                    out.append(self.unknown)
            ids = out
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as 32-bit integers."""
        text = text.replace(MARK, " ") if self.plain else self.normalised(text)
        if not text:
            return b""
        parts, known = self.stretches.findall(" " + text if self.dummy_prefix else text), self.known
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        out = []
        for x in parts:
            got = known.get(x)
            if got is None:
                got = self._ids(x)
                if len(x) <= _SHORT:
                    if len(known) >= _STRETCHES:
                        known.clear()
                    known[x] = got
            out.append(got)
        return b"".join(out)

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes that ids spell, without the dummy prefix; a null and an id that the model doesn't have spell nothing."""
        try:
            text = b"".join(map(self.decoded.__getitem__, ids))
        except (IndexError, TypeError):
            text = b"".join(self.decoded[k] for k in ids if k is not None and 0 <= k < len(self.decoded))
        return text[1:] if self.dummy_prefix and text.startswith(b" ") else text

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def compiled(model: bytes) -> Transducer:
    return Transducer(model)


def load(spark: SparkSession, path: str = MODEL) -> bytes:
    """The model file, by the driver's own file system or else by Spark's readers."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return spark.read.format("binaryFile").load(path).first()["content"]


def _lists(packed: list[bytes | None]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(p or b"") // 4 for p in packed])))
    values = pa.array(np.frombuffer(b"".join(p or b"" for p in packed), np.int32))
    return pa.ListArray.from_arrays(
        pa.array(at.astype(np.int32), pa.int32()), values, mask=pa.array([p is None for p in packed], pa.bool_())
    )


def encode(model: bytes, text: Column) -> Column:
    """``array<int>`` of ids; null for a null text, empty for an empty one. Whole texts of any length."""
    return tokenise(model, text)["ids"]


def tokenise(model: bytes, text: Column) -> Column:
    """A struct ``ids, round_trip`` of a text: its ids and whether decoding them gives the text back.

    A null text has null ids and comes back; an empty one has no ids. A normaliser that changes texts
    makes texts that it changes not come back.
    """
    sent = SparkSession.active().sparkContext.broadcast(model)  # a model file, of a fixed size

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = compiled(sent.value)
        try:
            for x in batches:
                packed, back = [], []
                for v in x:
                    v = v.as_py()
                    ids = None if v is None else t.encode(v)
                    packed.append(ids)
                    back.append(ids is None or t.decode_bytes(array("i", ids).tolist()) == v.encode())
                yield pa.StructArray.from_arrays([_lists(packed), pa.array(back, pa.bool_())], ["ids", "round_trip"])
        finally:
            t.forget()
            give_back()

    return both.asNondeterministic()(text)


def decode(model: bytes, ids: Column) -> Column:
    """The text of an id list; null for null. Bytes that aren't UTF-8 become U+FFFD; nulls and unknown ids spell nothing."""
    sent = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        t = compiled(sent.value)
        return pa.array([None if v is None else t.decode(v) for v in x.to_pylist()], pa.string())

    return text.asNondeterministic()(ids)
