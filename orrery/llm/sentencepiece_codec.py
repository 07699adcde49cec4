"""SentencePiece encoding and decoding by suffix-array matching.

The chunks of a batch that are new are put into one text and indexed by a suffix array; every piece of the vocabulary finds
its occurrences there by binary search. Occurrences are edges from position to position, sorted by where they start. They
are then relaxed in the order the model asks for: a BPE model joins, again and again, the two neighbours whose edge scores
highest; a unigram model takes the path of the highest sum.

No piece goes over the border between a letter and the space after it, so a text is encoded chunk by chunk, and equal chunks
are encoded once. Short chunks are relaxed side by side, long ones each on its own: by a heap of pairs, or along the path, so
that a chunk of n characters takes about n log n steps. Memory follows the batch, and the longest run without a space.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm.learning import pieces, scored

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_GAP = 0x7FFFFFFF  # between chunks: larger than any character
#: Fields that encoded() can add.
FIELDS = {"ids": "array<int>", "n_tokens": "int", "ids_crc": "bigint", "round_trip": "boolean"}


@dataclass(frozen=True)
class Vocabulary:
    """pieces hold plain spaces. ids of bytes stand in order of the byte, or are empty."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    unigram: bool
    prefix: bool
    unknown: int

    @staticmethod
    def read(path: str = DEFAULT_MODEL) -> Vocabulary:
        """A model file, read on the driver; its size bounds what executors get."""
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, tuple(p.type for p in proto.pieces)
        if norm.name not in ("identity", "") or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without normalization are supported")
        if 4 in kinds or proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without user-defined pieces are supported")
        pieces = tuple(p.piece.replace(_SPACE, " ") for p in proto.pieces)
        if any(k == _NORMAL and (" " in p.lstrip(" ") or ("\n" in p and len(p) > 1)) for p, k in zip(pieces, kinds)):
            raise ValueError("a piece goes over a border between chunks")
        return Vocabulary(pieces, tuple(p.score for p in proto.pieces), kinds, proto.trainer_spec.model_type == 1, norm.add_dummy_prefix, kinds.index(_UNKNOWN))


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the next `depth` codes: as many as a word holds at first, then by prefix doubling."""
    found = np.unique(codes)
    rank = np.searchsorted(found, codes).astype(np.int64) + 1
    bits = int(len(found) + 1).bit_length()
    key, k = rank, 1
    while 2 * k * bits <= 62 and k < depth:
        after = np.zeros_like(key)
        after[:-k] = key[k:]
        key, k = (key << (k * bits)) | after, 2 * k
    order = np.argsort(key)
    while k < depth:
        step = np.ones(len(codes), np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(step)
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        key = rank * (len(codes) + 1) + after
        order = np.argsort(key)
        k *= 2
    return order


def ranges(codes: np.ndarray, order: np.ndarray, pieces: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece (a row of codes), where its occurrences begin and end in the suffix array.

    All pieces search together, one character after another inside the range found so far.
    """
    padded = np.concatenate((codes, np.full(pieces.shape[1] + 1, -1, codes.dtype)))
    low, high = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(codes), np.int64)
    for j in range(pieces.shape[1]):
        live = np.flatnonzero((length > j) & (low < high))
        want = pieces[live, j]
        for side, out in ((False, low), (True, high)):
            a, b = low[live].copy() if not side else start, end if side else high[live].copy()
            first, last = a.copy(), b.copy()
            while (open_ := first < last).any():
                mid = (first + last) // 2
                ch = padded[order[np.minimum(mid, len(codes) - 1)] + j]
                right = open_ & ((ch <= want) if side else (ch < want))
                first = np.where(right, mid + 1, first)
                last = np.where(open_ & ~right, mid, last)
            if not side:
                start, end, found = a, b, first
            else:
                low[live], high[live] = found, first
    return low, high


class Edges:
    """Occurrences of pieces as arrays sorted by (start, length)."""

    def __init__(self, at: np.ndarray, length: np.ndarray, piece: np.ndarray, size: int, depth: int):
        self.width = depth + 1
        keys = at * self.width + length
        by = np.argsort(keys)
        self.keys, self.piece = np.append(keys[by], np.iinfo(np.int64).max), np.append(piece[by], -1)
        self.starts = np.searchsorted(self.keys, np.arange(size + 1) * self.width)

    def find(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The piece that starts at each place with that length, or -1."""
        want = at * self.width + length
        place = np.searchsorted(self.keys, want)
        return np.where(self.keys[place] == want, self.piece[place], -1)

    def between(self, first: int, end: int) -> tuple[array, array, array]:
        """Of starts from first to end: where each one's edges begin, their lengths and pieces."""
        low, high = self.starts[first], self.starts[end]
        offsets = array("q", (self.starts[first : end + 1] - low).tobytes())
        lengths = array("q", (self.keys[low:high] % self.width).tobytes())
        return offsets, lengths, array("q", self.piece[low:high].astype(np.int64).tobytes())


class Codec:
    """Encodes batches of texts; remembers up to `remember` chunks of `room` characters in all between batches.

    Chunks of up to `short` characters are relaxed side by side; the way does not change the ids.
    """

    def __init__(self, v: Vocabulary, remember: int = 400_000, short: int = 48, room: int = 8_000_000):
        self.v, self.remember, self.short, self.room = v, remember, short, room
        self.normal = [i for i, k in enumerate(v.kinds) if k == _NORMAL]
        self.depth = max((len(v.pieces[i]) for i in self.normal), default=1)
        self.length = np.array([len(v.pieces[i]) for i in self.normal])
        self.codes = np.full((len(self.normal), self.depth), -1, np.int64)
        for row, i in enumerate(self.normal):
            self.codes[row, : self.length[row]] = [ord(c) for c in v.pieces[i]]
        self.place = np.array(self.normal)
        self.unknown = min((v.scores[i] for i in self.normal), default=0.0) - 10
        by_score = np.unique(np.array(v.scores))
        self.rank = np.searchsorted(by_score, np.array(v.scores)) + 1
        self.bytes = [i for i, k in enumerate(v.kinds) if k == _BYTE]
        self.shown = [p if k == _NORMAL else "" for p, k in zip(v.pieces, v.kinds)]
        for b, i in enumerate(self.bytes):
            self.shown[i] = chr(b) if b < 128 else chr(0xDC00 + b)
        self.shown[v.unknown] = " ⁇ "
        self.chunk = re.compile(r"\n| +[^ \n]*|[^ \n]+")
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self.pool = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def _tokens_of_char(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.bytes else [self.v.unknown]

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks that are not known yet, a bounded number of characters at a time."""
        for part in pieces(chunks, 1 << 20):
            self._learn(chunks[part])

    def _learn(self, chunks: list[str]) -> None:
        text = "\n".join(chunks)  # a chunk with a line end is that alone
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        size = np.array([len(c) for c in chunks])
        first = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
        gaps = (first + size)[:-1]
        codes[gaps] = _GAP
        order = suffix_array(codes, self.depth)
        low, high = ranges(codes, order, self.codes, self.length)
        n = high - low
        at = order[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
        edges = Edges(at, np.repeat(self.length, n), np.repeat(self.place, n), len(codes), self.depth)
        relax, alone = (self._best_path, self._path_of) if self.v.unigram else (self._join, self._joined)
        short = size <= self.short
        parts = [relax(edges, first[short], size[short], np.flatnonzero(short))] if short.any() else []
        parts += [alone(edges, int(first[i]), int(size[i]), int(i)) for i in np.flatnonzero(~short)]
        begin, long, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
        by = np.argsort(begin, kind="stable")
        begin, long, owner = begin[by], long[by], owner[by]
        ids = edges.find(begin, long)
        missing = np.flatnonzero(ids < 0)
        if len(missing):
            tokens = [self._tokens_of_char(text[p]) for p in begin[missing]]
            width = np.ones(len(ids), np.int64)
            width[missing] = [len(t) for t in tokens]
            filled = np.repeat(ids, width)
            filled[np.repeat(ids < 0, width)] = [x for t in tokens for x in t]
            ids, owner = filled, np.repeat(owner, width)
        counts = np.bincount(owner, minlength=len(chunks))
        self.start = np.concatenate((self.start, len(self.pool) + np.concatenate(([0], np.cumsum(counts)[:-1]))))
        self.size = np.concatenate((self.size, counts))
        self.pool = np.concatenate((self.pool, ids.astype(np.int32)))
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))

    def _join(self, edges: Edges, first: np.ndarray, size: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Joins the best pair of neighbours in every chunk (the leftmost of equals) until no pair has an edge."""
        owner = np.repeat(name, size)
        begin = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        long = np.ones(len(begin), np.int64)
        done = []
        while len(begin):
            joined = np.zeros(len(begin), np.int64)
            both = long[:-1] + long[1:]
            pair = np.flatnonzero((owner[:-1] == owner[1:]) & (both <= self.depth))
            piece = edges.find(begin[pair], both[pair])
            joined[pair] = np.where(piece >= 0, self.rank[piece] * (len(begin) + 1) + len(begin) - pair, 0)
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            top = np.maximum.reduceat(joined, heads)
            runs = np.diff(np.concatenate((heads, [len(begin)])))
            moving = np.repeat(top > 0, runs)
            if not moving.all():
                done.append((begin[~moving], long[~moving], owner[~moving]))
            win = np.flatnonzero(moving & (joined == np.repeat(top, runs)))
            long[win] += long[win + 1]
            moving[win + 1] = False
            begin, long, owner = begin[moving], long[moving], owner[moving]
        return tuple(np.concatenate([d[i] for d in done]) for i in range(3))

    def _joined(self, edges: Edges, first: int, n: int, name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What _join does for one chunk, by a heap of pairs: highest rank first, the leftmost of equals."""
        offsets, lengths, found = edges.between(first, first + n)
        rank, depth = self.rank.tolist(), self.depth
        long, before = array("q", [1]) * n, array("q", range(-1, n - 1))

        def pair(i: int) -> tuple[int, int, int, int] | None:
            j = i + long[i]
            if j >= n or (both := long[i] + long[j]) > depth:
                return None
            k = bisect_left(lengths, both, offsets[i], offsets[i + 1])
            return (-rank[found[k]], i, long[i], long[j]) if k < offsets[i + 1] and lengths[k] == both else None

        heap = [p for p in map(pair, range(n)) if p]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            if long[i] != left or long[i + left] != right:  # one of the two has been joined since
                continue
            long[i + left] = 0
            long[i] = left + right
            if (after := i + left + right) < n:
                before[after] = i
            for k in (before[i], i):
                if k >= 0 and (p := pair(k)):
                    heapq.heappush(heap, p)
        kept = np.frombuffer(long, np.int64)
        at = np.flatnonzero(kept)
        return first + at, kept[at], np.full(len(at), name)

    def _best_path(self, edges: Edges, first: np.ndarray, size: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over all chunks together: edges relaxed in order of their start; a lone character may go as unknown."""
        scores = np.array(self.v.scores, np.float64)
        n = int(size.max())
        best, back = np.full((len(size), n + 1), -np.inf), np.zeros((len(size), n + 1), np.int64)
        best[:, 0] = 0
        for t in range(n):
            rows = np.flatnonzero(size > t)
            for k in range(1, min(self.depth, n - t) + 1):
                at = rows[size[rows] >= t + k]
                piece = edges.find(first[at] + t, np.full(len(at), k))
                gain = np.where(piece >= 0, scores[piece], self.unknown if k == 1 else -np.inf) + best[at, t]
                better = gain > best[at, t + k]
                best[at[better], t + k], back[at[better], t + k] = gain[better], k
        out = []
        at, end = np.arange(len(size)), size.copy()
        while len(at):
            k = back[at, end[at]]
            end[at] -= k
            out.append((first[at] + end[at], k, name[at]))
            at = at[end[at] > 0]
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3))

    def _path_of(self, edges: Edges, first: int, n: int, name: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What _best_path does, for one chunk."""
        offsets, lengths, found = edges.between(first, first + n)
        best, back = array("d", [-np.inf]) * (n + 1), array("i", [0]) * (n + 1)
        best[0] = 0.0
        for t in range(n):
            own, k = best[t], offsets[t]
            if k == offsets[t + 1] or lengths[k] > 1:  # no piece is this character alone
                if own + self.unknown > best[t + 1]:
                    best[t + 1], back[t + 1] = own + self.unknown, 1
            for k in range(k, offsets[t + 1]):
                end, gain = t + lengths[k], own + self.v.scores[found[k]]
                if gain > best[end]:
                    best[end], back[end] = gain, lengths[k]
        at, long = [], []
        while n:
            long.append(back[n])
            n -= back[n]
            at.append(first + n)
        return np.array(at), np.array(long), np.full(len(at), name)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin and end."""
        split = []
        for t in texts:
            t = t.replace(_SPACE, " ")
            split.append(self.chunk.findall(" " + t if self.v.prefix and t else t))
        every = [c for cs in split for c in cs]
        new = list(dict.fromkeys(c for c in set(every) if c not in self.known))
        if len(new) + len(self.known) > self.remember or self.held + sum(map(len, new)) > self.room:
            self.forget()
            new = list(set(every))
        if new:
            self.held += sum(map(len, new))
            self.learn(sorted(new))
        index = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        size = self.size[index]
        upto = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[index] - upto + size, size) + np.arange(int(upto[-1]) if len(upto) else 0)]
        chunks = np.cumsum([0, *[len(cs) for cs in split]])
        return ids, np.concatenate(([0], upto))[chunks]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD, as does what stands for them."""
        t = "".join(map(self.shown.__getitem__, ids))
        if not t.isascii():
            t = t.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return t[1:] if self.v.prefix and t[:1] == " " else t

    def fields(self, texts: list[str], fields: list[str]) -> list:
        ids, ends = self.encode(texts)
        out = {"ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), "n_tokens": np.diff(ends).astype(np.int32)}
        spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        if "ids_crc" in fields:
            raw = ids.astype("<i4")
            out["ids_crc"] = np.array([zlib.crc32(raw[a:b]) for a, b in spans], np.int64)
        if "round_trip" in fields:
            flat = ids.tolist()
            out["round_trip"] = np.array([self.decode(flat[a:b]) == t for (a, b), t in zip(spans, texts)], bool)
        return [out[f] for f in fields]


def encoded(docs: DataFrame, vocabulary: Vocabulary, fields: tuple[str, ...] = ("ids", "n_tokens"), text: str = "text") -> DataFrame:
    """docs without its text column, with fields of each text: ids, n_tokens, ids_crc (of the ids as 32-bit numbers), round_trip.

    round_trip tells whether decoding gives the text back; it fails only where a text holds U+2581, which the format uses
    for spaces. A null or empty text has no ids. Rows are encoded each on its own, so repeated rows give equal ids; an
    empty table gives an empty table. Columns named like a field are replaced, in upper or lower case. The model was read on
    the driver and goes along with the function.
    """

    def start():
        codec = Codec(vocabulary)
        return lambda texts: codec.fields(texts, list(fields))

    return scored(docs, start, text, [(f, FIELDS[f]) for f in fields])


def decoded(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text that its ids stand for; null or empty ids give an empty text, an empty table an empty table.

    A column of the text's name is replaced; other columns stay.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def f(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(vocabulary)
        for column in columns:
            yield column.map(lambda x: "" if x is None else codec.decode(list(x)))

    return df.withColumn(text, f(ids))
