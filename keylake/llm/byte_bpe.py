"""Byte-level BPE encoding and decoding of whole texts.

Each match of the split pattern is merged apart. Possible merges wait in a rank queue: one bucket of linked-list places
for each merge rank, and a bitmap over ranks with two levels of summary above it. Find-first-set on the three levels
gives the lowest waiting rank, and its whole bucket is merged at once: entries whose pair has changed since are skipped,
of overlapping pairs the left one counts, and where a merge brings up a lower rank the rest of that match waits for it.
So a match of any length takes about as many steps as it has ranks. Matches of many texts share one queue: none has a
neighbour in another, and one search serves the bucket of all.

Texts are cut at single spaces between other characters before the pattern is applied, and each different piece is split
and merged once. The pattern must always begin a match there, and split what follows alike wherever it stands, as the
public tokenizers' pattern does; spaces=False is for patterns that do not. Pieces, matches and ids are Arrow and numpy
arrays; a batch is worked on in parts of about `PART` bytes of text.

Defined results: null text encodes as the empty text, to no ids. Repeated rows each give a row; empty tables give none.
A byte that the ranks lack raises ValueError, as does an id without a token. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm import words as W

#: Bytes of text that are encoded together; a longer text is worked on by itself.
PART = 4 << 20
WORD = 64
#: No merge; above every rank.
NONE = 2**31 - 1
#: Bytes that are white space, and the first two bytes of longer characters that could be.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE = np.isin(np.arange(1 << 16), [0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380])


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _once(values: np.ndarray) -> np.ndarray:
    """The different values, in order."""
    values.sort()
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


class RankQueue:
    """Waiting merges by rank: buckets of places, and a bitmap of non-empty buckets with two summary levels."""

    def __init__(self, ranks: int):
        self.buckets: list[list[np.ndarray]] = [[] for _ in range(ranks + 1)]
        self.low = [0] * (ranks // WORD + 1)
        self.middle = [0] * (ranks // WORD**2 + 1)
        self.top = 0

    def push(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Places and the ranks they wait for, in order of both."""
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        at = 0
        for rank, to in zip([*ranks[:1].tolist(), *ranks[cuts].tolist()], [*cuts.tolist(), len(ranks)], strict=False):
            bucket = self.buckets[rank]
            if not bucket:
                a, b = rank >> 6, rank >> 12
                self.low[a] |= 1 << (rank & 63)
                self.middle[b] |= 1 << (a & 63)
                self.top |= 1 << b
            bucket.append(places[at:to])
            at = to

    def first(self) -> int:
        """The lowest waiting rank, or -1."""
        top = self.top
        if not top:
            return -1
        b = (top & -top).bit_length() - 1
        word = self.middle[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        return (a << 6) + (word & -word).bit_length() - 1

    def take(self, rank: int) -> np.ndarray:
        """The places of a bucket in order, each once; the bucket is empty then."""
        held, self.buckets[rank] = self.buckets[rank], []
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.middle[b] &= ~(1 << (a & 63))
            if not self.middle[b]:
                self.top &= ~(1 << b)
        return held[0] if len(held) == 1 else _once(np.concatenate(held))


class Partners:
    """The tokens that stand on one side of a token in its merges, with the ranks of these merges."""

    def __init__(self, own: np.ndarray, other: np.ndarray, rank: np.ndarray, tokens: int):
        order = np.argsort(own, kind="stable")
        self.other, self.rank = other[order], rank[order]
        self.bounds = np.searchsorted(own[order], np.arange(tokens + 1)).tolist()
        self.table = np.full(tokens + 2, NONE, np.int32)

    def fill(self, token: int) -> np.ndarray:
        """Ranks of this token's merges by the other token, in a table that is to be cleared after use."""
        a, b = self.bounds[token], self.bounds[token + 1]
        self.table[self.other[a:b]] = self.rank[a:b]
        return self.table

    def clear(self, token: int) -> None:
        self.table[self.other[self.bounds[token] : self.bounds[token + 1]]] = NONE


class Chain:
    """Linked parts of the bytes of many matches, with a place between any two matches: each part's token, and the rank
    of its merge with the part that follows."""

    def __init__(self, text: np.ndarray, bounds: np.ndarray, byte: np.ndarray, pairs: np.ndarray, between: int):
        n = len(bounds) - 1
        size = len(text) + n + 1
        place = np.arange(1, len(text) + 1, dtype=np.int32)
        place += np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        self.ends = bounds + np.arange(n + 1)  # the places before, between and after the matches
        self.token, self.rank = np.full(size, between, np.int32), np.full(size, NONE, np.int32)
        self.token[place] = byte[text]
        inner = place[:-1][np.diff(place) == 1]
        code = np.zeros(size, np.uint8)
        code[place] = text
        self.rank[inner] = pairs[code[inner].astype(np.int32) * 256 + code[inner + 1]]
        self.next, self.last = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        self.part = np.zeros(size, bool)
        self.part[place] = True

    def merge(self, rank: int, at: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Merge pairs of this rank at these places, which are in order, as if one by one; the places that have to wait.

        after and before give the ranks of the new token's merges with each token that follows it or precedes it.
        """
        asked, right = at, self.next[at]
        if len(at) > 1 and (right[:-1] == at[1:]).any():
            fresh = np.concatenate([[True], right[:-1] != at[1:]])
            count = np.arange(len(at))
            at = at[(count - np.maximum.accumulate(np.where(fresh, count, 0))) % 2 == 0]
            right = self.next[at]
        beyond = self.next[right]
        touch = beyond[:-1] == at[1:]
        ahead, behind = after[self.token[beyond]], self.token[self.last[at]]
        behind[1:][touch] = rank  # as the pair on the left is merged already
        behind = before[behind]
        lower = np.minimum(ahead, behind) < rank
        wait = at[:0]
        if len(at) > 1 and lower[:-1].any():
            match = np.searchsorted(self.ends, at)
            earlier = np.cumsum(lower) - lower
            go = earlier == earlier[np.searchsorted(match, match)]
            wait = np.setdiff1d(asked, at[go])
            at, right, beyond, ahead, behind = at[go], right[go], beyond[go], ahead[go], behind[go]
            touch = beyond[:-1] == at[1:]
        self.token[at] = rank
        self.next[at], self.last[beyond] = beyond, at
        self.part[right], self.rank[right] = False, NONE
        ahead[:-1][touch] = after[rank]
        self.rank[self.last[at]] = behind
        self.rank[at] = ahead
        self.woken = at
        return wait[self.rank[wait] == rank]

    def waiting(self) -> tuple[np.ndarray, np.ndarray]:
        """(ranks, places) of the pairs that the last merge made, in order of both."""
        at = np.concatenate([self.woken, self.last[self.woken]])
        rank = self.rank[at]
        key = rank[rank != NONE].astype(np.int64) << 32 | at[rank != NONE]
        key = _once(key)
        return key >> 32, (key & 0xFFFFFFFF).astype(np.int32)


def _pick(flat: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of these rows of a ragged array."""
    count = np.diff(bounds)[rows]
    own = _bounds(count)
    at = np.repeat(bounds[:-1][rows] - own[:-1], count)
    at += np.arange(len(at))
    return flat[at], own


def _bounds(count: np.ndarray | list[int]) -> np.ndarray:
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    return out


class ByteBPE:
    """Encoder and decoder for one set of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, spaces: bool = True):
        self.ranks, self.spaces = ranks, spaces
        self.match = regex.compile(pattern).findall
        size = self.size = max(ranks.values(), default=-1) + 1
        tokens: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        # two more codes than tokens: the place between matches, and a byte that the ranks lack
        self.byte = np.array([ranks.get(bytes([b]), size + 1) for b in range(256)], np.int32)
        merges = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = np.array(merges, np.int32).reshape(-1, 3).T
        self.after, self.before = Partners(left, right, merged, size), Partners(right, left, merged, size)
        self.pairs = np.full(1 << 16, NONE, np.int32)
        for token, rank in ranks.items():
            if len(token) == 2 and token[:1] in ranks and token[1:] in ranks:
                self.pairs[token[0] * 256 + token[1]] = rank

    def merge(self, matches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of matches of the pattern."""
        text = np.frombuffer(b"".join(matches), np.uint8)
        chain = Chain(text, _bounds([len(m) for m in matches]), self.byte, self.pairs, self.size)
        queue = RankQueue(self.size)
        at = np.flatnonzero(chain.rank != NONE)
        at |= chain.rank[at].astype(np.int64) << 32
        at.sort()
        queue.push((at >> 32).astype(np.int32), (at & 0xFFFFFFFF).astype(np.int32))
        del at
        while (rank := queue.first()) >= 0:
            at = queue.take(rank)
            at = at[chain.rank[at] == rank]  # the others are stale
            if len(at):
                wait = chain.merge(rank, at, self.after.fill(rank), self.before.fill(rank))
                self.after.clear(rank)
                self.before.clear(rank)
                queue.push(*chain.waiting())
                if len(wait):
                    queue.push(np.full(len(wait), rank), wait)
        ids = chain.token[chain.part]
        if (ids > self.size).any():
            raise ValueError(f"the ranks have no token for some bytes of {sorted({m[:40] for m in matches if any(self.byte[b] > self.size for b in m)})[:3]}")
        return ids, np.cumsum(chain.part, dtype=np.int32)[chain.ends].astype(np.int64)

    def _encode_distinct(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of different pieces of text."""
        found = [self.match(x) for x in pieces]
        own = _bounds([len(matches) for matches in found])
        coded = pa.array([m for matches in found for m in matches], pa.large_string()).dictionary_encode()
        del found, pieces
        matches = [m.encode() for m in coded.dictionary.to_pylist()]
        ids = np.array([self.ranks.get(m, -1) for m in matches], np.int32)
        rest = np.flatnonzero(ids < 0)
        matches = [matches[k] for k in rest.tolist()]
        merged, bounds = self.merge(matches)
        count = np.ones(len(ids), np.int64)
        count[rest] = np.diff(bounds)
        whole = np.ones(count.sum(), bool)
        at = _bounds(count)
        whole[_pick(np.arange(len(whole)), at, rest)[0]] = False
        flat = np.empty(len(whole), np.int32)
        flat[whole], flat[~whole] = ids[ids >= 0], merged
        flat, at = _pick(flat, at, coded.indices.to_numpy())
        return flat, at[own]

    def _cuts(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where pieces begin, in order, and where the last one ends: texts, and single spaces between other characters."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        begin = offsets[:-1][offsets[1:] > offsets[:-1]] - lo
        if not self.spaces:
            return np.append(begin, hi - lo)
        byte = np.zeros(hi - lo + 6, np.uint8)
        byte[3:-3] = data[lo:hi]
        space = np.flatnonzero(byte == 32)
        odd = _SPACE[byte[space - 1]] | _SPACE[byte[space + 1]]
        for at in (space - 2, space - 3, space + 1):
            odd |= _WIDE[byte[at].astype(np.int32) << 8 | byte[at + 1]]
        cut = np.zeros(hi - lo + 1, bool)
        cut[space[~odd] - 3] = cut[begin] = cut[-1] = True
        return np.flatnonzero(cut)

    def encode_column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds) of consecutive texts, in parts of about PART bytes."""
        offsets, data = W.raw(column)
        at = 0
        while at < len(offsets) - 1:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART)))
            yield self._encode_part(offsets[at : to + 1], data)
            at = to

    def _encode_part(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if offsets[0] == offsets[-1]:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cuts = self._cuts(offsets, data)
        buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[offsets[0] : offsets[-1]]))]
        pieces = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, buffers).dictionary_encode()
        indices = pieces.indices.to_numpy()
        ids, bounds = _pick(*self._encode_distinct(pieces.dictionary.to_pylist()), indices)
        return ids, bounds[np.searchsorted(cuts, offsets - offsets[0])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for ids, bounds in self.encode_column(pa.array(texts, pa.large_string())):
            packed, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
            out += [packed[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return out

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of consecutive texts."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id has no token")
        taken = self.tokens.take(pa.array(ids))
        if taken.null_count:
            raise ValueError("an id has no token")
        offsets, data = W.raw(taken)
        at = offsets[bounds].tolist()
        return [data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, "<u4").astype(np.int64)
        return self.decode_all(own, np.array([0, len(own)]))[0]


_coders: dict[tuple, ByteBPE] = {}


def _coder(shared, pattern: str, spaces: bool) -> ByteBPE:
    """This worker's coder; its tables last as long as the worker."""
    ranks = shared.value
    held = _coders.get((pattern, spaces))
    if held is None or held.ranks is not ranks:
        held = _coders[pattern, spaces] = ByteBPE(ranks, pattern, spaces)
    return held


def _share(spark: SparkSession, ranks: dict[bytes, int] | str):
    return spark.sparkContext.broadcast(read_ranks(ranks) if isinstance(ranks, str) else ranks)


def encode(docs: DataFrame, ranks: dict[bytes, int] | str, pattern: str, id_col: str = "doc_id", text_col: str = "text", checked: bool = False, spaces: bool = True) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids (array of int), and if checked round_trip: do they decode to the text."""
    shared = _share(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern, spaces)
        for b in batches:
            at = 0
            for ids, bounds in coder.encode_column(b.column(1)):
                n = np.diff(bounds)
                columns = [b.column(0).slice(at, len(n)), pa.array(n), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))]
                if checked:
                    offsets, data = W.raw(b.column(1).slice(at, len(n)))
                    spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
                    columns.append(pa.array([t == data[x:y].tobytes() for t, (x, y) in zip(coder.decode_all(ids, bounds), spans, strict=True)], pa.bool_()))
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids", *["round_trip"] * checked])
                at += len(n)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>" + ", round_trip boolean" * checked)


def decode(encoded: DataFrame, ranks: dict[bytes, int] | str) -> DataFrame:
    """One row per row of (doc_id, ids): doc_id, bytes. Null ids decode to no bytes."""
    shared = _share(encoded.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, "", False)
        for b in batches:
            out = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks: dict[bytes, int] | str, pattern: str, id_col: str = "doc_id", text_col: str = "text", spaces: bool = True) -> DataFrame:
    """encode, then decode, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = _share(docs.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern, spaces)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids, bounds in coder.encode_column(b.column(1)):
                n.append(np.diff(bounds))
                packed = memoryview(ids.astype("<u4").tobytes())
                at = (4 * bounds).tolist()
                ids_sha += [hashlib.sha256(packed[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]
                text_sha += [hashlib.sha256(t).hexdigest() for t in coder.decode_all(ids, bounds)]
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(n) if n else [], pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
