"""Benchmark decontamination: a prefix-filtered set join of documents against windows of benchmark items.

Every item gives windows of `window` consecutive words (a shorter item is one window). A window's set is its shingles of
up to three words. Since containment must be whole, one shingle is a sufficient prefix, and the join takes the rarest,
by counts over all documents. A document meets a window only at that shingle; the place of the shingle in the window
(positional bound) and the words left in the document (length bound) fix the one possible alignment, whose words are
then compared exactly.

The benchmark's windows are broadcast in blocks of about `block_bytes` of item text, as flat arrays of some 60 bytes a
window; equal windows, by a 128-bit digest, are one. One block, and so one pass, serves any usual benchmark; more blocks
mean more passes over the documents, whose rows are then written with numbers, by which hits are merged.

Defined results: null or wordless text has no words, is not contaminated and has no items (digest of the empty string).
Items with null id or text, or without words, have no windows. Repeated rows each give a row; repeated items count once.
Empty tables give no rows, or documents without hits. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keylake.llm import words as W
from keylake.session import materialize

BLOCK_BYTES = 8 << 20
SHINGLE = 3
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_EMPTY = hashlib.sha256(b"").hexdigest()


class Windows:
    """Windows of one block of items; after order(), by the rarest shingle of each."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        w = W.words(pa.array([t for _, t in items], pa.string()))
        self.item_ids = [i for i, _ in items]
        self.byte, self.start, self.end, self.hash = W.WORD_BYTE[w.data], w.start, w.end, w.hash
        count = w.per_row()
        number = np.where(count > 0, np.maximum(1, count - window + 1), 0)
        item = np.repeat(np.arange(len(items)), number)
        first = np.searchsorted(w.row, np.arange(len(items)))[item] + np.arange(len(item)) - np.repeat(np.cumsum(number) - number, number)
        length = np.minimum(window, count)[item]
        digest = [np.zeros(len(first), W.U) for _ in range(2)]
        for k in range(int(length.max(initial=0))):
            word = np.where(k < length, self.hash[np.minimum(first + k, len(self.hash) - 1)], W.U(0))
            digest = [W.mix(d * W.U(c) + word) for d, c in zip(digest, (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15), strict=True)]
        order = np.lexsort((item, *digest, length))
        key = np.stack([length.astype(W.U), *digest])[:, order]
        new = np.ones(len(order), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
        self.first, self.length = first[order][new], length[order][new]
        self.owners, self.owner_bounds = item[order].astype(np.int32), np.append(np.flatnonzero(new), len(order))
        self.sizes = sorted({min(SHINGLE, n) for n in self.length.tolist()})
        self.shingles = {}  # by size, the shingle that begins at each word
        for size in self.sizes:
            self.shingles[size] = np.zeros(len(self.hash), W.U)
            h, at = W.shingles(w, size)
            self.shingles[size][at] = h
        self.distinct = np.unique(np.concatenate([x for x in self.shingles.values()])) if self.sizes else np.zeros(0, W.U)
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def order(self, counts: np.ndarray) -> None:
        """Take each window's rarest shingle, by counts of the distinct ones; then the least, then the first."""
        for size in self.sizes:
            own = np.flatnonzero(np.minimum(self.length, SHINGLE) == size)
            best, place, rare = np.zeros(len(own), W.U), np.zeros(len(own), np.int32), np.full(len(own), np.iinfo(np.int64).max)
            for k in range(int(self.length[own].max(initial=0)) - size + 1):
                inside = k <= self.length[own] - size
                h = self.shingles[size][np.minimum(self.first[own] + k, len(self.hash) - 1)]
                n = counts[np.searchsorted(self.distinct, h)]
                better = inside & ((n < rare) | ((n == rare) & (h < best)))
                best[better], rare[better], place[better] = h[better], n[better], k
            order = np.argsort(best, kind="stable")
            found, begin = np.unique(best[order], return_index=True)
            self.prefix[size] = found, np.append(begin, len(order)), own[order], place[order]
        del self.shingles, self.distinct

    def text(self, n: int) -> list[bytes]:
        """The words of a window."""
        at = slice(self.first[n], self.first[n] + self.length[n])
        return [self.byte[a:b].tobytes() for a, b in zip(self.start[at], self.end[at], strict=True)]

    def items(self, n: int) -> list:
        return [self.item_ids[k] for k in self.owners[self.owner_bounds[n] : self.owner_bounds[n + 1]].tolist()]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size; streamed, so the driver holds one block at a time."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    block, held = [], 0
    for r in items.distinct().toLocalIterator():
        block.append((r.item, r.text))
        held += len(r.text)
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _count_shingles(docs: DataFrame, windows: Windows) -> np.ndarray:
    """How often each distinct shingle of the block occurs in all documents."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((windows.sizes, windows.distinct))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, distinct = shared.value
        total = np.zeros(len(distinct), np.int64)
        for b in W.slices(batches):
            w = W.words(b.column(0))
            for size in sizes:
                there, place = W.member(W.shingles(w, size)[0], distinct)
                total += np.bincount(place[there], minlength=len(distinct))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["place", "n"])

    rows = docs.select("text").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # one row for a shingle of the block at most
    out = np.zeros(len(windows.distinct), np.int64)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out


def _hits(w: W.Words, windows: Windows) -> tuple[np.ndarray, dict[int, set]]:
    """(is the word hit, items by row) of a batch."""
    edge = np.zeros(len(w.hash) + 1, np.int64)
    items: dict[int, set] = defaultdict(set)
    for size, (ordered, bounds, window, offset) in windows.prefix.items():
        h, at = W.shingles(w, size)
        there, place = W.member(h, ordered)
        at, place = at[there], place[there]
        count = bounds[place + 1] - bounds[place]
        entry = np.repeat(bounds[place] - np.cumsum(count) + count, count) + np.arange(count.sum())
        n, first = window[entry], np.repeat(at, count) - offset[entry]
        after = first + windows.length[n]
        fits = (first >= 0) & (after <= len(w.hash))
        n, first, after = n[fits], first[fits], after[fits]
        fits = w.row[first] == w.row[after - 1]
        for k in range(int(windows.length[n].max(initial=0))):
            n, first, after = n[fits], first[fits], after[fits]
            longer = k < windows.length[n]
            fits = ~longer | (w.hash[np.minimum(first + k, len(w.hash) - 1)] == windows.hash[np.minimum(windows.first[n] + k, len(windows.hash) - 1)])
        for m, a, b in zip(n[fits].tolist(), first[fits].tolist(), after[fits].tolist(), strict=True):
            if w.text(a, b) == windows.text(m):
                edge[a] += 1
                edge[b] -= 1
                items[int(w.row[a])].update(windows.items(m))
    return np.cumsum(edge[:-1]) > 0, items


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest() if items else _EMPTY


def _scan(windows: Windows):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = windows.value
        for b in W.slices(batches):
            w = W.words(b.column(1))
            hit, items = _hits(w, found)
            n_hit = np.bincount(w.row[hit], minlength=w.rows)
            own = [items.get(r, ()) for r in range(w.rows)]
            yield pa.record_batch(
                [b.column(0), pa.array(w.per_row()), pa.array(n_hit), pa.array([len(x) for x in own], pa.int64()), pa.array([_digest(x) for x in own], pa.string()), pa.array(n_hit > 0)],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return scan


_PARTS = "row long, doc_id long, n_words long, hit array<int>, items array<string>"


def _scan_parts(windows: Windows):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = windows.value
        for b in W.slices(batches):
            w = W.words(b.column(2))
            hit, items = _hits(w, found)
            first = np.searchsorted(w.row, np.arange(w.rows))
            places: dict[int, list[int]] = defaultdict(list)
            for k in np.flatnonzero(hit).tolist():
                places[int(w.row[k])].append(k - int(first[w.row[k]]))
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(w.per_row()), pa.array([places.get(r, []) for r in range(w.rows)], pa.list_(pa.int32())), pa.array([sorted(map(str, items.get(r, ()))) for r in range(w.rows)], pa.list_(pa.string()))],
                ["row", "doc_id", "n_words", "hit", "items"],
            )

    return scan


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (see the module)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    blocks = []
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        windows = Windows(items, window)
        windows.order(_count_shingles(docs, windows))
        blocks.append(spark.sparkContext.broadcast(windows))
    if len(blocks) <= 1:
        return docs.mapInArrow(_scan(blocks[0] if blocks else spark.sparkContext.broadcast(Windows([], window))), SCHEMA)
    # Each row has a number of its own; the numbered rows are written, so that it is the same in every pass.
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    parts = None
    for b in blocks:
        own = numbered.mapInArrow(_scan_parts(b), _PARTS)
        parts = own if parts is None else parts.unionByName(own)
    merged = parts.groupBy("row", "doc_id", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return merged.select("doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without contaminated rows; columns unchanged. A row goes by its own text, so nothing is joined or shuffled."""
    spark, out = docs.sparkSession, docs
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        windows = Windows(items, window)
        windows.order(_count_shingles(docs.select(F.col(text_col).alias("text")), windows))
        out = out.where(~_hit_in(spark.sparkContext.broadcast(windows))(F.col(text_col)))
    return out


def _hit_in(windows):
    """A function of a text column: does it hold a window?"""

    @F.arrow_udf("boolean")
    def hit(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for lo in range(0, len(text), 1024):
            w = W.words(text.slice(lo, 1024))
            there = _hits(w, windows.value)[0]
            out[lo + np.unique(w.row[there])] = True
        return pa.array(out)

    return hit


def oracle(window: int = 10) -> str:
    """The same rows in DuckDB SQL."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all({lower}, '{word}') AS w FROM documents),
dw AS (SELECT doc_id, rid, coalesce(len(w), 0) AS n_words, coalesce(w, []) AS w FROM d),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({lower}, '{word}') AS w FROM benchmark
      WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item_id, w[p:p + least({window}, len(w)) - 1] AS win, least({window}, len(w)) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {window} + 1, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
pos AS (SELECT rid, n, w[p:p + n - 1] AS win, p FROM
        (SELECT rid, n, w, unnest(range(1, n_words - n + 2)) AS p FROM dw, sizes WHERE n_words >= n)),
hits AS (SELECT pos.rid, pos.p, pos.n, iw.item_id FROM pos JOIN iw ON pos.n = iw.n AND pos.win = iw.win),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS k FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
