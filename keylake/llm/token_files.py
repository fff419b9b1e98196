"""Token ids in Parquet files: list columns whose encodings, row groups and page indexes serve selective reads.

Documents are dealt to segments by ranges of their ids, and each segment is one file in the order of ids. A row has a piece
of one document's ids, PIECE at most, so that a page, and what a reader decodes for one position, stays small however long a
document is. The list of ids is dictionary encoded (a vocabulary of 16 bits packs into two bytes an id); doc_id, row, part,
first and n rise or repeat within a file and are delta encoded. Row groups have a bounded size, pages a bounded number of
rows, and each file carries column and offset indexes: a read by document or by place in the corpus skips row groups and
pages by the values of doc_id and first, and a read of metadata never touches the ids.

The tokenizers library encodes. As its matches never hold white space, a document of any length is worked on in parts of
some megabytes, cut at ASCII white space, and each distinct piece of a part's words is encoded once.

Defined results: null and empty texts are the end id alone. Rows with null doc_id come last. Repeated doc_ids are rows of
their own, in the order of a hash of their texts; equal rows follow each other. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keylake.llm import words as W

#: Ids of a row, and bytes of text that are encoded at once.
PIECE, PART = 4096, 4 << 20
#: Bytes of a row group and of a page, and rows of a page, at most.
GROUP, PAGE, PAGE_ROWS = 16 << 20, 64 << 10, 512
COLUMNS = "segment int, row long, doc_id long, part int, first long, n int, ids array<int>"
DELTA = ("segment", "row", "doc_id", "part", "first", "n")

#: Kinds of bytes: white space, letters of ASCII and of U+00C0 to U+024F, digits, other ASCII, apostrophe (begins
#: contractions), and all else; the bar, which is in the names of special tokens, counts as that.
_SPACE, _LETTER, _DIGIT, _OTHER, _APOSTROPHE, _ELSE = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 13, 32]], _KIND[48:58], _KIND[65:91], _KIND[97:123], _KIND[39], _KIND[124] = _SPACE, _DIGIT, _LETTER, _LETTER, _APOSTROPHE, _ELSE
_KIND[0x80:0xC0], _KIND[0xC0:], _KIND[0xC3:0xCA] = _LETTER, _ELSE, _LETTER
#: Two bytes of that range that are no letters, or whose lower case isn't one: U+00D7, U+00F7, U+0130.
_NO_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))
#: Pairs of kinds, 8 * before + after, between which a match of the tokenizer's pattern always ends.
_CUT = np.zeros(64, bool)
for _a, _b in [(_DIGIT, k) for k in (_LETTER, _DIGIT, _OTHER, _APOSTROPHE)] + [(k, _DIGIT) for k in (_LETTER, _OTHER, _APOSTROPHE)] + [(_LETTER, _OTHER), (_LETTER, _APOSTROPHE), (_OTHER, _LETTER)]:
    _CUT[8 * _a + _b] = True
#: Pieces that a worker remembers, about, and that the library encodes at once.
KNOWN, TOGETHER = 1_000_000, 4096


class Coder:
    """Ids of whole texts by a tokenizer of words: runs of letters, single digits, and runs of others, but for contractions.

    Its matches never hold white space, so texts are cut there, and plain words also where a match always ends. Each
    distinct piece is encoded once while it is remembered; runs of letters are encoded as one text of many words, as each of them ends
    with the one token that ends a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()
        words = self.tokenizer.get_vocab()
        self.last = np.zeros(max(words.values()) + 1, bool)
        self.last[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, counts, ids): parts of texts in order; a long text is spread over several parts, ids end to end."""
        at, end = int(offsets[0]), int(offsets[-1])
        while at < end:
            stop = min(at + PART, end)
            while stop < end and _KIND[data[stop - 1]]:  # on to the end of a word
                step = min(PART, end - stop)
                space = np.flatnonzero(_KIND[data[stop : stop + step]] == _SPACE)
                stop += int(space[0]) + 1 if len(space) else step
            yield self._part(offsets, data, at, stop)
            at = stop

    def _part(self, offsets: np.ndarray, data: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        here = data[at:stop]
        kind = _KIND[here]
        for a, b in _NO_LETTERS:
            kind[:-1][(here[:-1] == a) & (here[1:] == b)] = _ELSE
        text = kind != _SPACE
        begin = np.ones(len(kind), bool)  # words, and white space between them: as pieces of their own, few differ
        begin[1:] = text[1:] != text[:-1]
        begin[offsets[(offsets > at) & (offsets < stop)] - at] = True
        start = np.flatnonzero(begin)
        finer = np.flatnonzero(_CUT[8 * kind[:-1] + kind[1:]]) + 1
        plain = ~np.logical_or.reduceat(kind == _ELSE, start)
        finer = finer[plain[np.searchsorted(start, finer, side="right") - 1] & ~begin[finer]]
        letters = np.concatenate([plain, np.ones(len(finer), bool)])
        start = np.concatenate([start, finer])
        order = np.argsort(start, kind="stable")
        start, letters = start[order], letters[order]
        letters &= kind[start] == _LETTER
        start += at
        row = np.searchsorted(offsets, start, side="right") - 1
        first = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
        bounds = np.append(start, stop).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        which = pieces.indices.to_numpy()
        words = np.zeros(len(pieces.dictionary), bool)
        words[which] = letters
        place = self._places(pieces.dictionary.to_pylist(), words)[which]
        n = self.size[place]
        done = np.cumsum(n)
        ids = self.flat[np.arange(int(done[-1])) + np.repeat(self.where[place] - (done - n), n)]
        return row[first], np.add.reduceat(n, first), ids

    def _forget(self) -> None:
        """Begin anew with no known piece: a place for each, and the number and first place of its ids in flat."""
        self.known: dict[bytes, int] = {}
        self.size, self.where, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _places(self, pieces: list[bytes], words: np.ndarray) -> np.ndarray:
        """The place of each piece among those known; new ones are encoded. Words are runs of letters."""
        if len(self.known) > KNOWN:
            self._forget()
        places = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(places < 0)
        size, flat, order = [self.size], [self.flat], []
        for together, some in ((True, new[words[new]]), (False, new[~words[new]])):
            for lo in range(0, len(some), TOGETHER):
                own = some[lo : lo + TOGETHER].tolist()
                order += own
                if together:
                    text = b" ".join([pieces[k] for k in own]).decode()
                    ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
                    n = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
                    if len(n) != len(own):
                        raise ValueError("a run of letters is not one word of this tokenizer")
                else:
                    each = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k].decode() for k in own], add_special_tokens=False)]
                    n = np.array([len(e) for e in each], np.int64)
                    ids = np.fromiter((i for e in each for i in e), np.int32, int(n.sum()))
                size.append(n)
                flat.append(ids)
        places[order] = len(self.size) + np.arange(len(order))
        self.known.update((pieces[k], len(self.size) + i) for i, k in enumerate(order))
        self.size, self.flat = np.concatenate(size), np.concatenate(flat)
        self.where = np.cumsum(self.size) - self.size
        return places


_coders: dict[str, Coder] = {}


def _coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segments: int | None = None, compression: str = "zstd") -> None:
    """Encode documents, each followed by the end id, and write them in ascending order of ids, a file for each segment."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, segment, row, place = _coder(tokenizer), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], np.int32)
        for b in W.slices(batches):
            offsets, data = W.raw(b.column(1))
            doc_ids, m = b.column(0), b.num_rows
            closed, part = 0, 0  # documents of the batch that have their end; rows of the one that is open

            def rows_of(counts: np.ndarray, ids: np.ndarray, first_doc: int, part: int) -> tuple[pa.RecordBatch, int]:
                """Rows of documents first_doc, first_doc + 1, ... with these counts, and the number of rows of the last so far."""
                pieces = -(-counts // PIECE)
                doc = np.repeat(np.arange(len(counts)), pieces)
                of_doc = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                n = np.minimum(counts[doc] - of_doc * PIECE, PIECE)
                bounds = np.concatenate([[0], np.cumsum(n)])
                columns = [
                    pa.array(np.full(len(doc), segment, np.int32)),
                    pa.array(row + first_doc + doc),
                    doc_ids.take(pa.array(first_doc + doc)),
                    pa.array((of_doc + np.where(doc == 0, part, 0)).astype(np.int32)),
                    pa.array(place + bounds[:-1]),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                ]
                return pa.record_batch(columns, names=[c.split()[0] for c in COLUMNS.split(", ")]), int(pieces[-1]) + (part if len(counts) == 1 else 0)

            for rows, counts, ids in coder.encode(offsets, data):
                if not len(rows):
                    continue
                last = int(rows[-1])
                full = np.zeros(last - closed + 1, np.int64)
                full[rows - closed] = counts
                full[:-1] += 1  # ends of all but the last document, which may go on
                out = np.empty(len(ids) + last - closed, np.int32)
                stops = np.cumsum(full)[:-1] - 1
                own = np.ones(len(out), bool)
                own[stops] = False
                out[stops], out[own] = end_id, ids
                batch, part = rows_of(full, out, closed, part)
                yield batch
                place += len(out)
                closed = last
            if m > closed:  # the open document, and empty ones after it
                batch, _ = rows_of(np.ones(m - closed, np.int64), np.repeat(end, m - closed), closed, part)
                yield batch
                place += m - closed
            row += m

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("text")]
    ranged = keyed.repartitionByRange(segments, *order[:2]) if segments else keyed.repartitionByRange(*order[:2])
    options = {"compression": compression, "parquet.writer.version": "v2", "parquet.block.size": GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": PAGE_ROWS}
    options |= {f"parquet.enable.dictionary#{c}": "false" for c in DELTA}
    ranged.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, COLUMNS).write.options(**options).parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(segment, n_ids, base): ids of each file, and of all files before it; reads two columns of metadata."""
    sizes = spark.read.schema(COLUMNS).parquet(path).groupBy("segment").agg(F.sum("n").alias("n_ids"))  # a row for each file
    before = F.sum("n_ids").over(Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.withColumn("base", F.coalesce(before, F.lit(0)).cast("long"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None, span: tuple[int, int] | None = None) -> DataFrame:
    """Rows (doc_id, part, start, n, ids), start being the piece's place in the corpus; of some documents, or of places span[0] to span[1] - 1.

    Pieces that overlap the span come whole. Both filters reach the files' indexes.
    """
    rows = spark.read.schema(COLUMNS).parquet(path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    parts = manifest(spark, path)
    if span is not None:
        lo, hi = span
        hit = parts.where((F.col("base") < hi) & (F.col("base") + F.col("n_ids") > lo))
        ends = hit.agg(F.min(F.struct("segment", "base")), F.max(F.struct("segment", "base"))).first()
        if ends[0] is None or lo >= hi:
            rows = rows.where("false")
        else:
            (a, base), (b, last) = ends
            rows = rows.where(F.col("segment").between(a, b) & ((F.col("segment") > a) | (F.col("first") > lo - base - PIECE)) & ((F.col("segment") < b) | (F.col("first") < hi - last)))
    found = rows.join(parts.select("segment", "base"), "segment").select("doc_id", "part", (F.col("base") + F.col("first")).alias("start"), "n", "ids")
    return found if span is None else found.where((F.col("start") < hi) & (F.col("start") + F.col("n") > lo))


def _matrix_times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def _zeros(polynomial: int = 0xEDB88320) -> list[list[int]]:
    """Operators that append 1, 2, 4, ... zero bytes to a checksum, for lengths up to 2^48."""
    bit = [polynomial, *(1 << k for k in range(31))]
    square = lambda m: [_matrix_times(m, row) for row in m]
    byte = square(square(square(bit)))
    out = [byte]
    for _ in range(47):
        out.append(square(out[-1]))
    return out


_ZEROS = _zeros()


def joined_crc(a: int, b: int, length: int) -> int:
    """The checksum of two byte strings end to end, from theirs and the second's length."""
    k = 0
    while length:
        if length & 1:
            a = _matrix_times(_ZEROS[k], a)
        length >>= 1
        k += 1
    return a ^ b


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian 32-bit integers).

    Tasks check their own pieces; checksums of a document that several tasks have read are joined, without its ids.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["segment", "row", "doc_id", "first", "n", "crc"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        open_: list | None = None
        for b in batches:
            out: list[list] = []
            offsets = b.column(5).offsets.to_numpy()
            raw = memoryview(b.column(5).values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            for r, (segment, row, doc_id, first, n) in enumerate(zip(*(b.column(c).to_pylist() for c in range(5)), strict=True)):
                own = raw[4 * offsets[r] : 4 * offsets[r + 1]]
                if open_ and open_[:2] == [segment, row] and open_[3] + open_[4] == first:
                    open_[4:] = open_[4] + n, zlib.crc32(own, open_[5])
                    continue
                if open_:
                    out.append(open_)
                open_ = [segment, row, doc_id, first, n, zlib.crc32(own)]
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if open_:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(open_, types, strict=True)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pieces in b.column(b.schema.get_field_index("pieces")).to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = joined_crc(crc, p["crc"], 4 * p["n"])
                out.append(crc)
            yield pa.record_batch([*(b.column(c) for c in range(3)), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = spark.read.schema(COLUMNS).parquet(path).select("segment", "row", "doc_id", "first", "n", "ids").mapInArrow(check, "segment int, row long, doc_id long, first long, n long, crc long")
    whole = pieces.groupBy("segment", "row", "doc_id").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("first", "n", "crc"))).alias("pieces"))  # one for each task that read it
    placed = whole.join(manifest(spark, path).select("segment", "base"), "segment")
    return placed.select("doc_id", (F.col("base") + F.col("pieces")[0]["first"]).alias("start"), "n_tokens", "pieces").mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long")
