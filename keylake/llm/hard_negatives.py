"""Hard negatives by a vertical scan: dimensions are read one at a time, and candidates that can't matter any more go.

A shard of the rows keeps its dimensions as columns, rows with more components first, so that a column is as long as its
dimension has cells. An anchor reads the columns in the order of its own falling magnitudes. What the columns left can
add lies between the sums of their least and largest contributions, so each row left in the anchor's bitmap has a lower
and an upper bound of its score:
- the search for positives drops rows whose upper bound is below the k-th best lower bound;
- the search for negatives has a window of scores for each positive. It drops rows whose bounds lie outside every window,
  and rows of a window in which k others are surely inside and surely better.
Few rows are left to score exactly, after which the windows are resolved. Both searches run over all shards, the second
once the positives of all shards have been ranked.

Defined results: rows with null id or label, or a vector that is null or holds null or non-finite components, take no
part; a shorter vector counts as padded with zeros. Repeated ids are rows of their own, anchors too, but no row with the
anchor's own id is its positive or negative. Ties go to the smaller id. Scores beyond 64 bits stop at the ends of the
range, and are ties there. A window of a negative positive score is empty. Empty tables, tables without anchors, and
anchors without another row of their label give no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylake.llm import vectors as V
from keylake.session import materialize

#: Columns that are read between two prunings, and rows that are few enough to score at once.
STEP, FEW = 8, 32


class Columns:
    """A shard's vectors by dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: V.Ragged):
        order = np.argsort(-rows.widths, kind="stable")
        self.ids, self.labels, self.rows = ids[order], labels[order], rows.take(order)
        row, dimension = self.rows.cells()
        del row
        count = np.bincount(dimension)
        self.start = np.concatenate([[0], np.cumsum(count)])
        self.cell = self.rows.value[np.argsort(dimension, kind="stable")]
        full = count == len(ids)
        least, most = (f.reduceat(self.cell, self.start[:-1]) if len(count) else np.zeros(0) for f in (np.minimum, np.maximum))
        self.least, self.most = np.where(full, least, np.minimum(least, 0)), np.where(full, most, np.maximum(most, 0))
        largest = np.zeros(len(ids))
        some = self.rows.widths > 0
        if some.any():
            largest[some] = np.maximum.reduceat(np.abs(self.rows.value), self.rows.start[:-1][some])
        #: sums of products of components below this are exact in doubles; rows beyond it are always scored as whole numbers
        self.limit = np.sqrt(2.0**53 / max(1, len(count)))
        self.wild = largest >= self.limit
        self.read = 0  # cells that scans have read

    def scan(self, query: np.ndarray, wanted: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Rows of the bitmap that keep(lower bounds, upper bounds) left after some columns."""
        rows = np.flatnonzero(wanted & ~self.wild)
        always = np.flatnonzero(wanted & self.wild)
        if np.abs(query).max(initial=0) >= self.limit:
            return np.flatnonzero(wanted)
        width = min(len(query), len(self.start) - 1)
        order = np.argsort(-np.abs(query[:width]), kind="stable")
        order = order[query[order] != 0]
        ends = np.sort(np.stack([query[order] * np.clip(x[order], -self.limit, self.limit) for x in (self.least, self.most)]), axis=0)
        rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1))], axis=1)
        partial = np.zeros(len(rows))
        for lo in range(0, len(order), STEP):
            if len(rows) <= FEW:
                break
            for j in order[lo : lo + STEP].tolist():
                a, b = self.start[j], self.start[j + 1]
                there = np.searchsorted(rows, b - a)  # rows in order have this dimension up to here
                partial[:there] += query[j] * self.cell[a + rows[:there]]
                self.read += int(there)
            at = min(lo + STEP, len(order))
            left = keep(partial + rest[0, at], partial + rest[1, at])
            rows, partial = rows[left], partial[left]
        return np.sort(np.concatenate([rows, always]))

    def best(self, query: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best k rows of a label, without the anchor's own id."""

        def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            return upper >= np.partition(lower, -k)[-k] if len(lower) > k else np.ones(len(lower), bool)

        found = self.scan(query, (self.labels == label) & (self.ids != own), keep)
        scores = V.exact_scores(self.rows.take(found), query)
        first = V.by_score(self.ids[found], scores)[:k]
        return self.ids[found][first], scores[first]

    def between(self, query: np.ndarray, own: int, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores, ends included: (ids, scores) of the best k rows of other labels in it."""
        open_ = sorted({w for w in windows if w[0] <= w[1]})
        if not open_:
            return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)

        def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            left = np.zeros(len(lower), bool)
            for low, high in open_:
                inside = (upper >= low) & (lower <= high)
                sure = lower[(lower >= low) & (upper <= high)]
                if len(sure) >= k:
                    inside &= upper >= np.partition(sure, -k)[-k]
                left |= inside
            return left

        found = self.scan(query, (self.labels != label) & (self.ids != own), keep)
        scores = V.exact_scores(self.rows.take(found), query)
        order = V.by_score(self.ids[found], scores)
        ids, scores = self.ids[found][order], scores[order]
        out = []
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))[:k]
            out.append((ids[inside], scores[inside]))
        return out


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores n with low * score <= 100 * n <= high * score, within 64 bits."""
    return max(-(2**63), -((-low * score) // 100)), min(2**63 - 1, (high * score) // 100)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cells: int = V.CELLS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are rows whose id is divisible by `every`; a positive is one of the best other rows of the anchor's label; its
    negatives are the best rows of other labels whose scores are `low` to `high` per cent of the positive's.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & V.sound(vector_col))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), V.floored(vector_col, scale).alias("v"))
    rows = materialize(rows, "vectors").withColumn("row", F.monotonically_increasing_id())  # numbered as written
    anchor = F.col("id") % every == 0
    n, n_anchors, n_cells = rows.agg(F.count("*"), F.count_if(anchor), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    shards = V.shard_count(spark, n, n_cells, cells)
    found = "place int, positive_id long, positive_score long"
    windows = f"array<struct<{found}>>"
    candidates = rows.select(V.shard_of(shards, "id", "row").alias("shard"), F.lit(0).alias("kind"), "row", "id", "label", "v", F.lit(None).cast(windows).alias("windows"))
    anchors = rows.where(anchor)

    def shard_rows(asked: DataFrame) -> DataFrame:
        each = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "row", "id", "label", "v", "windows")
        return candidates.unionByName(each).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Columns, int, int, int, np.ndarray, list]]:
        here, held, index = -1, [], None
        for number, kind, b in V.runs(batches):
            if number != here:
                here, held, index = number, [], None
            if kind == 0:
                held.append(b)
                continue
            if index is None and held:
                index = Columns(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in (3, 4)), V.Ragged.of([x.column(5) for x in held]))
                held = []
            if index is not None:
                asked = V.Ragged.of([b.column(5)])
                for r, (row, own, label, places) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 6)), strict=True)):
                    yield index, row, own, label, asked.value[asked.start[r] : asked.start[r + 1]], places or []

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index, row, own, label, query, _ in searched(batches):
            ids, scores = index.best(query, own, label, positives)
            yield pa.record_batch([pa.array([row] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)], ["row", "positive_id", "positive_score"])

    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    near = shard_rows(anchors.withColumn("windows", F.lit(None).cast(windows))).mapInArrow(nearest, "row long, positive_id long, positive_score long")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    near = near.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("windows"))  # `positives` at most
    asked = materialize(anchors.join(near, "row"), "anchors")

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index, row, own, label, query, places in searched(batches):
            found = index.between(query, own, label, [window(p["positive_score"], low, high) for p in places], negatives)
            count = [len(ids) for ids, _ in found]
            each = [np.repeat(np.array([p[c] for p in places], np.int64), count) for c in ("place", "positive_id", "positive_score")]
            ids, scores = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            yield pa.record_batch([pa.array([row] * len(ids), pa.int64()), pa.array([own] * len(ids), pa.int64()), *map(pa.array, each), pa.array(ids), pa.array(scores)], ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    hard = shard_rows(asked).mapInArrow(mined, "row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    return hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def moved_labels(vectors: DataFrame) -> DataFrame:
    """vectors with the label of every seventh id moved on by one, modulo ten: rows of one group under another label."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def oracle() -> str:
    """The same rows in DuckDB SQL; vectors of one length and distinct ids."""
    return """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.id % 100 = 0 AND a.id <> c.id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND p.place <= 5
                   AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
