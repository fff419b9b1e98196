"""Exact top-k inner products, score at a time over an impact-ordered index.

Components become integers. For a query, a dimension's impact is the component's distance above the dimension's least
value where the query's weight is positive, and below its largest where it is negative, so every contribution is at
least 0. Each shard of the candidates keeps postings by quantised impact: a segment has the vectors and dimensions of one
impact level. Segments are added to the scores of a block of queries from the highest level down. After some levels the
scores are lower bounds, and the levels left bound what any candidate can still gain: once few candidates of the shard can
reach the k-th best lower bound, or no level is left, those are scored exactly. Nothing else ends a search, and where
doubles could round, the bounds give way by the most that they can be off.

Candidates are dealt to shards of bounded numbers of vectors and components, by id and row, and every query visits every shard. A task has one shard, by its number,
and builds its index once; the queries follow it as a stream, and are searched in blocks.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a shorter vector, an empty
one too, counts as padded with zeros. Repeated vec_ids are rows of their own, but no row with the query's own id is a
candidate. Ties go to the smaller vec_id. Rows with null id take no part. Scores beyond 64 bits stop at the ends of the
range. Empty tables, and tables without queries, give no rows. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylake.llm import vectors as V
from keylake.session import materialize

#: Candidates of a shard, and queries that are searched together, at most.
SHARD, BLOCK = 32_768, 256
LEVELS = 16
#: A search may end once so many times k candidates or fewer are possible.
FEW = 8
#: Products that are held at once.
CELLS = 1 << 17


class Shard:
    """Integer vectors of one shard with their impact-ordered postings; both hold the cells there are, without padding."""

    def __init__(self, ids: np.ndarray, vectors: V.Ragged | np.ndarray):
        if isinstance(vectors, np.ndarray):
            vectors = V.Ragged(np.arange(len(vectors) + 1) * vectors.shape[1], vectors.astype(np.float64).ravel())
        self.ids, self.vectors = ids, vectors
        row, dimension = vectors.cells()
        count = np.bincount(dimension)
        self.width = len(count)
        order, start = np.argsort(dimension, kind="stable"), np.cumsum(count) - count
        least, most = (f.reduceat(vectors.value[order], start) if self.width else np.zeros(0) for f in (np.minimum, np.maximum))
        del order
        # a vector that lacks a dimension has 0 there: such a dimension's impacts are distances from 0, and those below it
        # come in the first segment, so that after it nothing left can lower a score
        ragged = count < len(ids)
        self.base = np.concatenate([np.where(ragged, 0, least), np.where(ragged, 0, -most)])  # what a unit of weight scores without any impact
        self.reach = np.tile(np.maximum(np.abs(least), np.abs(most)), 2)
        self.top = np.concatenate([np.where(ragged, np.maximum(most, 0), most - least), np.where(ragged, np.maximum(-least, 0), most - least)])
        self.step = max(1.0, np.ceil((self.top.max(initial=0) + 1) / LEVELS))
        self.segments: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(LEVELS)]
        for shift, sign in ((0, 1.0), (self.width, -1.0)):
            impact = sign * vectors.value - self.base[dimension + shift]
            level = np.where(impact < 0, LEVELS - 1, impact // self.step).astype(np.int8)
            for k in range(LEVELS):
                cell = np.flatnonzero((level == k) & (impact != 0))
                self.segments[LEVELS - 1 - k].append((row[cell], dimension[cell] + np.int32(shift), impact[cell]))
        self.skipped = 0  # segments that searches did not need

    def _add(self, gained: np.ndarray, weight: np.ndarray, segment: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        """Add a part of a segment: products with the weights (dimensions x queries) to the scores (vectors x queries)."""
        step = max(1, CELLS // weight.shape[1])
        for lo in range(0, len(segment[0]), step):
            vector, dimension, value = (x[lo : lo + step] for x in segment)
            first = np.concatenate([[0], np.flatnonzero(vector[1:] != vector[:-1]) + 1])
            gained[vector[first]] += np.add.reduceat(weight[dimension] * value[:, None], first, axis=0)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of each query's best k of the shard, own ids left out."""
        queries = _fit(queries, self.width)
        weight = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1)
        gained = np.where(self.ids[:, None] == own[None, :], -np.inf, 0.0)
        most = weight @ (2 * self.reach)
        base = weight @ self.base
        slack = np.where(most < 2**52, 0.0, most * (weight.shape[1] + 8) * 2.0**-51)
        open_ = np.arange(len(queries))
        possible: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        for level, segment in zip(range(LEVELS - 1, -1, -1), self.segments, strict=True):
            for part in segment:
                self._add(gained, weight[open_].T, part)
            if level % 4 and level > 2:
                continue
            rest = weight[open_] @ np.minimum(self.top, level * self.step) + slack[open_]
            best = np.partition(gained, -k, axis=0)[-k] if len(self.ids) > k else np.full(len(open_), -np.inf)
            # scores beyond 64 bits are ties at the ends of the range
            best = np.where(best + base[open_] - slack[open_] <= -(2.0**63), -np.inf, np.minimum(best, 2.0**63 - base[open_]))
            reaching = (gained + rest >= best - slack[open_]) & (gained > -np.inf)
            done = (reaching.sum(axis=0) <= FEW * k) | (level == 0)
            for n in np.flatnonzero(done):
                possible[open_[n]] = np.flatnonzero(reaching[:, n])
            self.skipped += level * int(done.sum())
            open_, gained = open_[~done], np.ascontiguousarray(gained[:, ~done])
            if not len(open_):
                break
        for n, members in enumerate(possible):
            exact = V.exact_scores(self.vectors.take(members), queries[n])
            take = V.by_score(self.ids[members], exact)[:k]
            yield self.ids[members][take], exact[take]


def _fit(queries: np.ndarray, width: int) -> np.ndarray:
    """Queries cut or padded to a width; where a shard has no cells, nothing scores."""
    return np.pad(queries, [(0, 0), (0, max(0, width - queries.shape[1]))])[:, :width]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, cells: int = V.CELLS, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each vector whose id is divisible by `every`, the k best others.

    A shard has about `shard` vectors and `cells` components at most.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & V.sound(vector_col)).select(F.col(id_col).cast("long").alias("id"), V.floored(vector_col, scale).alias("v"))
    rows = materialize(rows, "vectors").withColumn("row", F.monotonically_increasing_id())  # numbered as written
    query = F.col("id") % every == 0
    n, n_queries, n_cells = rows.agg(F.count("*"), F.count_if(query), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    if not n or not n_queries:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).where("false")
    shards = max(-(-n // shard), V.shard_count(vectors.sparkSession, n, n_cells, cells))
    candidates = rows.select(V.shard_of(shards, "id", "row").alias("shard"), F.lit(0).alias("kind"), "row", "id", "v")
    queries = rows.where(query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "row", "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, index = -1, [], None
        for number, kind, b in V.runs(batches):
            if number != here:
                here, held, index = number, [], None
            if kind == 0:
                held.append(b)
                continue
            if index is None and held:
                index, held = Shard(np.concatenate([x.column(3).to_numpy() for x in held]), V.Ragged.of([x.column(4) for x in held])), []
            step = min(block, max(1, V.AT_ONCE // (2 * index.width + 1))) if index else 1
            for lo in range(0, b.num_rows if index else 0, step):
                part = b.slice(lo, step)
                own = part.column(3).to_numpy()
                ids, scores = zip(*index.search(V.Ragged.of([part.column(4)]).dense(index.width), own, k), strict=True)
                found = [len(x) for x in ids]
                yield pa.record_batch([pa.array(np.repeat(part.column(2).to_numpy(), found)), pa.array(np.repeat(own, found)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["row", "query_id", "vec_id", "score"])

    both = candidates.unionByName(queries).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 10, every: int = 100, scale: int = 1024) -> str:
    """The same rows in DuckDB SQL; vectors of one length."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""
