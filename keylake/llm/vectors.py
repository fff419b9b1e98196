"""Integer vectors of any widths: sound rows, rows without padding, and shards that are bounded by cells."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a shard, about; a row counts as its components and ROW more.
CELLS, ROW = 1 << 21, 8
#: A shard has no fewer rows than this for the sake of more tasks.
SMALL = 1024


def sound(vector: str) -> Column:
    """Is the vector not null, without null or non-finite components?"""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def floored(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component as a double; beyond 2^53 doubles are whole already."""

    def one(x: Column) -> Column:
        y = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def shard_count(spark, rows: int, cells: int, size: int = CELLS) -> int:
    """Shards of about `size` cells at most; more while cores are idle and shards not small."""
    return max(1, -(-(cells + ROW * rows) // size), min(spark.sparkContext.defaultParallelism, -(-rows // SMALL)))


def shard_of(shards: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(shards)).cast("int")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(shard, kind, rows): parts of batches of one shard and kind, the first two columns, in order."""
    for b in batches:
        key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield *divmod(int(key[lo]), 2), b.slice(lo, hi - lo)


@dataclass
class Ragged:
    """Rows of different widths, end to end; a missing component is 0."""

    start: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, columns: list[pa.ListArray]) -> Ragged:
        width = np.concatenate([np.diff(c.offsets.to_numpy()) for c in columns]).astype(np.int64)
        value = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in columns]).astype(np.float64, copy=False)
        return cls(np.concatenate([[0], np.cumsum(width)]), value)

    def __len__(self) -> int:
        return len(self.start) - 1

    @property
    def widths(self) -> np.ndarray:
        return np.diff(self.start)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, dimension) of each value."""
        width = self.widths
        row = np.repeat(np.arange(len(width), dtype=np.int32), width)
        return row, (np.arange(len(self.value)) - np.repeat(self.start[:-1], width)).astype(np.int32)

    def take(self, rows: np.ndarray) -> Ragged:
        width = self.widths[rows]
        start = np.concatenate([[0], np.cumsum(width)])
        return Ragged(start, self.value[np.arange(start[-1]) + np.repeat(self.start[rows] - start[:-1], width)])

    def dense(self, width: int) -> np.ndarray:
        """Rows padded or cut to a width; for few rows."""
        out = np.zeros((len(self), width))
        row, dimension = self.cells()
        there = dimension < width
        out[row[there], dimension[there]] = self.value[there]
        return out


#: Padded cells that are held at once when rows are scored exactly.
AT_ONCE = 1 << 20


def exact_scores(vectors: Ragged, query: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits they stop at the ends of the range."""
    step = max(1, AT_ONCE // max(1, len(query)))
    out = [np.zeros(0, np.int64)]
    for lo in range(0, len(vectors), step):
        v = vectors.take(np.arange(lo, min(lo + step, len(vectors)))).dense(len(query))
        if np.abs(v).max(initial=0) * np.abs(query).max(initial=0) * len(query) < 2**53:
            out.append((v @ query).astype(np.int64))
        else:
            q = [int(x) for x in query]
            out.append(np.array([max(-(2**63), min(2**63 - 1, sum(int(a) * b for a, b in zip(r, q, strict=True)))) for r in v], np.int64))
    return np.concatenate(out)


def by_score(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The order of falling scores, ties by rising ids; ~s falls as s rises and never overflows."""
    return np.lexsort((ids, ~scores))


def parallel(df: DataFrame, rows: int, least: int = 500) -> DataFrame:
    """df as it is if its tasks keep all cores busy; else dealt anew, for work that costs far more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    want = min(4 * cores, -(-rows // least))
    return df.repartition(want) if df.rdd.getNumPartitions() < min(cores, want) else df
