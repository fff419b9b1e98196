"""Least spacing of times in a group, without a group in one task.

Each kept time depends on the one before. A group's time is cut into chunks; a chunk's distinct times are bounded by its
length. Inside a chunk every time's next one is found by a search, and following these leads from a time to where its
chain leaves the chunk. Chains enter a chunk only among its first times, so the chunk comes down to few links from entry
to entry. An as-of join finds where a chain that left one chunk enters a later one, pointer doubling finds the entries
that the chain from a group's first time meets, in as many rounds as the logarithm of its chunks, and from these each
chunk's kept times follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keylake.session import materialize

#: A chunk is so many spacings long, and so many seconds, at least.
SPACINGS, SECONDS = 16, 100_000


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole chunks of rows sorted by (key, chunk, t), and where chunks begin.

    Batches of a chunk that goes on are put aside as they are, and joined once it ends.
    """
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        own = _starts(pa.Table.from_batches([b]))
        same = held and all(held[-1][c][-1].as_py() == b[c][0].as_py() for c in ("key", "chunk"))
        last = int(own[-1])
        if held and (last or not same):  # a chunk ends in this batch, or with the one before
            t = pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks()
            yield t, _starts(t)
            held = [b.slice(last)]
        elif last:
            yield pa.Table.from_batches([b.slice(0, last)]), own[:-1]
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _starts(t)


def _starts(t: pa.Table) -> np.ndarray:
    key = t["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    chunk = t["chunk"].to_numpy()
    return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1])


class _Chunks:
    """Places of the rows of whole chunks: the next time that may be kept, or the chunk's end."""

    def __init__(self, t: pa.Table, starts: np.ndarray, length: int, seconds: int):
        self.time = t["t"].to_numpy()
        size = np.diff(np.append(starts, len(t)))
        self.ends = np.repeat(starts + size, size)
        self.offset = self.time - t["chunk"].to_numpy() * length  # from the chunk's beginning
        place = np.repeat(np.arange(len(starts)), size) * (length + seconds) + self.offset  # rises over all rows
        self.next = np.searchsorted(place, place + seconds)
        #: entries: the first times of a chunk, up to the spacing, and the one after
        early = self.offset < seconds
        self.entry = early.copy()
        self.entry[starts] = True
        self.entry[1:] |= early[:-1]
        self.entry[starts] = True

    def last(self) -> np.ndarray:
        """The last place of each row's chain inside its chunk."""
        own = np.arange(len(self.next))
        out = np.where(self.next < self.ends, self.next, own)
        while True:
            further = out[out]
            if (further == out).all():
                return out
            out = further


def _links(rows: DataFrame, length: int, seconds: int) -> DataFrame:
    """(key, chunk, t, free): for each entry of a chunk, the first time that its chain leaves free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_chunks(batches):
            c = _Chunks(t, starts, length, seconds)
            at = np.flatnonzero(c.entry)
            out = t.select(["key", "chunk", "t"]).take(pa.array(at)).append_column("free", pa.array(c.time[c.last()[at]] + seconds))
            yield from out.combine_chunks().to_batches()

    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "t").mapInArrow(run, "key string, chunk long, t long, free long")


def _targets(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, chunk, free, target): the group's first time that is not before `free`; no row where there is none.

    It is less than a spacing beyond the chunk's end. So it is an entry of the next chunk, or the first time of a later one.
    """
    asked = entries.select("key", "chunk", "free").distinct().join(chunks.select("key", "chunk", "next_chunk", "next_first"), ["key", "chunk"]).where("next_chunk is not null")
    far = asked.where("next_chunk > chunk + 1").select("key", "chunk", "free", F.col("next_first").alias("target"))
    near = asked.where("next_chunk = chunk + 1")
    both = entries.select("key", "chunk", F.col("t").alias("at"), F.col("t").alias("found")).unionByName(near.select("key", F.col("next_chunk").alias("chunk"), F.col("free").alias("at"), F.lit(None).cast("long").alias("found")))
    # from the last time to the first, as a frame that grows takes each row once, and one that shrinks all that are left
    ahead = Window.partitionBy("key", "chunk").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("target", F.min("found").over(ahead)).where("found is null").select("key", "chunk", F.col("at").alias("free"), "target")
    met = met.join(chunks.select("key", "chunk", "next_first"), ["key", "chunk"]).select("key", (F.col("chunk") - 1).alias("chunk"), "free", F.coalesce("target", "next_first").alias("target"))
    return far.unionByName(met).where("target is not null")


def _reached(firsts: DataFrame, links: DataFrame) -> DataFrame:
    """(key, t): entries on the way from each key's first time, along links (key, t, target), by pointer doubling."""
    reached, jump = firsts, materialize(links, "jumps")
    while not jump.isEmpty():
        step = reached.join(jump, ["key", "t"]).select("key", F.col("target").alias("t"))
        reached = materialize(reached.unionByName(step), "reached")
        jump = materialize(jump.join(jump.select("key", F.col("t").alias("target"), F.col("target").alias("then")), ["key", "target"]).select("key", "t", F.col("then").alias("target")), "jumps")
    return reached


def _kept(rows: DataFrame, length: int, seconds: int) -> DataFrame:
    """(key, t) of rows (key, chunk, t, entry): the chain from the chunk's entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_chunks(batches):
            c = _Chunks(t, starts, length, seconds)
            at = np.flatnonzero(c.time == t["entry"].to_numpy())
            keep = np.zeros(len(t), bool)
            while len(at):
                keep[at] = True
                after = c.next[at]
                at = after[after < c.ends[at]]
            yield from t.select(["key", "t"]).filter(pa.array(keep)).combine_chunks().to_batches()

    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "t").mapInArrow(run, "key string, t long")


def min_spacing(times: DataFrame, seconds: int, group: str, ts: str = "epoch", length: int | None = None) -> DataFrame:
    """Times of each group at least so many seconds after the last kept one, whole seconds; (group, ts).

    Repeated times count once, null times not; null is a group. The first time of each group is kept. A task has whole
    chunks, of `length` seconds: one group's chunks are spread over all tasks.
    """
    if seconds <= 0:
        return times.select(group, F.col(ts).cast("long").alias(ts)).where(F.col(ts).isNotNull()).distinct()
    length = max(length or max(SPACINGS * seconds, SECONDS), seconds)
    kind = times.schema[group].dataType
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("-"))
    rows = times.select(key.alias("key"), F.col(ts).cast("long").alias("t")).where("t is not null").distinct()
    rows = materialize(rows.withColumn("chunk", F.floor(F.col("t") / F.lit(length))), "times")
    chunks = rows.groupBy("key", "chunk").agg(F.min("t").alias("first"))
    order = Window.partitionBy("key").orderBy("chunk")  # one row for each chunk: a group's span of time over `length`
    chunks = materialize(chunks.withColumns({"next_chunk": F.lead("chunk").over(order), "next_first": F.lead("first").over(order)}), "chunks")
    entries = materialize(_links(rows, length, seconds), "entries")
    links = entries.join(_targets(entries, chunks), ["key", "chunk", "free"]).select("key", "t", "target")
    reached = _reached(chunks.groupBy("key").agg(F.min("first").alias("t")), links)
    entered = reached.select("key", F.floor(F.col("t") / F.lit(length)).alias("chunk"), F.col("t").alias("entry"))
    kept = _kept(rows.join(entered, ["key", "chunk"]), length, seconds)
    return kept.select(F.when(F.col("key") != "-", F.substring("key", 2, 1 << 30)).cast(kind).alias(group), F.col("t").alias(ts))
