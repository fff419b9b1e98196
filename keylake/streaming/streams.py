"""Streaming forms: first-seen keys, windows and sessions, associations, snapshot differences, and running a stream over what is there."""

from __future__ import annotations

import json
import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from keylake.session import free_names, remove, shared_dir


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which holds more keys than memory does."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stream_first_seen(stream: DataFrame, key: str, ts: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key; state grows with the distinct keys.

    With ts and within, a key counts as seen for that long after its time, and state is bounded by the keys of that span;
    rows older than the watermark are dropped. So input that is replayed counts once, in the same run or a later one.
    """
    if within is None:
        return stream.dropDuplicates([key])
    (timed,) = free_names(stream, "timed")
    return stream.withColumn(timed, F.col(ts).cast("timestamp")).withWatermark(timed, within).dropDuplicatesWithinWatermark([key]).drop(timed)


def stream_trailing_counts(stream: DataFrame, ts: str, key: str, length: str = "5 minutes", slide: str | None = "1 minute", late: str = "10 minutes", gap: str | None = None) -> DataFrame:
    """(start, end, key, n) of windows; rows later than the watermark are dropped.

    Windows slide, or follow each other where slide is None. With a gap they are sessions: a key's rows, each less than the
    gap after the one before; a session ends a gap after its last row.
    """
    (timed,) = free_names(stream, "timed")
    rows = stream.withColumn(timed, F.col(ts).cast("timestamp")).withWatermark(timed, late)
    span = F.session_window(timed, gap) if gap else F.window(timed, length, slide)
    return rows.groupBy(span.alias("span"), key).agg(F.count("*").alias("n")).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), key, "n")


def dead_letter(df: DataFrame, max_fail: int, count_col: str = "fail_cnt") -> tuple[DataFrame, DataFrame]:
    """(to retry, failed for good); an unknown count is to retry."""
    failed = F.coalesce(F.col(count_col) > max_fail, F.lit(False))
    return df.where(~failed), df.where(failed)


def retry(df: DataFrame, failed: DataFrame, key: str, max_fail: int, sink: str, count_col: str = "fail_cnt") -> DataFrame:
    """Rows to try again after a round in which the keys of `failed` failed: these count one failure more, others are done.

    Rows beyond the cap are appended to the sink, a table of dead letters. Null keys, and unknown counts, are no failure
    before. Returned rows are to be materialised before the next round.
    """
    again = df.join(failed.select(key).distinct(), key, "left_semi").withColumn(count_col, F.coalesce(F.col(count_col), F.lit(0)) + 1)
    left, dead = dead_letter(again, max_fail, count_col)
    dead.write.mode("append").parquet(sink)
    return left


class _Associations(StatefulProcessor):
    """An owner's open items with the check that found them, and its last check."""

    def __init__(self, owner: T.StructField, item: T.StructField, check: T.StructField) -> None:
        self.owner, self.item, self.check = owner, item, check

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", T.StructType([self.item]), T.StructType([T.StructField("found_at", self.check.dataType)]))
        self.last = handle.getValueState("last", T.StructType([self.check]))

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        checks: dict = {}  # the owner's lists in this batch
        for part in rows:
            for item, check in zip(part[self.item.name].tolist(), part[self.check.name].tolist(), strict=True):
                here = checks.setdefault(check, set())
                if not pd.isna(item):
                    here.add(int(item) if isinstance(self.item.dataType, T.IntegralType) else item)
        last = self.last.get()[0] if self.last.exists() else None
        held = {k[0]: v[0] for k, v in self.open.iterator()}
        out = []
        for check in sorted(c for c in checks if last is None or c > last):
            for item in sorted(set(held) - checks[check]):
                out.append((item, held.pop(item), check))
                self.open.removeKey((item,))
            for item in sorted(checks[check] - set(held)):
                held[item] = check
                self.open.updateValue((item,), (check,))
                out.append((item, check, None))
            self.last.update((check,))
        if out:
            items, found, lost = zip(*out, strict=True)
            frame = pd.DataFrame({self.owner.name: [key[0]] * len(out), self.item.name: items, "found_at": found})
            frame["lost_at"] = pd.Series(lost, dtype="object")
            yield frame

    def close(self) -> None:
        pass


def stream_assoc(stream: DataFrame, owner: str, item: str, check: str, out: str, checkpoint: str) -> None:
    """Changes of association over a stream of (owner, item, check): (owner, item, found_at, lost_at) is appended to out.

    A micro-batch has the newest lists of some owners, one check of each, or several that are taken in order. An item that
    the newest list lacks is lost at that check; one that comes again opens a new row. A null item makes an empty list.
    Each owner has a state of its own, its open items, so a batch costs what its owners hold, not the whole history; a
    change is written once, when an item is found, and once more with lost_at. A check no later than the owner's last one
    is replayed input and changes nothing. Rows with null owner or check are left out. An owner's list of one batch is held
    by one task. assoc_table() gives the history.
    """
    rows = stream.select(owner, item, check).where(F.col(owner).isNotNull() & F.col(check).isNotNull())
    fields = [T.StructField(f.name, f.dataType) for f in (rows.schema[c] for c in (owner, item, check))]
    schema = T.StructType([*fields[:2], *(T.StructField(n, fields[2].dataType) for n in ("found_at", "lost_at"))])
    changes = rows.groupBy(owner).transformWithStateInPandas(_Associations(*fields), schema, "Append", "none")
    with rocks_state(stream.sparkSession):
        query = changes.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
    query.awaitTermination()


def assoc_table(spark: SparkSession, out: str, owner: str, item: str) -> DataFrame:
    """(owner, item, found_at, lost_at) of all runs in the changes that stream_assoc() has written."""
    return spark.read.parquet(out).groupBy(owner, item, "found_at").agg(F.max("lost_at").alias("lost_at"))


def run_available(stream: DataFrame, checkpoint: str, out: str, mode: str = "append") -> None:
    """Run a stream over all input that is there and stop; run again, it goes on where it stopped.

    Append writes to the exactly-once file sink. Complete replaces the table at out with each batch's whole result.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").start(out)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()


def once(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """The whole result of a stream over the input that is there, kept in the shared folder."""
    base = f"{shared_dir(spark)}/keylake-stream-{uuid.uuid4().hex}"
    run_available(stream, f"{base}/checkpoint", f"{base}/out", mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_snapshot_diff(stream: DataFrame, key: str, state: str, out: str, checkpoint: str) -> None:
    """(key, change, batch) for each micro-batch taken as a snapshot: new or lost against the one before it.

    Each batch's keys are written under its number, and its changes too, so that a repeated batch writes the same again.
    Keys of batches before the last are removed once they are not needed any more.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{state}/{number}")
        now = spark.read.parquet(f"{state}/{number}")
        before = spark.read.schema(now.schema).parquet(f"{state}/{number - 1}") if number else now.where("false")
        new, lost = now.join(before, key, "left_anti"), before.join(now, key, "left_anti")
        changes = new.withColumn("change", F.lit("new")).unionByName(lost.withColumn("change", F.lit("lost")))
        changes.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number > 1:  # a repeated batch reads the one before it, no earlier one
            remove(spark, f"{state}/{number - 2}")

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start().awaitTermination()


class ProgressLog(StreamingQueryListener):
    """Keeps (batch, rows, rows a second) of the queries' progress; the last `keep` of them."""

    def __init__(self, keep: int = 10_000) -> None:
        self.ended = 0
        self.rows: deque[tuple[int, int, float]] = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.rows.append((p["batchId"], p["numInputRows"], p.get("processedRowsPerSecond", 0.0)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
