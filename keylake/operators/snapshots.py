"""Snapshots: what is new, lost or unchanged, monthly fulls, spacing and trailing counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keylake.session import materialize


def snapshot_diff(hosts: DataFrame, key: str = "fprint", snap: str = "snap") -> DataFrame:
    """(snap, key, first_seen, new, same) for each key of each snapshot, and lost = true at the snapshot after its last.

    Distinct snapshots are few: they are numbered densely, and broadcast. A key's snapshots are gathered where they are
    read and shuffled once, by key. Null is a key; rows with null snap are left out. Repeated rows count once.
    """
    hosts = hosts.where(F.col(snap).isNotNull())
    numbers = materialize(hosts.select(snap).distinct().withColumn("ix", F.row_number().over(Window.orderBy(snap))), "snapshots")
    last = numbers.agg(F.max("ix").alias("last"))
    seen = hosts.join(F.broadcast(numbers), snap).groupBy(key).agg(F.array_sort(F.collect_set("ix")).alias("at"))  # one number for each snapshot
    rows = seen.crossJoin(F.broadcast(last)).select(key, "at", "last", F.posexplode("at").alias("pos", "ix"))
    before = F.when(F.col("pos") > 0, F.col("at")[F.col("pos") - 1])
    after = F.try_element_at("at", F.col("pos") + 2)
    is_new, no = before.isNull() | (before != F.col("ix") - 1), F.lit(False)
    here = F.struct(F.col("ix").alias("ix"), before.isNull().alias("first_seen"), is_new.alias("new"), (~is_new).alias("same"), no.alias("lost"))
    gone = F.when((after.isNull() | (after != F.col("ix") + 1)) & (F.col("ix") < F.col("last")), F.struct((F.col("ix") + 1).alias("ix"), no.alias("first_seen"), no.alias("new"), no.alias("same"), F.lit(True).alias("lost")))
    found = rows.select(key, F.inline(F.array_compact(F.array(here, gone))))
    return found.join(F.broadcast(numbers), "ix").select(snap, key, "first_seen", "new", "same", "lost")


def month_full(hosts: DataFrame, archive: DataFrame, key: str = "fprint") -> DataFrame:
    """For each month, the keys of its last snapshot that the archive had first seen by then: (month, snap, key, n_hosts)."""
    month = F.date_trunc("month", F.col("snap"))
    last = hosts.select(month.alias("month"), "snap").distinct().groupBy("month").agg(F.max("snap").alias("snap"))
    final = hosts.join(F.broadcast(last), "snap")  # one row for each month
    counted = final.groupBy("month", "snap", key).agg(F.countDistinct("ip").alias("n_hosts"))
    return counted.join(archive.select(key, "first_seen"), key).where("first_seen <= snap").select("month", "snap", key, "n_hosts")


def trailing_counts(events: DataFrame, spans: list[int], key: str, epoch: str = "epoch") -> DataFrame:
    """Rows with n_<span>: events of the key in the last so many seconds, the row's own included.

    A key's time is cut into slots as long as the longest span; a row also counts, without its other columns, in the slot
    after its own, so that a key with many rows is spread over its slots.
    """
    slot = F.floor(F.col(epoch) / max(spans))
    rest = [c for c in events.columns if c not in (key, epoch)]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("__any"))
    places = F.array(F.struct(slot.alias("slot"), row.alias("row")), F.struct((slot + 1).alias("slot"), F.when(F.lit(False), row).alias("row")))
    placed = events.select(key, epoch, F.inline(places))
    for s in spans:
        w = Window.partitionBy(key, "slot").orderBy(epoch).rangeBetween(-s, 0)
        placed = placed.withColumn(f"n_{s}", F.count("*").over(w))
    return placed.where("row is not null").select(key, epoch, *[F.col(f"row.{c}").alias(c) for c in rest], *[f"n_{s}" for s in spans])


def month_merge(hosts: DataFrame, archive: DataFrame, key: str = "fprint") -> DataFrame:
    """(month, key, ips): all of a month's archived keys, with the hosts of the month's last snapshot; none gives [].

    archive has (snap, key). Keys that the last snapshot lacks stay.
    """
    final, keys = month_rows(hosts, archive, key)
    ips = final.groupBy("month", key).agg(F.array_sort(F.collect_set("ip")).alias("ips"))
    return keys.join(ips, ["month", key], "left").withColumn("ips", F.coalesce("ips", F.array().cast(ips.schema["ips"].dataType)))


def month_rows(hosts: DataFrame, archive: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Hosts of each month's last snapshot, with month, and the (month, key) of the archive."""
    month = F.date_trunc("month", F.col("snap")).alias("month")
    last = hosts.select(month, "snap").distinct().groupBy("month").agg(F.max("snap").alias("snap"))
    return hosts.join(F.broadcast(last), "snap"), archive.select(month, key).distinct()  # last has one row for each month


def seq_id(df: DataFrame, *order: str, start: int = 0) -> DataFrame:
    """df with id: the row's place in an order over all rows.

    Rows are split into ranges of the order; each range counts its own, and the ranges' sizes, one number for each
    partition, give where it starts. No single task sees all rows.
    """
    parts = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__p", before.alias("__start"))
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return parts.join(F.broadcast(starts), "__p").select(*df.columns, (F.col("__start") + place - 1 + start).alias("id"))  # one row for each partition


#: Rows of a range whose rows one task numbers, about.
RANGE = 500_000


def place_within(df: DataFrame, group: str | list[str], *order: str, start: int = 0) -> DataFrame:
    """df with place: the row's place in its group, null being a group, so that no task has a whole group.

    Rows are split into ranges of (group, order), and each range numbers its rows of each group. Only the group that begins a
    range can have rows in those before: how many is broadcast, one row at most for each range. There are as many ranges as
    rows ask for, and a number that is given keeps Spark from joining small ones, so that a task's rows don't grow with df.
    """
    groups = [group] if isinstance(group, str) else group
    key = F.struct(*groups).alias("__g")
    n = df.sparkSession.sparkContext.defaultParallelism + df.count() // RANGE
    parts = materialize(df.repartitionByRange(n, *groups, *order).sortWithinPartitions(*groups, *order).withColumn("__p", F.spark_partition_id()), "ranges")
    begins = parts.groupBy("__p").agg(F.min(key).alias("__g")).select("__g").distinct()
    sizes = parts.groupBy("__p", key).agg(F.count("*").alias("__n")).join(F.broadcast(begins), "__g")
    before = F.sum("__n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    carried = sizes.select("__p", "__g", before.alias("__before")).where("__before is not null")
    place = F.row_number().over(Window.partitionBy("__p", *groups).orderBy(*order))
    numbered = parts.repartition(n, "__p").select("*", key, place.alias("__place")).join(F.broadcast(carried), ["__p", "__g"], "left")
    return numbered.select(*df.columns, (F.coalesce("__before", F.lit(0)) + F.col("__place") - 1 + start).alias("place"))


def cap_entities(df: DataFrame, order: str, capped: Column, n: int) -> DataFrame:
    """Rows in order up to and with the n-th capped one, and no further.

    The n-th capped row is found by a top-n, so that no task sorts all rows; ties in order stay together.
    """
    nth = df.where(capped).select(order).orderBy(order).limit(n).agg(F.when(F.count("*") == n, F.max(order)).alias("__last"))
    return df.crossJoin(F.broadcast(nth)).where(F.col("__last").isNull() | (F.col(order) <= F.col("__last"))).drop("__last")  # nth is one row


def order_by_bigint(df: DataFrame, digits: str, *ties: str) -> DataFrame:
    """df with id: the row's place, from 0, by a canonical hex integer, then by ties; nulls come last."""
    keyed = df.withColumns({"__none": F.col(digits).isNull(), "__size": F.length(digits)})
    return seq_id(keyed, "__none", "__size", digits, *ties).drop("__none", "__size")


def next_page(df: DataFrame, id_col: str, since, size: int) -> DataFrame:
    """The next rows after an id, in order: a top-n, not a sort of all. Null ids are on no page."""
    return df.where(F.col(id_col) > since).orderBy(id_col).limit(size)
