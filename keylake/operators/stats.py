"""Histograms, rates, series, funnels and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keylake.operators.relations import PART, lists_in_parts, ordered_in_parts

def keys_per_entity(df: DataFrame, entity: str) -> DataFrame:
    """(n_keys, n_entities, ratio) over entities."""
    sizes = df.groupBy(entity).agg(F.count("*").alias("n_keys")).groupBy("n_keys").agg(F.count("*").alias("n_entities"))
    total = sizes.agg(F.sum("n_entities").alias("__total"))
    return sizes.crossJoin(F.broadcast(total)).select("n_keys", "n_entities", (F.col("n_entities") / F.col("__total")).alias("ratio"))  # total is one row


def rate_matrix(df: DataFrame, dims: list[str], flag: Column) -> DataFrame:
    """Cells and margins: total, flagged and percent (-1 if empty)."""
    out = df.cube(*dims).agg(F.count("*").alias("total"), F.count_if(flag).alias("flagged"))
    return out.withColumn("percent", F.when(F.col("total") > 0, 100.0 * F.col("flagged") / F.col("total")).otherwise(-1.0))


def zero_filled(df: DataFrame, value: Column, grid: DataFrame, flag: Column) -> DataFrame:
    """(slot, total, flagged) for every slot of a grid; slots without rows are 0."""
    counted = df.groupBy(value.alias("slot")).agg(F.count("*").alias("total"), F.count_if(flag).alias("flagged"))
    return grid.join(counted, "slot", "left").select("slot", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "flagged")])


def entity_flags(df: DataFrame, entity: str, order: str, flag: Column) -> DataFrame:
    """(entity, n_keys, any_flagged, master_flagged, n_sub_flagged): the master is the first key by order."""
    rows = df.withColumn("__f", flag)
    out = rows.groupBy(entity).agg(F.count("*").alias("n_keys"), F.bool_or("__f").alias("any_flagged"), F.min_by("__f", order).alias("master_flagged"), F.count_if("__f").alias("__n"))
    return out.select(entity, "n_keys", "any_flagged", "master_flagged", (F.col("__n") - F.col("master_flagged").cast("int")).alias("n_sub_flagged"))


def funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """df with reject_reason: the first step that a row fails, null if it passes all."""
    reason = F.when(F.lit(False), "")
    for name, passes in steps:
        reason = reason.when(~F.coalesce(passes, F.lit(False)), name)
    return df.withColumn("reject_reason", reason)


def contributor_stats(df: DataFrame, who: str, where: str, amount: str) -> DataFrame:
    """(who, total, n_repos, average, repos): repos sorted and joined by '|'."""
    found = df.groupBy(who).agg(F.sum(amount).alias("total"), F.collect_set(where).alias("repos"), F.avg(amount).alias("average"))
    return found.select(who, "total", F.size("repos").cast("long").alias("n_repos"), "average", F.array_join(F.array_sort(F.col("repos").cast("array<string>")), "|").alias("repos"))


def contributors_in_parts(df: DataFrame, who: str, where: str, amount: str, size: int = PART) -> tuple[DataFrame, DataFrame]:
    """contributor_stats with its lists in parts: (who, total, average) and (who, part, n, values), repos sorted as text.

    n_repos is the sum of n of the parts; one without repos has no part.
    """
    totals = df.groupBy(who).agg(F.sum(amount).alias("total"), F.avg(amount).alias("average"))
    return totals, lists_in_parts(df.withColumn(where, F.col(where).cast("string")), who, where, size)


def flagged_hist(df: DataFrame, value: Column, flag: Column) -> DataFrame:
    """(slot, total, flagged, share): flagged rows of each value, and their share of all flagged, -1 if there are none."""
    out = df.groupBy(value.alias("slot")).agg(F.count("*").alias("total"), F.count_if(flag).alias("flagged"))
    total, all_flagged = out.agg(F.sum("flagged").alias("__all")), F.col("__all")
    share = F.when(all_flagged > 0, F.col("flagged") / all_flagged).otherwise(F.lit(-1.0))
    return out.crossJoin(F.broadcast(total)).withColumn("share", share).drop("__all")  # total is one row


def in_range_counts(df: DataFrame, inside: Column, flags: dict[str, Column]) -> DataFrame:
    """One row: rows inside, and those inside with each flag."""
    return df.agg(F.count_if(inside).alias("total"), *[F.count_if(inside & f).alias(name) for name, f in flags.items()])


def population_summary(df: DataFrame, who: str, kind: str, born: Column, today: str) -> DataFrame:
    """(kind, n, people, first, last, adults) for each kind of key; adults were born over 18 * 365 days before today."""
    days = F.datediff(F.lit(today).cast("date"), F.col("__born"))
    people = df.withColumn("__born", born).groupBy(kind, who).agg(F.count("*").alias("__n"), F.min("__born").alias("__born"))
    return people.groupBy(kind).agg(F.sum("__n").alias("n"), F.count("*").alias("people"), F.min("__born").alias("first"), F.max("__born").alias("last"), F.count_if(days > 18 * 365).alias("adults"))


def repo_summary(commits: DataFrame, issues: DataFrame, key: str, at: str, is_open: Column) -> DataFrame:
    """(key, first, last, n_open, n_closed): dates of commits, and issues by state; 0 for none."""
    days = commits.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    states = issues.groupBy(key).agg(F.count_if(is_open).alias("n_open"), F.count_if(~is_open).alias("n_closed"))
    return days.join(states, key, "left").fillna(0, ["n_open", "n_closed"])


def match_map(df: DataFrame, entity: str, order: str, flag: Column) -> DataFrame:
    """(entity, matches): the flags of an entity's keys in order."""
    pairs = df.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), flag.alias("f")))).alias("p"))
    return pairs.select(entity, F.transform("p", lambda x: x["f"]).alias("matches"))


def matches_in_parts(df: DataFrame, entity: str, order: str, flag: Column, size: int = PART) -> DataFrame:
    """(entity, part, n, values): the form in parts of match_map, for an entity of very many keys."""
    return ordered_in_parts(df.select(entity, order, flag.alias("__f")), entity, order, "__f", size)


def pmf(df: DataFrame, value: str, grid: DataFrame, prior: float, ranges: list[tuple[int, int, float]], weight: float) -> DataFrame:
    """(slot, p): a prior and extra scores for ranges [low, high), with weight spread over the sample's values, normalised."""
    total = df.select(F.count("*").alias("__total"))
    counted = df.groupBy(F.col(value).alias("slot")).agg(F.count("*").alias("__n"))
    score = F.lit(prior) + F.when(F.col("__total") > 0, weight * F.coalesce("__n", F.lit(0)) / F.col("__total")).otherwise(F.lit(0.0))
    for low, high, extra in ranges:
        score = score + F.when((F.col("slot") >= low) & (F.col("slot") < high), extra).otherwise(0.0)
    scored = grid.join(counted, "slot", "left").crossJoin(F.broadcast(total)).select("slot", score.alias("__s"))  # total is one row
    return scored.crossJoin(F.broadcast(scored.agg(F.sum("__s").alias("__all")))).select("slot", (F.col("__s") / F.col("__all")).alias("p"))  # one row


def grid_hist(df: DataFrame, value: Column, low: int, high: int, flag: Column) -> DataFrame:
    """(slot, total, flagged, scaled) for every whole number from low to below high; slots without rows are 0.

    scaled is flagged by the ratio of all to flagged rows of the grid, so that both have one sum; -1 if none is flagged.
    Values outside and nulls are left out.
    """
    grid = df.sparkSession.range(low, high).select(F.col("id").alias("slot"))
    out = zero_filled(df, value.cast("long"), grid, flag)
    sums = out.agg(F.sum("total").alias("__total"), F.sum("flagged").alias("__flagged"))
    scaled = F.when(F.col("__flagged") > 0, F.col("flagged") * F.col("__total") / F.col("__flagged")).otherwise(F.lit(-1.0))
    return out.crossJoin(F.broadcast(sums)).select("slot", "total", "flagged", scaled.alias("scaled"))  # sums is one row


def size_hist(df: DataFrame, bits: Column) -> DataFrame:
    """(bits, n, ratio) of key sizes, ratio to all rows; sizes that could not be parsed are one null bucket."""
    counted = df.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    return counted.crossJoin(F.broadcast(total)).select("bits", "n", (F.col("n") / F.col("__total")).alias("ratio"))  # total is one row


def archive_stats(df: DataFrame, unique: dict[str, Column], **conditions: Column) -> DataFrame:
    """One row: n, n_<name> rows for which each condition holds, and n_<name> distinct values of each unique column, nulls
    left out. An empty table gives zeros."""
    counts = [F.count_if(c).alias(f"n_{name}") for name, c in conditions.items()]
    return df.agg(F.count("*").alias("n"), *counts, *[F.countDistinct(c).alias(f"n_{name}") for name, c in unique.items()])


def sig_counts(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of every key; null is a key."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def mismatch_audit(df: DataFrame, entity: str, first: Column, second: Column) -> DataFrame:
    """Entities for which one of two conditions holds in some row and the other in none; null does not hold."""
    both = df.groupBy(entity).agg(F.count_if(first).alias("__a"), F.count_if(second).alias("__b"))
    return both.where((F.col("__a") > 0) != (F.col("__b") > 0)).select(entity)


def snapshot_counts(hosts: DataFrame, snap: str = "snap", ip: str = "ip", key: str = "fprint") -> DataFrame:
    """(snap, n_ips, n_prints): distinct hosts and keys of each snapshot, nulls left out."""
    return hosts.groupBy(snap).agg(F.countDistinct(ip).alias("n_ips"), F.countDistinct(key).alias("n_prints"))


def key_bitmaps(hosts: DataFrame, numbers: DataFrame, snap: str = "snap", key: str = "fprint") -> DataFrame:
    """(snap, bucket, bits): the keys of each snapshot as bitmaps over their numbers (key, id), which are dense from 0.

    A bucket has some 32 000 numbers. Stored bitmaps are added to as snapshots come, and any union of snapshots is counted
    from them exactly, without the rows.
    """
    placed = hosts.select(snap, key).join(numbers, key)
    bucket, place = F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id")
    return placed.groupBy(snap, bucket).agg(F.bitmap_construct_agg(place).alias("bits"))


def bitmap_counts(bitmaps: DataFrame, group: Column, name: str = "n") -> DataFrame:
    """(group, n): distinct keys of the union of each group's stored bitmaps."""
    united = bitmaps.groupBy(group.alias("group"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy("group").agg(F.sum(F.bitmap_count("bits")).alias(name))


def file_digests(df: DataFrame, content: str = "content") -> DataFrame:
    """df with md5, sha1, sha256 and size of its bytes in place of them; nulls for null."""
    raw = F.col(content).cast("binary")
    return df.withColumns({"md5": F.md5(raw), "sha1": F.sha1(raw), "sha256": F.sha2(raw, 256), "size": F.octet_length(raw).cast("long")}).drop(content)


def count(df: DataFrame, where: Column | None = None) -> DataFrame:
    """One row n: rows for which a condition holds, or all."""
    return df.agg((F.count("*") if where is None else F.count_if(where)).alias("n"))
