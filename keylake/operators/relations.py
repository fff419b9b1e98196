"""Joins, dedupe, sets and upserts over key corpora."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keylake.functions.text import version_key, version_length
from keylake.operators.snapshots import month_rows, place_within

#: Values of one row, where a key's list comes in parts.
PART = 10_000


def attach_hosts(certs: DataFrame, hosts: DataFrame, key: str = "fprint") -> DataFrame:
    """certs with the sorted distinct ips of their hosts; an empty list for none, and for a null key.

    A key's list is one row, as the format wants it; attached_hosts() has a row for each host instead.
    """
    ips = hosts.groupBy(key).agg(F.array_sort(F.collect_set("ip")).alias("ips"))
    return certs.join(ips, key, "left").withColumn("ips", F.coalesce("ips", F.array().cast(ips.schema["ips"].dataType)))


def attached_hosts(certs: DataFrame, hosts: DataFrame, key: str = "fprint") -> DataFrame:
    """(key, ip): a row for each host of each cert, and one with null ip for a cert without hosts; no key meets in one row."""
    return certs.select(key).distinct().join(hosts.select(key, "ip").distinct(), key, "left")


def lists_in_parts(df: DataFrame, key: str | list[str], value: str, size: int = PART, distinct: bool = True) -> DataFrame:
    """(key, part, n, values): each key's sorted values in lists of at most size, parts counted from 0 in order.

    Values are placed by ranges of key and value, so that neither a row nor a task has all values of a key. Null is a key;
    null values are not listed. Values that repeat are listed once, or all of them if not distinct.
    """
    keys = [key] if isinstance(key, str) else key
    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    placed = place_within(rows.distinct() if distinct else rows, keys, value)
    return placed.groupBy(*keys, F.floor(F.col("place") / size).alias("part")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(value)).alias("values"))


def ordered_in_parts(df: DataFrame, key: str | list[str], order: str, value: str, size: int = PART) -> DataFrame:
    """(key, part, n, values): lists_in_parts of all values of a key in their order, null ones with them.

    Null orders come first, and values with one order are in their own order.
    """
    parts = lists_in_parts(df.withColumn(value, F.struct(F.col(order).alias("o"), F.col(value).alias("v"))), key, value, size, distinct=False)
    return parts.withColumn("values", F.transform("values", lambda x: x["v"]))


def attached_in_parts(left: DataFrame, right: DataFrame, key: str | list[str], value: str, size: int = PART) -> DataFrame:
    """(key, part, n, values) for each distinct key of left, the form in parts of attach_hosts and key_packages.

    A key that right lacks, and a null key, has one part with an empty list.
    """
    keys = [key] if isinstance(key, str) else key
    parts = lists_in_parts(right, keys, value, size)
    out = left.select(*keys).distinct().join(parts, keys, "left").fillna(0, ["part", "n"])
    return out.withColumn("values", F.coalesce("values", F.array().cast(parts.schema["values"].dataType)))


def month_in_parts(hosts: DataFrame, archive: DataFrame, key: str = "fprint", size: int = PART) -> DataFrame:
    """(month, key, part, n, values): the form in parts of month_merge; a key without hosts has one part with an empty list."""
    final, keys = month_rows(hosts, archive, key)
    return attached_in_parts(keys, final, ["month", key], "ip", size)


def unique_in_parts(df: DataFrame, key: str, order: str, list_col: str, size: int = PART) -> tuple[DataFrame, DataFrame]:
    """unique_by with its lists in parts: the first row of each key with n_rows, and (key, part, n, values)."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("rep"), F.count("*").alias("n_rows"))
    return first.select(key, "rep.*", "n_rows"), lists_in_parts(df, key, list_col, size, distinct=False)


def in_snapshot(certs: DataFrame, hosts: DataFrame, key: str = "fprint") -> DataFrame:
    """certs whose key has a host; a null key has none. Repeated rows stay."""
    return certs.join(hosts.select(key), key, "left_semi")


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left whose key right lacks; null keys are lacking. Repeated rows stay."""
    return left.join(right.select(key), key, "left_anti")


def unique_by(df: DataFrame, key: str, order: str, list_col: str) -> DataFrame:
    """One row for each key: the first row's columns by order, n_rows, and the sorted values of list_col.

    Null is a key of its own; null orders do not come first, and null values are not listed. Of equal orders any row is taken.
    """
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("rep"), F.count("*").alias("n_rows"), F.array_sort(F.collect_list(list_col)).alias("all_values"))
    return out.select(key, "rep.*", "n_rows", "all_values")


def first_wins(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, null keys being one; give enough columns of order, as of ties any row is taken."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def set_report(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, membership): a, b or both, from one full join of the two sets."""
    left, right = a.select(key).distinct().withColumn("__a", F.lit(1)), b.select(key).distinct().withColumn("__b", F.lit(1))
    side = F.when(F.col("__a").isNull(), "b").when(F.col("__b").isNull(), "a").otherwise("both")
    return left.join(right, key, "full").select(key, side.alias("membership"))


def upsert(current: DataFrame, new: DataFrame, keys: list[str], mode: str = "overwrite") -> DataFrame:
    """current with new rows by key; insert_only keeps the current row where both have one.

    Rows with a null in their keys equal no other, so all of them stay. Keys are to be unique in new: repeated rows all stay.
    """
    if mode == "insert_only":
        return current.unionByName(new.join(current.select(keys), keys, "left_anti"))
    return new.unionByName(current.join(new.select(keys), keys, "left_anti"))


def fill_nulls(target: DataFrame, source: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """target with nulls of cols taken from source."""
    other = source.select(*keys, *[F.col(c).alias(f"__{c}") for c in cols])
    out = target.join(other, keys, "left")
    return out.select(*[F.coalesce(c, f"__{c}").alias(c) if c in cols else F.col(c) for c in target.columns])


def compare_rows(a: DataFrame, b: DataFrame, key: str, cols: list[str], defaults: dict[str, object] | None = None, transforms: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(key, same) of keys that both have: do the columns agree, once transformed and nulls replaced by defaults.

    Nulls that remain count as equal. Rows with null keys are left out; repeated keys give a row for each pair.
    """
    seen = [F.struct(*[c.alias(n) for n, c in projected(cols, defaults, transforms).items()]).alias(side) for side in ("__l", "__r")]
    left, right = a.select(key, seen[0]), b.select(key, seen[1])
    return left.join(right, key).select(key, F.col("__l").eqNullSafe(F.col("__r")).alias("same"))


def assoc_history(seen: DataFrame, owner: str, item: str, check: str) -> DataFrame:
    """(owner, item, found_at, lost_at) for each unbroken run of the owner's checks in which the item was there.

    Checks of an owner are the times at which any item of it was seen; lost_at is the check after a run, null if none was.
    """
    checks = seen.select(owner, check).distinct()
    w = Window.partitionBy(owner).orderBy(check)
    checks = checks.withColumn("ix", F.row_number().over(w)).withColumn("next", F.lead(check).over(w))
    rows = seen.select(owner, item, check).distinct().join(checks, [owner, check])
    island = F.col("ix") - F.row_number().over(Window.partitionBy(owner, item).orderBy("ix"))
    runs = rows.withColumn("run", island).groupBy(owner, item, "run")
    return runs.agg(F.min(check).alias("found_at"), F.max_by("next", "ix").alias("lost_at")).drop("run")


def lookup_new(wanted: DataFrame, archive: DataFrame, key: str = "fprint") -> tuple[DataFrame, DataFrame]:
    """(found, missing): wanted keys with the archive's columns, and those that it lacks."""
    joined = wanted.select(key).distinct().join(archive.withColumn("__here", F.lit(True)), key, "left")
    return joined.where("__here").drop("__here"), joined.where("__here is null").select(key)


def cumulative_inputs(catalogue: DataFrame, ts: str = "date_utc", item: str = "id") -> DataFrame:
    """(month, item) of every data set dated up to the month's last one. A catalogue has a row for each published set.

    Months are few and have a bounded list of sets, so the last one of each is broadcast.
    """
    month = F.date_trunc("month", F.timestamp_seconds(ts)).alias("month")
    last = catalogue.groupBy(month).agg(F.max(ts).alias("__last"))
    return catalogue.join(F.broadcast(last), F.col(ts) <= F.col("__last")).select("month", item)


def new_apps(listing: DataFrame, apps: DataFrame, now: str, pid: int | None = None) -> DataFrame:
    """Listing rows (title, type, uploaded) that no app record of the same title and type has handled.

    A record handles a row if it was downloaded or processed, is unreserved, or was reserved in the 20 minutes before now
    (all of these by process pid only, if given), or was uploaded no earlier than the row.
    """
    busy = F.col("downloaded") | F.col("processed") | F.col("reserved").isNull() | (F.col("reserved") >= F.lit(now).cast("timestamp_ntz") - F.expr("interval 20 minutes"))
    if pid is not None:
        busy = busy & (F.col("pid") == pid)
    # whether any record handles a row takes two values of each title and type
    handled = apps.groupBy(F.col("title").alias("__title"), F.col("type").alias("__type")).agg(F.coalesce(F.bool_or(busy), F.lit(False)).alias("__busy"), F.max("uploaded").alias("__uploaded"))
    met = listing.join(handled, (F.col("title") == F.col("__title")) & F.col("type").eqNullSafe(F.col("__type")), "left")
    done = F.coalesce("__busy", F.lit(False)) | F.coalesce(F.col("__uploaded") >= F.col("uploaded"), F.lit(False))
    return met.where(~done).select(*listing.columns)


def extend_catalogue(catalogue: DataFrame, files: DataFrame, key: str = "name") -> DataFrame:
    """The catalogue and those files that it does not list."""
    return catalogue.unionByName(files.join(catalogue.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert_conflicts(current: DataFrame, new: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Keys whose new row differs from the current one in a column, nulls counting as equal."""
    left, right = current.select(*keys, F.struct(*cols).alias("__l")), new.select(*keys, F.struct(*cols).alias("__r"))
    return left.join(right, keys).where(~F.col("__l").eqNullSafe(F.col("__r"))).select(keys)


def pick_versions(df: DataFrame, group: str, version: str = "version") -> DataFrame:
    """(group, version, pick): the highest version of each group, and the highest of those below its first two parts.

    Among those the greatest first two parts count, then fewer parts, then the greatest rest, which compares as a version.
    """
    v = F.col(version)
    rows = df.select(group, version).distinct().withColumn("__k", version_key(v))  # a version's key is made once
    part = lambda n: F.when(F.size(F.get("__k", F.lit(n))) > 0, F.get("__k", F.lit(n)))  # noqa: E731  (null, the least, for none and for zero)
    two = F.struct(part(0).alias("a"), part(1).alias("b")).alias("__two")
    high, low = F.struct("__k", version), F.struct(-version_length(v), F.slice("__k", 3, 1000), v)
    best = rows.groupBy(group, two).agg(F.max_by(version, high).alias("__high"), F.max_by(version, low).alias("__low"))
    # the highest is among those of the greatest first two parts; those below are of the next
    order = Window.partitionBy(group).orderBy(F.desc("__two"))
    near = best.withColumn("__n", F.row_number().over(order)).where("__n <= 2")
    top = F.col("__n") == 1
    out = near.where(top | (F.col(group).isNotNull() & F.col("__low").isNotNull()))
    return out.select(group, F.when(top, F.col("__high")).otherwise(F.col("__low")).alias(version), F.when(top, "top").otherwise("lower").alias("pick"))


def version_filter(df: DataFrame, version: str, low: str | None = None, high: str | None = None, exact: str | None = None) -> DataFrame:
    """Rows whose version is in bounds; each bound compares with as many parts as it has."""
    parts = lambda bound: bound.replace(":", ".").count(".") + 1
    key = lambda bound: (version_key(F.col(version), parts(bound)), version_key(F.lit(bound)))
    for bound, holds in ((exact, lambda a, b: a == b), (low, lambda a, b: a >= b), (high, lambda a, b: a <= b)):
        if bound is not None:
            df = df.where(holds(*key(bound)))
    return df


def key_family(keys: DataFrame, key: str = "key_id", master: str = "master_key_id") -> DataFrame:
    """(key, relative, relation): each subkey's master and each master's subkeys."""
    links = keys.where(F.col(master).isNotNull() & (F.col(master) != F.col(key))).select(F.col(key).alias("a"), F.col(master).alias("b")).distinct()
    up = links.select(F.col("a").alias(key), F.col("b").alias("relative"), F.lit("master").alias("relation"))
    return up.unionByName(links.select(F.col("b").alias(key), F.col("a").alias("relative"), F.lit("subkey").alias("relation")))


def is_processed(kind: Column, version: Column, skipped: list[str], modulus: Column, digits: Column, least: int = 10) -> Column:
    """Is a package's record complete: kind and version known, and a modulus unless the kind needs none."""
    known = kind.isNotNull() & version.isNotNull()
    key = F.coalesce(modulus != 0, F.lit(False)) & F.coalesce(F.length(digits) >= least, F.lit(False))
    return known & (F.coalesce(kind.isin(skipped), F.lit(False)) | key)


def projected(cols: list[str], defaults: dict[str, object] | None = None, transforms: dict[str, Callable[[Column], Column]] | None = None) -> dict[str, Column]:
    """Columns by name, each put through its transform; then a null, and a missing result of the transform, is its default."""
    out = {}
    for c in cols:
        value = (transforms or {}).get(c, lambda x: x)(F.col(c))
        out[c] = F.coalesce(value, F.lit(defaults[c])) if c in (defaults or {}) else value
    return out


def with_defaults(df: DataFrame, defaults: dict[str, object] | None = None, transforms: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """df with columns transformed and their nulls replaced; other columns are unchanged."""
    return df.withColumns(projected([c for c in df.columns if c in {*(defaults or {}), *(transforms or {})}], defaults, transforms))


def key_packages(keys: DataFrame, signatures: DataFrame, key: str = "key_id", package: str = "package") -> DataFrame:
    """keys with the sorted distinct packages that each signed, and their number n; none gives an empty list and 0.

    A key's list is one row, as its record has it.
    """
    signed = signatures.groupBy(key).agg(F.array_sort(F.collect_set(F.col(package).cast("string"))).alias("packages"))
    out = keys.join(signed, key, "left").withColumn("packages", F.coalesce("packages", F.array().cast("array<string>")))
    return out.withColumn("n", F.size("packages").cast("long"))


def flagged_packages(flagged: DataFrame, signatures: DataFrame, key: str, package: str) -> DataFrame:
    """(key, package): the distinct packages that flagged keys signed. Null keys sign nothing."""
    return signatures.select(key, package).join(flagged.select(key).distinct(), key, "left_semi").distinct()


def chain_ids(chains: DataFrame, dictionary: DataFrame, leaf: str, place: str, cert: str, id_col: str = "id") -> DataFrame:
    """(leaf, ids): for each leaf the ids of its chain's certificates, in order of place, then id.

    dictionary (cert, id) may repeat a certificate, whose least id counts; certificates that it lacks are left out.
    """
    ordered = _chained(chains, dictionary, cert, id_col).groupBy(leaf).agg(F.array_sort(F.collect_list(F.struct(place, "__id"))).alias("__c"))
    return ordered.select(leaf, F.transform("__c", lambda x: x["__id"]).alias("ids"))


def _chained(chains: DataFrame, dictionary: DataFrame, cert: str, id_col: str) -> DataFrame:
    """chains with the __id of each certificate that the dictionary has."""
    first = dictionary.where(F.col(cert).isNotNull()).groupBy(cert).agg(F.min(id_col).alias("__id"))
    return chains.join(first, cert)


def chains_in_parts(chains: DataFrame, dictionary: DataFrame, leaf: str, place: str, cert: str, id_col: str = "id", size: int = PART) -> DataFrame:
    """(leaf, part, n, values): the form in parts of chain_ids, for a leaf that very many chains have."""
    return ordered_in_parts(_chained(chains, dictionary, cert, id_col).select(leaf, place, "__id"), leaf, place, "__id", size)


def impact(flagged: DataFrame, *links: DataFrame, keep: list[str]) -> DataFrame:
    """The distinct columns to keep of flagged rows that are followed through links.

    Each link is joined on the columns that it shares with what came before, so users, organisations, their repositories
    (already filtered by stars) and assignees follow one another. Nulls link nothing.
    """
    out = flagged
    for link in links:
        out = out.join(link, [c for c in link.columns if c in out.columns])
    return out.select(keep).distinct()


def rank_join(ranking: DataFrame, apps: DataFrame, key: str = "package") -> DataFrame:
    """Ranking rows with the metadata of their application; those without are left out, repeated ones stay."""
    return ranking.join(apps, key)


def drop_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each combination of keys, null counting as a value; which one is open where other columns differ."""
    return df.dropDuplicates(list(keys))


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in order, null first."""
    return df.select(column).distinct().orderBy(column)


def union_corpora(**corpora: DataFrame) -> DataFrame:
    """Rows of several corpora with the name of each in `corpus`; columns that one lacks are null there."""
    parts = [df.select(F.lit(name).alias("corpus"), "*") for name, df in corpora.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def popular(df: DataFrame, key: str, least: int, count: str = "stars") -> DataFrame:
    """(key, count) of keys with so many rows at least."""
    return df.groupBy(key).agg(F.count("*").alias(count)).where(F.col(count) >= least)


def select_datasets(catalogue: DataFrame, id_col: str, ids: list[int] | None = None, ranges: list[tuple[int, int]] | None = None) -> DataFrame:
    """Data sets of these ids or in these ranges, ends included; with neither, none."""
    chosen = F.col(id_col).isin(ids or [])
    for low, high in ranges or []:
        chosen = chosen | F.col(id_col).between(low, high)
    return catalogue.where(chosen)


def route(df: DataFrame, rsa: Column, ca: Column, self_signed: Column) -> dict[str, DataFrame]:
    """The outputs rsa, ca and ca_not_self_signed of one input; a condition that is null does not hold."""
    return {"rsa": df.where(rsa), "ca": df.where(ca), "ca_not_self_signed": df.where(ca & ~F.coalesce(self_signed, F.lit(False)))}


def reflag(keys: DataFrame, flag: Column, old: str = "flagged") -> DataFrame:
    """keys whose flag differs from the stored one, with the new flag in its place; null differs from both."""
    return keys.withColumn("__new", flag).where(~F.col("__new").eqNullSafe(F.col(old))).withColumn(old, F.col("__new")).drop("__new")


def dependency_index(edges: DataFrame, library: list[str], dependent: str) -> DataFrame:
    """(library, n, dependents) for each library and version: the sorted distinct dependents, one row as the index has it.

    Edges with null dependents count for nothing.
    """
    rows = edges.where(F.col(dependent).isNotNull()).select(*library, dependent).distinct()
    return rows.groupBy(*library).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(dependent)).alias("dependents"))
