"""URL filters: a temporal list join of captures against dated list entries.

A list is a log of dated changes: a pattern (a domain, or a domain with the first segment of a path) is added or removed
at a time. A pattern's changes in order of time become validity intervals: from an addition to the next change. A capture
is tested with every parent domain of its host of two labels or more (an address has none), and with its host and first
path segment, against the intervals that hold at the time when it was fetched.

Only DataFrame functions are used. Captures are first reduced to distinct (host, segment, time). The as-of join lays
probes and intervals of all patterns out in ranges of (pattern, time), so a pattern with very many of either spans many
ranges; each range begins with the last interval of its pattern in earlier ones. A probe meets the last interval that began
by then, and is listed if that has not ended. The verdict joins back by host, segment
and time.

Defined results: a null or unparsable URL, or a null fetch time, is not listed. Changes with null pattern, time or action
are ignored; of changes of one pattern at one time an addition counts. A change holds from its very time on. Captures with
null id are kept. Repeated captures each give a row. Empty tables give no rows, or captures that are not listed. Only the
named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keylake.session import materialize

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@]+)"
#: Addresses, which have no parent domains.
ADDRESS = r"^(\[.*|[0-9.]+)$"
SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]+)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def segment(url: Column) -> Column:
    return F.regexp_extract(url, SEGMENT, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until): when each pattern is listed; until is exclusive, null while it still is.

    Changes are laid out in ranges of (pattern, time). The next change of a range's last one is the pattern's first in a
    later range, so a pattern with very many changes spans many tasks.
    """
    laid = materialize(_changes(entries).repartitionByRange("pattern", "at").withColumn("range", F.spark_partition_id()), "changes")
    firsts = laid.groupBy("pattern", "range").agg(F.min("at").alias("first"))  # a pattern has a row for each range at most
    after = firsts.select("pattern", "range", F.lead("first").over(Window.partitionBy("pattern").orderBy("range")).alias("after"))
    until = F.coalesce(F.lead("at").over(Window.partitionBy("pattern", "range").orderBy("at")), F.col("after"))
    return laid.join(after, ["pattern", "range"]).select("pattern", F.col("at").alias("since"), until.alias("until"), "listed").where("listed").drop("listed")


def _changes(entries: DataFrame) -> DataFrame:
    """(pattern, at, listed): one for each pattern and time."""
    sound = entries.where("pattern is not null and at is not null and action in ('add', 'remove')")
    return sound.select(F.lower("pattern").alias("pattern"), F.col("at").cast("timestamp_ntz").alias("at"), (F.col("action") == "add").alias("listed")).groupBy("pattern", "at").agg(F.max("listed").alias("listed"))


def _as_of(probes: DataFrame, spans: DataFrame) -> DataFrame:
    """probes (pattern, at) that the pattern's last interval (since, until) up to then still holds."""
    span = F.struct(F.col("since"), F.col("until")).alias("span")
    both = spans.select("pattern", F.col("since").alias("at"), span, F.lit(False).alias("asked"))
    both = both.unionByName(probes.select("pattern", "at", F.lit(None).cast(both.schema["span"].dataType).alias("span"), F.lit(True).alias("asked")))
    laid = materialize(both.repartitionByRange("pattern", "at").withColumn("range", F.spark_partition_id()), "ranges")
    ends = laid.groupBy("pattern", "range").agg(F.max_by("span", F.when(F.col("span").isNotNull(), F.col("at"))).alias("span"))  # a pattern has a row for each range at most
    before = F.last("span", ignorenulls=True).over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    begun = ends.select("pattern", "range", F.lit(None).cast("timestamp_ntz").alias("at"), before.alias("span"), F.lit(False).alias("asked")).where("span is not null")
    up_to = Window.partitionBy("pattern", "range").orderBy(F.asc_nulls_first("at"), "asked").rowsBetween(Window.unboundedPreceding, 0)
    found = laid.select("pattern", "range", "at", "span", "asked").unionByName(begun).withColumn("span", F.last("span", ignorenulls=True).over(up_to))
    return found.where("asked and span is not null and (span.until is null or at < span.until)").select("pattern", "at")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """One row per capture: page_id, host, fetched (text), listed, n_patterns, pattern (the longest, then least, that holds)."""
    rows = captures.select(F.col(id_col).alias("page_id"), F.coalesce(host(F.col(url_col)), F.lit("")).alias("host"), F.coalesce(segment(F.col(url_col)), F.lit("")).alias("segment"), F.col(time_col).cast("timestamp_ntz").alias("at"))
    sound = (F.col("host") != "") & F.col("at").isNotNull()
    distinct = rows.where(sound).select("host", "segment", "at").distinct()
    labels = F.split("host", r"\.")
    parents = F.when((F.size(labels) > 2) & ~F.col("host").rlike(ADDRESS), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(labels) - 1)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array("host"))
    patterns = F.array_distinct(F.concat(parents, F.when(F.col("segment") != "", F.array(F.lower(F.concat("host", "segment")))).otherwise(F.array().cast("array<string>"))))
    asked = distinct.select("host", "segment", "at", F.explode(patterns).alias("pattern"))
    held = _as_of(asked.select("pattern", "at").distinct(), intervals(entries))
    verdict = asked.join(held, ["pattern", "at"]).groupBy("host", "segment", "at").agg(F.count("*").alias("n_patterns"), F.min(F.struct((-F.length("pattern")).alias("long"), "pattern"))["pattern"].alias("pattern"))
    out = rows.where(sound).join(verdict, ["host", "segment", "at"], "left")
    none = rows.where(~sound).withColumn("n_patterns", F.lit(None).cast("long")).withColumn("pattern", F.lit(None).cast("string"))
    out = out.unionByName(none)  # which a join would bring to one task
    return out.select("page_id", "host", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("fetched"), F.col("n_patterns").isNotNull().alias("listed"), F.coalesce("n_patterns", F.lit(0)).cast("long").alias("n_patterns"), "pattern")


def captures_and_list(pages: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A capture log and a list log from the given tables.

    The event whose id is a page's id is its fetch, the earliest of several. A fetch that is an error adds to the list, at
    its time, the page's host with its first path segment, and the whole host if the event's value is over 20; a purchase
    removes both.
    """
    own = events.where("event_id is not null and ts is not null").groupBy(F.col("event_id").alias("page_id")).agg(F.min(F.struct(F.col("ts").alias("fetched"), "event_type", "value")).alias("e"))
    fetched = pages.join(own, "page_id", "left").select("page_id", "url", "e.fetched", "e.event_type", "e.value")
    action = F.when(F.col("event_type") == "error", "add").when(F.col("event_type") == "purchase", "remove")
    marked = fetched.where("event_type in ('error', 'purchase')").select(host(F.col("url")).alias("host"), segment(F.col("url")).alias("segment"), F.col("fetched").alias("at"), action.alias("action"), "value")
    whole = marked.where("host <> '' and (action = 'remove' or value > 20)").select(F.col("host").alias("pattern"), "at", "action")
    part = marked.where("host <> '' and segment <> ''").select(F.concat("host", "segment").alias("pattern"), "at", "action")
    return fetched.select("page_id", "url", "fetched"), whole.unionByName(part)


def oracle() -> str:
    """The same rows in DuckDB SQL, with plain interval conditions."""
    return f"""
WITH e AS (SELECT event_id, ts, event_type, value FROM events WHERE ts IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts, event_type NULLS FIRST, value NULLS FIRST) = 1),
c AS (SELECT p.page_id, coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') AS host, coalesce(regexp_extract(url, '{SEGMENT}', 1), '') AS seg,
             e.ts, e.event_type, e.value, row_number() OVER () AS rid
      FROM pages p LEFT JOIN e ON e.event_id = p.page_id),
m AS (SELECT host, seg, ts, value, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 0 END AS listed FROM c WHERE host <> ''),
l AS (SELECT host AS pattern, ts, listed FROM m WHERE listed = 0 OR (listed = 1 AND value > 20)
      UNION ALL SELECT lower(host || seg), ts, listed FROM m WHERE listed IS NOT NULL AND seg <> ''),
d AS (SELECT pattern, ts, max(listed) AS listed FROM l GROUP BY pattern, ts),
i AS (SELECT * FROM (SELECT pattern, ts AS since, lead(ts) OVER (PARTITION BY pattern ORDER BY ts) AS until, listed FROM d) WHERE listed = 1),
k AS (SELECT rid, ts, unnest(list_distinct(list_concat(
        CASE WHEN len(string_split(host, '.')) > 2 AND NOT regexp_matches(host, '{ADDRESS}')
             THEN list_transform(range(1, len(string_split(host, '.'))), lambda x: array_to_string(string_split(host, '.')[x:], '.')) ELSE [host] END,
        CASE WHEN seg <> '' THEN [lower(host || seg)] ELSE [] END))) AS pattern FROM c WHERE host <> '' AND ts IS NOT NULL),
h AS (SELECT rid, count(*) AS n_patterns, arg_min(k.pattern, (-length(k.pattern), k.pattern)) AS pattern FROM k JOIN i
      ON k.pattern = i.pattern AND k.ts >= i.since AND (i.until IS NULL OR k.ts < i.until) GROUP BY rid)
SELECT page_id, host, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS fetched, n_patterns IS NOT NULL AS listed, CAST(coalesce(n_patterns, 0) AS BIGINT) AS n_patterns, pattern
FROM c LEFT JOIN h USING (rid)
"""
