"""Queries for snapshots, windows, statistics, filters and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.operators import relations, snapshots, spacing, stats
from keylake.plans.registry import query
from keylake.session import materialize, table


def _hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Host snapshots: an event's day, its user as ip, its user and type as fingerprint."""
    return table(spark, sf, "events").select(F.date_trunc("day", "ts").cast("string").alias("snap"), F.col("user_id").alias("ip"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("fprint"))


_H = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS t, strftime(ts, '%Y-%m-%d 00:00:00') AS snap, user_id AS ip, user_id || '-' || event_type AS fprint FROM events"


@query(
    "w01_w04_snapshot_diff",
    f"""WITH s AS (SELECT DISTINCT snap, fprint FROM ({_H})), n AS (SELECT snap, row_number() OVER (ORDER BY snap) AS ix FROM (SELECT DISTINCT snap FROM s)),
r AS (SELECT ix, fprint, lag(ix) OVER w AS b, lead(ix) OVER w AS a FROM s JOIN n USING (snap) WINDOW w AS (PARTITION BY fprint ORDER BY ix)),
u AS (SELECT ix, fprint, b IS NULL AS first_seen, b IS NULL OR b <> ix - 1 AS new, coalesce(b = ix - 1, false) AS same, false AS lost FROM r
UNION ALL SELECT ix + 1, fprint, false, false, false, true FROM r WHERE (a IS NULL OR a <> ix + 1) AND ix < (SELECT max(ix) FROM n))
SELECT snap, fprint, first_seen, new, same, lost FROM u JOIN n USING (ix)""",
)
def snapshot_diff(spark, sf):
    return snapshots.snapshot_diff(_hosts(spark, sf))


@query(
    "w05_month_full",
    f"""WITH h AS ({_H}), l AS (SELECT date_trunc('month', t) AS m, max(t) AS t FROM h GROUP BY 1), f AS (SELECT fprint, min(t) AS first_seen FROM h GROUP BY 1)
SELECT strftime(l.t, '%Y-%m') AS month, h.fprint, count(DISTINCT ip) AS n_hosts FROM h JOIN l USING (t) JOIN f USING (fprint) WHERE first_seen <= h.t GROUP BY ALL""",
)
def month_full(spark, sf):
    hosts = _hosts(spark, sf).withColumn("snap", F.col("snap").cast("timestamp"))
    archive = hosts.groupBy("fprint").agg(F.min("snap").alias("first_seen"))
    return snapshots.month_full(hosts, archive).select(F.date_format("month", "yyyy-MM").alias("month"), "fprint", "n_hosts")


@query(
    "w07_min_spacing",
    """WITH RECURSIVE e AS (SELECT DISTINCT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
k(event_type, t) AS (SELECT event_type, min(t) FROM e GROUP BY 1 UNION ALL SELECT k.event_type, (SELECT min(t) FROM e WHERE e.event_type = k.event_type AND e.t >= k.t + 86400) FROM k WHERE k.t IS NOT NULL)
SELECT event_type, t AS epoch FROM k WHERE t IS NOT NULL""",
)
def min_spacing(spark, sf):
    times = table(spark, sf, "events").select("event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    return spacing.min_spacing(times, 86_400, "event_type")


@query(
    "w10_trailing_counts",
    "WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n_3600, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n_86400 FROM e",
)
def trailing_counts(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    return snapshots.trailing_counts(events, [3600, 86_400], "user_id").select("event_id", "n_3600", "n_86400")


@query("a01_keys_per_entity", "SELECT n_keys, count(*) AS n_entities, count(*) / sum(count(*)) OVER () AS ratio FROM (SELECT user_id, count(*) AS n_keys FROM events GROUP BY 1) GROUP BY 1")
def keys_per_entity(spark, sf):
    return stats.keys_per_entity(table(spark, sf, "events"), "user_id")


@query("a02_size_hist", "SELECT CAST(n_chars // 256 AS BIGINT) AS bits, count(*) AS n, count(*) / (SELECT count(*) FROM documents) AS ratio FROM documents GROUP BY 1")
def size_hist(spark, sf):
    return stats.size_hist(table(spark, sf, "documents"), F.expr("n_chars div 256"))


@query("a04_entity_flags", "SELECT user_id, count(*) AS n_keys, bool_or(value > 50) AS any_flagged, arg_min(value > 50, event_id) AS master_flagged, count(*) FILTER (WHERE value > 50) - CAST(arg_min(value > 50, event_id) AS INTEGER) AS n_sub_flagged FROM events GROUP BY 1")
def entity_flags(spark, sf):
    return stats.entity_flags(table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 50)


@query("a06_rate_matrix", "SELECT lang, source, count(*) AS total, count(*) FILTER (WHERE n_chars > 2000) AS flagged, 100.0 * count(*) FILTER (WHERE n_chars > 2000) / count(*) AS percent FROM documents GROUP BY CUBE (lang, source)")
def rate_matrix(spark, sf):
    return stats.rate_matrix(table(spark, sf, "documents"), ["lang", "source"], F.col("n_chars") > 2000)


@query("a07_monthly_series", "WITH g AS (SELECT strftime(d, '%Y-%m') AS slot FROM (SELECT unnest(generate_series(DATE '2023-06-01', DATE '2024-12-01', INTERVAL 1 MONTH)) AS d)), c AS (SELECT strftime(ts, '%Y-%m') AS slot, count(*) AS t, count(*) FILTER (WHERE event_type = 'error') AS f FROM events GROUP BY 1) SELECT slot, coalesce(t, 0) AS total, coalesce(f, 0) AS flagged FROM g LEFT JOIN c USING (slot)")
def monthly_series(spark, sf):
    grid = spark.range(1).select(F.explode(F.sequence(F.lit("2023-06-01").cast("date"), F.lit("2024-12-01").cast("date"), F.expr("interval 1 month"))).alias("d")).select(F.date_format("d", "yyyy-MM").alias("slot"))
    return stats.zero_filled(table(spark, sf, "events"), F.date_format("ts", "yyyy-MM"), grid, F.col("event_type") == "error")


@query("a08_grid_hist", "WITH h AS (SELECT s.slot, count(p_partkey) AS total, count(*) FILTER (WHERE p_retailprice > 1200) AS flagged FROM (SELECT unnest(range(0, 60)) AS slot) s LEFT JOIN part ON p_size = s.slot GROUP BY 1) SELECT *, CASE WHEN sum(flagged) OVER () > 0 THEN flagged * (sum(total) OVER ()) / (sum(flagged) OVER ()) ELSE -1.0 END AS scaled FROM h")
def grid_hist(spark, sf):
    return stats.grid_hist(table(spark, sf, "part"), F.col("p_size"), 0, 60, F.col("p_retailprice") > 1200)


@query("a10_archive_stats", "SELECT count(*) AS n, count(*) FILTER (WHERE lang = 'en') AS n_rsa, count(*) FILTER (WHERE source = 'src0') AS n_ca, count(*) FILTER (WHERE lang = 'en' AND source = 'src0') AS n_rsa_ca, count(DISTINCT md5(text)) AS n_unique FROM documents")
def archive_stats(spark, sf):
    rsa, ca = F.col("lang") == "en", F.col("source") == "src0"
    return stats.archive_stats(table(spark, sf, "documents"), {"unique": F.md5(F.col("text").cast("binary"))}, rsa=rsa, ca=ca, rsa_ca=rsa & ca)


def _funnel(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return stats.funnel(rows, [("not_ok", F.col("quality").isNotNull()), ("not_parsed", F.col("quality") == 1), ("not_rsa", F.col("lang") == "en")])


_F = "SELECT doc_id, CASE WHEN quality IS NULL THEN 'not_ok' WHEN quality <> 1 THEN 'not_parsed' WHEN lang <> 'en' THEN 'not_rsa' END AS reject_reason FROM documents LEFT JOIN labels USING (doc_id)"


@query("p01_funnel", _F)
def funnel(spark, sf):
    return _funnel(spark, sf).select("doc_id", "reject_reason")


@query("a11_funnel_counts", f"SELECT reject_reason, count(*) AS n FROM ({_F}) GROUP BY 1")
def funnel_counts(spark, sf):
    return _funnel(spark, sf).groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("a12_sig_counts", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def sig_counts(spark, sf):
    return stats.sig_counts(table(spark, sf, "lineitem"), "l_suppkey")


@query("a13_contributor_stats", "SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS total, count(DISTINCT l_partkey) AS n_repos, avg(l_quantity) AS average, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)) AS repos FROM lineitem GROUP BY 1")
def contributor_stats(spark, sf):
    return stats.contributor_stats(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity").withColumn("total", F.col("total").cast("double"))


@query("a15_mismatch_audit", "SELECT user_id FROM events GROUP BY 1 HAVING bool_or(event_type = 'error' AND value > 60) <> bool_or(event_type = 'purchase' AND value > 60)")
def mismatch_audit(spark, sf):
    large = F.col("value") > 60
    return stats.mismatch_audit(table(spark, sf, "events"), "user_id", (F.col("event_type") == "error") & large, (F.col("event_type") == "purchase") & large)


@query("a18_snapshot_counts", f"SELECT snap, count(DISTINCT ip) AS n_ips, count(DISTINCT fprint) AS n_prints FROM ({_H}) GROUP BY 1")
def snapshot_counts(spark, sf):
    return stats.snapshot_counts(_hosts(spark, sf))


@query("a18_bitmap_months", f"SELECT left(CAST(snap AS VARCHAR), 7) AS month, count(DISTINCT ip) AS n FROM ({_H}) WHERE snap IS NOT NULL GROUP BY 1")
def bitmap_months(spark, sf):
    """Hosts of each month from the stored bitmaps of its days."""
    hosts = _hosts(spark, sf).where("snap is not null and ip is not null")
    numbers = materialize(snapshots.seq_id(hosts.select("ip").distinct(), "ip"), "numbers")
    stored = materialize(stats.key_bitmaps(hosts, numbers, key="ip"), "bitmaps")
    return stats.bitmap_counts(stored, F.left(F.col("snap").cast("string"), F.lit(7))).withColumnRenamed("group", "month")


@query("l02_next_page", "SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def next_page(spark, sf):
    return snapshots.next_page(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000, 100)


@query("p05_route", "SELECT 'rsa' AS output, doc_id FROM documents WHERE lang <> 'fr' UNION ALL SELECT 'ca', doc_id FROM documents WHERE source = 'src0' UNION ALL SELECT 'ca_not_self_signed', doc_id FROM documents WHERE source = 'src0' AND lang IS DISTINCT FROM 'en'")
def route(spark, sf):
    routed = relations.route(table(spark, sf, "documents").select("doc_id", "lang", "source"), F.col("lang") != "fr", F.col("source") == "src0", F.col("lang") == "en")
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("output"), "doc_id") for name, df in routed.items()])


@query("p12_artifact_dirs", """SELECT page_id, score FROM (SELECT page_id, CAST(3 * CAST(len(a) < 100 AS INTEGER) + len(list_filter(a, lambda x: regexp_matches(x, '[0-9]|e$'))) AS BIGINT) AS score FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)) WHERE score > 3""")
def artifact_dirs(spark, sf):
    from keylake.sources.files import anchors

    links = table(spark, sf, "pages").select("page_id", anchors(F.col("html")).alias("a"))
    score = F.when(F.size("a") < 100, 3).otherwise(0) + F.size(F.filter("a", lambda x: x.rlike("[0-9]|e$")))
    return links.select("page_id", score.cast("long").alias("score")).where("score > 3")
