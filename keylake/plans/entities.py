"""Further queries of joins, statistics, windows, limits, graphs and streams."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.functions import keys as K
from keylake.operators import graph, relations, snapshots, stats
from keylake.plans.registry import query
from keylake.session import shared_dir, table
from keylake.sources import files
from keylake.streaming import streams


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


_NEW = "WITH w AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'signup'), a AS (SELECT s_suppkey AS k, s_name FROM supplier) "


@query("j03_lookup_new", _NEW + "SELECT k, s_name FROM w JOIN a USING (k)")
def lookup_new(spark, sf):
    return _lookup(spark, sf)[0]


@query("j03_lookup_missing", _NEW + "SELECT k FROM w WHERE k NOT IN (SELECT k FROM a)")
def lookup_missing(spark, sf):
    return _lookup(spark, sf)[1]


def _lookup(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    wanted = _events(spark, sf).where("event_type = 'signup'").select(F.col("user_id").alias("k"))
    return relations.lookup_new(wanted, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), "k")


@query("j04_cumulative_inputs", "WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), m AS (SELECT date_trunc('month', d) AS m, max(d) AS last FROM c GROUP BY 1) SELECT strftime(m, '%Y-%m') AS month, count(*) AS n FROM m JOIN c ON d <= last GROUP BY 1")
def cumulative_inputs(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("id")).distinct().withColumn("date_utc", F.unix_timestamp(F.col("id").cast("timestamp")))
    return relations.cumulative_inputs(days).groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("j11_skip_done", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def skip_done(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return relations.missing_from(table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query(
    "j12_new_apps",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey AND event_type = CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'signup' END "
    "AND (value > 150 OR value < 1 OR (event_id % 10 <> 0 AND ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 20 MINUTE) OR event_id % 10 = 0 OR ts - INTERVAL 9600 DAY >= o_orderdate))",
)
def new_apps(spark, sf):
    listing = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("title"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("signup").alias("type"), F.col("o_orderdate").alias("uploaded"))
    apps = _events(spark, sf).select(F.col("user_id").alias("title"), F.col("event_type").alias("type"), (F.col("value") > 150).alias("downloaded"), (F.col("value") < 1).alias("processed"), F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("reserved"), (F.col("ts") - F.expr("interval 9600 days")).alias("uploaded"))
    return relations.new_apps(listing, apps, "2024-01-30 00:00:00").select("o_orderkey")


@query("j13_extend_catalogue", "SELECT url AS name, page_id AS id FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, NULL FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def extend_catalogue(spark, sf):
    pages = table(spark, sf, "pages")
    return relations.extend_catalogue(pages.where("page_id % 3 = 0").select(F.col("url").alias("name"), F.col("page_id").alias("id")), pages.select(F.col("url").alias("name")))


@query("j14_upsert_conflicts", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE n_chars % 2 <> quality")
def upsert_conflicts(spark, sf):
    now = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    return relations.upsert_conflicts(now, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], ["quality"])


@query("j17_rank_join", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY'")
def rank_join(spark, sf):
    parts = table(spark, sf, "part").where("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    ranking = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return relations.rank_join(ranking, parts, "l_partkey").select("l_orderkey", "l_linenumber", "p_name")


@query("r03_unique_by_fingerprint", "SELECT sha256(text) AS fprint, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY 1")
def unique_by_fingerprint(spark, sf):
    rows = table(spark, sf, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("fprint"), "doc_id")
    return relations.unique_by(rows.withColumn("at", F.col("doc_id")), "fprint", "doc_id", "at").select("fprint", "doc_id", "n_rows")


@query("r05_distinct_sorted", "SELECT DISTINCT url FROM pages ORDER BY url")
def distinct_sorted(spark, sf):
    return relations.distinct_sorted(table(spark, sf, "pages"), "url")


@query("k11_export_ssh_keys", "SELECT CAST(doc_id AS VARCHAR) AS source, ltrim(md5(text), '0') AS n, 946684800::BIGINT AS added FROM documents")
def export_ssh_keys(spark, sf):
    keys = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("mod"), F.lit(65537).alias("e"), F.lit("2000-01-01").cast("timestamp").alias("added_at"))
    return files.export_ssh_keys(keys).select(F.array_join(F.col("source").cast("array<string>"), ",").alias("source"), "n", "added")


@query("a03_flagged_hist", "SELECT p_size AS slot, count(*) AS total, count(*) FILTER (WHERE p_retailprice > 950) AS flagged, CASE WHEN (SELECT count(*) FROM part WHERE p_retailprice > 950) > 0 THEN count(*) FILTER (WHERE p_retailprice > 950) / (SELECT count(*) FROM part WHERE p_retailprice > 950) ELSE -1.0 END AS share FROM part GROUP BY 1")
def flagged_hist(spark, sf):
    return stats.flagged_hist(table(spark, sf, "part"), F.col("p_size"), F.col("p_retailprice") > 950)


@query("a05_in_range_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS large FROM events WHERE strftime(ts, '%H:%M:%S') >= '09:00:00' AND strftime(ts, '%H:%M:%S') < '17:00:00'")
def in_range_counts(spark, sf):
    return stats.in_range_counts(_events(spark, sf), K.time_between(F.col("ts"), "09:00:00", "17:00:00"), {"errors": F.col("event_type") == "error", "large": F.col("value") > 50})


@query("a09_population_summary", "WITH p AS (SELECT o_orderpriority AS kind, o_custkey, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS d FROM orders GROUP BY 1, 2) SELECT kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS people, CAST(min(d) AS VARCHAR) AS first, CAST(max(d) AS VARCHAR) AS last, count(*) FILTER (WHERE DATE '2016-01-01' - d > 18 * 365) AS adults FROM p GROUP BY 1")
def population_summary(spark, sf):
    out = stats.population_summary(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "kind"), "o_custkey", "kind", F.to_date("o_orderdate"), "2016-01-01")
    return out.withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


@query("a14_repo_summary", "WITH c AS (SELECT l_suppkey, min(l_shipdate) AS a, max(l_shipdate) AS b FROM lineitem GROUP BY 1), i AS (SELECT user_id, count(*) FILTER (WHERE value > 50) AS o, count(*) FILTER (WHERE value <= 50) AS x FROM events GROUP BY 1) SELECT l_suppkey, strftime(a, '%Y-%m-%d') AS first, strftime(b, '%Y-%m-%d') AS last, coalesce(o, 0) AS n_open, coalesce(x, 0) AS n_closed FROM c LEFT JOIN i ON user_id = l_suppkey")
def repo_summary(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("at", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return stats.repo_summary(lines, _events(spark, sf).withColumnRenamed("user_id", "l_suppkey"), "l_suppkey", "at", F.col("value") > 50)


@query("a16_match_map", "SELECT l_orderkey, string_agg(CAST(l_quantity > 25 AS VARCHAR), ',' ORDER BY l_linenumber, l_quantity > 25) AS matches FROM lineitem GROUP BY 1")
def match_map(spark, sf):
    out = stats.match_map(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_quantity") > 25)
    return out.select("l_orderkey", F.array_join(F.transform("matches", lambda m: m.cast("string")), ",").alias("matches"))


@query("a17_pmf", "WITH c AS (SELECT p_size AS slot, count(*) AS n FROM part GROUP BY 1), s AS (SELECT slot, 0.5::DOUBLE + CASE WHEN slot >= 10 AND slot < 20 THEN 3.0::DOUBLE ELSE 0 END + 100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM part) AS v FROM (SELECT unnest(range(0, 60)) AS slot) LEFT JOIN c USING (slot)) SELECT slot, round(v / (SELECT sum(v) FROM s), 9) AS p FROM s")
def pmf(spark, sf):
    out = stats.pmf(table(spark, sf, "part"), "p_size", spark.range(60).select(F.col("id").alias("slot")), 0.5, [(10, 20, 3.0)], 100.0)
    return out.withColumn("p", F.round("p", 9))


@query(
    "w06_month_merge",
    "WITH h AS (SELECT date_trunc('day', ts) AS snap, date_trunc('month', ts) AS m, user_id, event_type AS fprint FROM events), l AS (SELECT m, max(snap) AS snap FROM h GROUP BY 1), k AS (SELECT DISTINCT m, user_id FROM h), "
    "f AS (SELECT h.m, user_id, string_agg(DISTINCT fprint, ',' ORDER BY fprint) AS ips FROM h JOIN l ON h.snap = l.snap GROUP BY 1, 2) SELECT strftime(k.m, '%Y-%m') AS month, user_id, coalesce(ips, '') AS ips FROM k LEFT JOIN f USING (m, user_id)",
)
def month_merge(spark, sf):
    hosts = _events(spark, sf).select(F.date_trunc("day", "ts").alias("snap"), "user_id", F.col("event_type").alias("ip"))
    return snapshots.month_merge(hosts, hosts, "user_id").select(F.date_format("month", "yyyy-MM").alias("month"), "user_id", F.array_join("ips", ",").alias("ips"))


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", F.concat_ws(".", *[(k % p).cast("string") for p in (3, 5, 11)]).alias("version"))


_V = "(SELECT DISTINCT o_custkey, o_orderkey % 3 AS a, o_orderkey % 5 AS b, o_orderkey % 11 AS c, a || '.' || b || '.' || c AS version FROM orders)"


@query(
    "w08_pick_versions",
    f"WITH v AS {_V}, t AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY a DESC, b DESC, c DESC) AS n FROM v), l AS (SELECT v.*, row_number() OVER (PARTITION BY v.o_custkey ORDER BY v.a DESC, v.b DESC, v.c DESC) AS n FROM v JOIN t ON t.n = 1 AND t.o_custkey = v.o_custkey AND (v.a < t.a OR v.a = t.a AND v.b < t.b)) "
    "SELECT o_custkey, version, 'top' AS pick FROM t WHERE n = 1 UNION ALL SELECT o_custkey, version, 'lower' FROM l WHERE n = 1",
)
def pick_versions(spark, sf):
    return relations.pick_versions(_versions(spark, sf), "o_custkey")


@query("p10_version_filter", f"SELECT o_custkey, version FROM {_V} WHERE a >= 1 AND (a < 2 OR a = 2 AND b <= 3)")
def version_filter(spark, sf):
    return relations.version_filter(_versions(spark, sf).distinct(), "version", low="1", high="2.3")


@query("l04_version_order", f"SELECT o_custkey, version, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY a, b, c) AS INTEGER) AS n FROM {_V}")
def version_order(spark, sf):
    from pyspark.sql import Window

    from keylake.functions.text import version_key

    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(version_key(F.col("version"))))
    return _versions(spark, sf).distinct().withColumn("n", place)


@query("w09_seq_id", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS id FROM orders")
def seq_id(spark, sf):
    return snapshots.seq_id(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "id")


@query("l03_cap_entities", "SELECT o_orderkey FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 100))")
def cap_entities(spark, sf):
    return snapshots.cap_entities(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus") == "F", 100).select("o_orderkey")


@query("p13_popular_repos", "SELECT l_partkey, count(*) AS stars FROM lineitem GROUP BY 1 HAVING count(*) >= 30")
def popular_repos(spark, sf):
    return relations.popular(table(spark, sf, "lineitem"), "l_partkey", 30)


@query("p14_needs_reparse", "SELECT doc_id, NOT CASE WHEN quality IS NULL OR lang IS NULL THEN false WHEN lang IN ('de', 'fr') THEN true ELSE n_chars <> 0 AND length(source) >= 4 END AS again FROM documents LEFT JOIN labels USING (doc_id)")
def needs_reparse(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    done = relations.is_processed(F.col("lang"), F.col("quality"), ["de", "fr"], F.col("n_chars"), F.col("source"), 4)
    return rows.select("doc_id", (~done).alias("again"))


@query("p15_select_datasets", "SELECT page_id FROM pages WHERE page_id IN (3, 5, 8) OR page_id BETWEEN 10 AND 192")
def select_datasets(spark, sf):
    return relations.select_datasets(table(spark, sf, "pages").select("page_id"), "page_id", [3, 5, 8], [(10, 192)])


@query("g05_key_family", "SELECT o_orderkey AS key_id, -1 - o_custkey AS relative, 'master' AS relation FROM orders UNION ALL SELECT -1 - o_custkey, o_orderkey, 'subkey' FROM orders")
def key_family(spark, sf):
    return relations.key_family(table(spark, sf, "orders").select(F.col("o_orderkey").alias("key_id"), (-1 - F.col("o_custkey")).alias("master_key_id")))


@query(
    "g04_tree",
    """WITH RECURSIVE e AS (SELECT doc_id // 2 AS src, doc_id AS dst FROM documents WHERE doc_id > 1),
s AS (SELECT DISTINCT doc_id FROM documents, (SELECT max(doc_id) AS m FROM documents) WHERE doc_id > greatest(m // 64, 1) AND doc_id <= m // 32),
r(seed, node, level, nodes) AS (SELECT doc_id, doc_id, 0, [doc_id] FROM s UNION ALL SELECT seed, dst, level + 1, list_append(nodes, dst) FROM r JOIN e ON src = node),
o AS (SELECT *, lag(level, 1, -1) OVER (PARTITION BY seed ORDER BY nodes) AS before FROM r)
SELECT seed, '{' || string_agg((CASE WHEN before < level THEN '' ELSE repeat('}', before - level + 1) || ',' END) || '"' || node || '":{', '' ORDER BY nodes) || repeat('}', arg_max(level, nodes) + 2) AS tree FROM o GROUP BY seed""",
)
def tree(spark, sf):
    """Trees of at most 127 nodes below the documents of one level, as their number grows with the table and not their size."""
    docs = table(spark, sf, "documents").where("doc_id > 1")
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    seeds = docs.where((F.col("doc_id") > max(top // 64, 1)) & (F.col("doc_id") <= top // 32)).select(F.col("doc_id").alias("node"))
    return graph.to_tree_json(graph.paths(docs.select(F.expr("doc_id div 2").alias("src"), F.col("doc_id").alias("dst")), seeds))


@query("t01_stream_first_seen", "SELECT DISTINCT user_id || '-' || event_type AS fprint FROM events")
def stream_first_seen(spark, sf):
    schema = _events(spark, sf).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("fprint"))
    return streams.once(spark, streams.stream_first_seen(stream, "fprint"))


@query("t02_stream_trailing_counts", "WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS s, ts FROM events, (SELECT unnest(range(0, 6)) AS k)) SELECT CAST(epoch(s) AS BIGINT) AS start, user_id, count(*) AS n FROM w GROUP BY 1, 2")
def stream_trailing_counts(spark, sf):
    stream = spark.readStream.schema(_events(spark, sf).schema).parquet(f"{sf}/events.parquet*")
    out = streams.once(spark, streams.stream_trailing_counts(stream, "ts", "user_id", "6 hours", "1 hour"), "complete")
    return out.select(F.unix_timestamp("start").alias("start"), "user_id", "n")


@query("t02_stream_tumbling", "SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf):
    stream = spark.readStream.schema(_events(spark, sf).schema).parquet(f"{sf}/events.parquet*")
    out = streams.once(spark, streams.stream_trailing_counts(stream, "ts", "user_id", "6 hours", None), "complete")
    return out.select(F.unix_timestamp("start").alias("start"), "user_id", "n")


@query(
    "t02_stream_sessions",
    """WITH b AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 2 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM b)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 2 DAY) AS ends, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf):
    stream = spark.readStream.schema(_events(spark, sf).schema).parquet(f"{sf}/events.parquet*")
    out = streams.once(spark, streams.stream_trailing_counts(stream, "ts", "user_id", gap="2 days"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("ends"), "n")


@query("t07_dead_letter", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS fail_cnt FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def dead_letter(spark, sf):
    rows = _events(spark, sf).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("fail_cnt"))
    return streams.dead_letter(rows, 90)[1]


@query("t07_retry", "SELECT event_id, CAST(1 + CAST(json_extract(props, '$.k') AS BIGINT) AS BIGINT) AS fail_cnt, CAST(json_extract(props, '$.k') AS BIGINT) >= 90 AS dead FROM events WHERE event_id % 3 = 0")
def retry(spark, sf):
    rows = _events(spark, sf).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("fail_cnt"))
    sink = f"{shared_dir(spark)}/keylake-dead-{uuid.uuid4().hex}"
    left = streams.retry(rows, rows.where("event_id % 3 = 0"), "event_id", 90, sink)
    dead = spark.read.schema(left.schema).parquet(sink)
    return left.withColumn("dead", F.lit(False)).unionByName(dead.withColumn("dead", F.lit(True)))


@query("t06_progress", "SELECT count(*) AS n FROM events WHERE user_id IS NOT NULL")
def progress(spark, sf):
    log = streams.ProgressLog()
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema(_events(spark, sf).schema).parquet(f"{sf}/events.parquet*").where("user_id is not null")
        streams.once(spark, stream.select("user_id"))
        for _ in range(100):  # progress is told after the stream has ended
            if log.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    return spark.createDataFrame([(sum(n for _, n, _ in log.rows),)], "n long")  # one row of counts


@query(
    "t04_stream_assoc",
    "WITH s AS (SELECT DISTINCT user_id, event_type AS item, CAST(event_id % 3 AS BIGINT) AS d FROM events WHERE (user_id + event_id) % 4 <> 0), c AS (SELECT user_id, d, row_number() OVER w AS ix, lead(d) OVER w AS nx FROM (SELECT DISTINCT user_id, d FROM s) WINDOW w AS (PARTITION BY user_id ORDER BY d)), "
    "r AS (SELECT s.*, ix, nx, ix - row_number() OVER (PARTITION BY s.user_id, item ORDER BY ix) AS run FROM s JOIN c USING (user_id, d)) SELECT user_id, item, min(d) AS found_at, arg_max(coalesce(nx, -1), ix) AS lost_at FROM r GROUP BY user_id, item, run",
)
def stream_assoc(spark, sf):
    at = f"{shared_dir(spark)}/keylake-assoc-{uuid.uuid4().hex}"
    rows = _events(spark, sf).where("(user_id + event_id) % 4 <> 0").select("user_id", F.col("event_type").alias("item"), (F.col("event_id") % 3).alias("d"))
    for k in range(3):
        rows.where(F.col("d") == k).write.mode("append").parquet(f"{at}/in")
        streams.stream_assoc(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), "user_id", "item", "d", f"{at}/out", f"{at}/checkpoint")
    return streams.assoc_table(spark, f"{at}/out", "user_id", "item").select("user_id", "item", "found_at", F.coalesce("lost_at", F.lit(-1)).alias("lost_at"))
