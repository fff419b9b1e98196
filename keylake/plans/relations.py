"""Queries for joins, dedupe, sets, upserts and graphs.

documents stand for a certificate archive (sha1 of text as fingerprint), events for host snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.operators import graph, relations, stats
from keylake.plans.registry import query
from keylake.session import materialize, table
from keylake.sources import scans


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


@query("j01_attach_hosts", "SELECT c_custkey AS fprint, coalesce(string_agg(DISTINCT CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)), '') AS ips FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def attach_hosts(spark, sf):
    hosts = _orders(spark, sf).select(F.col("o_custkey").alias("fprint"), F.col("o_orderkey").cast("string").alias("ip"))
    return relations.attach_hosts(table(spark, sf, "customer").select(F.col("c_custkey").alias("fprint")), hosts).select("fprint", F.array_join("ips", ",").alias("ips"))


@query("j02_in_snapshot", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')")
def in_snapshot(spark, sf):
    hosts = table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return relations.in_snapshot(table(spark, sf, "customer").select("c_custkey"), hosts, "c_custkey")


@query("j05_key_packages", "SELECT s_suppkey AS key_id, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), '|' ORDER BY CAST(l_partkey AS VARCHAR)), '') AS packages, count(DISTINCT l_partkey) AS n FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey")
def key_packages(spark, sf):
    signed = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key_id"), F.col("l_partkey").alias("package"))
    found = relations.key_packages(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key_id")), signed)
    return found.select("key_id", F.array_join("packages", "|").alias("packages"), "n")


@query("j06_missing_keys", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def missing_keys(spark, sf):
    return relations.missing_from(table(spark, sf, "customer").select("c_custkey"), _orders(spark, sf).where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").distinct()


@query("j07_pending_keys", "SELECT DISTINCT user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = user_id)")
def pending_keys(spark, sf):
    return relations.missing_from(table(spark, sf, "events").select("user_id").distinct(), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("user_id")), "user_id")


@query("j08_flagged_packages", "SELECT DISTINCT l_suppkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0")
def flagged_packages(spark, sf):
    keys = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return relations.flagged_packages(keys, table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("j09_chain_ids", "SELECT l_orderkey, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY l_linenumber, p_partkey) AS chain FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def chain_ids(spark, sf):
    dictionary = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("id"))
    found = relations.chain_ids(table(spark, sf, "lineitem"), dictionary, "l_orderkey", "l_linenumber", "l_partkey")
    return found.select("l_orderkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("chain"))


@query("j14_upsert", "WITH c AS (SELECT user_id, max(value) AS v FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15' GROUP BY 1), n AS (SELECT user_id, max(value) AS v FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM c WHERE user_id NOT IN (SELECT user_id FROM n)")
def upsert(spark, sf):
    e = table(spark, sf, "events")
    part = lambda c: e.where(c).groupBy("user_id").agg(F.max("value").alias("v"))
    return relations.upsert(part("ts < timestamp_ntz'2024-01-15'"), part("to_date(ts) = date'2024-01-15'"), ["user_id"])


@query("j15_fill_nulls", "SELECT d.doc_id, coalesce(l.quality, CAST(d.n_chars % 2 AS INTEGER)) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def fill_nulls(spark, sf):
    docs = table(spark, sf, "documents")
    given = docs.select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return relations.fill_nulls(given, docs.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality")), ["doc_id"], ["quality"])


@query("j16_impact", "SELECT DISTINCT c_custkey, p_partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE c_acctbal < 0 AND p_size > 40")
def impact(spark, sf):
    keys = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    orders = _orders(spark, sf).select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf, "part").where("p_size > 40").select("p_partkey")
    return relations.impact(keys, orders, lines, parts, keep=["c_custkey", "p_partkey"])


@query("j18_compare_rows", "SELECT d.doc_id, (d.n_chars % 2 = 1) IS NOT DISTINCT FROM (l.quality = 1) AS same FROM documents d JOIN labels l USING (doc_id)")
def compare_rows(spark, sf):
    a = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") % 2 == 1).alias("f"))
    return relations.compare_rows(a, table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("f")), "doc_id", ["f"])


@query("r01_unique_by_modulus", "SELECT sha1(text) AS fprint, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, count(*) AS n_rows, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS all_ids FROM documents GROUP BY 1")
def unique_by(spark, sf):
    rows = table(spark, sf, "documents").select(F.sha1(F.col("text").cast("binary")).alias("fprint"), "doc_id", "source")
    return relations.unique_by(rows, "fprint", "doc_id", "doc_id").select("fprint", "doc_id", "source", "n_rows", F.array_join(F.transform("all_values", lambda x: x.cast("string")), ",").alias("all_ids"))


@query("r02_first_wins", "SELECT md5(text) AS key, arg_min(doc_id, doc_id) AS doc_id FROM documents GROUP BY 1")
def first_wins(spark, sf):
    return relations.first_wins(table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("key"), "doc_id"), "key", "doc_id")


@query("r04_drop_duplicates", "SELECT DISTINCT lang, source FROM documents")
def drop_duplicates(spark, sf):
    return relations.drop_duplicates(table(spark, sf, "documents").select("lang", "source"), "lang", "source")


@query("e01_set_report", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND day(ts) < 8), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND day(ts) > 25) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'b' WHEN b.user_id IS NULL THEN 'a' ELSE 'both' END AS membership FROM a FULL JOIN b ON a.user_id = b.user_id")
def set_report(spark, sf):
    e = table(spark, sf, "events")
    return relations.set_report(e.where("event_type = 'error' and day(ts) < 8"), e.where("event_type = 'purchase' and day(ts) > 25"), "user_id")


@query("e03_union_corpora", "SELECT 'docs' AS corpus, doc_id AS id, lang FROM documents UNION ALL SELECT 'pages', page_id, NULL FROM pages")
def union_corpora(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return relations.union_corpora(docs=docs, pages=table(spark, sf, "pages").select(F.col("page_id").alias("id")))


@query(
    "e03_classified",
    """SELECT 'docs' AS corpus, CAST(doc_id AS VARCHAR) AS record_id, source AS name, NULL::VARCHAR AS date, ltrim(md5(text), '0') AS n_hex, sha1(text) AS fprint, '{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || '}' AS attrs FROM documents
UNION ALL SELECT 'orders', CAST(o_orderkey AS VARCHAR), o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR), NULL, NULL, '{"o_custkey":' || o_custkey || '}' FROM orders""",
)
def classified(spark, sf):
    docs, none = table(spark, sf, "documents"), F.lit(None).cast("string")
    n = F.md5(F.col("text").cast("binary"))
    a = scans.classified(docs, "docs", F.col("doc_id"), n, F.lit("10001"), F.sha1(F.col("text").cast("binary")), F.col("source"), none, F.lit(False), ["lang", "n_chars"])
    b = scans.classified(_orders(spark, sf), "orders", F.col("o_orderkey"), none, none, none, F.col("o_orderstatus"), F.to_date("o_orderdate"), F.lit(None).cast("boolean"), ["o_custkey"])
    out = materialize(a.unionByName(b), "classified")
    return out.select("corpus", "record_id", "source.name", "source.date", "n_hex", "fprint", F.to_json("attrs").alias("attrs"))


@query("t04_assoc_history", """WITH s AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS d FROM events),
c AS (SELECT user_id, d, row_number() OVER (PARTITION BY user_id ORDER BY d) AS ix, lead(d) OVER (PARTITION BY user_id ORDER BY d) AS nx FROM (SELECT DISTINCT user_id, d FROM s)),
r AS (SELECT s.*, ix, nx, ix - row_number() OVER (PARTITION BY s.user_id, event_type ORDER BY ix) AS run FROM s JOIN c USING (user_id, d))
SELECT user_id, event_type, CAST(min(d) AS VARCHAR) AS found_at, CAST(arg_max(coalesce(nx, DATE '9999-01-01'), ix) AS VARCHAR) AS lost_at FROM r GROUP BY user_id, event_type, run""")
def assoc_history(spark, sf):
    seen = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("d"))
    out = relations.assoc_history(seen, "user_id", "event_type", "d")
    return out.select("user_id", "event_type", F.col("found_at").cast("string").alias("found_at"), F.coalesce(F.col("lost_at").cast("string"), F.lit("9999-01-01")).alias("lost_at"))


@query("g01_trust_levels", """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
t(node, level) AS (SELECT 'r' || r_regionkey, 0 FROM region WHERE r_regionkey < 3 UNION SELECT e.dst, t.level + 1 FROM t JOIN e ON e.src = t.node) SELECT node AS subject, CAST(min(level) AS INTEGER) AS level FROM t GROUP BY node""")
def trust_levels(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf, "nation").select(name("r", "n_regionkey").alias("issuer"), name("n", "n_nationkey").alias("subject"))
    edges = edges.unionByName(table(spark, sf, "customer").select(name("n", "c_nationkey").alias("issuer"), name("c", "c_custkey").alias("subject")))
    edges = edges.unionByName(_orders(spark, sf).select(name("c", "o_custkey").alias("issuer"), name("o", "o_orderkey").alias("subject")))
    return graph.trust_levels(edges, table(spark, sf, "region").where("r_regionkey < 3").select(name("r", "r_regionkey").alias("subject")))


@query("g02_affected", "WITH RECURSIVE d AS (SELECT doc_id AS library, doc_id // 2 AS needs FROM documents WHERE doc_id > 1), a(library, level) AS (SELECT library, 1 FROM d WHERE needs = 3 UNION SELECT d.library, a.level + 1 FROM a JOIN d ON d.needs = a.library) SELECT library, CAST(min(level) AS INTEGER) AS level FROM a GROUP BY library")
def affected(spark, sf):
    docs = table(spark, sf, "documents").where("doc_id > 1")
    deps = docs.select(F.col("doc_id").alias("library"), F.expr("doc_id div 2").alias("needs"))
    return graph.affected(deps, docs.where("doc_id = 3").select(F.col("doc_id").alias("library")))


@query("g03_dependency_index", "SELECT l_partkey, count(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) AS dependents FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) GROUP BY 1")
def dependency_index(spark, sf):
    index = relations.dependency_index(table(spark, sf, "lineitem"), ["l_partkey"], "l_orderkey")
    return index.select("l_partkey", "n", F.array_join(F.transform("dependents", lambda x: x.cast("string")), ",").alias("dependents"))


@query("j18_defaults", "SELECT d.doc_id, coalesce(upper(d.lang), 'NONE') || coalesce(l.quality, 1) = CASE WHEN l.toxic = 1 THEN 'NONE' ELSE 'EN' END || 1 AS same FROM documents d JOIN labels l USING (doc_id)")
def compare_with_defaults(spark, sf):
    labels = table(spark, sf, "labels")
    a = table(spark, sf, "documents").select("doc_id", "lang").join(labels.select("doc_id", "quality"), "doc_id")
    b = labels.select("doc_id", F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.lit("en")).alias("lang"), F.lit(1).alias("quality"))
    return relations.compare_rows(a, b, "doc_id", ["lang", "quality"], {"lang": "NONE", "quality": 1}, {"lang": F.upper})


@query("j01_attached_hosts", "SELECT DISTINCT c_custkey AS fprint, o_orderkey AS ip FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def attached_hosts(spark, sf):
    hosts = _orders(spark, sf).select(F.col("o_custkey").alias("fprint"), F.col("o_orderkey").alias("ip"))
    return relations.attached_hosts(table(spark, sf, "customer").select(F.col("c_custkey").alias("fprint")), hosts)


def _parts_sql(rows: str, keys: str, value: str, size: int) -> str:
    """SQL of the values of rows in lists of size: keys, part, n and the list joined."""
    placed = f"SELECT *, (row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1) // {size} AS part FROM ({rows})"
    return f"SELECT {keys}, part, count(*) AS n, string_agg(CAST({value} AS VARCHAR), ',' ORDER BY {value}) AS joined FROM ({placed}) GROUP BY ALL"


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumn("joined", F.array_join(F.transform("values", lambda x: x.cast("string")), ",")).drop("values")


@query("j01_hosts_in_parts", _parts_sql("SELECT DISTINCT event_type AS fprint, user_id AS ip FROM events", "fprint", "ip", 10) + " UNION ALL SELECT r_name, 0, 0, '' FROM region")
def hosts_in_parts(spark, sf):
    """A handful of certificates with a large part of all hosts each, and some without."""
    hosts = table(spark, sf, "events").select(F.col("event_type").alias("fprint"), F.col("user_id").alias("ip"))
    certs = hosts.select("fprint").unionByName(table(spark, sf, "region").select(F.col("r_name").alias("fprint")))
    return _joined(relations.attached_in_parts(certs, hosts, "fprint", "ip", 10))


@query("j05_packages_in_parts", _parts_sql("SELECT DISTINCT l_returnflag AS key_id, l_partkey AS package FROM lineitem", "key_id", "package", 50))
def packages_in_parts(spark, sf):
    signed = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("key_id"), F.col("l_partkey").alias("package"))
    return _joined(relations.attached_in_parts(signed, signed, "key_id", "package", 50))


@query("r01_unique_in_parts", "SELECT p.*, first, n_rows FROM (" + _parts_sql("SELECT lang, doc_id FROM documents", "lang", "doc_id", 64) + ") p JOIN (SELECT lang, min(doc_id) AS first, count(*) AS n_rows FROM documents GROUP BY 1) f ON f.lang IS NOT DISTINCT FROM p.lang")
def unique_in_parts(spark, sf):
    first, parts = relations.unique_in_parts(table(spark, sf, "documents").select("lang", "doc_id", F.col("doc_id").alias("first")), "lang", "first", "doc_id", 64)
    first = first.select(F.col("lang").alias("__lang"), "first", "n_rows")
    return _joined(parts.join(first, F.col("lang").eqNullSafe(F.col("__lang"))).drop("__lang"))


@query("g03_dependents_in_parts", _parts_sql("SELECT DISTINCT l_linestatus, l_linenumber, l_orderkey FROM lineitem", "l_linestatus, l_linenumber", "l_orderkey", 100))
def dependents_in_parts(spark, sf):
    return _joined(relations.lists_in_parts(table(spark, sf, "lineitem"), ["l_linestatus", "l_linenumber"], "l_orderkey", 100))


def _ordered_sql(rows: str, key: str, order: str, value: str, size: int) -> str:
    """SQL of all values v of rows (key, o, v) by o, then v, in lists of size."""
    placed = f"SELECT {key}, {order} AS o, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {order}, {value}) - 1 AS place FROM ({rows})"
    return f"SELECT {key}, place // {size} AS part, count(*) AS n, string_agg(CAST(v AS VARCHAR), ',' ORDER BY place) AS joined FROM ({placed}) GROUP BY ALL"


@query("a16_matches_in_parts", _ordered_sql("SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS line, l_quantity > 25 AS f FROM lineitem", "l_suppkey", "line", "f", 64))
def matches_in_parts(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"), "l_quantity")
    return _joined(stats.matches_in_parts(lines, "l_suppkey", "line", F.col("l_quantity") > 25, 64))


@query("a13_repos_in_parts", "SELECT p.*, total, average FROM (" + _parts_sql("SELECT DISTINCT l_suppkey, CAST(l_partkey AS VARCHAR) AS repo FROM lineitem", "l_suppkey", "repo", 64) + ") p JOIN (SELECT l_suppkey, CAST(sum(l_quantity) AS DOUBLE) AS total, avg(l_quantity) AS average FROM lineitem GROUP BY 1) USING (l_suppkey)")
def repos_in_parts(spark, sf):
    totals, parts = stats.contributors_in_parts(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", 64)
    return _joined(parts.join(totals.withColumn("total", F.col("total").cast("double")), "l_suppkey"))


@query("j09_chains_in_parts", _ordered_sql("SELECT l_returnflag, l_linenumber, p_partkey FROM lineitem JOIN part ON p_partkey = l_partkey", "l_returnflag", "l_linenumber", "p_partkey", 100))
def chains_in_parts(spark, sf):
    """Three leaves, each with a third of all links."""
    dictionary = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("id"))
    return _joined(relations.chains_in_parts(table(spark, sf, "lineitem"), dictionary, "l_returnflag", "l_linenumber", "l_partkey", size=100))


_H = "(SELECT date_trunc('day', ts) AS snap, date_trunc('month', ts) AS m, user_id % 7 AS fprint, event_id AS ip FROM events)"


@query(
    "w06_month_in_parts",
    f"SELECT strftime(k.m, '%Y-%m') AS month, fprint, coalesce(part, 0) AS part, coalesce(n, 0) AS n, coalesce(joined, '') AS joined FROM (SELECT DISTINCT m, fprint FROM {_H}) k LEFT JOIN ("
    + _parts_sql(f"SELECT DISTINCT m, fprint, ip FROM {_H} JOIN (SELECT max(snap) AS snap FROM {_H} GROUP BY m) USING (snap)", "m, fprint", "ip", 10)
    + ") USING (m, fprint)",
)
def month_in_parts(spark, sf):
    e = table(spark, sf, "events")
    hosts = e.select(F.date_trunc("day", "ts").alias("snap"), (F.col("user_id") % 7).alias("fprint"), F.col("event_id").alias("ip"))
    return _joined(relations.month_in_parts(hosts, hosts, size=10)).withColumn("month", F.date_format("month", "yyyy-MM"))
