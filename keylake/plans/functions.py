"""Queries for column functions and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.functions import keys as K
from keylake.functions import text as T
from keylake.operators import snapshots
from keylake.plans.registry import query
from keylake.session import table
from keylake.sources import files

DOCS_HEX = "SELECT doc_id, ltrim(md5(text), '0') AS h FROM documents"


def _moduli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's md5 as a 128-bit modulus."""
    return table(spark, sf_dir, "documents").select("doc_id", K.hex_canon(F.concat(F.lit("0x"), F.upper(F.md5(F.col("text").cast("binary"))))).alias("h"))


@query("f01_hex_canon", DOCS_HEX)
def hex_canon(spark, sf):
    return _moduli(spark, sf)


@query("f02_bit_length", f"SELECT doc_id, CAST(4 * (length(h) - 1) + CASE WHEN h[1] >= '8' THEN 4 WHEN h[1] >= '4' THEN 3 WHEN h[1] >= '2' THEN 2 ELSE 1 END AS INTEGER) AS bits FROM ({DOCS_HEX})")
def bit_length(spark, sf):
    return _moduli(spark, sf).select("doc_id", K.bit_length(F.col("h")).alias("bits"))


@query("f03_msb", f"SELECT doc_id, CASE WHEN length(h) % 2 = 1 THEN h[1] ELSE h[1:2] END AS top FROM ({DOCS_HEX})")
def msb(spark, sf):
    return _moduli(spark, sf).select("doc_id", K.msb(F.col("h")).alias("top"))


@query("f04_hex_mod", f"SELECT doc_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(h, ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 97) AS BIGINT) AS residue FROM ({DOCS_HEX})")
def hex_mod(spark, sf):
    return _moduli(spark, sf).select("doc_id", K.hex_mod(F.col("h"), 97).alias("residue"))


def _residues() -> str:
    """SQL: is every residue of digits d a power of 65537."""
    return " AND ".join(f"list_contains({sorted(K._allowed(p))}, list_reduce(list_prepend(0::BIGINT, d), lambda a, x: (a * 16 + x) % {p}))" for p in K.PRIMES)


@query("f05_weak_key_flag", f"SELECT doc_id, {_residues()} AS flagged FROM (SELECT doc_id, list_transform(string_split(CASE WHEN doc_id % 3 = 0 THEN '10001' WHEN doc_id % 3 = 1 THEN '100020001' ELSE h END, ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)) AS d FROM ({DOCS_HEX}))")
def weak_key(spark, sf):
    k = F.col("doc_id") % 3  # two thirds are powers of the generator
    return _moduli(spark, sf).select("doc_id", K.weak_key_flag(F.when(k == 0, "10001").when(k == 1, "100020001").otherwise(F.col("h"))).alias("flagged"))


@query("f07_pgp_key_id", "SELECT doc_id, lpad(ltrim(right(md5(text), 8), '0'), 16, '0') AS key_id FROM documents")
def pgp_key_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.pgp_key_id(F.right(F.md5(F.col("text").cast("binary")), F.lit(8))).alias("key_id"))


@query("f10_url_parts", r"""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
 string_split(regexp_replace(url, '/\s*$', ''), '/')[-1] AS last FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.host(u).alias("host"), T.path(u).alias("path"), T.last_segment(u).alias("last"))


@query("f12_size_bytes", "SELECT p_partkey, CAST(floor((p_size + 0.5) * CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1048576 END) AS BIGINT) AS bytes FROM part")
def size_bytes(spark, sf):
    unit = F.element_at(F.array(F.lit("B"), F.lit("KB"), F.lit("MB")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", T.size_bytes(F.concat((F.col("p_size") + F.lit(0.5)).cast("string"), F.lit(" "), unit)).alias("bytes"))


@query("f14_version_order", """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7, o_orderkey % 13, o_orderkey) AS INTEGER) AS n FROM orders""")
def version_order(spark, sf):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    version = F.concat_ws(":", (k % 7).cast("string"), (k % 13).cast("string"), F.lit("0"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", T.version_parts(version).alias("v"))
    return rows.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("v", "o_orderkey")).alias("n"))


@query("f17_category", "SELECT doc_id, CASE WHEN contains(text, 'token') THEN 'secret' WHEN contains(text, 'Licensed') THEN 'license' WHEN contains(text, '@') THEN 'mail' END AS category FROM documents")
def category(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.category(F.col("text"), [("token", "secret"), ("Licensed", "license"), ("@", "mail")]).alias("category"))


@query(
    "f17_categories",
    """WITH c AS (SELECT doc_id, CASE WHEN contains(lower(text), 'token') THEN 'secret' WHEN contains(lower(text), 'licensed') THEN 'license' WHEN contains(text, '@') THEN 'mail' END AS a, CASE WHEN contains(text, '#') THEN 'tag' WHEN contains(lower(text), 'e') THEN 'plain' END AS b FROM documents)
SELECT doc_id, CASE WHEN b IS NOT NULL THEN a END AS "first", CASE WHEN a IS NOT NULL THEN b END AS "second", CASE WHEN a IS NULL THEN 'unknown_first' WHEN b IS NULL THEN 'unknown_second' END AS reject_reason FROM c""",
)
def categories(spark, sf):
    found = T.categories(F.col("text"), [("Token", "secret"), ("Licensed", "license"), ("@", "mail")], [("#", "tag"), ("E", "plain")])
    return table(spark, sf, "documents").select("doc_id", found.alias("c")).select("doc_id", "c.*")


_SUM = "list_sum(list_transform([{w}], lambda p: CAST(id[p // 100] AS INTEGER) * (p % 100))) % 11"


@query(
    "f18_national_id_check",
    "WITH i AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + o_custkey AS VARCHAR), 11, '3') AS id FROM orders), "
    f"s AS (SELECT o_orderkey, id, {_SUM.format(w=', '.join(str((k + 1) * 100 + w) for k, w in enumerate((1, 2, 3, 4, 5, 6, 7, 8, 9, 1))))} AS a, "
    f"{_SUM.format(w=', '.join(str((k + 1) * 100 + w) for k, w in enumerate((3, 4, 5, 6, 7, 8, 9, 1, 2, 3))))} AS b FROM i) "
    "SELECT o_orderkey, CAST(CASE WHEN a < 10 THEN a WHEN b < 10 THEN b ELSE 0 END AS INTEGER) = CAST(id[11] AS INTEGER) AS valid FROM s",
)
def national_id(spark, sf):
    made = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 11, "3")
    return table(spark, sf, "orders").select("o_orderkey", K.national_id_check(made).alias("valid"))


@query("f19_digests", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM documents")
def digests(spark, sf):
    made = K.fingerprints(F.col("text").cast("binary"))
    return table(spark, sf, "documents").select("doc_id", *[c.alias(name) for name, c in made.items()])


@query("l01_bigint_order", f"SELECT doc_id, row_number() OVER (ORDER BY h IS NULL, length(h), h, doc_id) - 1 AS n FROM (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN h[:1 + doc_id % 20] END AS h FROM ({DOCS_HEX}))")
def bigint_order(spark, sf):
    rows = _moduli(spark, sf).select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.substring("h", F.lit(1), (1 + F.col("doc_id") % 20).cast("int"))).alias("h"))
    return snapshots.order_by_bigint(rows, "h", "doc_id").select("doc_id", F.col("id").alias("n"))


@query("p09_time_between", "SELECT event_id FROM events WHERE strftime(ts, '%H:%M:%S') >= '23:30:00' OR strftime(ts, '%H:%M:%S') < '04:15:00'")
def time_between(spark, sf):
    return table(spark, sf, "events").where(K.time_between(F.col("ts"), "23:30:00", "04:15:00")).select("event_id")


@query("s01_hosts_ragged", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS ip, event_type AS fprint FROM events")
def hosts_ragged(spark, sf):
    lines = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    lines = lines.select(F.concat_ws(",", F.col("user_id").cast("string"), F.array_join(F.transform("t", lambda x: F.concat(F.lit(" 0x"), F.upper(x))), ",")).alias("value"))
    return files.parse_hosts(lines)


@query("s02_hosts_col2", "SELECT CAST(user_id AS VARCHAR) AS ip, event_type AS fprint, count(*) AS n FROM events GROUP BY ALL")
def hosts_col2(spark, sf):
    lines = table(spark, sf, "events").select(F.concat_ws(",", F.col("user_id").cast("string"), F.lit("x"), F.upper("event_type")).alias("value"))
    return files.parse_hosts(lines, "col2").groupBy("ip", "fprint").agg(F.count("*").alias("n"))


@query("s03_cert_archive", "SELECT sha1(text) AS fprint, CASE WHEN doc_id % 10 <> 0 THEN md5(text) END AS digest FROM documents")
def cert_archive(spark, sf):
    payload = F.when(F.col("doc_id") % 10 != 0, F.base64(F.col("text").cast("binary"))).otherwise("not base64!")
    lines = table(spark, sf, "documents").select(F.concat_ws(",", F.upper(F.sha1(F.col("text").cast("binary"))), payload).alias("value"))
    return files.parse_archive(lines).select("fprint", F.md5("der").alias("digest"))


@query("s12_tolerant_json", "SELECT 'good' AS side, CAST(user_id AS VARCHAR) AS what, count(*) AS n FROM (SELECT DISTINCT user_id FROM events WHERE event_id % 11 <> 0) GROUP BY ALL UNION ALL SELECT 'bad', substr('{\"id\":' || event_id || ' ' || props, 9, 11), count(*) FROM events WHERE event_id % 11 = 0 GROUP BY ALL")
def tolerant_json(spark, sf):
    sound = F.to_json(F.struct(F.lit(None).cast("string").alias("note"), F.col("user_id").alias("id"), F.col("props").alias("props")), {"ignoreNullFields": "false"})
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 11 == 0, F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(" "), "props")).otherwise(sound).alias("value"))
    good, bad = files.read_json_tolerant(lines, "note string, id long, props string", id_col="id")
    what = good.select(F.lit("good").alias("side"), F.col("id").cast("string").alias("what")).unionByName(bad.select(F.lit("bad").alias("side"), F.col("serial").alias("what")))
    return what.groupBy("side", "what").agg(F.count("*").alias("n"))


@query("s13_page_anchors", """SELECT page_id, CAST(p AS INTEGER) AS pos, a[p + 1] AS href FROM (SELECT page_id, a, unnest(range(len(a))) AS p FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages))""")
def page_anchors(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(files.anchors(F.col("html"))).alias("pos", "href"))


@query("s21_repo_list", r"""SELECT DISTINCT s[-2] AS owner, s[-1] AS repo FROM (SELECT string_split(regexp_replace(url, '/\s*$', ''), '/') AS s FROM pages)""")
def repo_list(spark, sf):
    parts = F.split(T.strip_final_slash(F.col("url")), "/")
    return table(spark, sf, "pages").select(F.element_at(parts, -2).alias("owner"), F.element_at(parts, -1).alias("repo")).dropDuplicates()
