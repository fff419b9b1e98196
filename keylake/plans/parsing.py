"""Queries for parsers, scan records, markup and further functions: inputs in their formats are made from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.functions import keys as K
from keylake.functions import text as T
from keylake.parsers import frames
from keylake.operators import relations
from keylake.plans.registry import query
from keylake.session import materialize, spread, table
from keylake.sources import files, keyfiles, markup, scans


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("m", F.md5(F.col("text").cast("binary")))


_D = "(SELECT *, md5(text) AS m FROM documents)"


@query("f06_big_integers", "WITH t AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 AS VARCHAR), 12, '1') AS s FROM orders) SELECT o_orderkey, 'hex' AS encoding, s AS n FROM t UNION ALL SELECT o_orderkey, 'base64', ltrim(lower(hex(from_base64(s))), '0') FROM t UNION ALL SELECT o_orderkey, 'decimal', lower(to_hex(CAST(s AS BIGINT))) FROM t")
def big_integers(spark, sf):
    made = table(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") * 7919).cast("string"), 12, "1").alias("s"))
    return made.select("o_orderkey", F.explode(K.big_integers(F.col("s"))).alias("r")).select("o_orderkey", "r.*")


@query("f08_package_id", "SELECT doc_id, source || ':' || lang || ':' || doc_id AS id FROM documents")
def package_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.package_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("id"))


@query(
    "f09_coordinates",
    r"WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS h FROM pages), s AS (SELECT *, string_split(h, '.') AS p FROM h) "
    "SELECT page_id, array_to_string(p[:-2], '.') AS parent, p[-1] AS leaf, array_to_string(p[:-2], '.') AS \"group\", p[-1] AS artifact, CAST(page_id AS VARCHAR) AS version FROM s",
)
def coordinates(spark, sf):
    host = T.host(F.col("url"))
    parent, leaf = T.split_group(host)
    at = F.concat(F.lit("/"), F.replace(host, F.lit("."), F.lit("/")), F.lit("/"), F.col("page_id").cast("string"), F.lit("/x.pom"))
    return table(spark, sf, "pages").select("page_id", parent.alias("parent"), leaf.alias("leaf"), T.coordinates(at).alias("c")).select("page_id", "parent", "leaf", "c.*")


@query("f11_dates", "SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'soon' END AS day, CASE WHEN event_id % 11 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS epoch FROM events")
def dates(spark, sf):
    text = F.when(F.col("event_id") % 11 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, sf, "events").select("event_id", T.date_part(text).alias("day"), T.tolerant_epoch(text).alias("epoch"))


@query("f13_app_title", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name || ' Pro' ELSE p_name END AS app, CASE p_partkey % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'beta' ELSE 'pro' END AS kind FROM part")
def app_title(spark, sf):
    k, version = F.col("p_partkey") % 3, F.concat(F.col("p_size").cast("string"), F.lit(".1"))
    title = F.when(k == 0, F.concat("p_name", F.lit(" 12 Free"))).when(k == 1, F.concat("p_name", F.lit(" "), version, F.lit(" BETA"))).otherwise(F.concat("p_name", F.lit(" Pro")))
    return table(spark, sf, "part").select("p_partkey", T.app_name(title, version).alias("app"), T.version_type(title).alias("kind"))


@query("f15_slug", r"SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || ' & ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CAST(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT) AS n FROM customer")
def slug(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", T.slug(F.concat("c_name", F.lit(" & "), "c_mktsegment")).alias("slug"), T.digits(F.col("c_name")).alias("n"))


@query("f16_tolerant_values", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS BIGINT) AS id, CASE WHEN event_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS first_known FROM events")
def tolerant_values(spark, sf):
    known = T.without_nulls(F.array(F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("string")), F.col("event_type")))
    first = T.first_of(known)
    return table(spark, sf, "events").select("event_id", T.tolerant_long(first).alias("id"), first.alias("first_known"))


@query("f20_experiment_name", "SELECT page_id, '443-scan-' || page_id AS name FROM pages")
def experiment_name(spark, sf):
    file = F.concat(F.lit("/in/"), F.substring(F.md5(F.col("url").cast("binary")), 1, 8), F.lit("-443-scan-"), F.col("page_id").cast("string"), F.lit(".json.gz"))
    return table(spark, sf, "pages").select("page_id", T.experiment_name(file).alias("name"))


@query("f21_json_moduli", f"SELECT doc_id, path, kind, CASE pos WHEN 0 THEN m WHEN 1 THEN '1' || doc_id || '0000000000000000000000' ELSE to_base64(unhex(m)) END AS value FROM {_D}, (VALUES (0, '$.a[0].key.n', 'mod'), (1, '$.mod', 'mod'), (2, '$.certs[0]', 'cert'), (3, '$.certs[1]', 'cert')) v(pos, path, kind)")
def json_moduli(spark, sf):
    cert = F.base64(F.unhex("m"))
    text = F.concat(F.lit('{"a": [{"key": {"n": "'), "m", F.lit('"}}], "mod" : 1'), F.col("doc_id").cast("string"), F.lit('0000000000000000000000, "certs": ["'), cert, F.lit('", "'), cert, F.lit('"], "cn": "no \\"n\\": 1", "modes": null}'))
    return _docs(spark, sf).select("doc_id", F.explode(keyfiles.json_keys(text)).alias("k")).select("doc_id", "k.*")


@query("f22_typed_json", "SELECT event_id, '{\"at\":' || CAST(floor(epoch(ts)) AS BIGINT) || ',\"day\":\"' || strftime(ts, '%Y-%m-%d') || '\",\"price\":\"' || event_id || '.00\",\"who\":[' || user_id || ']}' AS json FROM events")
def typed_json(spark, sf):
    rows = table(spark, sf, "events")
    made = T.typed_json(rows, at=F.col("ts"), day=F.to_date("ts"), price=F.col("event_id").cast("decimal(12,2)"), who=F.array("user_id", "user_id"))
    return rows.select("event_id", made.alias("json"))


@query("f23_defaults", "SELECT doc_id, coalesce(quality, -1) AS quality, coalesce(1 - toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def defaults(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return relations.with_defaults(rows, {"quality": -1, "toxic": 0}, {"toxic": lambda c: 1 - c})


def _armored(label: str, body: Column) -> Column:
    return F.concat(F.lit(f"junk\n-----BEGIN {label}-----\n"), body, F.lit(f"\n-----END {label}-----\n"))


@query("f24_armor_blocks", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN 'CERTIFICATE' ELSE 'RSA PUBLIC KEY' END AS label, CASE pos WHEN 0 THEN m ELSE substr(m, 1, 16) END AS body FROM {_D}, (VALUES (0), (1)) v(pos)")
def armor_blocks(spark, sf):
    text = F.concat(_armored("CERTIFICATE", F.concat(F.substring("m", 1, 20), F.lit("\n"), F.substring("m", 21, 12))), _armored("RSA PUBLIC KEY", F.substring("m", 1, 16)))
    return _docs(spark, sf).select("doc_id", F.posexplode(T.blocks(text)).alias("pos", "b")).select("doc_id", "pos", "b.*")


@query("f25_link_last", "SELECT page_id, url || '?page=' || page_id AS last FROM pages")
def link_last(spark, sf):
    link = F.concat(F.lit("<"), "url", F.lit('?page=2>; rel="next", <'), "url", F.lit("?page="), F.col("page_id").cast("string"), F.lit('>; rel="last"'))
    return table(spark, sf, "pages").select("page_id", T.link_last(link).alias("last"))


@query("f26_bytes", f"SELECT doc_id, to_base64(unhex(m)) AS b64, ltrim(m, '0') AS back, lpad(substr(m, 1, 6), 10, '0') AS padded, CAST('0x' || substr(m, 1, 12) AS BIGINT) AS n FROM {_D}")
def to_bytes(spark, sf):
    m = F.col("m")
    made = _docs(spark, sf).select("doc_id", "m", K.hex_to_base64(m).alias("b64"))
    return made.select("doc_id", "b64", K.base64_to_hex(F.col("b64")).alias("back"), K.pad_hex(F.substring("m", 1, 6), 10).alias("padded"), K.hex_to_long(F.substring("m", 1, 12)).alias("n"))


@query("p11_link_filters", r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS h, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p, string_split(regexp_replace(url, '/\s*$', ''), '/')[-1] AS l FROM pages)
SELECT page_id, h = 'example.org' OR h LIKE '%.example.org' OR contains(h, 'blog') AS allowed, lower(regexp_extract(p, '\.([A-Za-z0-9]+)$', 1)) NOT IN ('pdf', 'zip') AS follow, regexp_full_match(l, 'v?[0-9]+([.-].*)?') AS version FROM u""")
def link_filters(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", T.host_allowed(u, ["example.org"], ["blog"]).alias("allowed"), T.should_follow(u, ["pdf", "zip"]).alias("follow"), T.is_version_folder(u).alias("version"))


@query("s04_hex_archive", "SELECT sha1(text) AS fprint, CASE WHEN doc_id % 10 <> 0 THEN m END AS digest FROM " + _D)
def hex_archive(spark, sf):
    payload = F.when(F.col("doc_id") % 10 != 0, F.when(F.col("doc_id") % 2 == 0, F.hex(F.col("text").cast("binary"))).otherwise(F.lower(F.hex(F.col("text").cast("binary"))))).otherwise("xyz")
    return files.parse_archive(_docs(spark, sf).select(F.concat_ws(",", F.sha1(F.col("text").cast("binary")), payload).alias("value")), "hex").select("fprint", F.md5("der").alias("digest"))


@query("s18_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS followers, CAST(date_trunc('second', ts) AS TIMESTAMP) AS created_at FROM events")
def flatten(spark, sf):
    made = F.concat(F.lit('[{"login": {"k": '), F.get_json_object("props", "$.k"), F.lit('}, "created": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}]'))
    out = files.flatten(table(spark, sf, "events").select("event_id", made.alias("j")), "j", "login: struct<k: bigint>, created: string", {"followers": "login.k", "created_at": "created"}, ("created_at",))
    return out.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("s19_first_field", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS ip FROM events")
def first_field(spark, sf):
    return files.first_field(table(spark, sf, "events").select(F.concat_ws(",", F.col("user_id").cast("string"), "event_type", "props").alias("value")))


@query("s20_id_array", "SELECT DISTINCT v AS id FROM (SELECT unnest([event_type, CAST(user_id AS VARCHAR)]) AS v FROM events)")
def id_array(spark, sf):
    return files.id_array(table(spark, sf, "events").select(F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("j")), "j")


@query("s15_sitemap", "SELECT 'app' || page_id AS package, 'https://h.example/a/app' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN '2024-01-01' END AS lastmod FROM pages")
def sitemap(spark, sf):
    k = F.col("page_id").cast("string")
    entry = F.concat(F.lit("<urlset><url><loc>https://h.example/a/app"), k, F.lit("</loc>"), F.when(F.col("page_id") % 2 == 0, "<lastmod>2024-01-01</lastmod>").otherwise(""), F.lit("</url><url><loc>https://h.example/about</loc></url></urlset>"))
    return markup.sitemap_entries(table(spark, sf, "pages").select(entry.alias("xml")))


@query("s15_sitemap_index", "SELECT page_id, kind, CASE kind WHEN 'index' THEN url || '/s.xml' END AS url FROM (SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'urls' END AS kind FROM pages)")
def sitemap_index(spark, sf):
    loc = lambda name: F.concat(F.lit("<sitemap>\n<loc>"), "url", F.lit(f"/{name}</loc></sitemap>"))
    k, head = F.col("page_id") % 3, F.lit('<?xml version="1.0"?>')
    index = F.concat(head, F.lit("<sitemapindex>"), loc("s.xml"), loc("default.xml"), loc("topics.xml"), F.lit("</sitemapindex>"))
    xml = F.when(k == 0, index).when(k == 1, F.concat(head, F.lit("<urlset><url><loc>"), "url", F.lit("</loc></url></urlset>"))).otherwise(F.col("html"))
    made = table(spark, sf, "pages").select("page_id", xml.alias("xml"))
    return made.select("page_id", markup.sitemap_kind(F.col("xml")).alias("kind")).join(markup.sitemap_links(made), "page_id", "left")


@query(
    "s15_listing",
    r"""WITH p AS (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS h FROM pages), q AS (SELECT *, trim(regexp_replace(h, '\s+', ' ', 'g')) AS u FROM p), r AS (SELECT *, replace(replace(replace(replace(replace(u, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM q)
SELECT page_id, n, t AS app, 'beta' AS type, '1.' || page_id || '.' || n AS version, CASE WHEN n = 1 THEN '2024-01-02 03:04:05' END AS uploaded, CAST(floor((page_id + 0.5) * 1048576) AS BIGINT) AS size, 1000 + page_id AS downloads, n = 2 AS variants, 'c' || page_id AS company FROM r, (VALUES (1), (2)) x(n)""",
)
def listing(spark, sf):
    """Whole pages with two rows of a listing of their titles after them."""
    k, title = F.col("page_id").cast("string"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)

    def row(n: int) -> Column:
        version = F.concat(F.lit("1."), k, F.lit(f".{n}"))
        head = [F.lit('<div class="appRow"><div><a href="https://h.example/apk/c'), k, F.lit(f'/a/{n}">'), title, F.lit(" "), version, F.lit(" BETA</a>"), F.lit('<div class="appRowVariantTag">2</div>' if n == 2 else "")]
        time = '<span data-utcdate="2024-01-02 03:04:05 UTC">Tuesday</span>' if n == 1 else "never"
        named = lambda name, value: [F.lit(f"<p><span>{name}:</span> <span>"), value, F.lit("</span></p>")]
        size = F.concat(k, F.lit(".5 MB"))
        return F.concat(*head, F.lit("</div></div><div class='infoSlide'>"), *named("Version", version), *named("Uploaded", F.lit(time)), *named("File size", size), *named("Downloads", F.format_number(F.col("page_id") + 1000, 0)), F.lit("</div>"))

    pages = table(spark, sf, "pages").select("page_id", F.concat("html", F.lit('<div id="primary"><div class="listWidget">'), row(1), row(2), F.lit("</div></div>")).alias("html"))
    found = markup.listing_entries(pages).withColumn("n", F.right("link", F.lit(1)).cast("int"))
    return found.select("page_id", "n", "app", "type", "version", F.date_format("uploaded", "yyyy-MM-dd HH:mm:ss").alias("uploaded"), "size", "downloads", "variants", "company")


@query("s22_ldif", f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN m ELSE substr(m, 1, 24) END AS cert FROM {_D}, (VALUES (0), (1)) v(pos)")
def ldif(spark, sf):
    text = F.concat(F.lit("dn: x\nuserCertificate;binary:: "), F.base64(F.unhex("m")), F.lit("\nuserCertificate;binary:: "), F.base64(F.unhex(F.substring("m", 1, 24))), F.lit("\ncn: y\n"))
    return _docs(spark, sf).select("doc_id", F.posexplode(markup.ldif_certs(text)).alias("pos", "c")).select("doc_id", "pos", F.lower(F.hex("c")).alias("cert"))


@query("s23_first_anchor", """WITH a AS (SELECT page_id, CAST(p AS INTEGER) AS pos, a[p + 1] AS cert FROM (SELECT page_id, a, unnest(range(len(a))) AS p FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS a FROM pages)))
SELECT page_id, pos, cert FROM (SELECT *, row_number() OVER (PARTITION BY cert ORDER BY page_id, pos) AS n FROM a) WHERE n = 1""")
def first_anchor(spark, sf):
    return markup.trust_list_certs(table(spark, sf, "pages"), "html", "page_id", '<a href="([^"]*)"')


@query("s24_pom_dependencies", """SELECT o_orderkey, 'org.g' || l_suppkey AS "group", 'lib' || l_partkey AS artifact, CASE WHEN l_linenumber <> 1 THEN '1.' || l_linenumber END AS version FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def pom_dependencies(spark, sf):
    version = F.when(F.col("l_linenumber") != 1, F.concat(F.lit("<version>1."), F.col("l_linenumber").cast("string"), F.lit("</version>"))).otherwise("")
    one = F.concat(F.lit("<dependency> <groupId>org.g"), F.col("l_suppkey").cast("string"), F.lit("</groupId><artifactId>lib"), F.col("l_partkey").cast("string"), F.lit("</artifactId>"), version, F.lit("</dependency>"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.collect_list(one), "\n").alias("d"))
    poms = lines.select("o_orderkey", F.concat(F.lit('<project xmlns="http://maven.example/4"><dependencies>'), "d", F.lit("<dependency><groupId>alone</groupId></dependency></dependencies></project>")).alias("pom"))
    return markup.pom_dependencies(poms.join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "left_semi"))


def _list_page() -> Column:
    """A page's own markup, then a published list: a header that is mostly a date, and a table of two files."""
    k = F.col("page_id")
    cell = lambda n: F.concat(F.lit("<td>"), (10 * k + n).cast("string"), F.lit("</td>"))
    day = F.concat(F.lit("<td>2020-02-0"), (1 + k % 7).cast("string"), F.lit("</td></tr>"))
    rows = [F.concat(F.lit(f"<tr><td><a href='x{n}'>f{n}</a></td>"), cell(1), cell(2), cell(3), day) for n in (1, 2)]
    header = F.when(k % 5 == 0, "soon").otherwise(F.concat(F.lit("2020-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0"), F.lit(" 01:02:03")))
    return F.concat("html", F.lit("<h2>"), header, F.lit("</h2><table><tr><th>File</th></tr>"), *rows, F.lit("</table>"))


@query("s13_html_cells", "SELECT page_id, 0 AS line, 0 AS col, NULL AS href, 'File' AS text FROM pages UNION ALL SELECT page_id, n, c, CASE WHEN c = 0 THEN 'x' || n END, CASE c WHEN 0 THEN 'f' || n WHEN 4 THEN '2020-02-0' || (1 + page_id % 7) ELSE CAST(10 * page_id + c AS VARCHAR) END FROM pages, (VALUES (1), (2)) r(n), (VALUES (0), (1), (2), (3), (4)) x(c)")
def html_cells(spark, sf):
    cells = markup.html_tables(table(spark, sf, "pages").select("page_id", _list_page().alias("html")), "html", "page_id")
    return cells.where("tbl >= 0").select("page_id", "line", "col", "href", "text")


@query(
    "s13_catalogue",
    """WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'soon' ELSE '2020-01-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') || ' 01:02:03' END AS h, '2020-02-0' || (1 + page_id % 7) AS d FROM pages),
s AS (SELECT layout, 9 + row_number() OVER (PARTITION BY layout ORDER BY page_id) AS id, h AS date, page_id FROM p, (VALUES ('flat'), ('header')) l(layout)
UNION ALL SELECT 'date', 9 + row_number() OVER (ORDER BY min(page_id)), d, max(page_id) FROM p GROUP BY d)
SELECT layout, id, date, CAST(epoch(TRY_CAST(date AS TIMESTAMP)) AS BIGINT) AS date_utc, 'f' || n AS name, 'x' || n AS href, CAST(10 * page_id + CASE layout WHEN 'flat' THEN 1 WHEN 'header' THEN 2 ELSE 3 END AS BIGINT) AS size, CAST(10 * page_id + CASE layout WHEN 'header' THEN 3 ELSE 2 END AS VARCHAR) AS hash FROM s, (VALUES (1), (2)) r(n)""",
)
def catalogue(spark, sf):
    cells = materialize(markup.html_tables(table(spark, sf, "pages").select("page_id", _list_page().alias("html")), "html", "page_id"), "cells")  # read once for each layout
    found = [markup.build_catalogue(cells, "page_id", layout=name).withColumn("layout", F.lit(name)) for name in markup.LAYOUTS]
    sets = reduce(DataFrame.unionByName, found).select("layout", "id", "date", "date_utc", F.explode("files").alias("name", "f"))
    return sets.select("layout", "id", "date", "date_utc", "name", "f.href", F.col("f.size").cast("long").alias("size"), "f.hash")


@query("u08_format_counters", f"SELECT kind, n_files, n_keys, n_flagged FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'pem' WHEN 1 THEN 'ssh' WHEN 2 THEN 'json' ELSE 'der' END AS kind, count(*) AS n_files, count(*) AS n_keys, count(*) FILTER (WHERE right(m, 1) = '5') AS n_flagged FROM {_D} GROUP BY 1)")
def format_counters(spark, sf):
    made = _key_files(spark, sf)
    return keyfiles.format_counters(made, keyfiles.scan_key_files(made, lambda n: F.endswith(n, F.lit("5"))))


@query("s09_detect_format", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pem' WHEN 1 THEN 'ssh,mods' WHEN 2 THEN 'json' ELSE 'apk' END AS kinds FROM pages")
def detect_format(spark, sf):
    k = F.col("page_id") % 4
    name = F.when(k == 0, "a").when(k == 1, "keys.TXT").when(k == 2, "x.json").otherwise("x.apk")
    body = F.when(k == 0, "-----BEGIN CERTIFICATE-----").when(k == 1, "from=x ssh-rsa AAAA").when(k == 2, ' {"n": 1}').otherwise("PK")
    return table(spark, sf, "pages").select("page_id", F.array_join(keyfiles.detect_format(name, body), ",").alias("kinds"))



@query(
    "s09_document_formats",
    r"""WITH d AS (SELECT doc_id, 'k' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.CRT' WHEN 1 THEN '.ldif' WHEN 2 THEN '.mods' WHEN 3 THEN '.jks' WHEN 4 THEN '.json' ELSE '' END AS name,
CASE doc_id % 5 WHEN 0 THEN text || '-----BEGIN CERTIFICATE-----' || text WHEN 1 THEN '[' || text WHEN 2 THEN text || '-----BEGIN RSA PUBLIC KEY-----' || text WHEN 3 THEN text || 'ssh-rsa ' ELSE text END AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(t, '-----BEGIN CERTIFICATE') THEN 'pem' END, CASE WHEN regexp_matches(t, '-----BEGIN (RSA )?(PUBLIC|PRIVATE) KEY') THEN 'rsa_pem' END, CASE WHEN contains(t, '-----BEGIN PGP PUBLIC KEY') THEN 'pgp' END,
CASE WHEN contains(t, 'ssh-rsa ') THEN 'ssh' END, CASE WHEN regexp_matches(ltrim(t, ' '), '^[\[{]') OR name LIKE '%.json' THEN 'json' END, CASE WHEN contains(t, 'binary::') OR name LIKE '%.ldif' THEN 'ldif' END,
CASE WHEN name LIKE '%.CRT' AND NOT contains(t, '-----BEGIN') THEN 'der' END, CASE WHEN name LIKE '%.mods' THEN 'mods' END, CASE WHEN name LIKE '%.jks' THEN 'jks' END], lambda x: x IS NOT NULL), ',') AS kinds FROM d""",
)
def document_formats(spark, sf):
    """Whole texts, with the mark of a format before, after or inside them, under names of several kinds."""
    k, n, text = F.col("doc_id") % 5, F.col("doc_id") % 6, F.col("text")
    name = F.concat(F.lit("k"), F.col("doc_id").cast("string"), F.when(n == 0, ".CRT").when(n == 1, ".ldif").when(n == 2, ".mods").when(n == 3, ".jks").when(n == 4, ".json").otherwise(""))
    inside = lambda mark: F.concat(text, F.lit(mark), text)
    body = F.when(k == 0, inside("-----BEGIN CERTIFICATE-----")).when(k == 1, F.concat(F.lit("["), text)).when(k == 2, inside("-----BEGIN RSA PUBLIC KEY-----")).when(k == 3, F.concat(text, F.lit("ssh-rsa "))).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", F.array_join(keyfiles.detect_format(name, body), ",").alias("kinds"))


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as scan results: each tenth has no tls, languages other than English no RSA key."""
    key = F.when(F.col("lang") == "en", F.struct(F.base64(F.unhex("m")).alias("modulus"), F.lit(65537).cast("long").alias("exponent")))
    parsed = F.to_json(F.struct(
        F.struct(F.array("source").alias("common_name")).alias("subject"), F.concat(F.lit("CN="), "source").alias("subject_dn"), F.struct(F.lit("2020-01-02T03:04:05Z").alias("start")).alias("validity"),
        F.sha1("text").alias("fingerprint_sha1"), F.struct(F.struct(F.when(F.col("lang") == "en", "RSA").otherwise("EC").alias("name")).alias("key_algorithm"), key.alias("rsa_public_key")).alias("subject_key_info"),
    ))
    parsed = F.from_json(parsed, scans.PARSED)
    server = F.struct(F.struct(F.lit(True).alias("browser_trusted"), F.lit(False).alias("matches_domain")).alias("validation"), F.struct(parsed.alias("parsed")).alias("certificate"), F.array(F.struct(parsed.alias("parsed"), F.col("m").alias("raw"))).alias("chain"))
    data = F.when(F.col("doc_id") % 10 != 0, F.struct(F.struct(server.alias("server_certificates")).alias("tls")))
    return _docs(spark, sf).select(F.col("doc_id").cast("string").alias("ip"), F.lit("d").alias("domain"), F.lit("t").alias("timestamp"), data.alias("data"))


@query("p02_tls_leaf", f"SELECT CAST(doc_id AS VARCHAR) AS ip, sha1(text) AS fprint_sha1, source AS cn, '2020-01-02' AS not_before, ltrim(m, '0') AS n, 65537::BIGINT AS e, true AS trusted FROM {_D} WHERE doc_id % 10 <> 0 AND lang = 'en'")
def tls_leaf(spark, sf):
    return scans.tls_leaf(_scan(spark, sf)).select("ip", "fprint_sha1", "cn", "not_before", "n", "e", "trusted")


@query("p03_tls_chain", f"SELECT CAST(doc_id AS VARCHAR) AS ip, 0 AS pos, m AS raw, coalesce(lang = 'en', false) AS is_rsa, false AS is_ca FROM {_D} WHERE doc_id % 10 <> 0")
def tls_chain(spark, sf):
    return scans.tls_chain(_scan(spark, sf)).select("ip", "pos", "raw", "is_rsa", "is_ca")


@query("p04_archive_record", f"SELECT doc_id, CASE WHEN source = 'src0' THEN m END AS m FROM {_D} WHERE lang = 'en' OR source = 'src0'")
def archive_record(spark, sf):
    return scans.archive_record(_docs(spark, sf), F.col("lang") == "en", F.col("source") == "src0", "m").select("doc_id", "m")


@query("p06_dump_flagged", "SELECT sha1(text) AS fprint, source = lang AS self_signed FROM documents WHERE right(md5(text), 1) IN ('0', '5', 'a', 'f')")
def dump_flagged(spark, sf):
    parsed = F.from_json(F.to_json(F.struct(F.col("source").alias("subject_dn"), F.col("lang").alias("issuer_dn"), F.struct(F.struct(F.base64(F.unhex("m")).alias("modulus")).alias("rsa_public_key")).alias("subject_key_info"))), scans.PARSED)
    dump = _docs(spark, sf).select(F.base64(F.col("text").cast("binary")).alias("raw"), parsed.alias("parsed"), F.array().cast("array<string>").alias("parents"), F.lit(True).alias("seen_in_scan"))
    return scans.dump_flagged(dump, lambda n: F.right(n, F.lit(1)).isin("0", "5", "a", "f")).select("fprint", "self_signed")


@query("p07_ca_candidates", "SELECT doc_id, sha1(text) AS fprint FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality = 1, true)")
def ca_candidates(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    raw = F.col("text").cast("binary")
    rows = rows.select("doc_id", (F.col("quality") == 1).alias("ca"), F.when(F.col("doc_id") % 2 == 0, F.upper(F.sha1(raw))).otherwise("?").alias("fprint"), F.base64(raw).alias("raw"))
    return scans.ca_candidates(rows).select("doc_id", "fprint")


@query("p08_recode_ssh", f"SELECT CAST(doc_id AS VARCHAR) AS source, ltrim(m, '0') AS n, '10001' AS e FROM {_D} WHERE doc_id % 3 <> 0")
def recode_ssh(spark, sf):
    keys = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.substring("m", 1, 5)).otherwise(F.col("m")).alias("mod"), F.lit(65537).cast("long").alias("e"))
    return scans.recode_ssh(keys).withColumn("source", F.array_join(F.col("source").cast("array<string>"), ","))


@query("j10_flatten_pgp", """SELECT conv_id AS master_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pos, false AS is_master, md5(text) AS n FROM conversations WHERE role = 'user' UNION ALL SELECT DISTINCT conv_id, 0, true, 'n' || conv_id FROM conversations""")
def flatten_pgp(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "Public-Subkey").alias("tag"), F.md5(F.col("text").cast("binary")).alias("n"))
    flat = scans.flatten_packets(turns, "conv_id", "turn", "tag")
    return flat.select("master_id", "pos", "is_master", F.when(F.col("is_master"), F.concat(F.lit("n"), F.col("master_id").cast("string"))).otherwise(F.col("n")).alias("n"))


@query("u02_parse_ssh", f"SELECT doc_id, '10001' AS e, 'c1' || m AS n, 136 AS bits FROM {_D}")
def parse_ssh(spark, sf):
    blob = F.unhex(F.concat(F.lit("000000077373682d727361" + "00000003010001" + "0000001200c1"), "m"))
    line = F.concat(F.lit('from="192.0.2.1" ssh-rsa '), F.base64(blob), F.lit(" user@host.example"))
    return _docs(spark, sf).select("doc_id", K.ssh_rsa(line).alias("k")).select("doc_id", "k.*")


Piece = tuple[Column, int]


def _tlv(tag: str, *parts: Piece) -> Piece:
    """A DER value in hex: its parts' hex and their size in bytes, below 65536."""
    size = sum(n for _, n in parts)
    head = tag + (f"{size:02x}" if size < 128 else f"81{size:02x}" if size < 256 else f"82{size:04x}")
    return F.concat(F.lit(head), *[c for c, _ in parts]), size + len(head) // 2


def _raw(h: str) -> Piece:
    return F.lit(h), len(h) // 2


def _rsa_key() -> Piece:
    return _tlv("30", _tlv("02", (F.concat(F.lit("00c1"), "m"), 18)), _raw("0203010001"))


def _certificate() -> Piece:
    """A certificate in hex for each document: name from doc_id, issuer from source, modulus from the digest."""
    name = lambda c: _tlv("30", _tlv("31", _tlv("30", _raw("0603550403"), _tlv("0c", (F.hex(F.lpad(c, 12, "0").cast("binary")), 12)))))
    algorithm = _tlv("30", _raw("06092a864886f70d01010b" + "0500"))
    times = _tlv("30", _tlv("17", _raw(b"200102030405Z".hex())), _tlv("18", _raw(b"20510102030405Z".hex())))
    key = _tlv("30", _tlv("30", _raw("06092a864886f70d010101" + "0500")), _tlv("03", _raw("00"), _rsa_key()))
    ca = F.when(F.col("source") == "src0", "ff").otherwise("00")
    extensions = _tlv("a3", _tlv("30", _tlv("30", _raw("0603551d13"), _tlv("04", _tlv("30", _tlv("01", (ca, 1)))))))
    body = _tlv("30", _raw("a003020102" + "02017f"), algorithm, name(F.coalesce("source", F.lit(""))), times, name(F.col("doc_id").cast("string")), key, extensions)
    return _tlv("30", body, algorithm, _tlv("03", _raw("00"), (F.col("m"), 16)))


@query("u01_parse_certificates", f"SELECT doc_id, 'c1' || m AS n, '10001' AS e, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS cn, 'CN=' || lpad(coalesce(source, ''), 12, '0') AS issuer_dn, '2020-01-02 03:04:05' AS not_before, '2051-01-02 03:04:05' AS not_after, coalesce(source = 'src0', false) AS is_ca, m AS signature, CAST(NULL AS VARCHAR) AS error FROM {_D}")
def parse_certificates(spark, sf):
    made = _docs(spark, sf).select("doc_id", F.unhex(_certificate()[0]).alias("der"))
    return frames.parse_certificates(made).select("doc_id", "n", "e", "cn", "issuer_dn", "not_before", "not_after", "is_ca", "signature", "error")


@query("u06_parse_rsa_keys", f"SELECT doc_id, 'c1' || m AS n, '10001' AS e FROM {_D}")
def parse_rsa_keys(spark, sf):
    return frames.parse_rsa_keys(_docs(spark, sf).select("doc_id", F.unhex(_rsa_key()[0]).alias("der"))).select("doc_id", "n", "e")


#: A PGP key body for a document: version 4, time 1600000000, RSA, a modulus of 136 bits, exponent 65537.
def _pgp_key() -> Column:
    return F.concat(F.lit("045f5e100001" + "0088c1"), "m", F.lit("0011010001"))


@query("u03_parse_pgp", f"""WITH b AS (SELECT doc_id, m, '045f5e1000010088c1' || m || '0011010001' AS k FROM {_D}), i AS (SELECT doc_id, m, right(sha1(unhex('99001e' || k)), 16) AS id FROM b)
SELECT doc_id, id AS key_id, id AS master_key_id, 'c1' || m AS n, '10001' AS e, is_master, 1600000000::BIGINT AS created, 'key@host.example' AS identities FROM i, (VALUES (true), (false)) v(is_master)""")
def parse_pgp(spark, sf):
    packets = F.concat(F.lit("99001e"), _pgp_key(), F.lit("b410" + b"key@host.example".hex() + "ce1e"), _pgp_key())
    out = frames.parse_pgp(_docs(spark, sf).select("doc_id", F.unhex(packets).alias("data")))
    return out.select("doc_id", "key_id", "master_key_id", "n", "e", "is_master", "created", F.array_join("identities", ",").alias("identities"))


@query("u04_parse_pgp_signatures", f"SELECT doc_id, 4 AS version, 0 AS type, 1 AS key_algorithm, 8 AS hash_algorithm, substr(m, 1, 16) AS key_id, 1600000000::BIGINT AS created, CAST(NULL AS BIGINT) AS expires FROM {_D}")
def parse_pgp_signatures(spark, sf):
    packet = F.concat(F.lit("c21a" + "04000108" + "0006" + "0502" + "5f5e1000" + "000a" + "0910"), F.substring("m", 1, 16), F.lit("abcd"))
    return frames.parse_pgp_signatures(_docs(spark, sf).select("doc_id", F.unhex(packet).alias("data"))).drop("error")


def _key_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of four formats, with one key each."""
    k, der = F.col("doc_id") % 4, F.unhex(_certificate()[0])
    ssh = F.concat(F.lit("ssh-rsa "), F.base64(F.unhex(F.concat(F.lit("000000077373682d727361" + "00000003010001" + "0000001200c1"), "m"))))
    text = F.when(k == 0, _armored("CERTIFICATE", F.base64(der))).when(k == 1, ssh).when(k == 2, F.concat(F.lit('{"keys": [{"n": "0x00C1'), "m", F.lit('"}]}')))
    name = F.concat(F.col("doc_id").cast("string"), F.when(k == 2, ".json").when(k == 3, ".der").otherwise(""))
    return _docs(spark, sf).select(name.alias("path"), F.coalesce(text.cast("binary"), der).alias("content"))


@query("u08_scan_key_files", f"SELECT doc_id || CASE doc_id % 4 WHEN 2 THEN '.json' WHEN 3 THEN '.der' ELSE '' END AS path, CASE doc_id % 4 WHEN 0 THEN 'pem' WHEN 1 THEN 'ssh' WHEN 2 THEN 'json' ELSE 'der' END AS kind, 'c1' || m AS n FROM {_D}")
def scan_key_files(spark, sf):
    made = _key_files(spark, sf)
    return keyfiles.scan_key_files(made).select("path", "kind", "n")


@query("u09_reflag", "SELECT doc_id, quality, CAST(n_chars > 1000 AS INTEGER) AS flagged FROM documents JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM CAST(n_chars > 1000 AS INTEGER)")
def reflag(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    changed = relations.reflag(rows.withColumn("flagged", F.col("quality")), (F.col("n_chars") > 1000).cast("int"))
    return changed.select("doc_id", "quality", "flagged")


@query("s14_app_rankings", "SELECT p_partkey, p_size + 1 AS place, p_name AS app, 'com.x' || p_partkey AS package, p_brand AS vendor FROM part")
def app_rankings(spark, sf):
    cell = lambda *parts: F.concat(F.lit("<td>"), *parts, F.lit("</td>"))
    link = F.concat(F.lit('<a href="/details?id=com.x'), F.col("p_partkey").cast("string"), F.lit('&hl=en">'), F.col("p_name"), F.lit("</a>"))
    row = F.concat(F.lit("<table><tr><th>#</th><th>App</th></tr><tr>"), cell((F.col("p_size") + 1).cast("string"), F.lit(".")), cell(link), cell(F.col("p_brand")), F.lit("</tr></table>"))
    pages = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")).select("p_partkey", row.alias("html"))
    return markup.app_rankings(markup.html_tables(pages, "html", "p_partkey"), "p_partkey")


@query(
    "s14_site_rankings",
    """SELECT p_partkey, 'cards' AS site, CAST(p_size + 1 AS BIGINT) AS place, p_name AS app, 'com.x' || p_partkey AS package, p_brand || ' & Co' AS vendor, 'top' AS type FROM part
UNION ALL SELECT p_partkey, 'list', 20 + k, p_name || k, 'com.x' || p_partkey, NULL, 'top' FROM part, (VALUES (0), (1)) l(k)
UNION ALL SELECT p_partkey, 'dashboard', p_size + 1, p_name, 'com.x' || p_partkey || t, CASE WHEN t <> 'paid' THEN p_brand END, t FROM part, (VALUES ('free'), ('paid'), ('grossing'), ('new_free'), ('new_paid')) c(t)""",
)
def site_rankings(spark, sf):
    k, name, brand, place = F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), (F.col("p_size") + 1).cast("string")
    card = F.concat(F.lit('<div class="details"><a class="title" href="/d?id=com.x'), k, F.lit('&hl=en">\n '), place, F.lit(". "), name, F.lit('</a><div><a class="subtitle" href="/v?id=1" title="'), brand, F.lit(' &amp; Co">x</a></div></div>'))
    items = [F.concat(F.lit('<li><div><a title="'), name, F.lit(f'{n}" href="/app/com.x'), k, F.lit('">x</a></div><div><a href="/get">Get</a></div></li>')) for n in (0, 1)]

    def cell(kind: str) -> Column:
        vendor = F.lit("") if kind == "paid" else F.concat(F.lit("<span>"), brand, F.lit("</span>"))
        return F.concat(F.lit('<td class="app-with-publisher-rank-iap tbl"><div><a href="/apps/com.x'), k, F.lit(f'{kind}/details/1"><i/></a><div class="asset-name"><a><span> '), name, F.lit("</span>"), vendor, F.lit("</a></div></div></td>"))

    board = F.concat(F.lit('<table><tr><th>#</th></tr><tr class="main-row table-row"><td><span>'), place, F.lit("</span></td>"), *[cell(t) for t in markup.CHARTS], F.lit("</tr></table>"))
    pages = {"cards": card, "list": F.concat(F.lit("<ul>"), *items, F.lit("</ul>")), "dashboard": board}
    part = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    found = [markup.site_rankings(part.select("p_partkey", html.alias("html")), "html", site, "top", 20).withColumn("site", F.lit(site)) for site, html in pages.items()]
    return reduce(DataFrame.unionByName, found).select("p_partkey", "site", "place", "app", "package", "vendor", "type")


@query("s17_maven_index", """SELECT 'org.s' || s_suppkey AS "group", 'a' || s_nationkey AS artifact, v AS version, 'https://m.example/org/s' || s_suppkey || '/a' || s_nationkey || '/' || v || '/a' || s_nationkey || '-' || v || '.pom' AS pom_url FROM supplier, (VALUES ('1.0'), ('2')) x(v) WHERE s_acctbal > 0""")
def maven_index(spark, sf):
    version = lambda v: F.struct(F.lit(v).alias("v"), F.lit("l").alias("l"))
    url = F.concat(F.lit("https://m.example/org/s"), F.col("s_suppkey").cast("string"), F.lit("/a"), F.col("s_nationkey").cast("string"), F.lit("/"))
    rows = table(spark, sf, "supplier").select(url.alias("url"), (F.col("s_acctbal") > 0).alias("artifact_detected"), F.array(version("1.0"), version("2")).alias("versions"))
    return files.maven_index(rows, "https://m.example/")
