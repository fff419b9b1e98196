"""Queries that write the tables' rows in the formats of sources and sinks to shared storage, and read them again."""

from __future__ import annotations

import uuid
from contextlib import closing

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.functions import keys as K
from keylake.operators import graph, snapshots, stats
from keylake.parsers import frames
from keylake.plans.parsing import _D, Piece, _certificate, _docs, _raw, _scan, _tlv
from keylake.plans.registry import query
from keylake.session import materialize, shared_dir, table
from keylake.sources import archives, database, files, keyfiles, scans
from keylake.streaming import streams


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/keylake-files-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


@query("s05_tls_scan", "SELECT CAST(doc_id AS VARCHAR) AS ip, CASE WHEN doc_id % 10 = 0 THEN 'not_tls' WHEN lang IS DISTINCT FROM 'en' THEN 'not_rsa' END AS reject_reason, CASE WHEN doc_id % 10 <> 0 THEN sha1(text) END AS fprint_sha1 FROM documents")
def tls_scan(spark, sf):
    at = _folder(spark)
    files.write_jsonl(_scan(spark, sf), at)
    found = scans.tls_funnel(scans.read_tls_scan(spark, at))
    return found.select("ip", "reject_reason", F.col("data.tls.server_certificates.certificate.parsed.fingerprint_sha1").alias("fprint_sha1"))


@query(
    "s05_unknown_fields",
    """SELECT CAST(doc_id AS VARCHAR) AS ip, CASE WHEN doc_id % 10 = 0 THEN 'not_tls' WHEN lang IS DISTINCT FROM 'en' THEN 'not_rsa' END AS reject_reason,
CASE WHEN doc_id % 10 = 0 THEN '' ELSE '{"data":{"tls":{"version":"v3"}},' END || CASE WHEN doc_id % 10 = 0 THEN '{' ELSE '' END || '"zgrab":{"v":' || doc_id || '}}' AS rest, NULL::VARCHAR AS bad FROM documents WHERE doc_id % 7 <> 0
UNION ALL SELECT NULL, 'not_tls', NULL, left('{"ip":"' || doc_id || '","domain":"d"', 18) FROM documents WHERE doc_id % 7 = 0""",
)
def unknown_fields(spark, sf):
    """Scans with fields that no schema names and with lines cut short, through a reader, a writer and the reader again."""
    at = _folder(spark)
    line = F.to_json(F.struct("ip", "domain", "timestamp", "data", F.struct(F.col("ip").cast("long").alias("v")).alias("zgrab")))
    line = F.replace(line, F.lit('"tls":{'), F.lit('"tls":{"version":"v3",'))
    made = _scan(spark, sf).select(F.when(F.col("ip").cast("long") % 7 == 0, F.left(line, F.lit(18))).otherwise(line).alias("value"))
    made.write.text(f"{at}/first")
    scans.format_lines(scans.read_lines(spark, f"{at}/first", scans.TLS_SCAN), scans.TLS_SCAN).write.text(f"{at}/second")
    again = scans.tls_funnel(scans.read_lines(spark, f"{at}/second", scans.TLS_SCAN))
    return again.select("ip", "reject_reason", F.to_json("rest").alias("rest"), "bad")


@query("s06_x509_dump", f"SELECT sha1(text) AS fprint, ltrim(m, '0') AS n, coalesce(source = lang, source IS NULL AND lang IS NULL) AS self_signed, doc_id % 2 = 0 AS seen_in_scan, 'p' || doc_id AS parents FROM {_D} WHERE right(m, 1) IN ('0', '5', 'a', 'f')")
def x509_dump(spark, sf):
    at = _folder(spark)
    key = F.struct(F.struct(F.base64(F.unhex("m")).alias("modulus")).alias("rsa_public_key"))
    parsed = F.struct(F.col("source").alias("subject_dn"), F.col("lang").alias("issuer_dn"), key.alias("subject_key_info"))
    parents = F.array(F.concat(F.lit("p"), F.col("doc_id").cast("string")))
    files.write_jsonl(_docs(spark, sf).select(F.base64(F.col("text").cast("binary")).alias("raw"), parsed.alias("parsed"), parents.alias("parents"), (F.col("doc_id") % 2 == 0).alias("seen_in_scan")), at)
    found = scans.dump_flagged(scans.read_x509_dump(spark, at), lambda n: F.right(n, F.lit(1)).isin("0", "5", "a", "f"))
    return found.select("fprint", "n", "self_signed", "seen_in_scan", F.array_join("parents", ",").alias("parents"))


@query("s07_pgp_dump", """SELECT CAST(conv_id AS VARCHAR) AS master_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS pos, false AS is_master, md5(text) AS n FROM conversations WHERE role = 'user' UNION ALL SELECT DISTINCT CAST(conv_id AS VARCHAR), 0, true, 'n' || conv_id FROM conversations""")
def pgp_dump(spark, sf):
    at, conv = _folder(spark), F.col("conv_id").cast("string")
    packet = F.struct(F.col("turn").alias("creation_time"), F.when(F.col("role") == "user", "Public-Subkey").otherwise("User ID").alias("tag_name"), F.md5(F.col("text").cast("binary")).alias("n"))
    dump = table(spark, sf, "conversations").groupBy(conv.alias("key_id")).agg(F.array_sort(F.collect_list(packet)).alias("packets"))
    files.write_jsonl(dump.withColumn("n", F.concat(F.lit("n"), "key_id")), at)
    return scans.flatten_pgp(scans.read_pgp_dump(spark, at)).select("master_id", "pos", "is_master", F.col("packet.n").alias("n"))


@query("s08_key_files", f"SELECT 'mods' AS kind, 'c1' || m AS n FROM {_D}")
def key_files(spark, sf):
    at = _folder(spark)
    _docs(spark, sf).select(F.concat(F.lit("0x00C1"), "m").alias("value")).write.text(at)
    return keyfiles.scan_key_files(keyfiles.read_key_files(spark, at)).select("kind", "n")


@query("s08_archives", "SELECT 'd/' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, ''))) AS size, md5(coalesce(text, '')) AS digest, NULL::VARCHAR AS error FROM documents")
def archived(spark, sf):
    """Whole texts as members of compressed tar archives, which tasks read in spans."""
    at = _folder(spark)
    spark.dataSource.register(archives.TarFiles)
    name = F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    table(spark, sf, "documents").select(name.alias("name"), F.col("text").cast("binary").alias("content")).write.format("tar_files").mode("append").option("path", at).option("compression", "zstd").save()
    read = keyfiles.read_key_files(spark, at)
    return read.select(F.regexp_extract("path", "!(.*)$", 1).alias("name"), F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest"), "error")


@query("s10_ssh_keys", f"SELECT CAST(doc_id AS VARCHAR) AS source, ltrim(m, '0') AS n, '10001' AS e FROM {_D} WHERE doc_id % 3 = 1")
def ssh_keys(spark, sf):
    at, k = _folder(spark), F.col("doc_id") % 3
    keys = _docs(spark, sf).select(F.col("doc_id").alias("id"), F.when(k == 0, F.substring("m", 1, 5)).when(k == 1, F.col("m")).alias("mod"), F.lit(65537).alias("e"), F.lit("ssh-rsa").alias("raw"))
    files.write_jsonl(keys, at)
    return scans.recode_ssh(scans.read_ssh_keys(spark, at)).withColumn("source", F.array_join(F.col("source").cast("array<string>"), ","))


@query("s16_read_many", "SELECT CAST(event_id AS VARCHAR) AS value, CAST(2 - event_id % 3 AS INTEGER) AS file_ord, row_number() OVER (ORDER BY 2 - event_id % 3, event_id) - 1 AS place FROM events")
def read_many(spark, sf):
    at = _folder(spark)
    for k in range(3):
        _events(spark, sf).where(F.col("event_id") % 3 == k).repartitionByRange(3, "event_id").sortWithinPartitions("event_id").select(F.col("event_id").cast("string").alias("value")).write.text(f"{at}/part={k}")
    many = files.read_many(spark, [f"{at}/part={k}" for k in (2, 1, 0)])
    return snapshots.seq_id(many, "file_ord", "file", "start", "line_ord").select("value", "file_ord", F.col("id").alias("place"))


@query("s25_select_inputs", "SELECT DISTINCT CAST(event_id % 5 AS VARCHAR) AS folder FROM events WHERE event_id % 5 <> 3")
def select_inputs(spark, sf):
    at, k = _folder(spark), F.col("event_id") % 5
    rows = _events(spark, sf).select(k.alias("k"), "event_type")
    rows.where("k <> 3").write.partitionBy("k").json(at)
    rows.where("k = 3").write.mode("append").partitionBy("k").csv(at)
    return files.select_inputs(spark, at, ".json").select(F.regexp_extract("path", "k=([0-9]+)/", 1).alias("folder")).distinct()


@query("k01_jsonl", """SELECT '{"doc_id":' || doc_id || CASE WHEN doc_id % 3 <> 0 THEN ',"fprint":"' || m || '"' ELSE '' END || '}' AS value FROM """ + _D)
def jsonl(spark, sf):
    at = _folder(spark)
    files.write_jsonl(_docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("m")).alias("fprint")), at)
    return spark.read.text(at)


@query("k02_cert_archive", f"SELECT m AS fprint, sha1(text) AS digest FROM {_D}")
def cert_archive(spark, sf):
    at = _folder(spark)
    files.write_cert_archive(_docs(spark, sf).select(F.col("m").alias("fprint"), F.col("text").cast("binary").alias("der")), at)
    return files.read_cert_archive(spark, at).select("fprint", F.sha1("der").alias("digest"))


@query("k03_sorted_list", "SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1")
def sorted_list(spark, sf):
    at = _folder(spark)
    files.write_sorted_list(_events(spark, sf), "user_id", at)
    return spark.read.text(at).groupBy("value").agg(F.count("*").alias("n"))


@query("k04_run_stats", "SELECT count(*) AS n, count_if(lang = 'en') AS english, max(n_chars) AS longest FROM documents")
def run_stats(spark, sf):
    rows, seen = files.run_stats(table(spark, sf, "documents").select("lang", "n_chars"), n=F.count("*"), english=F.count_if(F.col("lang") == "en"), longest=F.max("n_chars"))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "n long, english long, longest long")  # one row of counts


@query("k05_report", "SELECT event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1")
def report(spark, sf):
    at = _folder(spark)
    files.write_report(_events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").alias("total")), at)
    return spark.read.option("sep", ";").option("header", "true").schema("event_type string, n long, total long").csv(at)


@query("k06_split", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 1000")
def split(spark, sf):
    at = _folder(spark)
    files.write_split(table(spark, sf, "documents").select("doc_id", "n_chars", (F.col("n_chars") > 1000).alias("flagged")), at)
    return spark.read.parquet(at).where(F.col("flagged").cast("boolean")).select("doc_id", "n_chars")


@query("k07_levels", "SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS level FROM orders WHERE o_orderkey % 4 >= 2")
def levels(spark, sf):
    at = _folder(spark)
    files.write_levels(table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("level")), at)
    return spark.read.parquet(at).where("level >= 2").select("o_orderkey", F.col("level").cast("int").alias("level"))


@query("k08_consolidate", "SELECT event_type || ',' || user_id AS value FROM events")
def consolidate(spark, sf):
    at = _folder(spark)
    _events(spark, sf).select(F.concat_ws(",", "event_type", F.col("user_id").cast("string")).alias("value")).repartition(8).write.text(f"{at}/parts")
    files.consolidate(spark, f"{at}/parts", f"{at}/one", 2)
    return spark.read.text(f"{at}/one")


@query("k09_run_once", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def run_once(spark, sf):
    at, orders = _folder(spark), table(spark, sf, "orders")
    files.run_once(orders.where("o_totalprice > 100000").select("o_orderkey"), at)
    return files.run_once(orders.select("o_orderkey"), at)


@query("k10_merge_table", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 OR o_totalprice > 100000")
def merge_table(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"))
    return files.merge_table(orders.where("o_totalprice > 100000").drop("o_totalprice"), new, ["o_orderkey"], _folder(spark))


def _database(spark: SparkSession, table: str, columns: str) -> dict[str, str]:
    """Options of a new table in a database file of the shared folder, which is a local one where this query runs."""
    at = f"{shared_dir(spark).removeprefix('file://')}/keylake-{uuid.uuid4().hex}.db"
    options = {"module": "sqlite3", "database": at, "timeout": "600", "table": table, "key": columns.split()[0], "page": "5000"}
    spark.dataSource.register(database.KeyedTable)
    with closing(database.connect(options)) as db:
        db.execute(f"CREATE TABLE {table} ({columns})")
        db.commit()
    return options


@query("s11_keyed_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def keyed_table(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    options = _database(spark, "orders", "o_orderkey INTEGER PRIMARY KEY, o_orderstatus TEXT, o_totalprice REAL")
    rows.write.format("keyed_table").mode("append").options(**options).save()
    return spark.read.format("keyed_table").schema(rows.schema).options(**options).load()


@query("k10_merge_in_place", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 OR o_totalprice > 100000")
def merge_in_place(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    options = _database(spark, "orders", "o_orderkey INTEGER PRIMARY KEY, o_orderstatus TEXT")
    new = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"))
    for part in (orders.where("o_totalprice > 100000").drop("o_totalprice"), new, new):  # the last delivery comes twice
        part.write.format("keyed_table").mode("append").options(**options).save()
    return spark.read.format("keyed_table").schema(new.schema).options(**options).load()


@query("k12_error_sink", "SELECT event_id % 2 AS batch, event_type || user_id AS error, md5(event_type || user_id) AS err_md5 FROM events GROUP BY ALL")
def error_sink(spark, sf):
    at = _folder(spark)
    errors = _events(spark, sf).select((F.col("event_id") % 2).alias("batch"), F.concat("event_type", F.col("user_id").cast("string")).alias("error"))
    for k in range(2):
        files.append_errors(errors.where(F.col("batch") == k), at)
    return spark.read.schema("batch long, error string, err_md5 string").json(at)


@query("a19_file_digests", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents")
def file_digests(spark, sf):
    return stats.file_digests(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")))


@query("a20_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25")
def count(spark, sf):
    return stats.count(table(spark, sf, "lineitem"), F.col("l_quantity") > 25)


def _signed(subject: Column, issuer: Column, signed: Column) -> Column:
    """A certificate in hex whose key has exponent 1, so that a padded digest is its own signature."""
    name = lambda c: _tlv("30", _tlv("31", _tlv("30", _raw("0603550403"), _tlv("0c", (F.hex(F.lpad(c, 12, "0").cast("binary")), 12)))))
    algorithm = _tlv("30", _raw("06092a864886f70d01010b" + "0500"))
    times = _tlv("30", _tlv("17", _raw(b"200102030405Z".hex())), _tlv("18", _raw(b"20510102030405Z".hex())))
    key = _tlv("30", _tlv("02", (F.concat(F.lit("00c1"), F.repeat("m", F.lit(8))), 130)), _raw("020101"))
    info = _tlv("30", _tlv("30", _raw("06092a864886f70d010101" + "0500")), _tlv("03", _raw("00"), key))
    body = _tlv("30", _raw("a003020102" + "02017f"), algorithm, name(issuer), times, name(subject), info)
    digest = F.when(signed, F.sha2(F.unhex(body[0]), 256)).otherwise(F.repeat("m", F.lit(2)))
    block = F.concat(F.lit("0001" + "ff" * 75 + "003031300d060960864801650304020105000420"), digest)
    return F.unhex(_tlv("30", body, algorithm, _tlv("03", _raw("00"), (block, 129)))[0])


@query("u05_verify_pairs", "WITH p AS (SELECT source, min(doc_id) AS parent FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT doc_id, parent FROM documents JOIN p USING (source) WHERE doc_id % 3 <> 0")
def verify_pairs(spark, sf):
    docs = _docs(spark, sf).where("source is not null")
    children = docs.select("doc_id", _signed(F.col("doc_id").cast("string"), F.col("source"), F.col("doc_id") % 3 != 0).alias("der"))
    first = docs.groupBy("source").agg(F.min_by("m", "doc_id").alias("m"), F.min("doc_id").alias("id"))
    parents = first.select("id", _signed(F.col("source"), F.col("source"), F.lit(True)).alias("der"))
    parsed = materialize(frames.parse_certificates(children), "children")  # joined to parents in three ways
    return frames.verify_pairs(parsed, frames.parse_certificates(parents), "id").select("doc_id", "parent")


@query(
    "g01_verified_levels",
    """WITH RECURSIVE r(fprint, parent, level) AS (SELECT doc_id, NULL::BIGINT, 0 FROM documents WHERE doc_id BETWEEN 1 AND 3
UNION ALL SELECT doc_id, r.fprint, level + 1 FROM documents JOIN r ON doc_id // 2 = r.fprint WHERE doc_id > 3 AND doc_id % 7 <> 0 AND level < 9) SELECT CAST(fprint AS VARCHAR) AS fprint, CAST(parent AS VARCHAR) AS parent, level FROM r""",
)
def verified_levels(spark, sf):
    """Documents as certificates, each issued by that of half its id; every seventh has a wrong signature."""
    docs, k = _docs(spark, sf).where("doc_id > 0"), F.col("doc_id")
    made = docs.select(k, k.cast("string").alias("fprint"), _signed(k.cast("string"), F.expr("doc_id div 2").cast("string"), (k <= 3) | (k % 7 != 0)).alias("der"))
    certs = materialize(frames.parse_certificates(made).drop("der"), "certificates")
    roots = certs.where("doc_id <= 3").drop("doc_id")
    return graph.verified_levels(certs.where("doc_id > 3").drop("doc_id"), roots)


def _little(x: Column) -> Column:
    """A 32-bit number in hex, least byte first."""
    h = F.lpad(F.hex(x), 8, "0")
    return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])


def _zip(name: str, content: Piece) -> Column:
    """An archive in hex with one file, stored."""
    data, size = content
    title, le = name.encode().hex(), lambda v, n: v.to_bytes(n, "little").hex()
    crc = _little(F.crc32(F.unhex(data)))
    sizes = le(size, 4) * 2 + le(len(name), 2)
    entry = 46 + len(name)
    return F.concat(
        F.lit("504b0304" + "1400" + "0000" * 2 + "00002100"), crc, F.lit(sizes + "0000" + title), data,
        F.lit("504b0102" + "1400" * 2 + "0000" * 2 + "00002100"), crc, F.lit(sizes + "0000" * 4 + "00000000" * 2 + title),
        F.lit("504b0506" + "0000" * 2 + "0100" * 2 + le(entry, 4) + le(30 + len(name) + size, 4) + "0000"),
    )


@query("u07_parse_apk", f"SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS cn, 'c1' || m AS n, CASE WHEN doc_id % 5 = 0 THEN 'BadZipFile' END AS problem FROM {_D} WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, NULL, NULL, 'BadZipFile' FROM {_D} WHERE doc_id % 5 = 0")
def parse_apk(spark, sf):
    signed = _tlv("30", _raw("06012a"), _tlv("a0", _tlv("30", _raw("020101"), _raw("3100"), _raw("3000"), _tlv("a0", _certificate()))))
    made = F.when(F.col("doc_id") % 5 == 0, F.col("m").cast("binary")).otherwise(F.unhex(_zip("META-INF/CERT.RSA", signed)))
    out = frames.parse_apk(_docs(spark, sf).select("doc_id", made.alias("content")))
    return out.select("doc_id", "cn", "n", F.substring_index("error", ":", 1).alias("problem"))


@query("u10_predicates", f"SELECT doc_id, right(m, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS flagged FROM {_D}")
def predicates(spark, sf):
    K.register_predicate("odd", lambda n: F.right(n, F.lit(1)).isin(*"13579bdf"))
    return _docs(spark, sf).select("doc_id", K.PREDICATES["odd"](F.col("m")).alias("flagged"))


_SNAPSHOTS = "SELECT CAST(event_id % 3 AS BIGINT) AS batch, user_id FROM events WHERE (user_id + event_id) % 4 <> 0 GROUP BY ALL"


@query("t03_stream_snapshot_diff", f"WITH s AS ({_SNAPSHOTS}) SELECT batch, 'new' AS change, user_id FROM s WHERE (batch - 1, user_id) NOT IN (SELECT (batch, user_id) FROM s) UNION ALL SELECT batch + 1, 'lost', user_id FROM s WHERE batch < 2 AND (batch + 1, user_id) NOT IN (SELECT (batch, user_id) FROM s)")
def stream_snapshot_diff(spark, sf):
    at, rows = _folder(spark), _events(spark, sf).where("(user_id + event_id) % 4 <> 0")
    schema = rows.select("user_id").schema
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).select("user_id").write.mode("append").parquet(f"{at}/in")
        streams.stream_snapshot_diff(spark.readStream.schema(schema).parquet(f"{at}/in"), "user_id", f"{at}/state", f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select(F.col("batch").cast("long").alias("batch"), "change", "user_id")


@query("t05_resume", "SELECT DISTINCT user_id FROM events")
def resume(spark, sf):
    at, rows = _folder(spark), _events(spark, sf).select("user_id", "event_id")
    for k in range(2):
        rows.where(F.col("event_id") % 2 == k).select("user_id").write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.select("user_id").schema).parquet(f"{at}/in")
        streams.run_available(streams.stream_first_seen(stream, "user_id"), f"{at}/checkpoint", f"{at}/out")
    return spark.read.parquet(f"{at}/out")


@query("t05_replay", "SELECT event_id, user_id FROM events")
def replay(spark, sf):
    """The events in three parts of time, each delivered twice; a stream that is started anew for each delivery counts them once."""
    at, rows = _folder(spark), _events(spark, sf).select("event_id", "user_id", "ts")
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    cuts = [first + (last - first) * k / 3 for k in (1, 2)] if first else [None, None]
    part = F.when(F.col("ts") < F.lit(cuts[0]), 0).when(F.col("ts") < F.lit(cuts[1]), 1).otherwise(2)
    for k in (0, 0, 1, 1, 2, 2):
        rows.where(part == k).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
        with streams.rocks_state(spark):
            streams.run_available(streams.stream_first_seen(stream, "event_id", "ts", "2 days"), f"{at}/checkpoint", f"{at}/out")
    return spark.read.parquet(f"{at}/out").select("event_id", "user_id")


@query("u07_apk_signers", f"SELECT doc_id, m AS serial, 'CN=' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS issuer_dn, 'sha256' AS digest_alg, '2020-01-02 03:04:05' AS signed_at, 1 AS signer_count FROM {_D}")
def parse_apk_signers(spark, sf):
    name = _tlv("30", _tlv("31", _tlv("30", _raw("0603550403"), _tlv("0c", (F.hex(F.lpad(F.col("doc_id").cast("string"), 12, "0").cast("binary")), 12)))))
    digest, algorithm = _tlv("30", _raw("0609608648016503040201" + "0500")), _tlv("30", _raw("06092a864886f70d010101" + "0500"))
    times = _tlv("a0", _tlv("30", _raw("06092a864886f70d010905"), _tlv("31", _tlv("17", _raw(b"200102030405Z".hex())))))
    signer = _tlv("30", _raw("020101"), _tlv("30", name, _tlv("02", (F.col("m"), 16))), digest, times, algorithm, _tlv("04", _raw("00")))
    signed = _tlv("30", _raw("06012a"), _tlv("a0", _tlv("30", _raw("020101"), _raw("3100"), _raw("3000"), _tlv("a0", _certificate()), _tlv("31", signer))))
    made = _docs(spark, sf).select("doc_id", F.unhex(_zip("META-INF/CERT.RSA", signed)).alias("content"))
    return frames.parse_apk_signers(made).select("doc_id", "serial", "issuer_dn", "digest_alg", "signed_at", "signer_count")
