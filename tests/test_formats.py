"""Parsers, key files, sinks and streams on small fixtures that the test makes."""

import base64
import hashlib
import io
import random
import tarfile
import zipfile

import pytest
import zstandard
from pyspark.sql import functions as F

from keylake import plans
from keylake.functions import keys as K
from keylake.functions import text as T
from keylake.operators import graph, relations, snapshots, stats
from keylake.parsers import frames
from keylake.sources import archives, database, files, keyfiles, markup, scans
from keylake.streaming import streams


def tlv(tag: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def integer(v: int) -> bytes:
    return tlv(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))


def prime(rng: random.Random, bits: int) -> int:
    while True:
        p = rng.getrandbits(bits) | 1 | 3 << (bits - 2)
        if (p - 1) % 65537 and all(pow(a, p - 1, p) == 1 for a in (2, 3, 5, 7)):
            return p


class Key:
    def __init__(self, seed: int) -> None:
        rng = random.Random(seed)
        p, q = prime(rng, 512), prime(rng, 512)
        self.n, self.d = p * q, pow(65537, -1, (p - 1) * (q - 1))
        self.der = tlv(48, integer(self.n), integer(65537))


RSA, SHA256 = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010b")


def certificate(subject: str, key: Key, issuer: str, signer: Key, ca: bool, key_id: bytes = b"", names: tuple = ()) -> bytes:
    name = lambda s: tlv(48, tlv(49, tlv(48, tlv(6, b"\x55\x04\x03"), tlv(12, s.encode()))))
    algorithm = tlv(48, tlv(6, SHA256), tlv(5))
    extensions = [tlv(48, tlv(6, b"\x55\x1d\x13"), tlv(1, b"\xff"), tlv(4, tlv(48, tlv(1, b"\xff") if ca else b"")))]
    if key_id:
        extensions.append(tlv(48, tlv(6, b"\x55\x1d\x0e"), tlv(4, tlv(4, key_id))))
    if names:
        extensions.append(tlv(48, tlv(6, b"\x55\x1d\x11"), tlv(4, tlv(48, *[tlv(0x82, n.encode()) for n in names]))))
    times = tlv(48, tlv(23, b"990101000000Z"), tlv(24, b"20300101000000Z"))
    spki = tlv(48, tlv(48, tlv(6, RSA), tlv(5)), tlv(3, b"\0", key.der))
    body = tlv(48, tlv(0xA0, integer(2)), integer(7), algorithm, name(issuer), times, name(subject), spki, tlv(0xA3, tlv(48, *extensions)))
    digest = bytes.fromhex("3031300d060960864801650304020105000420") + hashlib.sha256(body).digest()
    block = b"\0\1" + b"\xff" * (128 - 3 - len(digest)) + b"\0" + digest
    return tlv(48, body, algorithm, tlv(3, b"\0", pow(int.from_bytes(block, "big"), signer.d, signer.n).to_bytes(128, "big")))


KEYS = [Key(k) for k in range(4)]
ROOT = certificate("R", KEYS[0], "R", KEYS[0], True)
ONE = certificate("I1", KEYS[1], "R", KEYS[0], True, b"\1\2")
TWO = certificate("I2", KEYS[2], "I1", KEYS[1], True, names=("a.example", "b.example"))
FAKE = certificate("I3", KEYS[3], "R", KEYS[3], True)


def test_certificates(spark):
    rows = spark.createDataFrame([(1, ONE, "x"), (2, TWO, "x"), (3, b"\x30\x05no", "x"), (4, None, "x"), (5, b"", "x")], "id int, der binary, n string")
    out = {r.id: r for r in frames.parse_certificates(rows).collect()}
    assert (out[1].n, out[1].e, out[1].subject_dn, out[1].issuer_dn, out[1].is_ca, out[1].in_n) == (f"{KEYS[1].n:x}", "10001", "CN=I1", "CN=R", True, "x")
    assert (out[1].not_before, out[1].not_after, out[1].subject_key_id) == ("1999-01-01 00:00:00", "2030-01-01 00:00:00", "0102")
    assert out[2].alt_names == ["a.example", "b.example"] and out[2].sha256 == hashlib.sha256(TWO).hexdigest()
    assert out[3].error and out[3].n is None and out[5].error and out[4].error is None


def test_certificates_of_an_empty_table(spark):
    assert frames.parse_certificates(spark.createDataFrame([], "id int, der binary")).count() == 0


def test_trust_by_signature(spark):
    rows = [(name, der) for name, der in (("one", ONE), ("two", TWO), ("fake", FAKE))]
    certs = frames.parse_certificates(spark.createDataFrame(rows, "fprint string, der binary"))
    roots = frames.parse_certificates(spark.createDataFrame([("root", ROOT)], "fprint string, der binary"))
    assert {tuple(r) for r in graph.verified_levels(certs, roots).collect()} == {("root", None, 0), ("one", "root", 1), ("two", "one", 2)}


def test_key_files_and_archives(spark, tmp_path):
    armored = lambda label, der: f"-----BEGIN {label}-----\n{base64.encodebytes(der).decode()}-----END {label}-----\n"
    ssh = base64.b64encode(b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-rsa", b"\1\0\1", b"\0" + KEYS[3].n.to_bytes(128, "big")))).decode()
    (tmp_path / "in").mkdir()
    (tmp_path / "in/two.pem").write_text(armored("CERTIFICATE", ONE) + armored("CERTIFICATE", TWO))
    (tmp_path / "in/own.key").write_text(armored("RSA PUBLIC KEY", KEYS[2].der))
    (tmp_path / "in/id.pub").write_text(f"ssh-rsa {ssh} me\nssh-rsa AAAA cut\n")
    (tmp_path / "in/list.txt").write_text("12\n")
    with tarfile.open(tmp_path / "in/more.tar.gz", "w:gz") as tar:
        member = tarfile.TarInfo("sub/root.der")
        member.size = len(ROOT)
        tar.addfile(member, io.BytesIO(ROOT))
    signed = tlv(48, tlv(6, b"\x2a"), tlv(0xA0, tlv(48, integer(1), tlv(49), tlv(48), tlv(0xA0, ONE))))
    with zipfile.ZipFile(tmp_path / "in/app.apk", "w") as z:
        z.writestr("META-INF/CERT.RSA", signed)
    read = keyfiles.read_key_files(spark, str(tmp_path / "in"))
    out = {(r.path.rsplit("/", 1)[-1], r.kind, r.idx, r.n) for r in keyfiles.scan_key_files(read).collect()}
    h = [f"{k.n:x}" for k in KEYS]
    assert out == {("two.pem", "pem", 0, h[1]), ("two.pem", "pem", 1, h[2]), ("own.key", "rsa_pem", 0, h[2]), ("id.pub", "ssh", 0, h[3]), ("list.txt", "mods", 0, "12"), ("list.txt", "mods", 0, "c"), ("root.der", "der", 0, h[0]), ("app.apk", "apk", 0, h[1])}


@pytest.mark.parametrize(("text", "want"), [("0x00FF", {("hex", "ff")}), ("12345678", {("hex", "12345678"), ("base64", "d76df8e7aefc"), ("decimal", "bc614e")}), ("?", set()), (None, set()), ("9" * 5000, {("hex", "9" * 5000), ("decimal", f"{10**5000 - 1:x}"), ("base64", ("f7df7d" * 1250))})])
def test_every_reading_of_a_number(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(K.big_integers(F.col("t")).alias("r")).first()
    assert {tuple(x) for x in row.r or []} == want


def test_version_order(spark):
    names = ["1.0", "1", "1.0-rc", "1.2", "1.10", "1:2"]
    key = {r.v: r.k for r in spark.createDataFrame([(n,) for n in names], "v string").select("v", T.version_key(F.col("v")).alias("k")).collect()}
    assert key["1.0"] == key["1"] < key["1.0-rc"] < key["1.2"] == key["1:2"] < key["1.10"]


def test_poms_with_missing_parts(spark):
    pom = "<project><dependencies><dependency><groupId>g</groupId></dependency><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId><version>2</version></dependency></dependencies></project>"
    out = markup.pom_dependencies(spark.createDataFrame([(1, pom), (2, "<broken"), (3, None)], "id int, pom string")).collect()
    assert {tuple(r) for r in out} == {(1, "g", "a", None), (1, "h", "b", "2")}


def test_catalogue_of_html_tables(spark):
    page = "<h2>2020-01-02</h2><table><tr><td><a href='/f1'>f1</a></td><td>1,024</td><td>aa</td></tr></table><h2>soon</h2><table><tr><td><a href='/f2'>f2</a></td><td>7</td><td>bb</td></tr></table>"
    out = markup.build_catalogue(markup.html_tables(spark.createDataFrame([(1, page), (2, None)], "id int, html string"), "html", "id"), "id").orderBy("id").collect()
    assert [(r.id, r.date, r.date_utc) for r in out] == [(10, "2020-01-02", 1577923200), (11, "soon", None)]
    assert out[0].files["f1"].asDict() == {"name": "f1", "href": "/f1", "size": 1024, "hash": "aa"}


def test_funnel_of_scans(spark):
    lines = ['{"ip":"192.0.2.1"}', '{"ip":"192.0.2.2","data":{"tls":{}}}', '{"ip":"192.0.2.3","data":{"tls":{"server_certificates":{"validation":{},"certificate":{"parsed":{"subject_dn":"x"}}}}}}']
    rows = spark.createDataFrame([(x,) for x in lines], "value string").select(F.from_json("value", scans.TLS_SCAN).alias("r")).select("r.*")
    assert [r.reject_reason for r in scans.tls_funnel(rows).orderBy("ip").collect()] == ["not_tls", "not_ok", "not_rsa"]


def test_files_and_sinks(spark, tmp_path):
    for name, lines in (("b.txt", "3\n1\n"), ("a.txt", "2\n")):
        (tmp_path / name).write_text(lines)
    many = files.read_many(spark, [f"{tmp_path}/b.txt", f"{tmp_path}/a.txt"])
    assert {tuple(r) for r in many.select("value", "file_ord").collect()} == {("3", 0), ("1", 0), ("2", 1)}
    files.write_sorted_list(many, "value", f"{tmp_path}/sorted")
    assert [r.value for r in spark.read.text(f"{tmp_path}/sorted").orderBy("value").collect()] == ["1", "2", "3"]
    files.consolidate(spark, f"{tmp_path}/sorted", f"{tmp_path}/one", 1)
    assert len(list((tmp_path / "one").glob("part-*"))) == 1
    assert files.run_once(many, f"{tmp_path}/once").count() == files.run_once(many.limit(1), f"{tmp_path}/once").count() == 3
    files.append_errors(spark.createDataFrame([("x",), ("x",)], "error string"), f"{tmp_path}/errors")
    files.append_errors(spark.createDataFrame([("y",)], "error string"), f"{tmp_path}/errors")
    assert spark.read.json(f"{tmp_path}/errors").count() == 2
    files.write_levels(spark.createDataFrame([(1, "a"), (2, "b")], "level int, c string"), f"{tmp_path}/levels")
    assert spark.read.parquet(f"{tmp_path}/levels/level=2").first().c == "b"
    ders = spark.createDataFrame([("bb", b"2"), ("aa", b"1")], "fprint string, der binary")
    files.write_cert_archive(ders, f"{tmp_path}/archive")
    assert {(r.fprint, bytes(r.der)) for r in files.read_cert_archive(spark, f"{tmp_path}/archive").collect()} == {("bb", b"2"), ("aa", b"1")}
    assert files.select_inputs(spark, str(tmp_path), ".txt").count() >= 2


def test_snapshot_changes_in_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    for k, keys in enumerate(("ab", "bc", "ac")):
        spark.createDataFrame([(c,) for c in keys], "fprint string").coalesce(1).write.mode("append").parquet(str(source))
        streams.stream_snapshot_diff(spark.readStream.schema("fprint string").parquet(str(source)), "fprint", f"{tmp_path}/state", f"{tmp_path}/out", f"{tmp_path}/check")
    out = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("batch", "change", "fprint").collect()}
    assert out == {(0, "new", "a"), (0, "new", "b"), (1, "new", "c"), (1, "lost", "a"), (2, "new", "a"), (2, "lost", "b")}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(2):
        spark.range(10 * k, 10 * k + 15).write.mode("append").parquet(source)
        streams.run_available(streams.stream_first_seen(spark.readStream.schema("id long").parquet(source), "id"), f"{tmp_path}/check", f"{tmp_path}/out")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(25))


def test_armored_blocks_with_hyphens_in_headers(spark):
    pgp = "-----BEGIN PGP PUBLIC KEY BLOCK-----\nComment: GPGTools - https://gpgtools.org\nVersion: x\n\nAAAA\nBBBB\n=abcd\n-----END PGP PUBLIC KEY BLOCK-----\n"
    rsa = "-----BEGIN RSA PRIVATE KEY-----\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: DES-EDE3-CBC,\r\n  0123-45\r\n\r\nCCCC\r\nDDD=\r\n-----END RSA PRIVATE KEY-----"
    signed = "-----BEGIN PGP SIGNED MESSAGE-----\nHash: SHA256\n\na - b\n-----BEGIN PGP SIGNATURE-----\n\nEEEE\n-----END PGP SIGNATURE-----"
    row = spark.createDataFrame([(f"a-b\n{pgp}junk - more\n{rsa}\n{signed}\n-----BEGIN CERTIFICATE-----\nFFFF\n",)], "t string").select(T.blocks(F.col("t")).alias("b")).first()
    assert [tuple(x) for x in row.b] == [("PGP PUBLIC KEY BLOCK", "AAAABBBB"), ("RSA PRIVATE KEY", "CCCCDDD="), ("PGP SIGNED MESSAGE", "a-b"), ("PGP SIGNATURE", "EEEE"), ("CERTIFICATE", "FFFF")]


def test_paths_in_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    out = graph.paths(edges, spark.createDataFrame([("a",)], "node string"))
    assert {(r.node, r.level, r.path) for r in out.collect()} == {("a", 0, "a"), ("b", 1, "a/b"), ("c", 2, "a/b/c")}


def test_database_tables(spark, tmp_path):
    url = "jdbc:derby:memory:keylake;create=true"
    files.write_table(spark.range(100).select("id", (F.col("id") * 2).alias("twice")), url, "numbers")
    files.copy_table(spark, url, "numbers", "id", 0, 100, 4, f"{tmp_path}/copy")
    assert spark.read.parquet(f"{tmp_path}/copy").agg(F.sum("twice")).first()[0] == 9900


def test_run_statistics(spark):
    df, seen = files.run_stats(spark.range(10), n=F.count("*"), even=F.count_if(F.col("id") % 2 == 0))
    df.collect()
    assert seen.get == {"n": 10, "even": 5}


def test_predicates_by_name(spark):
    K.register_predicate("odd", lambda n: F.right(n, F.lit(1)).isin(*"13579bdf"))
    rows = spark.createDataFrame([("list.txt", bytearray(b"0x010\n0x011\n"))], "path string, content binary")
    assert {r.n: r.flagged for r in keyfiles.scan_key_files(rows, K.PREDICATES["odd"]).collect()} == {"10": False, "11": True}


def _package(member: bytes, compressed: bool = True) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED if compressed else zipfile.ZIP_STORED) as z:
        z.writestr("META-INF/CERT.RSA", member)
    return held.getvalue()


def test_broken_packages_are_rows_with_errors(spark):
    whole = _package(bytes(range(256)) * 8)
    corrupt = bytearray(whole)
    corrupt[60:90] = b"\xff" * 30
    encrypted = bytearray(_package(b"abc", False))
    encrypted[6] |= 1
    encrypted[encrypted.index(b"PK\x01\x02") + 8] |= 1
    unknown = bytearray(_package(b"abc", False))
    unknown[8] = 99
    unknown[unknown.index(b"PK\x01\x02") + 10] = 99
    made = [whole, bytes(corrupt), bytes(encrypted), bytes(unknown), whole[: len(whole) // 2], b"", b"\x30\x84\xff\xff", None]
    files_in = spark.createDataFrame([(k, x, "clash") for k, x in enumerate(made)], "id int, content binary, n string")
    for parse in (frames.parse_apk, frames.parse_apk_signers):
        out = {r.id: r.error for r in parse(files_in).collect()}
        assert len(out) == len(made) and out[7] is None and all(out[k] for k in range(7))
    assert "in_n" in frames.parse_apk(files_in).columns
    assert frames.parse_apk(files_in.limit(0)).count() == 0


def test_broken_archives_are_rows_with_errors(spark, tmp_path):
    held = io.BytesIO()
    with tarfile.open(fileobj=held, mode="w") as tar:
        for name in ("a.txt", "b.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2000
            tar.addfile(info, io.BytesIO(b"x" * 2000))
    (tmp_path / "whole.tar").write_bytes(held.getvalue())
    (tmp_path / "cut.tar").write_bytes(held.getvalue()[:3500])
    (tmp_path / "none.tar").write_bytes(b"no archive at all")
    (tmp_path / "plain.txt").write_bytes(b"y")
    got = sorted((r.path.rsplit("/", 1)[1], len(r.content or b""), r.error is None) for r in keyfiles.read_key_files(spark, str(tmp_path)).collect())
    assert [x for x in got if x[0].startswith(("plain", "whole"))] == [("plain.txt", 1, True), ("whole.tar!a.txt", 2000, True), ("whole.tar!b.txt", 2000, True)]
    assert ("none.tar", 0, False) in got and ("cut.tar", 0, False) in got and ("cut.tar!a.txt", 2000, True) in got


def test_signature_checks_of_odd_numbers(spark):
    rows = [(b"t", "1", "2a864886f70d01010b", n, "3") for n in ("0", "x", "10001", None, "")]
    found = spark.createDataFrame(rows, "t binary, s string, a string, n string, e string").select("n", frames.verifies("t", "s", "a", "n", "e").alias("v"))
    assert {r.n: r.v for r in found.collect()} == {"0": None, "x": None, "10001": False, None: None, "": None}


def test_keys_in_json_with_paths(spark):
    texts = ['{"a": [{"n": "0x1", "x": {"mod": 12345678901234567890123}}], "certs": ["aa", {"cert": "bb"}], "n": null, "mod": true}', "[" * 3000, '{"n": "q\\"n\\": 1"}', "no json", "", None, "7"]
    out = [r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select(keyfiles.json_keys("t").alias("k")).collect()]
    assert [tuple(x) for x in out[0]] == [("$.a[0].n", "mod", "0x1"), ("$.a[0].x.mod", "mod", "12345678901234567890123"), ("$.certs[0]", "cert", "aa"), ("$.certs[1].cert", "cert", "bb")]
    assert [x.value for x in out[2]] == ['q"n": 1'] and out[1] == out[3] == out[4] == out[5] == out[6] == []


def test_a_half_written_table_is_written_again(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(10).toDF("id")
    assert files.run_once(rows, path).count() == 10
    assert files.run_once(rows.limit(3), path).count() == 10
    (tmp_path / "t" / "_SUCCESS").unlink()
    next((tmp_path / "t").glob("*.parquet")).unlink()
    assert files.run_once(rows, path).count() == 10


def test_tolerant_json_of_odd_lines(spark):
    lines = ['{"id": 1, "a": "x"}', '{"a": "y", "id": 1}', '{"a": null}', '{"id": "no number"}', "junk and more junk", "", None, '{"id": 2']
    good, bad = files.read_json_tolerant(spark.createDataFrame([(x,) for x in lines], "value string"), "a string, id long", id_col="id")
    assert sorted(r.id or 0 for r in good.collect()) == [0, 1]
    assert sorted(str(r.line) for r in bad.collect()) == sorted(map(str, lines[3:]))


def test_catalogues_by_layout(spark):
    row = lambda name, *cells: f"<tr><td><a href='/{name}'>{name}</a></td>{''.join(f'<td>{c}</td>' for c in cells)}</tr>"
    pages = [(1, f"<h2>2020-01-02 00:00:00</h2><table>{row('f', 'lz4', '5 B', 'aa')}</table><h2>2020-01-03 00:00:00</h2><table>{row('g', 'lz4', '6 B', 'bb')}</table>"), (2, "<table><tr><td>no link</td></tr></table>"), (3, None)]
    cells = markup.html_tables(spark.createDataFrame(pages, "id int, html string"), "html", "id")
    out = markup.build_catalogue(cells, "id", layout="header").orderBy("id").collect()
    assert [(r.id, r.date, r.date_utc, sorted(r.files)) for r in out] == [(10, "2020-01-03 00:00:00", 1578009600, ["g"]), (11, "2020-01-02 00:00:00", 1577923200, ["f"])]
    dated = [(1, f"<table>{row('f', '', 'aa', '5', '2020-01-02')}{row('g', '', 'bb', '6', '2020-01-03')}</table><table>{row('h', '', 'cc', '7', '2020-01-02')}{row('f', '', 'dd', '8', '2020-01-02')}</table>")]
    out = markup.build_catalogue(markup.html_tables(spark.createDataFrame(dated, "id int, html string"), "html", "id"), "id", layout="date").orderBy("id").collect()
    assert [(r.id, r.date, {k: (v["size"], v["hash"]) for k, v in r.files.items()}) for r in out] == [(10, "2020-01-02", {"f": (8, "dd"), "h": (7, "cc")}), (11, "2020-01-03", {"g": (6, "bb")})]
    assert markup.build_catalogue(cells.limit(0), "id").count() == 0


def test_retry_until_the_cap(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, 2), (3, 0), (None, 0)], "id int, fail_cnt int")
    left = streams.retry(rows, rows.where("id in (1, 2)"), "id", 2, str(tmp_path / "dead"))
    assert [tuple(r) for r in left.collect()] == [(1, 1)]
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == [(2, 3)]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_association_stream_equals_batch(spark, tmp_path, kind):
    """Three starts over growing input, the second batch delivered twice: rows are those of the batch form, changes are few."""
    rng = random.Random(9)
    items = {"string": ["x", "y", "z", None], "int": [5, 6, 7, None]}[kind]
    seen = [(rng.choice("abc"), rng.choice(items), t) for t in range(12) for _ in range(3)]
    rows = spark.createDataFrame(seen, f"who string, item {kind}, t long")
    at = lambda name: str(tmp_path / name)
    for lo in (0, 4, 4, 8):
        rows.where((F.col("t") >= lo) & (F.col("t") < lo + 4)).write.mode("append").parquet(at("in"))
        streams.stream_assoc(spark.readStream.schema(rows.schema).parquet(at("in")), "who", "item", "t", at("out"), at("checkpoint"))
    got = streams.assoc_table(spark, at("out"), "who", "item").select("who", "item", "found_at", "lost_at")
    want = relations.assoc_history(rows, "who", "item", "t").where("item is not null")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(at("out")).count() == want.count() + want.where("lost_at is not null").count()


def test_replayed_rows_count_once(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = spark.createDataFrame([(k % 9, 3600 * k) for k in range(40)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    for _ in range(2):
        rows.write.mode("append").parquet(at("in"))
        stream = spark.readStream.schema(rows.schema).parquet(at("in"))
        streams.run_available(streams.stream_first_seen(stream, "id", "ts", "60 hours"), at("check"), at("out"))
    assert sorted(r.id for r in spark.read.parquet(at("out")).collect()) == list(range(9))


def test_sessions_and_tumbling_windows(spark, tmp_path):
    rows = [("a", 0), ("a", 50), ("a", 170), ("b", 10), ("b", 500), (None, 3)]
    frame = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = streams.once(spark, streams.stream_trailing_counts(stream, "ts", "k", gap="100 seconds"), "complete")
    assert sorted(map(str, ((r.k, r.start.timestamp(), r.end.timestamp(), r.n) for r in out.collect()))) == sorted(map(str, [("a", 0.0, 150.0, 2), ("a", 170.0, 270.0, 1), ("b", 10.0, 110.0, 1), ("b", 500.0, 600.0, 1), (None, 3.0, 103.0, 1)]))
    out = streams.once(spark, streams.stream_trailing_counts(stream, "ts", "k", "100 seconds", None), "complete")
    assert sorted((r.start.timestamp(), r.n) for r in out.where("k = 'a'").collect()) == [(0.0, 2), (100.0, 1)]


def test_unknown_fields_and_broken_lines_survive(spark):
    schema = "id bigint, a struct<b: string, c: struct<d: int>>, l array<int>"
    lines = ['{"id":1,"a":{"b":"x","c":{"d":4,"z":[1,{"q":2}]},"y":null},"l":[1,2],"more":"\u00e9"}', '{"id":2}', '{"a":{"u":1}}', "{broken", "", "[1]", "7", '{"id":"no number"}', None, '{"id":3,"a":null,"rest":5,"bad":6}']
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    got = scans.parse_lines(frame, schema).select("id", "a", "l", F.to_json("rest").alias("rest"), "bad").collect()
    assert [(r.id, r.rest, r.bad) for r in got] == [(1, '{"a":{"c":{"z":[1,{"q":2}]},"y":null},"more":"é"}', None), (2, None, None), (None, '{"a":{"u":1}}', None), *((None, None, x or "") for x in lines[3:9]), (3, '{"bad":6,"rest":5}', None)]
    assert got[0].a.c.d == 4 and got[0].l == [1, 2]
    again = scans.format_lines(scans.parse_lines(frame, schema), schema)
    assert [r.value for r in again.collect()][3:9] == [x or "" for x in lines[3:9]]
    assert sorted(map(str, scans.parse_lines(again, schema).select("id", "a", "l", F.to_json("rest").alias("rest"), "bad").collect())) == sorted(map(str, got))


def test_packets_of_one_key_in_many_rows(spark):
    rows = [("k", t, "Public-Subkey" if t % 3 else "User ID", t) for t in range(3000)] + [("m", 1, "User ID", 9), (None, 1, "Public-Subkey", 9)]
    got = scans.flatten_packets(spark.createDataFrame(rows, "key string, at int, tag string, n int").repartition(7), "key", "at", "tag").collect()
    want = [("k", 0, True, None), ("m", 0, True, None), *(("k", p + 1, False, t) for p, t in enumerate(t for t in range(3000) if t % 3))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bitmaps_count_unions_exactly(spark):
    rng = random.Random(2)
    rows = [(f"d{d}", f"k{rng.randrange(70_000)}") for d in range(4) for _ in range(30_000)]
    hosts = spark.createDataFrame(rows, "snap string, fprint string")
    stored = stats.key_bitmaps(hosts, snapshots.seq_id(hosts.select("fprint").distinct(), "fprint"))
    assert {(r.group, r.n) for r in stats.bitmap_counts(stored, F.col("snap")).collect()} == {(d, len({k for s, k in rows if s == d})) for d in {s for s, _ in rows}}
    assert stats.bitmap_counts(stored, F.lit(1)).first().n == len({k for _, k in rows})


def test_keyed_table_pages_and_merges(spark, tmp_path):
    """Pages cross gaps; lost attempts leave nothing; a failed write changes nothing; a repeated write changes nothing."""
    options = {"module": "sqlite3", "database": str(tmp_path / "t.db"), "timeout": "60", "table": "t", "key": "id", "page": "7", "parts": "3"}
    spark.dataSource.register(database.KeyedTable)
    with database.connect(options) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    read = lambda: sorted(map(tuple, spark.read.format("keyed_table").schema("id long, v string").options(**options).load().collect()))
    write = lambda df: df.write.format("keyed_table").mode("append").options(**options).save()
    assert read() == []
    first = [(k, f"a{k}") for k in [-5, *range(40, 60), *range(900, 931)]]
    write(spark.createDataFrame([*first, (None, "none")], "id long, v string").repartition(4))
    assert read() == first
    second = spark.createDataFrame([(k, "b") for k in range(50, 905)], "id long, v string").repartition(5)
    for _ in range(2):
        write(second)
        assert read() == sorted({**dict(first), **{k: "b" for k in range(50, 905)}}.items())
    before = read()
    with pytest.raises(Exception):
        write(second.withColumn("v", F.when(F.col("id") == 700, F.raise_error(F.lit("lost"))).otherwise("c")))
    assert read() == before
    with database.connect(options) as db:
        assert [n for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")] == ["t"]
    one = spark.read.format("keyed_table").schema("v string").options(**options).load()
    assert one.count() == len(before)


def test_archive_in_spans(spark, tmp_path):
    """10 000 members of one archive, with long names, empty files, equal names, links and folders, by several tasks."""
    (tmp_path / "a b%").mkdir()
    with tarfile.open(tmp_path / "a b%/one.tar", "w", format=tarfile.GNU_FORMAT) as tar:
        for k in range(10_000):
            info = tarfile.TarInfo(f"{'deep/' * (30 if k % 1000 == 0 else 1)}{k // 2}")
            info.size = k % 50 * 20
            tar.addfile(info, io.BytesIO(str(k).encode().ljust(info.size)[: info.size]))
        for name, kind in (("folder", tarfile.DIRTYPE), ("link", tarfile.SYMTYPE)):
            info = tarfile.TarInfo(name)
            info.type, info.linkname = kind, "deep/1"
            tar.addfile(info)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = archives.read_members(spark, files, span=1 << 20).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((f"{'deep/' * (30 if k % 1000 == 0 else 1)}{k // 2}", str(k).encode().ljust(k % 50 * 20)[: k % 50 * 20]) for k in range(10_000))
    assert sorted((r.path.split("!")[1], bytes(r.content)) for r in got) == want
    assert len({r.task for r in got}) > 2 and all(r.error is None for r in got)


def test_archive_written_and_broken(spark, tmp_path):
    """Null names are left out, null contents are empty, archives roll; what stands after a bad block is reported."""
    at = str(tmp_path / "out")
    spark.dataSource.register(archives.TarFiles)
    df = spark.createDataFrame([(f"n{k}", bytearray(b"x" * 5000)) for k in range(20)] + [(None, bytearray(b"y")), ("none", None), ("n1", bytearray(b"again"))], "name string, content binary")
    for _ in range(2):
        df.coalesce(1).write.format("tar_files").mode("append").option("path", at).option("bytes", 20_000).save()
    made = sorted((tmp_path / "out").iterdir())
    assert len(made) > 4 and all(p.suffix in (".tar", ".crc") for p in made)
    rows = keyfiles.read_key_files(spark, at).collect()
    assert sorted((r.path.split("!")[1], len(r.content)) for r in rows) == sorted(2 * ([(f"n{k}", 5000) for k in range(20)] + [("none", 0), ("n1", 5)]))
    first = next(p for p in made if p.suffix == ".tar" and tarfile.open(p).getnames()[:2] == ["n0", "n1"])
    whole = first.read_bytes()
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/bad.tar").write_bytes(whole[:5632] + b"?" * 512 + whole[6144:])
    (tmp_path / "bad/empty.tar").write_bytes(b"")
    bad = sorted((r.path.rsplit("/", 1)[1], r.content and len(r.content), r.error is None) for r in keyfiles.read_key_files(spark, str(tmp_path / "bad")).collect())
    assert bad == [("bad.tar", None, False), ("bad.tar!n0", 5000, True)]


def test_archive_in_frames(spark, tmp_path):
    """Members across frames are read by place and by several tasks; without a list of frames, or cut, archives are streamed."""
    at = tmp_path / "made"
    spark.dataSource.register(archives.TarFiles)
    sizes = {f"n{k}": k * 37 % 9000 for k in range(3000)} | {"large": 9 << 20, "none": 0}
    df = spark.createDataFrame(sizes.items(), "name string, size int").select("name", F.repeat(F.sha2("name", 256), F.ceil(F.col("size") / 64).cast("int")).cast("binary").alias("content"))
    df.coalesce(1).write.format("tar_files").mode("append").option("path", str(at)).option("compression", "zstd").save()
    (made,) = [p for p in at.iterdir() if p.name.endswith(".tar.zst")]
    whole, want = made.read_bytes(), {r.name: bytes(r.content) for r in df.collect()}
    with made.open("rb") as f:
        found = archives.frame_sizes(f, len(whole))
    assert len(found) > 3 and archives.frame_sizes(io.BytesIO(whole[:-1]), len(whole) - 1) is None
    files = lambda path: spark.read.format("binaryFile").load(str(path))
    got = archives.read_members(spark, files(made), span=1 << 20).withColumn("task", F.spark_partition_id()).collect()
    assert {r.path.split("!")[1]: bytes(r.content) for r in got} == want and len(got) == len(want) and len({r.task for r in got}) > 2
    assert {r.name for r in archives.list_members(files(made)).collect()} == set(want)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read()
    (tmp_path / "other").mkdir()
    (tmp_path / "other/stream.tar.zst").write_bytes(zstandard.ZstdCompressor().compress(plain))
    (tmp_path / "other/cut.tar.zst").write_bytes(whole[: int(found[:2, 0].sum()) + 9])
    (tmp_path / "other/none.tar.zst").write_bytes(b"no archive at all, but as long as a list")
    rows = keyfiles.read_key_files(spark, str(tmp_path / "other")).collect()
    by = {n: [r for r in rows if f"/{n}.tar.zst" in r.path] for n in ("stream", "cut", "none")}
    assert {r.path.split("!")[1]: bytes(r.content) for r in by["stream"]} == want
    assert [r.error is None for r in by["none"]] == [False] and sum(r.error is not None for r in by["cut"]) == 1
    assert 100 < len(by["cut"]) < len(want) and all(bytes(r.content) == want[r.path.split("!")[1]] for r in by["cut"] if r.error is None)
    changed = bytearray(whole)
    changed[int(found[0, 0]) + 40 : int(found[0, 0]) + 80] = bytes(40)
    (tmp_path / "changed.tar.zst").write_bytes(changed)
    rows = keyfiles.read_key_files(spark, str(tmp_path / "changed.tar.zst")).collect()
    assert any(r.error for r in rows) and all(bytes(r.content) == want[r.path.split("!")[1]] for r in rows if r.error is None)


def test_lists_in_parts(spark):
    """One key with 10 000 of the rows, a null key, null and repeated values; no task places a whole key."""
    rows = [("hot", k) for k in range(10_000)] + [("cold", 5), ("cold", 5), ("cold", None), (None, 7), (None, 3), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(8)
    got = {(r.k, r.part): (r.n, list(r["values"])) for r in relations.lists_in_parts(df, "k", "v", 999).collect()}
    want = {("hot", p): (len(range(10_000)[p * 999 : p * 999 + 999]), list(range(10_000)[p * 999 : p * 999 + 999])) for p in range(11)}
    assert got == want | {("cold", 0): (1, [5]), (None, 0): (2, [3, 7])}
    first, parts = relations.unique_in_parts(df.withColumn("o", F.col("v")), "k", "o", "v", 2)
    assert {(r.k, r.v, r.n_rows) for r in first.where("k is null or k <> 'hot'").collect()} == {("cold", 5, 3), (None, 3, 2), ("none", None, 1)}
    assert sorted(r["values"] for r in parts.where("k = 'cold'").collect()) == [[5, 5]]
    left = spark.createDataFrame([("cold",), ("cold",), ("x",), (None,)], "k string")
    assert {(r.k, r.part, r.n, tuple(r["values"])) for r in relations.attached_in_parts(left, df, "k", "v").collect()} == {("cold", 0, 1, (5,)), ("x", 0, 0, ()), (None, 0, 0, ())}
    placed = snapshots.place_within(df.where("v is not null").repartition(8), "k", "v", start=1).collect()
    assert sorted((r.v, r.place) for r in placed if r.k == "hot") == [(k, k + 1) for k in range(10_000)]
    assert sorted((r.v, r.place) for r in placed if r.k is None) == [(3, 1), (7, 2)]
    assert relations.lists_in_parts(df.limit(0), "k", "v").count() == 0


def test_ordered_in_parts(spark):
    """Values in an order of their own, with null values, null orders, ties and a null key; a month's key without hosts."""
    rows = [("hot", k, (k * 7) % 1000 if k % 10 else None) for k in range(3000)] + [("few", 2, 5), ("few", 2, 3), ("few", None, 9), (None, 1, 4)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(8)
    got = {(r.k, r.part): (r.n, list(r["values"])) for r in relations.ordered_in_parts(df, "k", "o", "v", 700).collect()}
    hot = [v for k, _, v in rows if k == "hot"]
    assert got == {("hot", p): (len(hot[p * 700 : p * 700 + 700]), hot[p * 700 : p * 700 + 700]) for p in range(5)} | {("few", 0): (3, [9, 3, 5]), (None, 0): (1, [4])}
    flags = {(r.k, r.part): list(r["values"]) for r in stats.matches_in_parts(df, "k", "o", F.col("v") > 3, 2).where("k is null or k = 'few'").collect()}
    assert flags == {("few", 0): [True, False], ("few", 1): [True], (None, 0): [True]}
    totals, parts = stats.contributors_in_parts(df.where("k is null or k = 'few'"), "k", "v", "o", 2)
    assert {(r.k, r.total, r.average) for r in totals.collect()} == {("few", 4, 2.0), (None, 1, 1.0)}
    assert {(r.k, r.part, tuple(r["values"])) for r in parts.collect()} == {("few", 0, ("3", "5")), ("few", 1, ("9",)), (None, 0, ("4",))}
    hosts = spark.createDataFrame([("2024-01-03", "a", 1), ("2024-01-09", "a", 2), ("2024-01-09", "a", 2), ("2024-01-03", "b", 3), ("2024-02-01", None, 4)], "snap string, fprint string, ip long").withColumn("snap", F.col("snap").cast("timestamp"))
    assert sorted((r.month.month, str(r.fprint), r.n, list(r["values"])) for r in relations.month_in_parts(hosts, hosts).collect()) == [(1, "a", 1, [2]), (1, "b", 0, []), (2, "None", 0, [])]


def test_pages_of_odd_forms(spark):
    """Null and empty pages, entries that lack parts, and rows outside the primary part."""
    row = '<div class="appRow"><a href="/apk/c/x">X 2</a></div><p><span>V:</span>2</p><p>no time</p><p><span>S:</span>3 gb</p>'
    pages = [(1, None), (2, ""), (3, row), (4, f'<div id="primary">{row}<div class="appRow">no link</div></div>'), (5, "<li>none</li><li><a href='q'>x</a></li><li><a href=\"/a/b\">y</a></li>")]
    df = spark.createDataFrame(pages, "id long, html string")
    got = markup.listing_entries(df).collect()
    assert [(r.id, r.title, r.app, r.type, r.version, r.uploaded, r.size, r.downloads, r.variants, r.company) for r in got] == [(4, "X 2", "X", None, "2", None, 3 << 30, None, False, "c")]
    assert [(r.id, r.place, r.app, r.package, r.download) for r in markup.site_rankings(df, "html", "list", first=1).collect()] == [(5, 3, None, "b", "/a/b")]
    assert markup.site_rankings(df, "html", "cards").count() == markup.site_rankings(df, "html", "dashboard").count() == markup.sitemap_links(df, "html").count() == 0
    assert [r.k for r in df.select(markup.sitemap_kind(F.col("html")).alias("k")).collect()] == [None] * 5


def test_rankings_read_an_entry_once_and_on_all_cores(spark):
    page = '<table><tr class="main-row"><td>1</td><td class="app-with-publisher-rank-iap"><a href="/apps/com.a/details/1"></a><div class="asset-name"><span>A</span></div></td></tr></table>'
    df = spark.createDataFrame([(1, page), (2, "<p></p>"), (3, None)], "id int, html string").repartition(2)
    found = markup.site_rankings(df, "html", "dashboard", "top")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("main-row") == plan.count("app-with-publisher") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 1, "A", "com.a", None, "free", "/apps/com.a/details/1", None)]
    for name in ("s14_site_rankings", "s14_app_rankings"):
        plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition 16, true" in plan, name  # one small file, all cores


def test_workers_hand_on_a_few_inputs_at_a_time(spark, monkeypatch):
    """Of a large batch no worker holds all records or cells."""
    import pandas as pd
    import pyarrow as pa

    taken = {}
    kind = type(spark.range(1))
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(kind, name, lambda self, f, schema, name=name: taken.update({name: f}))
    frames.parse_rows(spark.createDataFrame([(1, b"x")], "id long, data binary"), "data", "v string", lambda d: [{"v": d.decode()}] * 2)
    batch = pd.DataFrame({"id": range(3 * frames.RECORDS // 2), "__bytes": [b"x"] * (3 * frames.RECORDS // 2)})
    sizes = [len(out) for out in taken["mapInPandas"](iter([batch]))]
    assert sizes == [2 * frames.RECORDS, frames.RECORDS]
    markup.html_tables(spark.createDataFrame([(1, "x")], "id long, html string"), "html", "id")
    page = "<table><tr><td>1</td><td>2</td></tr></table>"
    out = list(taken["mapInArrow"](iter([pa.record_batch({"id": list(range(5000)), "html": [page] * 4999 + [None]})])))
    assert sum(b.num_rows for b in out) == 9998 and max(b.num_rows for b in out) < 2 * markup.CELLS
    assert out[-1].to_pylist()[-1] == {"id": 4998, "header": None, "tbl": 0, "line": 0, "col": 1, "text": "2", "href": None}


def test_pick_versions_makes_a_key_once(spark):
    rows = [("a", v) for v in ("1.10.2", "1.9", "1.9.0", "1.9.1", "1.10", "0.9", None)] + [("z", v) for v in ("0", "0.0.1", None)] + [("one", "1.0"), ("none", None), (None, "1"), (None, "2"), ("t", "1.0.6"), ("t", "1.0.5"), ("t", "1-rc"), ("t", "0.9-b.7")]
    out = relations.pick_versions(spark.createDataFrame(rows, "g string, version string"), "g")
    assert {tuple(r) for r in out.collect()} == {("a", "1.10.2", "top"), ("a", "1.9", "lower"), ("z", "0.0.1", "top"), ("one", "1.0", "top"), ("none", None, "top"), (None, "2", "top"), ("t", "1-rc", "top"), ("t", "1.0.6", "lower")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[0-9]{1,38}") <= 3


def test_places_have_ranges_as_rows_ask_for(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.hash("id").alias("v"))
    monkeypatch.setattr(snapshots, "RANGE", 100)
    placed = snapshots.place_within(df, "k", "v")
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [__p" in plan and ", 34" in plan  # 4 cores, 3000 rows
    want = {(k, v): n for k in (0, 1) for n, v in enumerate(sorted(r.v for r in df.where(F.col("k") == k).collect()))}
    assert {(r.k, r.v): r.place for r in placed.collect()} == want
