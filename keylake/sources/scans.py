"""Scan results and key dumps as JSON lines: schemas, validity, and flat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keylake.functions.keys import bit_length, hex_canon
from keylake.functions.text import date_part
from keylake.operators.snapshots import place_within
from keylake.session import free_names

PARSED = (
    "struct<subject: struct<common_name: array<string>>, subject_dn: string, issuer_dn: string, validity: struct<start: string>, fingerprint_sha256: string, fingerprint_sha1: string, "
    "signature: struct<valid: boolean, self_signed: boolean>, subject_key_info: struct<key_algorithm: struct<name: string>, rsa_public_key: struct<modulus: string, exponent: bigint>>, "
    "extensions: struct<basic_constraints: struct<is_ca: boolean>>>"
)
TLS_SCAN = f"ip string, domain string, timestamp string, data struct<tls: struct<server_certificates: struct<validation: struct<browser_trusted: boolean, matches_domain: boolean>, certificate: struct<parsed: {PARSED}>, chain: array<struct<parsed: {PARSED}, raw: string>>>>>"
X509_DUMP = f"raw string, parsed {PARSED}, parents array<string>, source string, seen_in_scan boolean, valid_nss boolean, was_valid_nss boolean, current_valid_nss boolean"
_PACKET = "tag_name: string, user_id: string, key_id: string, fingerprint: string, n: string, e: string, algo_id: int, creation_time: bigint"
PGP_DUMP = f"key_id string, fingerprint string, n string, e string, algo_id int, creation_time bigint, packets array<struct<{_PACKET}>>"


def _at(value: Column, path: str) -> Column:
    """The fields of the object at a path of a variant, as a map; empty where there is none. Every level starts from the root, so
    that expressions grow with the schema and not with its depth."""
    return F.coalesce(F.try_variant_get(value, path, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def _objects(parts: list[tuple[str, Column]]) -> Column:
    """A map of variant objects from maps by name, without the empty ones."""
    full = F.filter(F.array(*[F.struct(F.lit(name).alias("key"), fields.alias("fields")) for name, fields in parts]), lambda x: F.size(x["fields"]) > 0)
    return F.map_from_entries(F.transform(full, lambda x: F.struct(x["key"].alias("key"), F.to_variant_object(x["fields"]).alias("value"))))


def _structs(kind: T.StructType) -> list[T.StructField]:
    return [f for f in kind.fields if isinstance(f.dataType, T.StructType)]


def _remainder(value: Column, kind: T.StructType, path: str = "$") -> Column:
    """Fields of a variant object that a schema lacks, at any depth of its structs: a map of variants."""
    unknown = F.map_filter(_at(value, path), lambda k, v: ~k.isin([f.name for f in kind.fields]))
    inner = [(f.name, _remainder(value, f.dataType, f"{path}.{f.name}")) for f in _structs(kind)]
    return F.map_concat(unknown, _objects(inner)) if inner else unknown


def parse_lines(lines: DataFrame, schema: str, line_col: str = "value") -> DataFrame:
    """JSON lines as the schema's columns, with rest and bad.

    rest is a variant of the fields that the schema lacks, at any depth of its structs (not inside its arrays), null where
    there are none. bad is the line where it is no JSON object or a known field has another type; its other columns are
    null. A null line is bad, and an empty string then.
    """
    kind = T.StructType.fromDDL(schema)
    row, bad, value = free_names(lines, "row", "bad_line", "variant")
    parsed = lines.withColumn(value, F.try_parse_json(line_col)).withColumn(row, F.from_json(line_col, f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    sound = F.coalesce(F.col(row)[bad].isNull() & F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    rest = _remainder(F.col(value), kind)
    return parsed.select(
        *[F.when(sound, F.col(row)[f.name]).alias(f.name) for f in kind.fields],
        F.when(sound & (F.size(rest) > 0), F.to_variant_object(rest)).alias("rest"),
        F.when(~sound, F.coalesce(line_col, F.lit(""))).alias("bad"),
    )


def read_lines(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """parse_lines() of text files: scans and dumps as they are, with unknown fields and broken records."""
    return parse_lines(spark.read.text(paths), schema)


def _merged(known: Column, rest: Column, kind: T.StructType, path: str = "$") -> Column:
    """A map of variants of a struct's fields and of those in rest, which go into the structs that they were in."""
    inner = [f.name for f in _structs(kind)]
    own = F.to_json(F.struct(*[known[f.name].alias(f.name) for f in kind.fields if f.name not in inner]))
    parts = [F.try_variant_get(F.parse_json(own), "$", "map<string,variant>"), F.map_filter(_at(rest, path), lambda k, v: ~k.isin(inner))]
    if inner:
        parts.append(_objects([(f.name, _merged(known[f.name], rest, f.dataType, f"{path}.{f.name}")) for f in _structs(kind)]))
    return F.map_concat(*parts)


def format_lines(df: DataFrame, schema: str) -> DataFrame:
    """(value): the JSON lines of parse_lines()' rows again: known fields and rest merged, null fields left out, and bad lines as they were."""
    kind = T.StructType.fromDDL(schema)
    whole = F.to_json(F.to_variant_object(_merged(F.struct(*[f.name for f in kind.fields]), F.col("rest"), kind)))
    return df.select(F.coalesce("bad", whole).alias("value"))


def read_tls_scan(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.schema(TLS_SCAN).json(paths)


def read_x509_dump(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.schema(X509_DUMP).json(paths)


def read_pgp_dump(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.schema(PGP_DUMP).json(paths)


SSH_KEYS = "id bigint, mod string, e bigint, raw string"


def read_ssh_keys(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.schema(SSH_KEYS).json(paths)


_CERTS = "data.tls.server_certificates"


def tls_funnel(df: DataFrame) -> DataFrame:
    """df with reject_reason: not_tls, not_ok (no validation or certificate), not_parsed or not_rsa; null if it passes."""
    s = F.col(_CERTS)
    parsed = s["certificate"]["parsed"]
    reason = F.when(F.col("data.tls").isNull(), "not_tls").when(s.isNull() | s["validation"].isNull() | s["certificate"].isNull(), "not_ok")
    return df.withColumn("reject_reason", reason.when(parsed.isNull(), "not_parsed").when(~is_rsa(parsed), "not_rsa"))


def is_rsa(parsed: Column) -> Column:
    return F.coalesce(F.lower(parsed["subject_key_info"]["key_algorithm"]["name"]) == "rsa", F.lit(False)) & parsed["subject_key_info"]["rsa_public_key"].isNotNull()


def _record(parsed: Column) -> list[Column]:
    key = parsed["subject_key_info"]["rsa_public_key"]
    return [
        parsed["fingerprint_sha256"].alias("fprint"), parsed["fingerprint_sha1"].alias("fprint_sha1"), F.try_element_at(parsed["subject"]["common_name"], F.lit(1)).alias("cn"),
        date_part(parsed["validity"]["start"]).alias("not_before"), parsed["subject_dn"].alias("subject_dn"), parsed["issuer_dn"].alias("issuer_dn"), parsed["signature"]["self_signed"].alias("self_signed"),
        F.coalesce(parsed["extensions"]["basic_constraints"]["is_ca"], F.lit(False)).alias("is_ca"), hex_canon(F.hex(F.try_to_binary(key["modulus"], F.lit("base64")))).alias("n"), key["exponent"].alias("e"),
    ]


def tls_leaf(df: DataFrame) -> DataFrame:
    """One flat record for each host that passes the funnel."""
    s = F.col(_CERTS)
    kept = tls_funnel(df).where("reject_reason is null")
    return kept.select("ip", "domain", "timestamp", s["validation"]["browser_trusted"].alias("trusted"), s["validation"]["matches_domain"].alias("matches"), *_record(s["certificate"]["parsed"]))


def tls_chain(df: DataFrame) -> DataFrame:
    """One flat record for each parsed certificate of each chain, with its position; RSA or not is in is_rsa."""
    chain = df.select("ip", F.posexplode(f"{_CERTS}.chain").alias("pos", "c")).where("c.parsed is not null")
    parsed = F.col("c.parsed")
    return chain.select("ip", "pos", F.col("c.raw").alias("raw"), is_rsa(parsed).alias("is_rsa"), *_record(parsed))


def dump_flagged(df: DataFrame, flag) -> DataFrame:
    """Records of a certificate dump whose modulus a predicate (Column -> Column) flags; self_signed is issuer = subject."""
    flat = df.select(F.sha1(F.try_to_binary("raw", F.lit("base64"))).alias("fprint"), "parents", "seen_in_scan", *[c.alias(f"p_{k}") for k, c in enumerate(_record(F.col("parsed")))])
    flat = flat.toDF("fprint", "parents", "seen_in_scan", "fprint_sha256", "fprint_sha1", "cn", "not_before", "subject_dn", "issuer_dn", "self_signed", "is_ca", "n", "e")
    return flat.where(flag(F.col("n"))).withColumn("self_signed", F.col("subject_dn").eqNullSafe(F.col("issuer_dn")))


def classified(df: DataFrame, corpus: str, record_id: Column, n_hex: Column, e_hex: Column, fprint: Column, name: Column, date: Column, flagged: Column, attrs: list[str]) -> DataFrame:
    """Records of one shape for every corpus: corpus, record_id, source (name, date), n_hex, e_hex, bits, flagged, fprint, attrs.

    attrs is a variant object of the named columns, whatever their types, so that corpora of any columns can be united. A
    modulus is canonical hex; one that is null has no bits and is not flagged.
    """
    n = hex_canon(n_hex)
    return df.select(
        F.lit(corpus).alias("corpus"), record_id.cast("string").alias("record_id"), F.struct(name.cast("string").alias("name"), date.cast("string").alias("date")).alias("source"),
        n.alias("n_hex"), hex_canon(e_hex).alias("e_hex"), bit_length(n).alias("bits"), F.coalesce(flagged, F.lit(False)).alias("flagged"), fprint.alias("fprint"), F.to_variant_object(F.struct(*attrs)).alias("attrs"),
    )


def flatten_packets(packets: DataFrame, key: str, order: str, tag: str, subkey: str = "Public-Subkey") -> DataFrame:
    """flatten_pgp() for packets that are rows of their own: (master_id, pos, is_master, and the packet's other columns).

    Subkeys are numbered by ranges of (key, order), so a key with very many packets is no single row or task.
    """
    rest = [c for c in packets.columns if c not in (key, order, tag)]
    known = packets.where(F.col(key).isNotNull())
    subkeys = place_within(known.where(F.col(tag) == subkey).select(key, order, *rest), key, order, start=1)
    masters = known.select(key).distinct().select(F.col(key).alias("master_id"), F.lit(0).alias("pos"), F.lit(True).alias("is_master"))
    return masters.unionByName(subkeys.select(F.col(key).alias("master_id"), F.col("place").cast("int").alias("pos"), F.lit(False).alias("is_master"), *rest), allowMissingColumns=True)


def flatten_pgp(df: DataFrame, key: str = "key_id", packets: str = "packets", tag: str = "tag_name", subkey: str = "Public-Subkey") -> DataFrame:
    """(key_id, pos, is_master, packet): a row for the master and each of its subkeys; rows without key_id are dropped.

    The master's own fields stand in a packet of the same shape; no shuffle is needed.
    """
    shape = df.schema[packets].dataType.elementType
    master = F.struct(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields])
    family = F.concat(F.array(master), F.coalesce(F.filter(packets, lambda p: p[tag] == subkey), F.array().cast(df.schema[packets].dataType)))
    return df.where(F.col(key).isNotNull()).select(F.col(key).alias("master_id"), F.posexplode(family).alias("pos", "packet")).withColumn("is_master", F.col("pos") == 0)


def archive_record(df: DataFrame, is_rsa_col: Column, is_ca_col: Column, raw: str, keep_non_rsa_ca: bool = True) -> DataFrame:
    """Rows that are RSA, or CA certificates if asked; raw is kept for CA certificates only."""
    kept = is_rsa_col | (F.lit(keep_non_rsa_ca) & is_ca_col)
    return df.where(F.coalesce(kept, F.lit(False))).withColumn(raw, F.when(is_ca_col, F.col(raw)))


def ca_candidates(df: DataFrame, ca: str = "ca", fprint: str = "fprint", raw: str = "raw") -> DataFrame:
    """Rows with raw bytes whose ca is true or unknown; a fingerprint that isn't 40 digits is computed from raw (base64)."""
    der = F.try_to_binary(raw, F.lit("base64"))
    kept = df.where(F.coalesce(F.col(ca), F.lit(True)) & F.col(raw).isNotNull())
    return kept.withColumn(fprint, F.when(F.length(fprint) == 40, F.lower(fprint)).otherwise(F.sha1(der)))


def recode_ssh(df: DataFrame) -> DataFrame:
    """(source, n, e) of keys whose modulus has more than five characters; e in hex, source an array of the id."""
    return df.where(F.length("mod") > 5).select(F.array("id").alias("source"), hex_canon(F.col("mod")).alias("n"), F.lower(F.hex("e")).alias("e"))
