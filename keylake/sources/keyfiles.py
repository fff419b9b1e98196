"""Key files of any format: reading, format detection and scanning."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from keylake.functions import keys as K
from keylake.functions.text import blocks
from keylake.parsers import frames
from keylake.session import materialize
from keylake.sources import archives
from keylake.sources.markup import ldif_certs


def read_key_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, content, error) of the files below folders; members of tar archives appear as path!member (see archives).

    An archive that breaks off, or is none, gives the members before that and a row with null content and the error. A file
    too large for one cell has null content and an error. Spark reads no files of no bytes, so these give no row; empty
    members of archives do.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    is_tar, fits = F.col("path").rlike(r"\.(tar|tar\.gz|tgz|tar\.zst)$"), F.col("length") <= archives.LARGEST
    none = F.lit(None).cast("string").alias("error")
    plain = files.where(~is_tar & fits).select("path", "content", none)
    large = files.where(~is_tar & ~fits).select("path", F.lit(None).cast("binary").alias("content"), F.format_string("%d bytes are too many", "length").alias("error"))
    return plain.unionByName(large).unionByName(archives.read_members(spark, files.where(is_tar)))


def detect_format(name: Column, text: Column) -> Column:
    """Every format that a file's name and content suggest."""
    lower = F.lower(name)
    rules = [
        ("pem", F.contains(text, F.lit("-----BEGIN CERTIFICATE"))), ("rsa_pem", text.rlike("-----BEGIN (RSA )?(PUBLIC|PRIVATE) KEY")), ("pgp", F.contains(text, F.lit("-----BEGIN PGP PUBLIC KEY"))),
        ("ssh", F.contains(text, F.lit("ssh-rsa "))), ("json", F.ltrim(text).rlike(r"^[\[{]") | F.endswith(lower, F.lit(".json"))), ("ldif", F.contains(text, F.lit("binary::")) | F.endswith(lower, F.lit(".ldif"))),
        ("der", lower.rlike(r"\.(der|crt|cer)$") & ~F.contains(text, F.lit("-----BEGIN"))), ("apk", F.endswith(lower, F.lit(".apk"))), ("mods", lower.rlike(r"\.(txt|mod|mods)$")), ("jks", lower.rlike(r"\.(jks|keystore)$")),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), kind) for kind, test in rules]))


#: Kind of what is found under a key of a JSON object.
JSON_KEYS = {"n": "mod", "mod": "mod", "modulus": "mod", "cert": "cert", "certs": "cert"}


def _walk(node, path: str) -> Iterator[dict[str, str]]:
    """(path, kind, value) below a parsed JSON value, without recursion, in order of place."""
    waiting = [(node, path, None)]
    while waiting:
        node, path, kind = waiting.pop()
        if isinstance(node, dict):
            waiting.extend((v, f"{path}.{k}", JSON_KEYS.get(k)) for k, v in reversed(node.items()))
        elif isinstance(node, list):
            waiting.extend((v, f"{path}[{k}]", kind) for k, v in reversed(list(enumerate(node))))
        elif kind and node is not None and not isinstance(node, bool):
            yield {"path": path, "kind": kind, "value": str(node)}


@F.pandas_udf(ArrayType(StructType([StructField(c, StringType()) for c in ("path", "kind", "value")])))
def json_keys(text: pd.Series) -> pd.Series:
    """(path, kind, value) of moduli (under n, mod, modulus) and certificates (cert, certs) at any depth of JSON texts.

    Numbers of any length are texts of their digits. Null, and text that is no JSON, give an empty list.
    """

    def one(t):
        try:
            return list(_walk(json.loads(t, parse_int=str, parse_float=str), "$")) if t else []
        except (ValueError, RecursionError):
            return []

    return text.map(one)


def json_moduli(text: Column) -> Column:
    """Texts under the keys n, mod and modulus of a JSON text, at any depth."""
    return F.transform(F.filter(json_keys(text), lambda x: x["kind"] == "mod"), lambda x: x["value"])


def format_counters(files: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, n_files, n_keys, n_flagged) for each format that files (path, content) suggest, from what a scan found in them."""
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.lit(""))
    kinds = files.select("path", F.explode(detect_format(F.col("path"), text)).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_files"))
    keys = found.groupBy("kind").agg(F.count("*").alias("n_keys"), F.count_if("flagged").alias("n_flagged"))
    return kinds.join(keys, "kind", "left").fillna(0, ["n_keys", "n_flagged"])


def scan_key_files(files: DataFrame, flag: Callable[[Column], Column] = K.weak_key_flag) -> DataFrame:
    """(path, kind, idx, n, flagged): a row for each key found in files (path, content), by each format that fits a file."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    known = files.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("kind", F.explode(detect_format(F.col("path"), F.coalesce(text, F.lit("")))))
    known = materialize(known, "detected")  # ten branches read it

    def found(kind: str, items: Column) -> DataFrame:
        return known.where(F.col("kind") == kind).select("path", "kind", F.posexplode(items).alias("idx", "item"))

    body = F.col("__text")
    der = found("pem", F.transform(F.filter(blocks(body), lambda b: b["label"] == "CERTIFICATE"), lambda b: F.try_to_binary(b["body"], F.lit("base64"))))
    nested = F.transform(F.filter(json_keys(body), lambda x: x["kind"] == "cert"), lambda x: F.try_to_binary(F.regexp_replace(x["value"], r"-----[A-Z ]+-----|\s", ""), F.lit("base64")))
    der = der.unionByName(found("der", F.array("content"))).unionByName(found("ldif", ldif_certs(body))).unionByName(found("json", nested))
    rsa = found("rsa_pem", F.transform(F.filter(blocks(body), lambda b: b["label"].rlike("^(RSA )?(PUBLIC|PRIVATE) KEY$")), lambda b: F.try_to_binary(b["body"], F.lit("base64"))))
    pgp = found("pgp", F.transform(F.filter(blocks(body), lambda b: F.startswith(b["label"], F.lit("PGP PUBLIC"))), lambda b: F.try_to_binary(b["body"], F.lit("base64"))))
    apk = known.where("kind = 'apk'").select("path", "kind", F.lit(0).alias("idx"), "content")
    lines = F.filter(F.split(body, r"\s*\n\s*"), lambda x: x != "")
    ssh = found("ssh", F.filter(lines, lambda x: F.contains(x, F.lit("ssh-rsa ")))).withColumn("n", K.ssh_rsa(F.col("item"))["n"])
    loose = found("mods", lines).unionByName(found("json", json_moduli(body)))
    loose = loose.select("path", "kind", "idx", F.explode(K.big_integers(F.col("item"))).alias("r")).withColumn("n", F.col("r.n"))
    parts = [frames.parse_certificates(der, "item"), frames.parse_rsa_keys(rsa, "item"), frames.parse_pgp(pgp, "item"), frames.parse_apk(apk), ssh, loose]
    out = None
    for p in parts:
        p = p.select("path", "kind", "idx", "n").where("n is not null")
        out = p if out is None else out.unionByName(p)
    return out.withColumn("flagged", flag(F.col("n")))
