"""DataFrame forms of the parsers: each maps Arrow batches, keeps the other columns, and reports bad bytes in `error`."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from keylake.parsers import der, pgp

CERTIFICATE = "key_type string, n string, e string, serial string, subject_dn string, issuer_dn string, cn string, not_before string, not_after string, is_ca boolean, alt_names array<string>, subject_key_id string, authority_key_id string, sig_alg string, tbs binary, signature string"
#: Inputs that a worker parses before it hands their records on.
RECORDS = 500

SIGNER = "serial string, issuer_dn string, digest_alg string, sig_alg string, signed_at string, signer_count int"
PGP_KEY = "key_id string, fingerprint string, created long, algorithm int, n string, e string, is_master boolean, master_key_id string, identities array<string>"
PGP_SIGNATURE = "version int, type int, key_algorithm int, hash_algorithm int, key_id string, created long, expires long"


def parse_rows(df: DataFrame, column: str, schema: str, parse: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """df without column, with the fields of each record in its bytes: a row for each; for none, one with nulls and error.

    Null bytes give a row of nulls without error. Whatever a parser raises over its bytes becomes the row's error, as
    records come from anywhere: none fails the job. Columns of df that a field's name clashes with are kept as in_<name>.
    A worker parses a few inputs at a time and hands their records on, so it holds those of no whole batch.
    """
    fields = [f.split()[0] for f in schema.split(", ")] + ["error"]
    kept = [c for c in df.columns if c != column]
    renamed = df.select(*[F.col(f"`{c}`").alias(f"in_{c}" if c in fields else c) for c in kept], F.col(f"`{column}`").cast("binary").alias("__bytes"))
    others = renamed.columns[:-1]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[k : k + RECORDS] for b in batches for k in range(0, len(b), RECORDS)):
            rows, at = [], []
            for k, data in enumerate(batch["__bytes"]):
                found, error = [], None
                if data is not None:
                    try:
                        found = list(parse(bytes(data)))
                        error = None if found else "no record"
                    except Exception as e:  # of any kind, as archives and decoders raise their own
                        error = f"{type(e).__name__}: {e}"
                for row in found or [{}]:
                    rows.append([row.get(f) for f in fields[:-1]] + [error])
                    at.append(k)
            left = batch[others].iloc[at].reset_index(drop=True)
            yield pd.concat([left, pd.DataFrame(rows, columns=fields, dtype=object)], axis=1)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in renamed.schema.fields[:-1])
    return renamed.mapInPandas(work, ", ".join(x for x in (ddl, schema, "error string") if x))


def parse_certificates(df: DataFrame, column: str = "der") -> DataFrame:
    """Fields of a DER certificate, with is self_signed and its fingerprints."""
    out = parse_rows(df.withColumn("__der", F.col(column)), column, CERTIFICATE, lambda d: [der.certificate(d)])
    raw = F.col("__der")
    return out.withColumns({"self_signed": F.col("subject_dn") == F.col("issuer_dn"), "sha1": F.sha1(raw), "sha256": F.sha2(raw, 256)}).drop("__der")


def parse_rsa_keys(df: DataFrame, column: str = "der") -> DataFrame:
    """n and e of PKCS#1, PKCS#8 or public-key bytes."""
    return parse_rows(df, column, "n string, e string", lambda d: [dict(zip(("n", "e"), der.rsa_key(d)))])


def parse_pgp(df: DataFrame, column: str = "data") -> DataFrame:
    """A row for each key and subkey of OpenPGP bytes; keys without a master are no record."""
    return parse_rows(df, column, PGP_KEY, pgp.key_rows)


def parse_pgp_signatures(df: DataFrame, column: str = "data") -> DataFrame:
    return parse_rows(df, column, PGP_SIGNATURE, lambda d: [pgp.signature(b) for tag, b in pgp.packets(d) if tag == pgp.SIGNATURE])


def _apk(data: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        signers = [z.read(n) for n in z.namelist() if n.startswith("META-INF/") and n.upper().endswith((".RSA", ".DSA", ".EC"))]
    return [der.certificate(c) for s in signers for c in der.pkcs7_certificates(s)]


def _signers(data: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        blocks = [z.read(n) for n in z.namelist() if n.startswith("META-INF/") and n.upper().endswith((".RSA", ".DSA", ".EC"))]
    return [s for b in blocks for s in der.pkcs7_signers(b)]


def parse_apk_signers(df: DataFrame, column: str = "content") -> DataFrame:
    """A row for each signer of an application package: serial number, issuer, digest and signature algorithm, sign time."""
    return parse_rows(df, column, SIGNER, _signers)


def parse_apk(df: DataFrame, column: str = "content") -> DataFrame:
    """The signing certificates of application packages, with digests and size of the package."""
    raw = F.col(column)
    marked = df.withColumns({"md5": F.md5(raw), "sha1": F.sha1(raw), "sha256": F.sha2(raw, 256), "size": F.octet_length(raw)})
    return parse_rows(marked, column, CERTIFICATE, _apk)


#: Signature algorithm, digest and the bytes before the digest in a PKCS#1 signature.
SIGNATURES = {
    "2a864886f70d010105": ("sha1", "3021300906052b0e03021a05000414"),
    "2a864886f70d01010b": ("sha256", "3031300d060960864801650304020105000420"),
    "2a864886f70d01010c": ("sha384", "3041300d060960864801650304020205000430"),
    "2a864886f70d01010d": ("sha512", "3051300d060960864801650304020305000440"),
}


@F.pandas_udf(BooleanType())
def verifies(tbs: pd.Series, signature: pd.Series, sig_alg: pd.Series, n: pd.Series, e: pd.Series) -> pd.Series:
    """Does an RSA signature hold under a key (n, e); null if it is of another kind, or a part is null or no number."""

    def one(t, s, a, n, e):
        if t is None or s is None or n is None or e is None or a not in SIGNATURES:
            return None
        name, prefix = SIGNATURES[a]
        try:
            value, exponent, modulus = int(s, 16), int(e, 16), int(n, 16)
        except ValueError:
            return None
        if modulus <= 0 or exponent < 0:
            return None
        size = (modulus.bit_length() + 7) // 8
        tail = "00" + prefix + hashlib.new(name, t).hexdigest()
        return f"{pow(value, exponent, modulus):0{2 * size}x}" == "0001" + "ff" * (size - 2 - len(tail) // 2) + tail

    return pd.Series([one(*row) for row in zip(tbs, signature, sig_alg, n, e)], dtype=object)


def verify_pairs(children: DataFrame, parents: DataFrame, parent_id: str, unknown: bool = False) -> DataFrame:
    """children with the parent_id of each parent whose key their signature verifies under.

    Parents are those whose subject is the child's issuer and, where both are known, whose key id is the child's
    authority key id; unknown says whether pairs of other algorithms stay.
    """
    p = parents.select(F.col("subject_dn").alias("__dn"), F.col("subject_key_id").alias("__ski"), F.col("n").alias("__n"), F.col("e").alias("__e"), F.col(parent_id).alias("parent"))
    # where both ids are known they are part of the key, so that one issuer's many keys do not all meet its many children
    by_id = children.join(p, (F.col("issuer_dn") == F.col("__dn")) & (F.col("authority_key_id") == F.col("__ski")))
    free = children.where("authority_key_id is null").join(p, F.col("issuer_dn") == F.col("__dn"))
    rest = children.where("authority_key_id is not null").join(p.where("__ski is null"), F.col("issuer_dn") == F.col("__dn"))
    pairs = by_id.unionByName(free).unionByName(rest)
    holds = verifies("tbs", "signature", "sig_alg", "__n", "__e")
    return pairs.withColumn("__ok", F.coalesce(holds, F.lit(unknown))).where("__ok").drop("__dn", "__ski", "__n", "__e", "__ok")
