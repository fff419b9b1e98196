"""Column functions for keys: big integers as hex text, ids and fingerprints. Native expressions but for decimal_to_hex."""

from __future__ import annotations

import sys
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Small primes of the published residue test for weak RSA moduli (CCS 2017); the allowed residues are powers of 65537.
PRIMES = (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 53, 61, 71, 73, 79, 97, 103, 107, 109, 127, 151, 157)
GENERATOR = 65537


def hex_canon(c: Column) -> Column:
    """Lower case, without 0x or \\x and leading zeros; zero is '0'."""
    digits = F.ltrim(F.regexp_replace(F.lower(F.trim(c)), r"^(0x|\\x)", ""), F.lit("0"))
    return F.when(c.isNotNull() & (digits == ""), "0").otherwise(digits)


def bit_length(c: Column) -> Column:
    """Bits of a canonical hex integer; 0 for zero."""
    lead = F.conv(F.substring(c, 1, 1), 16, 10).cast("int")
    bits = F.when(lead >= 8, 4).when(lead >= 4, 3).when(lead >= 2, 2).when(lead >= 1, 1).otherwise(0)
    return (4 * (F.length(c) - 1) + bits).cast("int")


def msb(c: Column) -> Column:
    """The top digits down to the first byte boundary: one digit if the length is odd, else two."""
    return F.when(F.length(c) % 2 == 1, F.substring(c, 1, 1)).otherwise(F.substring(c, 1, 2))


def hex_mod(c: Column, p: int) -> Column:
    """Residue of a hex integer of any length, in chunks of six digits from the left; the first chunk may be shorter."""
    size = F.when(F.length(c) % 6 == 0, 6).otherwise(F.length(c) % 6)
    first = F.conv(F.substring(c, F.lit(1), size), 16, 10).cast("long") % p
    starts = F.when(F.length(c) > size, F.sequence(size + 1, F.length(c), F.lit(6))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, first, lambda acc, at: (acc * (1 << 24) + F.conv(F.substring(c, at, F.lit(6)), 16, 10).cast("long")) % p)


def _allowed(p: int) -> list[int]:
    out, x = [], 1
    while x not in out:
        out.append(x)
        x = x * GENERATOR % p
    return out


def _moduli(primes: tuple[int, ...]) -> list[tuple[int, list[int]]]:
    """Products of neighbouring primes that hex_mod can work with, below 2^38, and the primes of each."""
    out: list[tuple[int, list[int]]] = []
    for p in primes:
        if out and out[-1][0] * p < 1 << 38:
            out[-1] = (out[-1][0] * p, [*out[-1][1], p])
        else:
            out.append((p, [p]))
    return out


def weak_key_flag(c: Column) -> Column:
    """Is every residue a power of 65537: the fingerprint of moduli from the flawed generator; null for null.

    The digits are folded once for each product of primes; small residues follow from the residue by the product.
    """
    return reduce(Column.__and__, [_allows(hex_mod(c, product), primes) for product, primes in _moduli(PRIMES)])


def _allows(residue: Column, primes: list[int]) -> Column:
    """Does a residue by a product of primes leave an allowed one by each; the residue is worked out once."""
    return F.transform(F.array(residue), lambda r: reduce(Column.__and__, [(r % p).isin(_allowed(p)) for p in primes]))[0]


def pgp_key_id(c: Column) -> Column:
    """16 lower hex digits."""
    return F.lpad(hex_canon(c), 16, "0")


def package_id(group: Column, artifact: Column, version: Column) -> Column:
    """group:artifact:version; null if a part is."""
    return F.concat(group, F.lit(":"), artifact, F.lit(":"), version)


def national_id_check(c: Column) -> Column:
    """Does the last of eleven digits agree with the two weight rows, modulo 11."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.substring(c, i, F.lit(1)).cast("int"))

    def total(weights: tuple[int, ...]) -> Column:
        return F.aggregate(F.zip_with(digits, F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w), F.lit(0), lambda a, x: a + x) % 11

    first, second = total((1, 2, 3, 4, 5, 6, 7, 8, 9, 1)), total((3, 4, 5, 6, 7, 8, 9, 1, 2, 3))
    check = F.when(first < 10, first).when(second < 10, second).otherwise(0)
    return F.when(c.rlike("^[0-9]{11}$"), check == F.substring(c, 11, 1).try_cast("int")).otherwise(False)


def time_between(ts: Column, start: str, end: str) -> Column:
    """Is the time of day in [start, end), over midnight if start is later."""
    t = F.date_format(ts, "HH:mm:ss")
    return ((t >= start) & (t < end)) if start <= end else ((t >= start) | (t < end))


@F.pandas_udf(StringType())
def decimal_to_hex(s: pd.Series) -> pd.Series:
    """Decimal digits of any length as hex; null for null."""
    sys.set_int_max_str_digits(0)
    return s.map(lambda x: None if x is None else f"{int(x):x}")


def big_integers(c: Column) -> Column:
    """Every reading of a text as a big integer: an array of (encoding, n), n in canonical hex.

    A text of digits only is read as hex, as base64 (if its length is a multiple of four) and as decimal.
    """
    t = F.trim(c)
    base64 = F.when(t.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length(t) % 4 == 0), hex_canon(F.hex(F.try_to_binary(t, F.lit("base64")))))
    readings = [
        F.when(t.rlike(r"^(0x|\\x)?[0-9A-Fa-f]+$"), F.struct(F.lit("hex").alias("encoding"), hex_canon(t).alias("n"))),
        F.when(base64.isNotNull(), F.struct(F.lit("base64").alias("encoding"), base64.alias("n"))),
        F.when(t.rlike("^[0-9]+$"), F.struct(F.lit("decimal").alias("encoding"), decimal_to_hex(F.when(t.rlike("^[0-9]+$"), t)).alias("n"))),
    ]
    return F.array_compact(F.array(*readings))


def ssh_rsa(line: Column) -> Column:
    """(e, n, bits) of an `ssh-rsa` line, options before the type dropped; null if it is none or is cut short."""
    raw = F.try_to_binary(F.regexp_extract(line, r"ssh-rsa\s+([A-Za-z0-9+/=]+)", 1), F.lit("base64"))
    h = F.lower(F.hex(raw))

    def field(start: Column) -> tuple[Column, Column]:
        """The field that starts at a digit, and the digit after it."""
        size = F.conv(F.substring(h, start, F.lit(8)), 16, 10).cast("int") * 2
        return F.substring(h, start + 8, size), start + 8 + size

    e, after = field(F.lit(23))
    n, end = field(after)
    made = F.struct(hex_canon(e).alias("e"), hex_canon(n).alias("n"), bit_length(hex_canon(n)).alias("bits"))
    return F.when(F.startswith(h, F.lit("000000077373682d727361")) & (F.length(h) >= end - 1) & (F.length(n) > 0), made)


def national_id_parts(c: Column) -> Column:
    """(sex digit, birth date, serial) of eleven digits; the date is null if there is no such day."""
    century = F.floor((F.substring(c, 1, 1).try_cast("int") - 1) / 2) + 18
    day = F.try_to_date(F.concat(century.cast("string"), F.substring(c, 2, 2), F.lit("-"), F.substring(c, 4, 2), F.lit("-"), F.substring(c, 6, 2)))
    return F.struct(F.substring(c, 1, 1).try_cast("int").alias("sex"), day.alias("born"), F.substring(c, 8, 3).try_cast("int").alias("serial"))


#: Predicates on canonical hex moduli, by name.
PREDICATES = {"weak": weak_key_flag}


def register_predicate(name: str, predicate) -> None:
    """Make a function of Column to Column known by name; a name that is known is replaced."""
    PREDICATES[name] = predicate


def hex_to_base64(c: Column) -> Column:
    """base64 of the bytes of a hex text, a digit short of a byte being padded; null for other text."""
    return F.base64(F.try_to_binary(F.when(F.length(c) % 2 == 1, F.concat(F.lit("0"), c)).otherwise(c), F.lit("hex")))


def base64_to_hex(c: Column) -> Column:
    """Canonical hex of the number that base64 bytes hold, high byte first; null for other text."""
    return hex_canon(F.hex(F.try_to_binary(c, F.lit("base64"))))


def pad_hex(c: Column, size: int) -> Column:
    """Hex with zeros on its left, of so many digits; longer ones are unchanged."""
    return F.when(F.length(c) < size, F.lpad(c, size, "0")).otherwise(c)


def hex_to_long(c: Column) -> Column:
    """A hex integer below 2^63 as a long; null for larger ones and other text."""
    h = hex_canon(c)
    return F.when(h.rlike("^([0-7][0-9a-f]{15}|[0-9a-f]{1,15})$"), F.conv(h, 16, 10).cast("long"))


def fingerprints(der: Column) -> dict[str, Column]:
    """md5, sha1, sha256 and size of bytes; null for null."""
    return {"md5": F.md5(der), "sha1": F.sha1(der), "sha256": F.sha2(der, 256), "size": F.octet_length(der).cast("long")}
