"""A reader of DER values, and the fields of certificates and RSA keys that the operators need."""

from __future__ import annotations

from collections.abc import Iterator

#: Object identifiers, as hex of their content, and the names used for them.
RSA = "2a864886f70d010101"
NAMES = {"550403": "CN", "550406": "C", "550407": "L", "550408": "ST", "55040a": "O", "55040b": "OU"}
ALT_NAME, CONSTRAINTS, SUBJECT_ID, AUTHORITY_ID = "551d11", "551d13", "551d0e", "551d23"


def values(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(tag, content, whole value) of each value in data; raises ValueError if one is cut short."""
    at = 0
    while at < len(data):
        start, tag, size, at = at, data[at], (data[at + 1] if at + 1 < len(data) else 0), at + 2
        if size >= 128:
            n = size - 128
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            raise ValueError("a value is cut short")
        yield tag, data[at : at + size], data[start : at + size]
        at += size


def children(data: bytes) -> list[tuple[int, bytes, bytes]]:
    """The values in the one value of data."""
    return list(values(next(values(data))[1]))


def distinguished_name(content: bytes) -> list[tuple[str, str]]:
    out = []
    for _, group, _ in values(content):
        for _, pair, _ in values(group):
            (_, oid, _), (tag, text, _) = list(values(pair))[:2]
            out.append((NAMES.get(oid.hex(), oid.hex()), text.decode("utf-16-be" if tag == 30 else "utf-8", "replace")))
    return out


def time(tag: int, content: bytes) -> str:
    """A date and time as 2020-12-31 23:59:59; two-digit years below 50 are of this century."""
    t = content.decode("ascii").rstrip("Z")
    if tag == 23:
        t = ("20" if int(t[:2]) < 50 else "19") + t
    return f"{t[:4]}-{t[4:6]}-{t[6:8]} {t[8:10]}:{t[10:12]}:{t[12:14] or '00'}"


def rsa_key(data: bytes) -> tuple[str, str]:
    """(n, e) in hex of a PKCS#1 public or private key, or of a public key with its algorithm."""
    parts = children(data)
    if parts[0][0] == 48:  # algorithm, then the key as a bit string
        return rsa_key(parts[1][1][1:])
    if len(parts) > 2:  # a private key starts with its version; PKCS#8 wraps it
        if parts[1][0] == 48:
            return rsa_key(parts[2][1])
        parts = parts[1:]
    return f"{int.from_bytes(parts[0][1], 'big'):x}", f"{int.from_bytes(parts[1][1], 'big'):x}"


def certificate(data: bytes) -> dict:
    """Fields of one X.509 certificate; raises ValueError or IndexError for other bytes."""
    (_, body, signed), (_, algorithm, _), (_, signature, _) = children(data)[:3]
    fields = list(values(body))
    if fields[0][0] == 0xA0:
        fields = fields[1:]
    issuer, subject = distinguished_name(fields[2][1]), distinguished_name(fields[4][1])
    before, after = [time(tag, content) for tag, content, _ in values(fields[3][1])][:2]
    key = list(values(fields[5][1]))
    is_rsa = next(values(key[0][1]))[1].hex() == RSA
    n, e = rsa_key(fields[5][2]) if is_rsa else (None, None)
    out = {"key_type": "RSA" if is_rsa else next(values(key[0][1]))[1].hex(), "n": n, "e": e, "serial": fields[0][1].hex()}
    out |= {"subject_dn": ", ".join(f"{k}={v}" for k, v in subject), "issuer_dn": ", ".join(f"{k}={v}" for k, v in issuer)}
    out |= {"cn": next((v for k, v in subject if k == "CN"), None), "not_before": before, "not_after": after, "is_ca": False, "alt_names": []}
    out |= {"subject_key_id": None, "authority_key_id": None, "sig_alg": next(values(algorithm))[1].hex(), "tbs": signed, "signature": signature[1:].hex()}
    for tag, content, _ in fields[6:]:
        for _, extension, _ in values(next(values(content))[1]) if tag == 0xA3 else ():
            parts = list(values(extension))
            oid, inner = parts[0][1].hex(), parts[-1][1]
            if oid == CONSTRAINTS:
                out["is_ca"] = any(t == 1 and v != b"\0" for t, v, _ in children(inner))
            elif oid == ALT_NAME:
                out["alt_names"] = [v.decode("utf-8", "replace") for t, v, _ in children(inner) if t == 0x82]
            elif oid == SUBJECT_ID:
                out["subject_key_id"] = next(values(inner))[1].hex()
            elif oid == AUTHORITY_ID:
                out["authority_key_id"] = next((v.hex() for t, v, _ in children(inner) if t == 0x80), None)
    return out


def pkcs7_certificates(data: bytes) -> list[bytes]:
    """The certificates of signed data."""
    inner = children(data)[1][1]
    return [whole for tag, content, _ in children(inner) if tag == 0xA0 for _, _, whole in values(content)]


#: Digest algorithms by object identifier, and that of the signing time.
DIGESTS = {"2a864886f70d0205": "md5", "2b0e03021a": "sha1", "608648016503040201": "sha256", "608648016503040202": "sha384", "608648016503040203": "sha512"}
SIGNING_TIME = "2a864886f70d010905"


def pkcs7_signers(data: bytes) -> list[dict]:
    """Serial number, issuer, algorithms and signing time of each signer of signed data."""
    inner = children(data)[1][1]
    found = [content for tag, content, _ in children(inner)[1:] if tag == 0x31]
    out = []
    for _, signer, _ in values(found[-1]) if len(found) > 1 else ():
        parts = list(values(signer))
        issuer, serial = list(values(parts[1][1]))[:2]
        row = {"serial": serial[1].hex(), "issuer_dn": ", ".join(f"{k}={v}" for k, v in distinguished_name(issuer[1])), "signed_at": None}
        digest = next(values(parts[2][1]))[1].hex()
        at = 3
        if parts[at][0] == 0xA0:
            for _, attribute, _ in values(parts[at][1]):
                (_, oid, _), (_, held, _) = list(values(attribute))[:2]
                if oid.hex() == SIGNING_TIME:
                    tag, content, _ = next(values(held))
                    row["signed_at"] = time(tag, content)
            at += 1
        out.append(row | {"digest_alg": DIGESTS.get(digest, digest), "sig_alg": next(values(parts[at][1]))[1].hex()})
    return [row | {"signer_count": len(out)} for row in out]
