"""A reader of OpenPGP packets: public keys, their subkeys, identities and signatures."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

KEY, SUBKEY, IDENTITY, SIGNATURE = 6, 14, 13, 2


def packets(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(tag, body) of each packet; ends at bytes that are no packet."""
    at = 0
    while at + 1 < len(data) and data[at] & 0x80:
        head, at = data[at], at + 1
        if head & 0x40:  # new format
            tag, first = head & 0x3F, data[at]
            if first < 192:
                size, at = first, at + 1
            elif first < 224:
                size, at = ((first - 192) << 8) + data[at + 1] + 192, at + 2
            else:
                size, at = int.from_bytes(data[at + 1 : at + 5], "big"), at + 5
        else:
            tag, kind = (head >> 2) & 15, head & 3
            n = (1, 2, 4, 0)[kind]
            size, at = (int.from_bytes(data[at : at + n], "big") if n else len(data) - at), at + n
        if at + size > len(data):
            return
        yield tag, data[at : at + size]
        at += size


def public_key(body: bytes) -> dict:
    """Fields of a key of version 4; n and e are null if it isn't RSA."""
    digest = hashlib.sha1(b"\x99" + len(body).to_bytes(2, "big") + body).hexdigest()
    out = {"key_id": digest[-16:], "fingerprint": digest, "created": int.from_bytes(body[1:5], "big"), "algorithm": body[5], "n": None, "e": None}
    if body[0] == 4 and body[5] in (1, 2, 3):
        at = 6
        for name in ("n", "e"):
            size = (int.from_bytes(body[at : at + 2], "big") + 7) // 8
            out[name], at = f"{int.from_bytes(body[at + 2 : at + 2 + size], 'big'):x}", at + 2 + size
    return out


def key_rows(data: bytes) -> list[dict]:
    """One row for each key and subkey: its fields, its master's id and the identities of the family."""
    rows, names = [], []
    for tag, body in packets(data):
        if tag in (KEY, SUBKEY):
            rows.append(public_key(body) | {"is_master": tag == KEY})
        elif tag == IDENTITY:
            names.append(body.decode("utf-8", "replace"))
    masters = [r["key_id"] for r in rows if r["is_master"]]
    return [r | {"master_key_id": masters[0], "identities": names} for r in rows] if masters else []


def signature(body: bytes) -> dict:
    """Fields of a signature of version 4: type, algorithms, issuer, creation and expiry; null where absent."""
    out = {"version": body[0], "type": body[1], "key_algorithm": body[2], "hash_algorithm": body[3], "key_id": None, "created": None, "expires": None}
    at = 4
    for _ in range(2):  # hashed, then other subpackets
        end = at + 2 + int.from_bytes(body[at : at + 2], "big")
        at += 2
        while at < end:
            size, at = body[at], at + 1
            if size >= 192:
                size, at = ((size - 192) << 8) + body[at] + 192, at + 1
            kind, content = body[at] & 127, body[at + 1 : at + size]
            if kind == 16:
                out["key_id"] = content.hex()
            elif kind in (2, 3):
                out["created" if kind == 2 else "expires"] = int.from_bytes(content, "big")
            at += size
        at = end
    return out
