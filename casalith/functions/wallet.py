"""Wallet addresses by their public checksums: mixed-case hexadecimal, Bech32 and Bech32m, Base58Check. Null where one fails."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Alphabets, version bytes by first character, and the constants of the two checksum kinds.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
VERSIONS = {"1": (0x00, 0x05), "3": (0x00, 0x05), "T": (0x41,)}
GENERATOR, PLAIN, MODIFIED = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3), 1, 0x2BC830A3


def _round_constants() -> list[int]:
    """Of Keccak: bit 2^j - 1 of round i is output 7 i + j of a linear feedback register."""
    out, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            c |= (r & 1) << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(c)
    return out


def keccak256(data: bytes) -> bytes:
    turn = lambda v, n: ((v << n) | (v >> (64 - n))) & (2**64 - 1) if n else v
    data = data + b"\x01" + b"\x00" * (-(len(data) + 1) % 136)
    data = data[:-1] + bytes([data[-1] | 0x80])
    a = [[0] * 5 for _ in range(5)]
    for at in range(0, len(data), 136):
        for i in range(17):
            a[i % 5][i // 5] ^= int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little")
        for constant in _round_constants():
            c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            d = [c[(x - 1) % 5] ^ turn(c[(x + 1) % 5], 1) for x in range(5)]
            a = [[a[x][y] ^ d[x] for y in range(5)] for x in range(5)]
            b, x, y, v = [row[:] for row in a], 1, 0, a[1][0]
            b = [[0] * 5 for _ in range(5)]
            b[0][0] = a[0][0]
            for t in range(24):
                b[y][(2 * x + 3 * y) % 5] = turn(a[x][y], (t + 1) * (t + 2) // 2 % 64)
                x, y = y, (2 * x + 3 * y) % 5
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            a[0][0] ^= constant
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def _hexadecimal(v: str) -> str | None:
    h = v[2:]
    if len(h) != 40 or any(c not in "0123456789abcdefABCDEF" for c in h):
        return None
    digest = keccak256(h.lower().encode()).hex()
    sound = "".join(c.upper() if int(d, 16) >= 8 else c for c, d in zip(h.lower(), digest, strict=False))
    mixed = h != h.lower() and h != h.upper()
    return None if mixed and sound != h else f"0x{sound}"


def _bech32(v: str) -> str | None:
    if len(v) > 90 or (v != v.lower() and v != v.upper()):
        return None
    v = v.lower()
    human, _, rest = v.rpartition("1")
    if human != "bc" or len(rest) < 8 or any(c not in BECH32 for c in rest):
        return None
    data, check = [BECH32.index(c) for c in rest], 1
    for x in [ord(c) >> 5 for c in human] + [0] + [ord(c) & 31 for c in human] + data:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ x
        for i, g in enumerate(GENERATOR):
            check ^= g if top >> i & 1 else 0
    version, program = data[0], data[1:-6]
    bits, spare = len(program) * 5 // 8, len(program) * 5 % 8
    fits = spare < 5 and not program[-1:] == [] and (program[-1] & ((1 << spare) - 1)) == 0
    ok = check == (PLAIN if version == 0 else MODIFIED) and version <= 16 and 2 <= bits <= 40 and (version > 0 or bits in (20, 32)) and fits
    return v if ok else None


def _base58(v: str) -> str | None:
    if not 26 <= len(v) <= 35 or any(c not in BASE58 for c in v):
        return None
    n = 0
    for c in v:
        n = n * 58 + BASE58.index(c)
    zeros = len(v) - len(v.lstrip("1"))
    raw = b"\x00" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")
    body, check = raw[:-4], raw[-4:]
    sound = hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] == check
    return v if sound and len(body) == 21 and body[0] in VERSIONS[v[0]] else None


def normalise_wallet(value: str | None) -> str | None:
    v = (value or "").strip()
    if v.startswith("0x"):
        return _hexadecimal(v)
    if v.lower().startswith("bc1"):
        return _bech32(v)
    return _base58(v) if v[:1] in VERSIONS else None


def wallet(value: Column) -> Column:
    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([normalise_wallet(v) for v in s], dtype=object)

    return of(value)
