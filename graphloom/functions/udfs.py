"""Functions that Spark lacks, as vectorised UDFs; they are registered when a query needs one."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_BASE32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
_MASK = 0xFFFFFFFF
#: Fixed values of BLAKE3: the initial state (that of SHA-256) and the order of message words between rounds.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)


def _rotate(x: int, n: int) -> int:
    return (x >> n | x << (32 - n)) & _MASK


def _compress(cv, block: bytes, counter: int, flags: int) -> list[int]:
    m = [int.from_bytes(block.ljust(64, b"\0")[i : i + 4], "little") for i in range(0, 64, 4)]
    s = [*cv, *_IV[:4], counter & _MASK, counter >> 32, len(block), flags]

    def mix(a, b, c, d, x, y):
        for add, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            s[a] = (s[a] + s[b] + add) & _MASK
            s[d] = _rotate(s[d] ^ s[a], r1)
            s[c] = (s[c] + s[d]) & _MASK
            s[b] = _rotate(s[b] ^ s[c], r2)

    for _ in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[k] for k in _ORDER]
    return [s[i] ^ s[i + 8] for i in range(8)]


def _node(data: bytes, index: int, root: int) -> list[int]:
    """The chaining value of a subtree: a chunk of 1,024 bytes, or two subtrees of which the left one is full."""
    if len(data) <= 1024:
        cv, blocks = list(_IV), [data[i : i + 64] for i in range(0, len(data), 64)] or [b""]
        for i, block in enumerate(blocks):
            last = i == len(blocks) - 1
            cv = _compress(cv, block, index, (i == 0) * 1 | last * 2 | (last and root))
        return cv
    left = 1024
    while left * 2 < len(data):
        left *= 2
    words = _node(data[:left], index, 0) + _node(data[left:], index + left // 1024, 0)
    return _compress(_IV, b"".join(w.to_bytes(4, "little") for w in words), 0, 4 | root)


def blake3(data: bytes) -> str:
    return b"".join(w.to_bytes(4, "little") for w in _node(data, 0, 8)).hex()


def _hashed(kind: str, text: str, salt: bytes) -> str:
    raw = hashlib.pbkdf2_hmac("sha256", text.encode(), salt, 10_000) if kind == "pbkdf2" else hashlib.scrypt(text.encode(), salt=salt, n=1024, r=8, p=1)
    return f"${kind}${salt.hex()}${raw.hex()}"


def _same(kind: str, made: str, text: str) -> bool:
    parts = made.split("$")
    return len(parts) == 4 and parts[1] == kind and _hashed(kind, text, bytes.fromhex(parts[2])) == made


def _ulid(ms: int) -> str:
    n = (int(ms) << 80) | int.from_bytes(os.urandom(10), "big")
    return "".join(_BASE32[n >> 5 * i & 31] for i in reversed(range(26)))


def register(spark: SparkSession) -> None:
    def one(f, returns):
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else f(x))

        return F.pandas_udf(run, returns)

    def two(f):
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

        return F.pandas_udf(run, "boolean")

    spark.udf.register("graphloom_blake3", one(lambda x: blake3(x.encode()), "string"))
    spark.udf.register("graphloom_ulid", one(_ulid, "string").asNondeterministic())
    for kind in ("pbkdf2", "scrypt"):
        spark.udf.register(f"graphloom_{kind}", one(lambda x, kind=kind: _hashed(kind, x, os.urandom(16)), "string").asNondeterministic())
        spark.udf.register(f"graphloom_{kind}_ok", two(lambda a, b, kind=kind: _same(kind, a, b)))
