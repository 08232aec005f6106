"""Canonical JSON and content digests.

Payloads of text, integers and arrays are put together by Spark's own functions. Payloads that may hold floating point numbers
or text that needs escapes go through one Arrow function, as number formats differ between the JVM and Python.
"""

from __future__ import annotations

import hashlib
import json
import math
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(value):
    """Plain JSON: -0.0 is 0.0, sets are sorted, keys are text; NaN and infinities are refused."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("not a finite number")
        return value + 0.0
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("a key is no text")
        return {k: normalize(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return sorted((normalize(v) for v in value), key=canonical_json)
    return [normalize(v) for v in value] if isinstance(value, (list, tuple)) else value


def canonical_json(value) -> str:
    return json.dumps(normalize(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def content_digest(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_text(c: Column) -> Column:
    """JSON text -> canonical JSON text; null for null and for text that isn't JSON."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else canonical_json(json.loads(x))
            except ValueError:
                return None

        return s.map(one, na_action=None)

    return run(c)


def digest(c: Column) -> Column:
    return F.sha2(canonical_text(c), 256)


def search_text(c: Column) -> Column:
    """Keys and scalars of JSON text, depth first, joined by blanks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def walk(v):
            if isinstance(v, dict):
                return [x for k in sorted(v) for x in (k, *walk(v[k]))]
            return [x for i in v for x in walk(i)] if isinstance(v, list) else [] if v is None else [str(v)]

        return s.map(lambda x: None if x is None else " ".join(walk(json.loads(x))))

    return run(c)


def digest_without(c: Column, field: str) -> Column:
    """The digest of a JSON object without one of its fields; null for what is no object."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                value = None if x is None else json.loads(x)
                return content_digest({k: v for k, v in value.items() if k != field}) if isinstance(value, dict) else None
            except ValueError:
                return None

        return s.map(one, na_action=None)

    return run(c)


def cbor(value) -> bytes:
    """Deterministic CBOR (RFC 8949, 4.2.1) of plain JSON: shortest heads, numbers of 64 bits, keys in the order of their bytes."""
    value = normalize(value) if isinstance(value, (dict, list, tuple, set, frozenset, float)) else value

    def head(kind: int, n: int) -> bytes:
        if n < 24:
            return bytes([kind << 5 | n])
        for at, size in enumerate((1, 2, 4, 8)):
            if n < 1 << 8 * size:
                return bytes([kind << 5 | 24 + at]) + n.to_bytes(size, "big")
        raise ValueError("a number needs more than 64 bits")

    if value is None or isinstance(value, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        for size, code in (("e", 0xF9), ("f", 0xFA), ("d", 0xFB)):
            try:
                packed = struct.pack(">" + size, value)
            except OverflowError:
                continue
            if struct.unpack(">" + size, packed)[0] == value:
                return bytes([code]) + packed
    if isinstance(value, str):
        return head(3, len(value.encode())) + value.encode()
    if isinstance(value, list):
        return head(4, len(value)) + b"".join(map(cbor, value))
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(k + v for k, v in sorted((cbor(k), cbor(v)) for k, v in value.items()))
    raise ValueError(f"no plain JSON: {type(value).__name__}")


def decode_cbor(data: bytes):
    """The value of ``cbor`` bytes; anything else is refused."""

    def read(at: int):
        kind, low = data[at] >> 5, data[at] & 31
        if kind == 7:
            if low in (20, 21, 22):
                return {20: False, 21: True, 22: None}[low], at + 1
            size, code = {25: (2, "e"), 26: (4, "f"), 27: (8, "d")}[low]
            return struct.unpack(">" + code, data[at + 1 : at + 1 + size])[0], at + 1 + size
        n, at = (low, at + 1) if low < 24 else (int.from_bytes(data[at + 1 : at + 1 + (1 << low - 24)], "big"), at + 1 + (1 << low - 24))
        if kind in (0, 1):
            return n if kind == 0 else -1 - n, at
        if kind == 3:
            return data[at : at + n].decode(), at + n
        items = []
        for _ in range(n * (2 if kind == 5 else 1)):
            item, at = read(at)
            items.append(item)
        return (items if kind == 4 else dict(zip(items[::2], items[1::2]))), at

    value, end = read(0)
    if end != len(data) or cbor(value) != data:
        raise ValueError("not canonical CBOR")
    return value
