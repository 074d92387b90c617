"""Byte-string coders of the simple containers: raw, byte runs, bit runs, adaptive binary arithmetic."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import jvm

METHODS = ("raw", "rle", "bit_rle", "arith")
HALVE_ABOVE = 4096  # sum of the adaptive counts (fixed value)
_TOP, _HALF, _QUARTER = (1 << 32) - 1, 1 << 31, 1 << 30


def rle_encode(data: bytes) -> bytes:
    """Runs of 4 or more as (1, length, byte), the rest as (0, length, bytes); lengths up to 255."""
    out, loose, at, n = bytearray(), 0, 0, len(data)

    def flush(end: int) -> None:
        for k in range(loose, end, 255):
            part = data[k : min(k + 255, end)]
            out.extend((0, len(part)))
            out.extend(part)

    while at < n:
        end = at + 1
        while end < n and end - at < 255 and data[end] == data[at]:
            end += 1
        if end - at >= 4:
            flush(at)
            out.extend((1, end - at, data[at]))
            at = loose = end
        else:
            at += 1
    flush(n)
    return bytes(out)


def rle_decode(code: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(code):
        if at + 2 > len(code) or code[at] > 1 or not code[at + 1]:
            raise ValueError("bad run")
        n = code[at + 1]
        body = code[at + 2 : at + 2 + (1 if code[at] else n)]
        if len(body) != (1 if code[at] else n) or len(out) + n > size:
            raise ValueError("bad run")
        out += body * n if code[at] else body
        at += 2 + len(body)
    if len(out) != size:
        raise ValueError("wrong length")
    return bytes(out)


def bit_rle_encode(data: bytes) -> bytes:
    """Top bit: the value; the rest: how often, up to 127."""
    if not data:
        return b""
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    edge = np.flatnonzero(np.diff(bits)) + 1
    starts = np.r_[0, edge]
    lengths = np.diff(np.r_[starts, len(bits)])
    parts = (lengths + 126) // 127
    size = np.full(parts.sum(), 127)
    size[np.cumsum(parts) - 1] = lengths - 127 * (parts - 1)
    return (np.repeat(bits[starts].astype(np.int64), parts) << 7 | size).astype(np.uint8).tobytes()


def bit_rle_decode(code: bytes, size: int) -> bytes:
    runs = np.frombuffer(code, np.uint8)
    lengths = (runs & 127).astype(np.int64)
    if (lengths == 0).any() or lengths.sum() != 8 * size:
        raise ValueError("bad run")
    return np.packbits(np.repeat(runs >> 7, lengths)).tobytes()


class _Counts:
    def __init__(self) -> None:
        self.n = [1, 1]

    def split(self, low: int, high: int) -> int:
        return low + (high - low + 1) * self.n[0] // sum(self.n) - 1

    def saw(self, bit: int) -> None:
        self.n[bit] += 1
        if sum(self.n) > HALVE_ABOVE:
            self.n = [max(1, (k + 1) // 2) for k in self.n]


def arith_encode(data: bytes) -> bytes:
    """One adaptive model for all bits; the interval is doubled as soon as its half is known."""
    out: list[int] = []
    low, high, waiting, counts = 0, _TOP, 0, _Counts()

    def put(bit: int) -> None:
        nonlocal waiting
        out.append(bit)
        out.extend([1 - bit] * waiting)
        waiting = 0

    for bit in np.unpackbits(np.frombuffer(data, np.uint8)).tolist():
        cut = counts.split(low, high)
        low, high = (cut + 1, high) if bit else (low, cut)
        while True:
            if high < _HALF:
                put(0)
                base = 0
            elif low >= _HALF:
                put(1)
                base = _HALF
            elif low >= _QUARTER and high < 3 * _QUARTER:
                waiting += 1
                base = _QUARTER
            else:
                break
            low, high = (low - base) * 2, (high - base) * 2 + 1
        counts.saw(bit)
    waiting += 1
    put(int(low >= _QUARTER))
    return np.packbits(np.array(out, dtype=np.uint8)).tobytes()


def arith_decode(code: bytes, size: int) -> bytes:
    bits = np.unpackbits(np.frombuffer(code, np.uint8)).tolist()
    bits += [0] * 32
    value, at = 0, 32
    for bit in bits[:32]:
        value = value * 2 + bit
    low, high, counts, out = 0, _TOP, _Counts(), []
    for _ in range(8 * size):
        cut = counts.split(low, high)
        bit = int(value > cut)
        low, high = (cut + 1, high) if bit else (low, cut)
        out.append(bit)
        while True:
            if high < _HALF:
                base = 0
            elif low >= _HALF:
                base = _HALF
            elif low >= _QUARTER and high < 3 * _QUARTER:
                base = _QUARTER
            else:
                break
            low, high = (low - base) * 2, (high - base) * 2 + 1
            value = (value - base) * 2 + (bits[at] if at < len(bits) else 0)
            at += 1
        counts.saw(bit)
    return np.packbits(np.array(out, dtype=np.uint8)).tobytes() if out else b""


def tries_bits(data: bytes) -> bool:
    """Bit runs are tried on short inputs and where three bytes in four are 0, 1, 128 or 255."""
    if len(data) <= 64:
        return True
    return 4 * int(np.isin(np.frombuffer(data, np.uint8), (0, 1, 128, 255)).sum()) >= 3 * len(data)


def encode(data: bytes, method: str | None = None) -> tuple[str, bytes]:
    """By a given method, or the smallest of raw, byte runs and bit runs by the container's rule."""
    coders = {"raw": bytes, "rle": rle_encode, "bit_rle": bit_rle_encode, "arith": arith_encode}
    if method is not None:
        return method, coders[method](data)
    runs = rle_encode(data)
    if tries_bits(data):
        bits = bit_rle_encode(data)
        if len(bits) < len(data) and len(bits) <= len(runs):
            return "bit_rle", bits
    return ("rle", runs) if len(runs) < len(data) else ("raw", data)


def decode(method: str, code: bytes, size: int) -> bytes:
    if method == "raw":
        if len(code) != size:
            raise ValueError("wrong length")
        return code
    return {"rle": rle_decode, "bit_rle": bit_rle_decode, "arith": arith_decode}[method](code, size)


def encode_column(df: DataFrame, key: str, column: str, method: str | None = None) -> DataFrame:
    """``key, method, raw_len, code`` of a binary column; null counts as empty.

    The coders run in the JVM, string by string: a code may be eight times as long as its string, so batches of them are not gathered.
    """
    if method is not None and method not in METHODS:
        raise ValueError(f"no method {method}")
    jvm.register(df.sparkSession)
    data = F.coalesce(F.col(column), F.lit(b""))
    coded = df.select(F.col(key), F.octet_length(data).cast("bigint").alias("raw_len"), jvm.entropy_encode(data, method).alias("_c"))
    return coded.select(key, "_c.method", "raw_len", "_c.code")


def decode_column(df: DataFrame, key: str) -> DataFrame:
    """``key, data`` from ``key, method, raw_len, code``; in the JVM, like the way there."""
    jvm.register(df.sparkSession)
    return df.select(key, jvm.entropy_decode(F.col("method"), F.col("code"), F.col("raw_len")).alias("data"))
