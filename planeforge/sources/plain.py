"""Uncompressed interchange formats: PGM, PGX, raw planar, BMP, and the simple wavelet container."""

from __future__ import annotations

import re
import struct

import numpy as np

from ..operators import kernels
from .raster import FormatError, Plane, Raster, interleaved, need, pixels

# ---- PGM ------------------------------------------------------------------------------------------


def _tokens(data: bytes, n: int) -> tuple[list[bytes], int]:
    """``n`` header words, comments skipped, and where they end."""
    out, at = [], 0
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        need(end > at, "header ends early")
        out.append(data[at:end])
        at = end
    return out, at


def read_pgm(data: bytes) -> Raster:
    words, at = _tokens(data, 4)
    need(words[0] == b"P5" and all(w.isdigit() for w in words[1:]), "not a binary PGM")
    width, height, top = map(int, words[1:])
    need(top == 255 and width > 0 and height > 0, "not an 8-bit PGM")
    body = data[at + 1 :]
    need(len(body) == width * height, "wrong length")
    return interleaved(np.frombuffer(body, np.uint8).reshape(height, width, 1), 8)


def write_pgm(raster: Raster) -> bytes:
    p = pixels(raster)
    need(p.shape[2] == 1 and raster.depth == 8, "PGM holds one 8-bit component")
    return b"P5\n%d %d\n255\n" % (raster.width, raster.height) + p.astype(np.uint8).tobytes()


# ---- PGX ------------------------------------------------------------------------------------------


def _storage(precision: int) -> int:
    return 1 if precision <= 8 else 2 if precision <= 16 else 4 if precision <= 32 else 8


def read_pgx(data: bytes) -> Raster:
    head = re.match(rb"PG[ \t]+(ML|LM)[ \t]*([+-]?)[ \t]*(\d+)[ \t]+(\d+)[ \t]+(\d+)\r?\n", data)
    need(head is not None, "not a PGX header")
    order, sign, precision, width, height = head[1], head[2], *map(int, head.groups()[2:])
    need(1 <= precision <= 32 and width > 0 and height > 0, "PGX geometry")
    kind = np.dtype(f"{'>' if order == b'ML' else '<'}{'i' if sign == b'-' else 'u'}{_storage(precision)}")
    body = data[head.end() :]
    need(len(body) == width * height * kind.itemsize, "wrong length")
    return Raster([Plane(np.frombuffer(body, kind).reshape(height, width).astype(np.int64), precision, sign == b"-")], "planar").check()


def write_pgx(raster: Raster, component: int = 0, big_endian: bool = True) -> bytes:
    p = raster.planes[component]
    need(p.precision <= 32, "PGX holds 32 bits at most")
    kind = np.dtype(f"{'>' if big_endian else '<'}{'i' if p.signed else 'u'}{_storage(p.precision)}")
    height, width = p.samples.shape
    return b"PG %s %s%d %d %d\n" % (b"ML" if big_endian else b"LM", b"-" if p.signed else b"+", p.precision, width, height) + p.samples.astype(kind).tobytes()


# ---- raw planar -----------------------------------------------------------------------------------

#: Signature of the raw planar format (fixed value).
RAW_MAGIC = b"Z2KRAW1\n"
REGISTRATION = 1


def read_raw(data: bytes, most_components: int = 16384) -> Raster:
    need(len(data) >= 28 and data[:8] == RAW_MAGIC, "not a raw planar file")
    x0, y0, x1, y1, n, flags = struct.unpack(">IIIIHH", data[8:28])
    need(flags in (0, REGISTRATION) and 0 < n <= most_components and x1 > x0 and y1 > y0, "raw planar header")
    size = 32 if flags else 28
    at, planes = 28 + n * size, []
    need(at <= len(data), "component records end early")
    for k in range(n):
        record = data[28 + k * size : 28 + (k + 1) * size]
        precision, signed, xs, ys, cx, cy, w, h = struct.unpack(">BBBBIIII", record[:20])
        rx, ry = struct.unpack(">HH", record[20:24]) if flags else (0, 0)
        need(signed in (0, 1) and struct.unpack(">Q", record[-8:])[0] == w * h, "component record")
        kind = np.dtype(f">{'i' if signed else 'u'}{_storage(precision)}")
        end = at + w * h * kind.itemsize
        need(end <= len(data), "samples end early")
        planes.append(Plane(np.frombuffer(data[at:end], kind).reshape(h, w).astype(np.int64), precision, bool(signed), xs, ys, cx, cy, rx, ry))
        at = end
    need(at == len(data), "trailing bytes")
    return Raster(planes, "planar", origin=(x0, y0), extra={"extent": (x1, y1)}).check()


def write_raw(raster: Raster) -> bytes:
    raster.check()
    x0, y0 = raster.origin
    x1, y1 = raster.extra.get("extent", (x0 + raster.width, y0 + raster.height))
    out = [RAW_MAGIC, struct.pack(">IIIIHH", x0, y0, x1, y1, len(raster.planes), REGISTRATION)]
    for p in raster.planes:
        h, w = p.samples.shape
        out.append(struct.pack(">BBBBIIIIHHQ", p.precision, p.signed, p.x_step, p.y_step, p.x0, p.y0, w, h, p.x_registration, p.y_registration, w * h))
    for p in raster.planes:
        out.append(p.samples.astype(np.dtype(f">{'i' if p.signed else 'u'}{_storage(p.precision)}")).tobytes())
    return b"".join(out)


# ---- BMP ------------------------------------------------------------------------------------------


def read_bmp(data: bytes) -> Raster:
    need(len(data) >= 54 and data[:2] == b"BM", "not a BMP")
    size, _, start, header, width, height, planes, bits, packing = struct.unpack("<IIIIiiHHI", data[2:34])
    need(header >= 40 and planes == 1 and packing == 0 and bits in (24, 32) and width > 0 and height != 0, "only plain 24- and 32-bit BMPs")
    row = (width * bits // 8 + 3) & ~3
    need(size == len(data) and start + row * abs(height) == len(data), "wrong length")
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    bgr = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, :3]
    return interleaved((bgr if height < 0 else bgr[::-1])[:, :, ::-1], 8)


def write_bmp(raster: Raster) -> bytes:
    p = pixels(raster)
    need(p.shape[2] == 3 and raster.depth == 8, "BMP holds 8-bit RGB")
    h, w, _ = p.shape
    row = (w * 3 + 3) & ~3
    rows = np.zeros((h, row), np.uint8)
    rows[:, : w * 3] = p[::-1, :, ::-1].reshape(h, w * 3)
    size = 54 + row * h
    return struct.pack("<2sIIIIiiHHIIiiII", b"BM", size, 0, 54, 40, w, h, 1, 24, 0, row * h, 2835, 2835, 0, 0) + rows.tobytes()


# ---- simple wavelet container ---------------------------------------------------------------------

#: Signature and version of the container (fixed values).
SIMPLE_MAGIC, SIMPLE_VERSION = b"ZJ2K", 1
_KINDS = ("5/3", "9/7")


def _levels(height: int, width: int, wanted: int) -> int:
    n = 0
    while n < wanted and (height > 1 or width > 1):
        n, height, width = n + 1, (height + 1) // 2, (width + 1) // 2
    return n


def write_simple(raster: Raster, levels: int = 3, kind: str = "9/7", step: float = 1.0) -> bytes:
    p = pixels(raster)
    need(p.shape[2] == 1 and raster.depth == 8, "the container holds one 8-bit component")
    need(np.isfinite(step) and step > 0, "quantiser step")
    done = _levels(raster.height, raster.width, levels)
    c = kernels.analyse(p[:, :, 0].astype(np.int64) - 128, done, kind).astype(np.float32) / np.float32(step)
    q = np.clip(np.where(c >= 0, np.floor(c + np.float32(0.5)), np.ceil(c - np.float32(0.5))), -32768, 32767)
    head = SIMPLE_MAGIC + bytes([SIMPLE_VERSION, _KINDS.index(kind), done, 0]) + struct.pack("<IIf", raster.width, raster.height, step)
    return head + q.astype("<i2").tobytes()


def read_simple(data: bytes) -> Raster:
    need(len(data) >= 20 and data[:4] == SIMPLE_MAGIC and data[4] == SIMPLE_VERSION and data[5] < 2, "not a simple container")
    width, height, step = struct.unpack("<IIf", data[8:20])
    need(width > 0 and height > 0 and np.isfinite(step) and step > 0 and len(data) == 20 + 2 * width * height, "simple container header")
    kind = _KINDS[data[5]]
    c = np.frombuffer(data, "<i2", offset=20).reshape(height, width).astype(np.float32) * np.float32(step)
    if kind == "5/3":
        # floats with floors: exact on whole numbers, and defined for any step
        samples = kernels_float53(c, data[6])
    else:
        samples = kernels.synthesise(c, data[6], kind)
    v = samples + np.float32(128)
    return interleaved(np.clip(np.floor(v + np.float32(0.5)), 0, 255).astype(np.int64)[:, :, None], 8)


def kernels_float53(c: np.ndarray, levels: int) -> np.ndarray:
    """Inverse 5/3 in single precision."""
    c = c.copy()
    for _, _, h, w in kernels.shapes(*c.shape, levels)[:-1][::-1]:
        part = _float53(c[:h, :w].T).T
        c[:h, :w] = _float53(part)
    return c


def _float53(a: np.ndarray) -> np.ndarray:
    n = len(a)
    if n < 2:
        return a
    out = np.empty_like(a)
    out[0::2], out[1::2] = a[: (n + 1) // 2], a[(n + 1) // 2 :]
    for start, shift, divisor, sign in ((0, 2, 4, -1), (1, 0, 2, 1)):
        l, r = kernels._neighbours(out, start)
        out[start::2] += sign * np.floor((l + r + np.float32(shift)) / np.float32(divisor))
    return out


__all__ = ["FormatError", "read_bmp", "read_pgm", "read_pgx", "read_raw", "read_simple", "write_bmp", "write_pgm", "write_pgx", "write_raw", "write_simple"]
