"""OpenEXR: single part, uncompressed scan lines, HALF channels B, G, R in 0..1."""

from __future__ import annotations

import struct

import numpy as np

from ..functions.curves import chromaticities_to_d50
from .raster import Raster, interleaved, need, pixels

#: Rec. 709 primaries and white, which hold where a file names none (fixed values).
REC709 = (0.64, 0.33, 0.30, 0.60, 0.15, 0.06, 0.3127, 0.3290)


def _name(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b"\0", at)
    need(0 <= end - at <= 255, "name")
    return data[at:end], end + 1


def read_exr(data: bytes) -> Raster:
    need(data[:8] == b"\x76\x2f\x31\x01\x02\0\0\0", "not a plain scan-line OpenEXR")
    at, head = 8, {}
    while True:
        name, at = _name(data, at)
        if not name:
            break
        _, at = _name(data, at)
        need(at + 4 <= len(data) and name not in head, "header")
        size = struct.unpack("<i", data[at : at + 4])[0]
        need(0 <= size <= len(data) - at - 4, "header")
        head[name] = data[at + 4 : at + 4 + size]
        at += 4 + size
    need(all(k in head for k in (b"channels", b"compression", b"dataWindow", b"displayWindow", b"lineOrder")), "attribute missing")
    need(head[b"compression"] == b"\0", "compressed")
    body, names, pos = head[b"channels"], [], 0
    while body[pos : pos + 1] != b"\0":
        name, pos = _name(body, pos)
        kind, _, xs, ys = struct.unpack("<i4sii", body[pos : pos + 16])
        need((kind, xs, ys) == (1, 1, 1), "channel type")
        names.append(name)
        pos += 16
    need(names == [b"B", b"G", b"R"], "channels")
    x0, y0, x1, y1 = struct.unpack("<4i", head[b"dataWindow"])
    need(head[b"dataWindow"] == head[b"displayWindow"] and x1 >= x0 and y1 >= y0, "windows")
    width, height = x1 - x0 + 1, y1 - y0 + 1
    size = width * 6
    offsets = struct.unpack(f"<{height}Q", data[at : at + 8 * height])
    start = at + 8 * height
    # every line once, the chunks side by side up to the end of the file
    spans = sorted(offsets)
    need(spans == list(range(start, start + height * (size + 8), size + 8)) and len(data) == start + height * (size + 8), "chunk layout")
    out = np.zeros((height, width, 3), np.float64)
    seen = set()
    for offset in offsets:
        y, n = struct.unpack("<ii", data[offset : offset + 8])
        need(n == size and y0 <= y <= y1 and y not in seen, "chunk")
        seen.add(y)
        out[y - y0] = np.frombuffer(data, "<f2", 3 * width, offset + 8).reshape(3, width)[::-1].T
    need(bool(np.isfinite(out).all()) and bool((out >= 0).all()) and bool((out <= 1).all()), "sample is not in 0..1")
    c = struct.unpack("<8f", head[b"chromaticities"]) if b"chromaticities" in head else REC709
    raster = interleaved(np.floor(out * 65535.0 + 0.5).astype(np.int64), 16)
    raster.matrix = chromaticities_to_d50(c[:2], c[2:4], c[4:6], c[6:8])
    return raster


def write_exr(raster: Raster) -> bytes:
    """16-bit RGB as HALF (samples are rounded to what a HALF can hold)."""
    p = pixels(raster)
    need(p.shape[2] == 3 and raster.depth == 16, "OpenEXR holds 16-bit RGB")
    h, w, _ = p.shape
    attribute = lambda name, kind, body: name + b"\0" + kind + b"\0" + struct.pack("<i", len(body)) + body
    channels = b"".join(n + b"\0" + struct.pack("<i4sii", 1, bytes(4), 1, 1) for n in (b"B", b"G", b"R")) + b"\0"
    window = struct.pack("<4i", 0, 0, w - 1, h - 1)
    head = b"\x76\x2f\x31\x01\x02\0\0\0" + attribute(b"channels", b"chlist", channels) + attribute(b"compression", b"compression", b"\0") + attribute(b"dataWindow", b"box2i", window)
    head += attribute(b"displayWindow", b"box2i", window) + attribute(b"lineOrder", b"lineOrder", b"\0") + attribute(b"pixelAspectRatio", b"float", struct.pack("<f", 1)) + attribute(b"screenWindowCenter", b"v2f", bytes(8)) + attribute(b"screenWindowWidth", b"float", struct.pack("<f", 1)) + b"\0"
    start, step = len(head) + 8 * h, w * 6 + 8
    lines = (p / 65535.0).astype("<f2")
    chunks = b"".join(struct.pack("<ii", y, w * 6) + np.ascontiguousarray(lines[y, :, ::-1].T).tobytes() for y in range(h))
    return head + struct.pack(f"<{h}Q", *range(start, start + h * step, step)) + chunks
