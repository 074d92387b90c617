"""PNG: all legal bit depths, no interlace; unfiltering row by row in numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .raster import Raster, interleaved, need, pixels

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel and legal depths by colour type (fixed values).
COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}


def _chunks(data: bytes):
    need(data[:8] == SIGNATURE, "not a PNG")
    at = 8
    while at < len(data):
        need(at + 12 <= len(data), "chunk ends early")
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        end = at + 12 + size
        need(end <= len(data), "chunk ends early")
        need(zlib.crc32(data[at + 4 : end - 4]) == int.from_bytes(data[end - 4 : end], "big"), f"checksum of {kind!r}")
        yield kind, data[at + 8 : end - 4]
        at = end


def paeth(a: int, b: int, c: int) -> int:
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return a if da <= db and da <= dc else b if db <= dc else c


def unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """``height x (1 + bytes)`` filtered rows to ``height x bytes``."""
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for y, row in enumerate(rows):
        kind, line = row[0], row[1:]
        if kind == 0:
            out[y] = line
        elif kind == 1:  # a running sum in each of the pixel's bytes
            lanes = np.zeros(-(-len(line) // step) * step, np.uint8)
            lanes[: len(line)] = line
            out[y] = np.cumsum(lanes.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()[: len(line)]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):
            now, before = line.tolist(), above.tolist()
            for x in range(len(now)):
                a = now[x - step] if x >= step else 0
                guess = (a + before[x]) >> 1 if kind == 3 else paeth(a, before[x], before[x - step] if x >= step else 0)
                now[x] = (now[x] + guess) & 255
            out[y] = now
        else:
            need(False, "filter type")
        above = out[y]
    return out


def read_png(data: bytes) -> Raster:
    header, palette, clear, icc, parts, stage = None, None, None, None, [], 0
    for kind, body in _chunks(data):
        need(stage != 3, "data behind IEND")
        if header is None:
            need(kind == b"IHDR" and len(body) == 13, "IHDR is not first")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IHDR":
            need(False, "IHDR repeats")
        elif kind == b"PLTE":
            need(stage == 0 and palette is None and len(body) % 3 == 0 and 0 < len(body) <= 768, "palette")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        elif kind == b"tRNS":
            need(stage == 0 and clear is None, "transparency")
            clear = body
        elif kind == b"iCCP":
            name, _, rest = body.partition(b"\0")
            icc = zlib.decompress(rest[1:])
        elif kind == b"IDAT":
            need(stage < 2, "IDAT is not in one run")
            parts.append(body)
            stage = 1
            continue
        elif kind == b"IEND":
            need(bool(parts) and not body, "no image data")
            stage = 3
            continue
        else:
            need(bool(kind[0] & 32), f"unknown critical chunk {kind!r}")
        stage = 2 if stage == 1 else stage
    need(stage == 3, "no IEND")
    width, height, depth, colour, packing, filtering, lace = header
    need(width > 0 and height > 0 and colour in COLOURS and depth in COLOURS[colour][1] and (packing, filtering, lace) == (0, 0, 0), "header")
    need((palette is not None) if colour == 3 else (palette is None or colour in (2, 6)), "palette")
    n = COLOURS[colour][0]
    row = (width * n * depth + 7) // 8
    inflate = zlib.decompressobj()
    raw = inflate.decompress(b"".join(parts), (row + 1) * height + 1)
    need(len(raw) == (row + 1) * height and inflate.eof and not inflate.unused_data, "image data length")
    lines = unfilter(np.frombuffer(raw, np.uint8).reshape(height, row + 1), max(1, n * depth // 8))
    if depth == 16:
        samples = lines.reshape(height, -1).view(">u2").reshape(height, width, n).astype(np.int64)
    elif depth == 8:
        samples = lines.reshape(height, width, n).astype(np.int64)
    else:
        bits = np.unpackbits(lines, axis=1)[:, : width * depth].reshape(height, width, depth)
        samples = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.int64)[:, :, None]
    return _expanded(samples, depth, colour, palette, clear, icc)


def _expanded(samples: np.ndarray, depth: int, colour: int, palette, clear, icc) -> Raster:
    """Palette and transparency resolved; low depths scaled to 8 bits."""
    if colour == 3:
        index = samples[:, :, 0]
        need(int(index.max()) < len(palette), "index is not in the palette")
        out = palette[index]
        if clear is not None:
            need(len(clear) <= len(palette), "transparency")
            alpha = np.full(len(palette), 255, np.int64)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
            out = np.dstack([out, alpha[index]])
        return interleaved(out, 8, alpha_mode="unassociated" if clear is not None else None, icc=icc)
    need(clear is None or colour in (0, 2), "transparency with alpha")
    wide = 16 if depth == 16 else 8
    alpha = None
    if clear is not None:
        need(len(clear) == (2 if colour == 0 else 6), "transparency")
        key = np.array(struct.unpack(f">{len(clear) // 2}H", clear))
        need(bool((key < (1 << depth)).all()), "transparency")
        alpha = np.where((samples == key).all(axis=2), 0, (1 << wide) - 1)
    if depth < 8:
        samples = samples * (255 // ((1 << depth) - 1))
    if alpha is not None:
        samples = np.dstack([samples, alpha])
    return interleaved(samples, wide, alpha_mode="unassociated" if samples.shape[2] in (2, 4) else None, icc=icc)


def write_png(raster: Raster, level: int = 6, filter_type: int = 0) -> bytes:
    p = pixels(raster)
    h, w, n = p.shape
    need(raster.depth in (8, 16) and n in (1, 2, 3, 4), "PNG holds 8 or 16 bits")
    size = raster.depth // 8
    lines = p.astype(">u2" if size == 2 else "u1").reshape(h, -1).view(np.uint8).reshape(h, -1)
    step = n * size
    coded = np.zeros((h, lines.shape[1] + 1), np.uint8)
    coded[:, 0] = filter_type
    left = np.zeros_like(lines)
    left[:, step:] = lines[:, :-step]
    up = np.zeros_like(lines)
    up[1:] = lines[:-1]
    corner = np.zeros_like(lines)
    corner[1:, step:] = lines[:-1, :-step]
    if filter_type == 0:
        guess = np.zeros_like(lines)
    elif filter_type == 1:
        guess = left
    elif filter_type == 2:
        guess = up
    elif filter_type == 3:
        guess = ((left.astype(np.int64) + up) >> 1).astype(np.uint8)
    else:
        a, b, c = (x.astype(np.int64) for x in (left, up, corner))
        da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
        guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)
    coded[:, 1:] = lines - guess

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    profile = chunk(b"iCCP", b"icc\0\0" + zlib.compress(raster.icc)) if raster.icc else b""
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, raster.depth, colour, 0, 0, 0)) + profile + chunk(b"IDAT", zlib.compress(coded.tobytes(), level)) + chunk(b"IEND", b"")
