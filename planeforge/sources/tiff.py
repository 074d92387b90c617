"""TIFF directories, chunky TIFF rasters, and LinearRaw DNG."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ..functions.curves import camera_to_xyz
from .raster import Raster, interleaved, need, pixels

#: Size and unpacking code of the field types (fixed values).
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I")}


@dataclass(frozen=True)
class Field:
    tag: int
    kind: int
    count: int
    raw: bytes
    endian: str

    @property
    def values(self) -> tuple:
        size, code = TYPES[self.kind]
        if self.kind == 2:
            return (self.raw.rstrip(b"\0").decode("ascii", "replace"),)
        flat = struct.unpack(f"{self.endian}{self.count * len(code)}{code[0]}", self.raw)
        if self.kind in (5, 10):
            need(all(d != 0 for d in flat[1::2]), "zero denominator")
            return tuple(n / d for n, d in zip(flat[::2], flat[1::2], strict=True))
        return flat

    @property
    def value(self):
        need(self.count == 1, f"tag {self.tag} holds several values")
        return self.values[0]


def directories(data: bytes) -> list[dict[int, Field]]:
    """All directories of the chain and, behind each, its sub-directories (tag 330)."""
    need(data[:4] in (b"II*\0", b"MM\0*"), "not a TIFF")
    e = "<" if data[:2] == b"II" else ">"
    out, todo, seen = [], [struct.unpack(e + "I", data[4:8])[0]], set()
    while todo:
        at = todo.pop(0)
        if at == 0:
            continue
        need(at not in seen and 8 <= at and at + 2 <= len(data), "directory offset")
        seen.add(at)
        n = struct.unpack(e + "H", data[at : at + 2])[0]
        need(n > 0 and at + 6 + 12 * n <= len(data), "directory ends early")
        fields: dict[int, Field] = {}
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind, count = struct.unpack(e + "HHI", entry[:8])
            if kind not in TYPES:
                continue
            size = TYPES[kind][0] * count
            start = at + 10 + 12 * k if size <= 4 else struct.unpack(e + "I", entry[8:])[0]
            need(start + size <= len(data), f"tag {tag} lies outside the file")
            need(tag not in fields, f"tag {tag} repeats")
            fields[tag] = Field(tag, kind, count, data[start : start + size], e)
        out.append(fields)
        if 330 in fields:
            todo += fields[330].values
        todo.append(struct.unpack(e + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0])
    return out


def _strips(data: bytes, ifd: dict[int, Field], row_bytes: int, height: int) -> bytes:
    need(273 in ifd and 279 in ifd, "no strips")
    offsets, counts = ifd[273].values, ifd[279].values
    per = ifd[278].value if 278 in ifd else height
    need(len(offsets) == len(counts) == -(-height // per), "strip count")
    parts = []
    for k, (at, size) in enumerate(zip(offsets, counts, strict=True)):
        need(size == row_bytes * min(per, height - k * per) and at + size <= len(data), "strip length")
        parts.append(data[at : at + size])
    return b"".join(parts)


def _samples(data: bytes, ifd: dict[int, Field], channels: int) -> tuple[np.ndarray, int]:
    width, height = ifd[256].value, ifd[257].value
    need(width > 0 and height > 0, "empty image")
    bits = ifd[258].values if 258 in ifd else (1,)
    need(len(set(bits)) == 1 and len(bits) == channels and bits[0] in (8, 16), "bits per sample")
    need(ifd[259].value == 1 if 259 in ifd else True, "compressed")
    need(ifd[284].value == 1 if 284 in ifd else True, "not chunky")
    need(set(ifd[339].values) == {1} if 339 in ifd else True, "sample format")
    kind = np.dtype("u1") if bits[0] == 8 else np.dtype(f"{ifd[256].endian}u2")
    body = _strips(data, ifd, width * channels * kind.itemsize, height)
    return np.frombuffer(body, kind).reshape(height, width, channels).astype(np.int64), bits[0]


def read_tiff(data: bytes) -> Raster:
    """One uncompressed chunky image; gray, RGB, each with one alpha at most."""
    found = directories(data)
    need(len(found) == 1, "several images")
    ifd = found[0]
    need(256 in ifd and 257 in ifd and 262 in ifd, "required tag missing")
    need(ifd[274].value == 1 if 274 in ifd else True, "orientation")
    photometric, channels = ifd[262].value, ifd[277].value if 277 in ifd else 1
    colours = {0: 1, 1: 1, 2: 3}.get(photometric)
    need(colours is not None and channels - colours in (0, 1), "photometric layout")
    alpha = None
    if channels > colours:
        need(338 in ifd and ifd[338].count == 1 and ifd[338].value in (1, 2), "extra sample")
        alpha = "associated" if ifd[338].value == 1 else "unassociated"
    else:
        need(338 not in ifd, "extra sample")
    samples, depth = _samples(data, ifd, channels)
    icc = ifd[34675].raw if 34675 in ifd else None
    need(icc is None or (len(icc) >= 132 and int.from_bytes(icc[:4], "big") == len(icc)), "ICC profile")
    return interleaved(samples, depth, alpha_mode=alpha, white_is_zero=photometric == 0, icc=icc)


def write_tiff(raster: Raster) -> bytes:
    """Little-endian, chunky, one strip."""
    p = pixels(raster)
    h, w, n = p.shape
    need(n in (1, 2, 3, 4) and raster.depth in (8, 16), "TIFF holds 8- or 16-bit gray or RGB")
    body = p.astype("u1" if raster.depth == 8 else "<u2").tobytes()
    entries: list[tuple[int, int, int, bytes]] = []
    short, long = (lambda *v: struct.pack(f"<{len(v)}H", *v)), (lambda *v: struct.pack(f"<{len(v)}I", *v))
    entries += [(256, 4, 1, long(w)), (257, 4, 1, long(h)), (258, 3, n, short(*[raster.depth] * n)), (259, 3, 1, short(1))]
    entries += [(262, 3, 1, short(2 if n >= 3 else 0 if raster.white_is_zero else 1)), (273, 4, 1, long(0)), (277, 3, 1, short(n)), (278, 4, 1, long(h)), (279, 4, 1, long(len(body))), (284, 3, 1, short(1))]
    if n in (2, 4):
        entries.append((338, 3, 1, short(1 if raster.alpha_mode == "associated" else 2)))
    if raster.icc:
        entries.append((34675, 7, len(raster.icc), raster.icc))
    return tiff_bytes(entries, body)


def tiff_bytes(entries: list[tuple[int, int, int, bytes]], body: bytes) -> bytes:
    """One directory behind the header, long values behind it, then the strip (tag 273 is set here)."""
    entries = sorted(entries)
    at = 8 + 2 + 12 * len(entries) + 4
    spots, tail = [], b""
    for _, _, _, raw in entries:
        if len(raw) > 4:
            spots.append(at + len(tail))
            tail += raw + bytes(len(raw) & 1)
        else:
            spots.append(0)
    out = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(entries))
    for (tag, kind, count, raw), spot in zip(entries, spots, strict=True):
        value = struct.pack("<I", at + len(tail)) if tag == 273 else struct.pack("<I", spot) if len(raw) > 4 else raw.ljust(4, b"\0")
        out += struct.pack("<HHI", tag, kind, count) + value
    return out + struct.pack("<I", 0) + tail + body


#: DNG tags whose effect is not modelled; a file that has one is refused (fixed values).
DNG_REFUSED = (50711, 50715, 50716, 51008, 51009, 51022)


def read_dng(data: bytes) -> Raster:
    """Exactly one LinearRaw image of three channels, normalised to its full range."""
    found = directories(data)
    main = found[0]
    need(50706 in main, "not a DNG")
    raw = [f for f in found if 262 in f and f[262].value == 34892 and (254 not in f or f[254].value == 0)]
    need(len(raw) == 1, "not exactly one LinearRaw image")
    ifd = raw[0]
    need(not any(t in f for f in (main, ifd) for t in DNG_REFUSED), "unsupported DNG tag")
    need((ifd[277].value if 277 in ifd else 1) == 3, "not three channels")
    samples, depth = _samples(data, ifd, 3)
    if 50713 in ifd:
        need(tuple(ifd[50713].values) == (1, 1), "black level pattern")
    top = (1 << depth) - 1
    if 50712 in ifd:
        table = np.array(ifd[50712].values, dtype=np.int64)
        samples = table[np.minimum(samples, len(table) - 1)]
    black, white = _levels(ifd, 50714, 0.0), _levels(ifd, 50717, float(top))
    need(bool((white > black).all()), "levels")
    unit = np.clip((samples - black) / (white - black), 0.0, 1.0)
    out = interleaved(np.floor(unit * top + 0.5).astype(np.int64), depth)
    if 50964 in main:
        need(main[50778].value not in (0, 255) if 50778 in main else False, "calibration illuminant")
        out.matrix = camera_to_xyz(np.array(main[50964].values).reshape(3, 3), main[50728].values)
    return out


def write_linear_dng(samples: np.ndarray, black: int, white: int) -> bytes:
    """A 16-bit LinearRaw DNG of ``height x width x 3`` samples with its levels."""
    height, width, _ = samples.shape
    body = samples.astype("<u2").tobytes()
    short = lambda *v: struct.pack(f"<{len(v)}H", *v)
    long = lambda *v: struct.pack(f"<{len(v)}I", *v)
    entries = [(254, 4, 1, long(0)), (256, 4, 1, long(width)), (257, 4, 1, long(height)), (258, 3, 3, short(16, 16, 16)), (259, 3, 1, short(1)), (262, 3, 1, short(34892)), (273, 4, 1, long(0))]
    entries += [(277, 3, 1, short(3)), (278, 4, 1, long(height)), (279, 4, 1, long(len(body))), (50706, 1, 4, bytes([1, 4, 0, 0])), (50714, 3, 1, short(black)), (50717, 4, 1, long(white))]
    return tiff_bytes(entries, body)


def _levels(ifd: dict[int, Field], tag: int, default: float) -> np.ndarray:
    if tag not in ifd:
        return np.full(3, default)
    values = ifd[tag].values
    need(len(values) in (1, 3), "level count")
    return np.array(values * 3 if len(values) == 1 else values, dtype=np.float64)


def dng_info(data: bytes) -> list[dict[int, tuple]]:
    """The tags of every directory, without reading a sample."""
    return [{tag: f.values for tag, f in ifd.items() if f.count <= 64} for ifd in directories(data)]
