"""Baseline JPEG: one interleaved scan, gray or YCbCr 4:4:4, 4:2:2, 4:2:0, or RGB by an Adobe marker."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..functions.dct import inverse
from .raster import Raster, interleaved, need


def _zigzag() -> list[int]:
    """Place of the k-th coefficient: diagonals, by turns upwards and downwards."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return [8 * y + x for y, x in cells]


ZIGZAG = _zigzag()


@dataclass
class _Component:
    ident: int
    h: int
    v: int
    table: int
    dc: int = 0
    ac: int = 0
    last: int = 0
    blocks: np.ndarray | None = None


@dataclass
class _State:
    tables: dict[int, np.ndarray] = field(default_factory=dict)
    codes: dict[tuple[int, int], dict[tuple[int, int], int]] = field(default_factory=dict)
    components: list[_Component] = field(default_factory=list)
    width: int = 0
    height: int = 0
    restart: int = 0
    jfif: bool = False
    adobe: int | None = None
    exif: bytes | None = None
    xmp: bytes | None = None
    iptc: bytes | None = None


class _Bits:
    """Entropy-coded bits; a stuffed zero is skipped, a marker ends them."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.hold, self.n = data, at, 0, 0

    def bit(self) -> int:
        if not self.n:
            need(self.at < len(self.data), "scan ends early")
            byte = self.data[self.at]
            self.at += 1
            if byte == 0xFF:
                need(self.at < len(self.data) and self.data[self.at] == 0, "marker inside the scan")
                self.at += 1
            self.hold, self.n = byte, 8
        self.n -= 1
        return (self.hold >> self.n) & 1

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out * 2 + self.bit()
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for size in range(1, 17):
            code = code * 2 + self.bit()
            found = codes.get((size, code))
            if found is not None:
                return found
        need(False, "unknown code")
        return 0

    def value(self, size: int) -> int:
        """A signed value of ``size`` bits: those without a leading one are negative."""
        need(size <= 11, "coefficient size")
        if not size:
            return 0
        v = self.bits(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _huffman(body: bytes, state: _State) -> None:
    at = 0
    while at < len(body):
        kind, slot = body[at] >> 4, body[at] & 15
        need(kind < 2 and slot < 4 and at + 17 <= len(body), "code table")
        counts = body[at + 1 : at + 17]
        at += 17
        need(at + sum(counts) <= len(body), "code table")
        codes, code = {}, 0
        for size, n in enumerate(counts, 1):
            need(code + n <= 1 << size, "too many codes")
            for _ in range(n):
                codes[size, code] = body[at]
                code, at = code + 1, at + 1
            code *= 2
        state.codes[kind, slot] = codes


def _quantisers(body: bytes, state: _State) -> None:
    at = 0
    while at < len(body):
        need(body[at] >> 4 == 0 and body[at] & 15 < 4 and at + 65 <= len(body), "quantiser table")
        table = np.zeros(64, dtype=np.int64)
        table[ZIGZAG] = np.frombuffer(body, np.uint8, 64, at + 1)
        need(bool((table > 0).all()), "quantiser table")
        state.tables[body[at] & 15] = table
        at += 65


def _frame(body: bytes, state: _State) -> None:
    need(not state.components and len(body) >= 6 and body[0] == 8 and body[5] in (1, 3) and len(body) == 6 + 3 * body[5], "frame")
    state.height, state.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
    need(state.width > 0 and state.height > 0, "empty frame")
    for k in range(body[5]):
        ident, sampling, table = body[6 + 3 * k : 9 + 3 * k]
        state.components.append(_Component(ident, sampling >> 4, sampling & 15, table))
    if len(state.components) == 1:
        state.components[0].h = state.components[0].v = 1
    else:
        first, *rest = state.components
        need((first.h, first.v) in ((1, 1), (2, 1), (2, 2)) and all((c.h, c.v) == (1, 1) for c in rest), "sampling")


def _scan(data: bytes, at: int, state: _State) -> int:
    top_h, top_v = max(c.h for c in state.components), max(c.v for c in state.components)
    across, down = -(-state.width // (8 * top_h)), -(-state.height // (8 * top_v))
    for c in state.components:
        need(c.table in state.tables and (0, c.dc) in state.codes and (1, c.ac) in state.codes, "table missing")
        c.blocks = np.zeros((down * c.v, across * c.h, 64), dtype=np.int64)
    bits = _Bits(data, at)
    for unit in range(across * down):
        if state.restart and unit and unit % state.restart == 0:
            expected = 0xD0 + (unit // state.restart - 1) % 8
            need(data[bits.at : bits.at + 2] == bytes([0xFF, expected]), "restart marker")
            bits = _Bits(data, bits.at + 2)
            for c in state.components:
                c.last = 0
        for c in state.components:
            dc, ac = state.codes[0, c.dc], state.codes[1, c.ac]
            for v in range(c.v):
                for h in range(c.h):
                    block = c.blocks[unit // across * c.v + v, unit % across * c.h + h]
                    c.last += bits.value(bits.symbol(dc))
                    block[0] = c.last
                    k = 1
                    while k < 64:
                        run, size = divmod(bits.symbol(ac), 16)
                        if not size:
                            if run != 15:
                                need(run == 0, "run length")
                                break
                            k += 16
                            continue
                        k += run
                        need(k < 64, "coefficient place")
                        block[ZIGZAG[k]] = bits.value(size)
                        k += 1
    return bits.at


def _plane(c: _Component, state: _State) -> np.ndarray:
    rows, cols, _ = c.blocks.shape
    out = inverse((c.blocks * state.tables[c.table]).reshape(-1, 8, 8)).reshape(rows, cols, 8, 8)
    return out.transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)


def upsampled(plane: np.ndarray, axis: int, size: int) -> np.ndarray:
    """Doubled along an axis by centred weights 1 and 3, values times 4."""
    at = np.arange(size)
    here = at // 2
    other = np.clip(np.where(at % 2 == 0, here - 1, here + 1), 0, plane.shape[axis] - 1)
    return np.take(plane, here, axis) * 3 + np.take(plane, other, axis)


def read_jpeg(data: bytes) -> Raster:
    need(data[:2] == b"\xff\xd8", "not a JPEG")
    state, at, scanned = _State(), 2, False
    while True:
        need(at + 2 <= len(data) and data[at] == 0xFF, "marker")
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            break
        need(at + 2 <= len(data), "segment ends early")
        size = int.from_bytes(data[at : at + 2], "big")
        need(size >= 2 and at + size <= len(data), "segment ends early")
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xC4:
            _huffman(body, state)
        elif marker == 0xDB:
            _quantisers(body, state)
        elif marker == 0xC0:
            _frame(body, state)
        elif marker == 0xDD:
            state.restart = int.from_bytes(body, "big")
        elif marker == 0xE0:
            state.jfif |= body[:5] == b"JFIF\0"
        elif marker == 0xE1:
            if body[:6] == b"Exif\0\0":
                state.exif = body[6:]
            elif body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                state.xmp = body[29:]
        elif marker == 0xED:
            state.iptc = _photoshop(body) or state.iptc
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            state.adobe = body[11]
        elif marker == 0xDA:
            need(not scanned and bool(state.components) and body[0] == len(state.components) and len(body) == 4 + 2 * body[0] and body[-3:] == b"\0\x3f\0", "scan")
            for k, c in enumerate(state.components):
                need(body[1 + 2 * k] == c.ident, "scan order")
                c.dc, c.ac = divmod(body[2 + 2 * k], 16)
            at, scanned = _scan(data, at, state), True
        else:
            need(0xE0 <= marker <= 0xEF or marker == 0xFE, f"unsupported marker {marker:02x}")
    need(scanned, "no scan")
    more = {"exif": state.exif, "xmp": state.xmp, "iptc": state.iptc}
    planes = [_plane(c, state) for c in state.components]
    if len(planes) == 1:
        return interleaved(planes[0][: state.height, : state.width, None], 8, **more)
    first = state.components[0]
    ids = [c.ident for c in state.components]
    if state.adobe == 0 and not state.jfif and ids == [82, 71, 66]:
        direct = True
    else:
        need((state.jfif or state.adobe == 1) and ids == [1, 2, 3] and state.adobe in (None, 1), "colour space")
        direct = False
    wide = []
    for k, plane in enumerate(planes):
        if k and first.h == 2:
            need_rows = (state.height + 1) // 2 if first.v == 2 else state.height
            plane = plane[:need_rows, : (state.width + 1) // 2]
        if k and (first.h, first.v) != (1, 1):
            plane = upsampled(plane, 1, state.width)
            plane = upsampled(plane, 0, state.height) if first.v == 2 else plane * 4
            plane = (plane + 8) // 16
        wide.append(plane[: state.height, : state.width])
    if direct:
        return interleaved(np.dstack(wide), 8, **more)
    y, cb, cr = wide[0], wide[1] - 128, wide[2] - 128
    rgb = (y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr + 32768 >> 16), y + (116130 * cb + 32768 >> 16))
    return interleaved(np.clip(np.dstack(rgb), 0, 255), 8, **more)


def _photoshop(body: bytes) -> bytes | None:
    """The IPTC resource (id 1028) of an image resource block."""
    if not body.startswith(b"Photoshop 3.0\0"):
        return None
    at = 14
    while at + 12 <= len(body) and body[at : at + 4] == b"8BIM":
        ident = int.from_bytes(body[at + 4 : at + 6], "big")
        at += 6 + (body[at + 6] + 2 & ~1)
        size = int.from_bytes(body[at : at + 4], "big")
        if ident == 1028:
            return body[at + 4 : at + 4 + size]
        at += 4 + (size + 1 & ~1)
    return None


def write_flat(levels: np.ndarray, quantiser: int = 1, restart: int = 0, metadata: dict[str, bytes] | None = None) -> bytes:
    """A gray JPEG of flat 8x8 blocks with the given DC levels: a test image whose every sample is known.

    Its tables hold DC sizes 0 to 11 and the end of block; ``restart`` blocks stand between restart marks.
    """
    segment = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    rows, cols = levels.shape
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    for name, body in (metadata or {}).items():
        if name == "iptc":
            out += segment(0xED, b"Photoshop 3.0\x008BIM\x04\x04\0\0" + struct.pack(">I", len(body)) + body + bytes(len(body) & 1))
        else:
            out += segment(0xE1, {"exif": b"Exif\0\0", "xmp": b"http://ns.adobe.com/xap/1.0/\0"}[name] + body)
    out += segment(0xDB, b"\0" + bytes([quantiser] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, rows * 8, cols * 8, 1) + b"\x01\x11\0")
    out += segment(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
    out += (segment(0xDD, struct.pack(">H", restart)) if restart else b"") + segment(0xDA, b"\x01\x01\0\0\x3f\0")
    bits: list[str] = []

    def flushed() -> bytes:
        line = "".join(bits)
        bits.clear()
        line += "1" * (-len(line) % 8)
        return int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\0") if line else b""

    before = 0
    for n, level in enumerate(levels.ravel().tolist()):
        if restart and n and n % restart == 0:
            out += flushed() + bytes([0xFF, 0xD0 + (n // restart - 1) % 8])
            before = 0
        step = level - before
        size = abs(step).bit_length()
        bits.append(f"{size:04b}" + (f"{step if step > 0 else step + (1 << size) - 1:0{size}b}" if size else "") + "0")
        before = level
    return out + flushed() + b"\xff\xd9"
