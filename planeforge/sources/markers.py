"""Pointer, packed-header and progression-change marker segments: write, parse, collect across segments."""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

from .codestream import PROGRESSIONS, varint
from .raster import need

# ---- tile-part lengths ----------------------------------------------------------------------------

#: Bytes of the tile index by ST and of the length by SP; the six legal pairs (fixed values).
INDEX_BYTES, LENGTH_BYTES = (0, 1, 2), (2, 4)


def write_tlm(entries: list[tuple[int, int]], number: int = 0, index_bytes: int = 2, length_bytes: int = 4) -> bytes:
    """Body of one segment; without index bytes the tiles must count up."""
    need(index_bytes in INDEX_BYTES and length_bytes in LENGTH_BYTES and 0 <= number < 256, "TLM widths")
    out = bytes([number, INDEX_BYTES.index(index_bytes) << 4 | LENGTH_BYTES.index(length_bytes) << 6])
    for tile, length in entries:
        need(length < 1 << (8 * length_bytes) and (not index_bytes or tile < 1 << (8 * index_bytes)), "TLM entry")
        out += (tile.to_bytes(index_bytes, "big") if index_bytes else b"") + length.to_bytes(length_bytes, "big")
    return out


def parse_tlm(body: bytes, expected: int, first_tile: int = 0) -> list[tuple[int, int]]:
    """(tile, length) of one segment; ``first_tile`` counts on where a segment names no tiles."""
    need(len(body) >= 2 and body[0] == expected, "TLM number")
    st, sp = body[1] >> 4 & 3, body[1] >> 6 & 1
    need(st < 3 and body[1] & 0x8F == 0, "TLM widths")
    a, b = INDEX_BYTES[st], LENGTH_BYTES[sp]
    need((len(body) - 2) % (a + b) == 0, "TLM length")
    out = []
    for k, at in enumerate(range(2, len(body), a + b)):
        tile = int.from_bytes(body[at : at + a], "big") if a else first_tile + k
        length = int.from_bytes(body[at + a : at + a + b], "big")
        need(length >= 14, "tile-part shorter than its header")
        out.append((tile, length))
    return out


# ---- packet lengths -------------------------------------------------------------------------------


def parse_varints(data: bytes) -> list[int]:
    out, value, open_ = [], 0, False
    for byte in data:
        value = value << 7 | byte & 127
        need(value < 1 << 32, "packet length")
        open_ = bool(byte & 128)
        if not open_:
            out.append(value)
            value = 0
    need(not open_, "packet length ends early")
    return out


def write_plt(lengths: Iterable[int], most: int = 65532) -> list[bytes]:
    """Bodies of the segments of a tile-part; a length is not split."""
    out, group = [], b""
    for n in lengths:
        v = varint(n)
        if len(group) + len(v) > most:
            out.append(group)
            group = b""
        group += v
    return [bytes([k]) + g for k, g in enumerate([*out, group])]


def parse_plt(bodies: Iterable[bytes]) -> list[int]:
    found = []
    for k, body in enumerate(bodies):
        need(len(body) >= 2 and body[0] == k, "PLT number")
        found += parse_varints(body[1:])
    return found


class _Collector:
    """Groups framed by a length that may run over from one numbered segment to the next."""

    frame = 1

    def __init__(self) -> None:
        self.next, self.groups, self.hold, self.missing = 0, [], b"", 0
        self.head = b""

    def append(self, body: bytes) -> None:
        need(bool(body) and body[0] == self.next, "segment number")
        self.next += 1
        at = 1
        while at < len(body):
            if not self.missing:
                take = self.frame - len(self.head)
                self.head += body[at : at + take]
                at += take
                if len(self.head) < self.frame:
                    return
                self.missing, self.hold, self.head = int.from_bytes(self.head, "big"), b"", b""
                if not self.missing:
                    self.groups.append(b"")
                continue
            part = body[at : at + self.missing]
            self.hold, self.missing, at = self.hold + part, self.missing - len(part), at + len(part)
            if not self.missing:
                self.groups.append(self.hold)

    def finish(self) -> list[bytes]:
        need(not self.missing and not self.head, "group ends early")
        return self.groups


class PlmCollector(_Collector):
    """Packet lengths of all tile-parts, each group framed by one byte.

    A group may run over from one segment to the next, a packet length may not; there is at least one segment, and none is empty.
    """

    def append(self, body: bytes) -> None:
        need(len(body) >= 2, "PLM segment is empty")
        super().append(body)
        # the part of a group that has come ends with whole lengths
        need(not self.hold or not self.missing or not self.hold[-1] & 128, "packet length runs over a segment's end")

    def finish(self) -> list[bytes]:
        need(self.next > 0, "no PLM segment")
        return super().finish()

    def lengths(self) -> list[list[int]]:
        return [parse_varints(g) for g in self.finish()]


def write_plm(groups: list[list[int]], most: int = 65532) -> list[bytes]:
    """Bodies of the segments for the packet lengths of each tile-part; a length is not split."""
    bodies, body = [], b""
    for lengths in groups:
        codes = [varint(n) for n in lengths]
        need(sum(map(len, codes)) < 256, "too many packet lengths for one group")
        # the count of a group and its first length stay together, so no segment ends within a length
        for part in [bytes([sum(map(len, codes))]) + (codes[0] if codes else b""), *codes[1:]]:
            if len(body) + len(part) > most:
                bodies.append(body)
                body = b""
            body += part
    need(len(bodies) < 256, "too many segments")
    return [bytes([k]) + b for k, b in enumerate([*bodies, body]) if b]


class PpmCollector(_Collector):
    """Packet headers of all tile-parts, each group framed by four bytes."""

    frame = 4


def write_ppm(groups: list[bytes], most: int = 65532) -> list[bytes]:
    stream = b"".join(struct.pack(">I", len(g)) + g for g in groups)
    bodies = [stream[k : k + most] for k in range(0, len(stream), most)]
    need(len(bodies) <= 256, "too many segments")
    return [bytes([k]) + b for k, b in enumerate(bodies)]


def collect_ppt(bodies: Iterable[bytes]) -> bytes:
    out = b""
    for k, body in enumerate(bodies):
        need(len(body) >= 2 and body[0] == k, "PPT number")
        out += body[1:]
    return out


# ---- progression changes --------------------------------------------------------------------------


@dataclass(frozen=True)
class Record:
    r_start: int
    c_start: int
    layer_end: int
    r_end: int
    c_end: int
    order: str

    def check(self, components: int, resolutions: int, layers: int) -> None:
        need(0 <= self.r_start < self.r_end <= resolutions and 0 <= self.c_start < self.c_end <= components and 0 < self.layer_end <= layers, "progression record")


def write_poc(records: list[Record], components: int, resolutions: int, layers: int) -> bytes:
    size = 1 if components <= 256 else 2
    need(bool(records) and len(records) * (5 + 2 * size) <= 65533, "progression records")
    out = b""
    for r in records:
        r.check(components, resolutions, layers)
        end = 0 if size == 1 and r.c_end == 256 else r.c_end
        out += bytes([r.r_start]) + r.c_start.to_bytes(size, "big") + struct.pack(">HB", r.layer_end, r.r_end) + end.to_bytes(size, "big") + bytes([PROGRESSIONS.index(r.order)])
    return out


def parse_poc(body: bytes, components: int, resolutions: int, layers: int) -> list[Record]:
    """Ends beyond the stream's own are cut to them; a one-byte component end of 0 stands for 256."""
    size = 1 if components <= 256 else 2
    step = 5 + 2 * size
    need(bool(body) and len(body) % step == 0, "progression records")
    out = []
    for at in range(0, len(body), step):
        part = body[at : at + step]
        c_start = int.from_bytes(part[1 : 1 + size], "big")
        layer_end, r_end = struct.unpack(">HB", part[1 + size : 4 + size])
        c_end = int.from_bytes(part[4 + size : 4 + 2 * size], "big") or (256 if size == 1 else 0)
        need(part[-1] < len(PROGRESSIONS), "progression")
        record = Record(part[0], c_start, min(layer_end, layers), min(r_end, resolutions), min(c_end, components), PROGRESSIONS[part[-1]])
        record.check(components, resolutions, layers)
        out.append(record)
    return out


# ---- profile signalling ---------------------------------------------------------------------------

CAP, PRF = 0xFF50, 0xFF56


def check_profile(markers: list[tuple[int, bytes]], capabilities: int) -> None:
    """CAP and PRF: once at most, in this order and straight behind SIZ, CAP exactly if SIZ announces it."""
    seen: list[int] = []
    for k, (marker, body) in enumerate(markers):
        if marker in (CAP, PRF):
            need(marker not in seen and k == 1 + len(seen), "CAP and PRF stand behind SIZ")
            need(not (marker == CAP and PRF in seen), "CAP stands before PRF")
            seen.append(marker)
            if marker == CAP:
                need(len(body) >= 4, "CAP")
                parts = int.from_bytes(body[:4], "big")
                need(len(body) == 4 + 2 * parts.bit_count(), "CAP")
            else:
                need(len(body) >= 2 and len(body) % 2 == 0 and body[-2:] != b"\0\0", "PRF")
    need((CAP in seen) == bool(capabilities & 0x4000), "SIZ and CAP disagree")
