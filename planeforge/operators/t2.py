"""Packet headers: bit stuffing, tag trees, pass counts and lengths, and the state of a precinct."""

from __future__ import annotations

from dataclasses import dataclass, field

from .t1 import segment_passes


class HeaderWriter:
    """Bits, highest first; behind a byte of ones the next has seven."""

    def __init__(self) -> None:
        self.out, self.hold, self.left = bytearray(), 0, 8

    def bit(self, bit: int) -> None:
        self.left -= 1
        self.hold |= bit << self.left
        if not self.left:
            self.out.append(self.hold)
            self.left = 7 if self.hold == 0xFF else 8
            self.hold = 0

    def bits(self, value: int, n: int) -> None:
        for k in range(n - 1, -1, -1):
            self.bit(value >> k & 1)

    def finish(self) -> bytes:
        if self.left != 8:
            self.out.append(self.hold)
            if self.hold == 0xFF:
                self.out.append(0)
        return bytes(self.out)


class HeaderReader:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.hold, self.left = data, at, 0, 0

    def bit(self) -> int:
        if not self.left:
            if self.at >= len(self.data):
                raise ValueError("packet header ends early")
            self.left = 7 if self.hold == 0xFF else 8
            self.hold = self.data[self.at]
            self.at += 1
        self.left -= 1
        return self.hold >> self.left & 1

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out * 2 + self.bit()
        return out

    def align(self) -> int:
        """Where the header ends."""
        if self.hold == 0xFF and self.at:
            self.at += 1
        self.left = self.hold = 0
        return self.at


class TagTree:
    """A pyramid of minima; what is known of a node survives from packet to packet."""

    def __init__(self, width: int, height: int) -> None:
        self.sizes = [(width, height)]
        while self.sizes[-1] != (1, 1) and width and height:
            w, h = self.sizes[-1]
            self.sizes.append(((w + 1) // 2, (h + 1) // 2))
        self.values = [[0] * (w * h) for w, h in self.sizes]
        self.low = [[0] * (w * h) for w, h in self.sizes]
        self.known = [[False] * (w * h) for w, h in self.sizes]

    def fill(self, leaves: list[int]) -> None:
        self.values[0] = list(leaves)
        for k in range(1, len(self.sizes)):
            (w, h), (pw, _) = self.sizes[k - 1], self.sizes[k]
            up: list[int | None] = [None] * len(self.values[k])
            for y in range(h):
                for x in range(w):
                    at, v = y // 2 * pw + x // 2, self.values[k - 1][y * w + x]
                    up[at] = v if up[at] is None else min(up[at], v)
            self.values[k] = up  # type: ignore[assignment]

    def _path(self, x: int, y: int) -> list[tuple[int, int]]:
        return [(k, (y >> k) * w + (x >> k)) for k, (w, _) in enumerate(self.sizes)][::-1]

    def write(self, out: HeaderWriter, x: int, y: int, bound: int) -> None:
        """Tells whether the leaf is below ``bound``, as far as that is not known yet."""
        low = 0
        for k, at in self._path(x, y):
            low = max(low, self.low[k][at])
            while low < bound and not self.known[k][at]:
                if low >= self.values[k][at]:
                    out.bit(1)
                    self.known[k][at] = True
                else:
                    out.bit(0)
                    low += 1
            self.low[k][at] = low

    def read(self, source: HeaderReader, x: int, y: int, bound: int) -> bool:
        low = 0
        for k, at in self._path(x, y):
            low = max(low, self.low[k][at])
            while low < bound and not self.known[k][at]:
                if source.bit():
                    self.known[k][at] = True
                else:
                    low += 1
            self.low[k][at] = low
        return self.known[0][self._path(x, y)[-1][1]] and low < bound

    def value(self, x: int, y: int) -> int:
        return self.low[0][y * self.sizes[0][0] + x]


def write_pass_count(out: HeaderWriter, n: int) -> None:
    if n == 1:
        out.bit(0)
    elif n == 2:
        out.bits(2, 2)
    elif n <= 5:
        out.bits(12 + n - 3, 4)
    elif n <= 36:
        out.bits(480 + n - 6, 9)
    elif n <= 164:
        out.bits(65408 + n - 37, 16)
    else:
        raise ValueError("too many passes")


def read_pass_count(source: HeaderReader) -> int:
    for n in (1, 2):
        if not source.bit():
            return n
    for base, bits in ((3, 2), (6, 5), (37, 7)):
        v = source.bits(bits)
        if v < (1 << bits) - 1 or bits == 7:
            return base + v
    raise AssertionError


@dataclass
class BlockState:
    """A block's place in its precinct and what packets have told of it."""

    x: int
    y: int
    lblock: int = 3
    passes: int = 0
    zero_planes: int = 0
    included: bool = False
    data: bytearray = field(default_factory=bytearray)
    segments: list[list[int]] = field(default_factory=list)  # passes, bytes


@dataclass
class BandState:
    width: int
    height: int
    blocks: list[BlockState]

    def __post_init__(self) -> None:
        self.inclusion, self.zero = TagTree(self.width, self.height), TagTree(self.width, self.height)


def spans(before: int, added: int, total_bound: int, style: int) -> list[int]:
    """Passes of the layer's part in each segment it touches."""
    out, at = [], 0
    for n in segment_passes(total_bound, style):
        lo, hi = max(at, before), min(at + n, before + added)
        if hi > lo:
            out.append(hi - lo)
        at += n
    return out


def write_packet(bands: list[BandState], layer: int, parts: list[list[tuple[int, list[int], bytes]]]) -> bytes:
    """``parts``: for each band and block the passes it adds, the bytes of each segment part, and its bytes.

    Trees must have been filled: inclusion with first layers, zero planes with their counts.
    """
    if not any(n for band in parts for n, _, _ in band):
        return b"\0"  # an empty packet: one zero bit
    out, body = HeaderWriter(), bytearray()
    out.bit(1)
    for band, added in zip(bands, parts, strict=True):
        for block, (n, sizes, data) in zip(band.blocks, added, strict=True):
            if block.included:
                out.bit(int(n > 0))
            else:
                band.inclusion.write(out, block.x, block.y, layer + 1)
            if not n:
                continue
            if not block.included:
                band.zero.write(out, block.x, block.y, 1 << 30)
                block.included = True
            write_pass_count(out, n)
            counts = sizes[::2]
            lengths = sizes[1::2]
            grow = max(0, *(size.bit_length() - block.lblock - (p.bit_length() - 1) for p, size in zip(counts, lengths, strict=True)))
            for _ in range(grow):
                out.bit(1)
            out.bit(0)
            block.lblock += grow
            for p, size in zip(counts, lengths, strict=True):
                out.bits(size, block.lblock + p.bit_length() - 1)
            body += data
    return out.finish() + bytes(body)


def read_packet(data: bytes, at: int, bands: list[BandState], layer: int, style: int, nominal: list[int], marks: bool = False) -> int:
    """Adds a packet to the blocks' state; returns where it ends."""
    source = HeaderReader(data, at)
    found: list[tuple[BlockState, list[tuple[int, int]]]] = []
    if source.bit():
        for band, planes in zip(bands, nominal, strict=True):
            for block in band.blocks:
                if block.included:
                    if not source.bit():
                        continue
                elif not band.inclusion.read(source, block.x, block.y, layer + 1):
                    continue
                if not block.included:
                    bound = 1
                    while not band.zero.read(source, block.x, block.y, bound):
                        bound += 1
                        if bound > planes + 1:
                            raise ValueError("zero bit planes")
                    block.zero_planes, block.included = bound - 1, True
                n = read_pass_count(source)
                while source.bit():
                    block.lblock += 1
                total = 3 * (planes - block.zero_planes) - 2
                if block.passes + n > total:
                    raise ValueError("more passes than the planes have")
                lengths = [(p, source.bits(block.lblock + p.bit_length() - 1)) for p in spans(block.passes, n, total, style)]
                block.passes += n
                found.append((block, lengths))
    at = source.align()
    if marks:
        if data[at : at + 2] != b"\xff\x92":
            raise ValueError("end of packet header missing")
        at += 2
    for block, lengths in found:
        for p, size in lengths:
            if at + size > len(data):
                raise ValueError("packet body ends early")
            block.segments.append([p, size])
            block.data += data[at : at + size]
            at += size
    return at


def joined_segments(block: BlockState, planes: int, style: int) -> list[tuple[int, int]]:
    """Parts of layers put together to whole segments."""
    total, out, k = 3 * planes - 2, [], 0
    for n in segment_passes(total, style):
        passes = size = 0
        while k < len(block.segments) and passes < n:
            passes, size, k = passes + block.segments[k][0], size + block.segments[k][1], k + 1
        if passes:
            out.append((passes, size))
    return out
