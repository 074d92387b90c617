"""Wavelet codestream: markers, tiles, packets; lossless 5/3 and lossy 9/7, any progression, several layers.

Encoding is split so that its parts can run apart: ``tile_blocks`` (samples to code blocks),
``t1.encode_block`` (one block), ``tile_packets`` (coded blocks to packets), ``assemble`` (tiles to a file).
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_right
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np

from ..functions.color import level_shift
from ..operators import kernels, t1, t2
from ..operators.progression import ORDERS, SAMPLED_ORDERS
from ..operators.rate import hull, layer_targets
from .raster import Plane, Raster, need

SOC, SIZ, COD, COC, QCD, QCC, RGN, POC, TLM, PLT, SOT, SOD, EOC, COM = 0xFF4F, 0xFF51, 0xFF52, 0xFF53, 0xFF5C, 0xFF5D, 0xFF5E, 0xFF5F, 0xFF55, 0xFF58, 0xFF90, 0xFF93, 0xFFD9, 0xFF64
PROGRESSIONS = ("LRCP", "RLCP", "RPCL", "PCRL", "CPRL")
KINDS = ("LL", "HL", "LH", "HH")
GAIN = {"LL": 0, "HL": 1, "LH": 1, "HH": 2}
GUARD = 2


@dataclass(frozen=True)
class Options:
    levels: int = 5
    layers: int = 1
    progression: str = "RPCL"
    reversible: bool = True
    colour: bool = True
    block_w: int = 64
    block_h: int = 64
    style: int = 0
    tile_w: int = 0  # 0: the whole image
    tile_h: int = 0
    precincts: tuple[tuple[int, int], ...] = ((32768, 32768),)
    rates: tuple[float, ...] = ()
    step: float = 1 / 256  # of the full range, 9/7 only
    part_lengths: bool = True  # TLM
    packet_lengths: bool = False  # PLT
    audit: bool = False  # read every tile's packets back


@dataclass(frozen=True)
class Band:
    kind: str
    level: int
    resolution: int
    x: int
    y: int
    w: int
    h: int
    x0: int
    y0: int
    planes: int
    step: float

    @property
    def index(self) -> int:
        return KINDS.index(self.kind)


@dataclass
class Head:
    """What the main header says."""

    x0: int
    y0: int
    x1: int
    y1: int
    tile_w: int
    tile_h: int
    tile_x0: int
    tile_y0: int
    components: list[tuple[int, bool, int, int]]  # precision, signed, steps
    levels: int = 0
    layers: int = 1
    progression: str = "LRCP"
    colour: bool = False
    block_w: int = 64
    block_h: int = 64
    style: int = 0
    reversible: bool = True
    precincts: tuple[tuple[int, int], ...] = ((32768, 32768),)
    quantisers: list[int] = field(default_factory=list)  # exponent, or exponent << 11 | mantissa
    guard: int = GUARD
    #: Guard bits and quantisers of components that have their own.
    own_quantisers: dict[int, tuple[int, list[int]]] = field(default_factory=dict)
    start_marks: bool = False
    end_marks: bool = False

    @property
    def columns(self) -> int:
        return -(-(self.x1 - self.tile_x0) // self.tile_w)

    @property
    def tiles(self) -> int:
        return self.columns * -(-(self.y1 - self.tile_y0) // self.tile_h)

    def tile(self, k: int) -> tuple[int, int, int, int]:
        """x0, y0, x1, y1 on the reference grid."""
        p, q = k % self.columns, k // self.columns
        x, y = self.tile_x0 + p * self.tile_w, self.tile_y0 + q * self.tile_h
        return max(x, self.x0), max(y, self.y0), min(x + self.tile_w, self.x1), min(y + self.tile_h, self.y1)

    def tile_component(self, k: int, c: int) -> tuple[int, int, int, int]:
        _, _, sx, sy = self.components[c]
        x0, y0, x1, y1 = self.tile(k)
        return -(-x0 // sx), -(-y0 // sy), -(-x1 // sx), -(-y1 // sy)

    def bands(self, k: int, c: int) -> list[Band]:
        x0, y0, x1, y1 = self.tile_component(k, c)
        dims = kernels.shapes(y1 - y0, x1 - x0, self.levels, y0, x0)
        order = [("LL", self.levels)] + [(kind, level) for level in range(self.levels, 0, -1) for kind in KINDS[1:]]
        out = []
        for at, (kind, level) in enumerate(order):
            ly, lx, lh, lw = dims[level]
            py, px, ph, pw = dims[level - 1] if level else dims[0]
            high_x, high_y = kind in ("HL", "HH"), kind in ("LH", "HH")
            w, h = (pw - lw if high_x else lw), (ph - lh if high_y else lh)
            planes, step = self._depth(at, kind, c)
            resolution = 0 if kind == "LL" else self.levels - level + 1
            out.append(Band(kind, level, resolution, lw if high_x else 0, lh if high_y else 0, w, h, px >> 1 if high_x else lx, py >> 1 if high_y else ly, planes, step))
        return out

    def _depth(self, at: int, kind: str, c: int) -> tuple[int, float]:
        precision = self.components[c][0]
        guard, quantisers = self.own_quantisers.get(c, (self.guard, self.quantisers))
        value = quantisers[at]
        if self.reversible:
            return guard + value - 1, 1.0
        exponent, mantissa = value >> 11, value & 2047
        return guard + exponent - 1, 2.0 ** (precision + GAIN[kind] - exponent) * (1 + mantissa / 2048)

    def precinct(self, resolution: int) -> tuple[int, int]:
        return self.precincts[min(resolution, len(self.precincts) - 1)]


def _norm(kind: str, level: int) -> float:
    """L2 norm of a 9/7 synthesis function, from an impulse."""
    size = 64
    deep = min(level, 4)
    dims = kernels.shapes(size, size, deep)
    _, _, h, w = dims[deep]
    a = np.zeros((size, size), np.float32)
    y, x = h // 2 + (h if kind in ("LH", "HH") else 0), w // 2 + (w if kind in ("HL", "HH") else 0)
    a[y, x] = 1
    return float(np.sqrt((kernels.synthesise(a, deep, "9/7").astype(np.float64) ** 2).sum())) * 2.0 ** (level - deep)


def _quantisers(options: Options, precision: int) -> list[int]:
    out = []
    for kind, level in [("LL", options.levels)] + [(k, v) for v in range(options.levels, 0, -1) for k in KINDS[1:]]:
        if options.reversible:
            out.append(precision + GAIN[kind])
            continue
        step = options.step * (1 << precision) / (_norm(kind, level) if level else 1.0)
        exponent = max(0, min(31, precision + GAIN[kind] - math.floor(math.log2(step))))
        mantissa = round((step / 2.0 ** (precision + GAIN[kind] - exponent) - 1) * 2048)
        out.append(exponent << 11 | max(0, min(2047, mantissa)))
    return out


def head_for(raster: Raster, options: Options) -> Head:
    raster.check()
    n = len(raster.planes)
    x0, y0 = raster.origin
    x1 = x0 + raster.width * raster.planes[0].x_step
    y1 = y0 + raster.height * raster.planes[0].y_step
    if "extent" in raster.extra:
        x1, y1 = raster.extra["extent"]
    need(0 < options.block_w <= 1024 and 0 < options.block_h <= 1024 and options.block_w * options.block_h <= 4096 and options.block_w >= 4 and options.block_h >= 4, "block size")
    need(all(v & (v - 1) == 0 for v in (options.block_w, options.block_h, *[v for p in options.precincts for v in p])), "sizes are powers of two")
    need(1 <= options.layers <= 32 and 0 <= options.levels <= 32 and options.progression in PROGRESSIONS, "options")
    need(all(v >= 2 for p in options.precincts[1:] for v in p), "precincts")
    same = n >= 3 and all(p.samples.shape == raster.planes[0].samples.shape and p.precision == raster.planes[0].precision and not p.signed for p in raster.planes[:3])
    head = Head(x0, y0, x1, y1, options.tile_w or x1, options.tile_h or y1, 0, 0, [(p.precision, p.signed, p.x_step, p.y_step) for p in raster.planes])
    head.levels, head.layers, head.progression, head.style = options.levels, options.layers, options.progression, options.style
    head.colour, head.reversible, head.precincts = options.colour and same, options.reversible, options.precincts
    head.block_w, head.block_h = options.block_w, options.block_h
    top = max(p.precision for p in raster.planes) + (1 if head.colour and options.reversible else 0)
    need(len({p.precision for p in raster.planes}) == 1 or options.reversible, "one precision for 9/7")
    head.quantisers = _quantisers(options, top if options.reversible else raster.planes[0].precision)
    return head


# ---- samples and code blocks ----------------------------------------------------------------------


def tile_coefficients(head: Head, k: int, samples: list[np.ndarray]) -> list[np.ndarray]:
    """Packed coefficients of a tile's components, quantised where the path is lossy."""
    shifted = [s.astype(np.int64) - (0 if signed else level_shift(precision) if precision <= 16 else 1 << (precision - 1)) for s, (precision, signed, _, _) in zip(samples, head.components, strict=True)]
    if head.colour:
        r, g, b = shifted[:3]
        if head.reversible:
            shifted[:3] = [(r + 2 * g + b) >> 2, b - g, r - g]
        else:
            f = [np.float32(1) * c.astype(np.float32) for c in (r, g, b)]
            shifted[:3] = [
                np.float32(0.299) * f[0] + np.float32(0.587) * f[1] + np.float32(0.114) * f[2],
                np.float32(-0.16875) * f[0] - np.float32(0.33126) * f[1] + np.float32(0.5) * f[2],
                np.float32(0.5) * f[0] - np.float32(0.41869) * f[1] - np.float32(0.08131) * f[2],
            ]
    out = []
    for c, plane in enumerate(shifted):
        x0, y0, _, _ = head.tile_component(k, c)
        done = kernels.analyse(plane, head.levels, "5/3" if head.reversible else "9/7", y0, x0)
        if not head.reversible:
            q = np.zeros(done.shape, np.int64)
            for band in head.bands(k, c):
                part = done[band.y : band.y + band.h, band.x : band.x + band.w].astype(np.float64)
                q[band.y : band.y + band.h, band.x : band.x + band.w] = np.sign(part) * np.floor(np.abs(part) / band.step)
            done = q
        out.append(done)
    return out


@dataclass(frozen=True)
class Place:
    """Where a code block belongs."""

    component: int
    band: int  # in the component's band list
    precinct: int
    x: int  # in the precinct's grid of blocks
    y: int
    left: int  # in the packed plane
    top: int
    w: int
    h: int


def _precinct_grid(head: Head, k: int, c: int, r: int) -> tuple[int, int, int, int]:
    """First precinct and counts of a resolution (x, y, nx, ny)."""
    x0, y0, x1, y1 = head.tile_component(k, c)
    d = head.levels - r
    cut = lambda v: -(-v // (1 << d))
    x0, y0, x1, y1 = cut(x0), cut(y0), cut(x1), cut(y1)
    pw, ph = head.precinct(r)
    if x1 <= x0 or y1 <= y0:
        return 0, 0, 0, 0
    return x0 // pw, y0 // ph, -(-x1 // pw) - x0 // pw, -(-y1 // ph) - y0 // ph


def places(head: Head, k: int, c: int) -> tuple[list[Place], dict[tuple[int, int], tuple[int, int]]]:
    """All code blocks of a tile component, and the block grid (w, h) of each (band, precinct)."""
    out, grids = [], {}
    for b, band in enumerate(head.bands(k, c)):
        px, py, nx, ny = _precinct_grid(head, k, c, band.resolution)
        pw, ph = head.precinct(band.resolution)
        if band.resolution:
            pw, ph = pw // 2, ph // 2
        bw, bh = min(head.block_w, pw), min(head.block_h, ph)
        for p in range(nx * ny):
            ax, ay = (px + p % nx) * pw, (py + p // nx) * ph
            x0, x1 = max(ax, band.x0), min(ax + pw, band.x0 + band.w)
            y0, y1 = max(ay, band.y0), min(ay + ph, band.y0 + band.h)
            if x1 <= x0 or y1 <= y0:
                grids[b, p] = (0, 0)
                continue
            gx, gy = x0 // bw, y0 // bh
            grids[b, p] = (-(-x1 // bw) - gx, -(-y1 // bh) - gy)
            for j in range(grids[b, p][1]):
                for i in range(grids[b, p][0]):
                    l, t = max(x0, (gx + i) * bw), max(y0, (gy + j) * bh)
                    w, h = min(x1, (gx + i + 1) * bw) - l, min(y1, (gy + j + 1) * bh) - t
                    out.append(Place(c, b, p, i, j, band.x + l - band.x0, band.y + t - band.y0, w, h))
    return out, grids


def packet_order(head: Head, k: int) -> list[tuple[int, int, int, int]]:
    """(resolution, component, precinct, layer) in stream order."""
    tx, ty, _, _ = head.tile(k)
    rows = []
    for c, (_, _, sx, sy) in enumerate(head.components):
        for r in range(head.levels + 1):
            px, py, nx, ny = _precinct_grid(head, k, c, r)
            pw, ph = head.precinct(r)
            d = head.levels - r
            for p in range(nx * ny):
                at = {"resolution": r, "component": c, "precinct_index": p, "x_ref": max((px + p % nx) * pw * sx << d, tx), "y_ref": max((py + p // nx) * ph * sy << d, ty)}
                rows += [at | {"layer": layer} for layer in range(head.layers)]
    even = len({c[2:] for c in head.components}) == 1
    keys = (ORDERS if even else SAMPLED_ORDERS)[head.progression]
    rows.sort(key=lambda row: tuple(row[key] for key in keys))
    return [(row["resolution"], row["component"], row["precinct_index"], row["layer"]) for row in rows]


# ---- layers and packets ---------------------------------------------------------------------------


def band_weight(head: Head, band: Band) -> float:
    """What a squared error of a band's coefficients weighs in the image."""
    return (band.step * (1.0 if head.reversible else _norm(band.kind, band.level) if band.level else 1.0)) ** 2


def block_hull(coded: t1.CodedBlock, weight: float) -> list[tuple[int, int, float, float]]:
    return hull([(n + 1, size, gain * weight) for n, (size, gain) in enumerate(zip(coded.cum_bytes, coded.gains, strict=True))])


def layer_cuts(hulls: list[list[tuple[int, int, float, float]]], total: int, rates: Iterable[float], layers: int) -> list[float]:
    """The slope down to which each layer but the last takes points, over all blocks of the image together."""
    slopes = sorted({point[3] for h in hulls for point in h}, reverse=True)
    size = lambda cut: sum(max((p[1] for p in h if p[3] >= cut), default=0) for h in hulls)
    fitting = [bisect_right(slopes, target, key=size) for target in layer_targets(total, list(rates), layers)[:-1]]
    return [slopes[n - 1] if n else math.inf for n in fitting]


def layer_passes(coded: t1.CodedBlock, weight: float, cuts: list[float]) -> list[int]:
    """The passes of a block up to each layer; the last layer takes what is left."""
    points = block_hull(coded, weight) if cuts else []
    found = [max((p[0] for p in points if p[3] >= cut), default=0) for cut in cuts]
    return [*accumulate(found, max), coded.passes]


def _cuts(coded: t1.CodedBlock, upto: list[int]) -> list[list[tuple[int, int]]]:
    """Parts of each layer: (passes, bytes) for every segment it touches."""
    ends, starts, at, whole = [], [], 0, 0
    for n, size in coded.segments:
        starts.append((at, whole))
        at, whole = at + n, whole + size
        ends.append((at, whole))

    def bytes_at(passes: int) -> int:
        return 0 if not passes else next((b for a, b in ends if a == passes), coded.cum_bytes[passes - 1])

    out, before = [], 0
    for passes in upto:
        part = []
        for (a, _), (b, _) in zip(starts, ends, strict=True):
            lo, hi = max(a, before), min(b, passes)
            if hi > lo:
                part.append((hi - lo, bytes_at(hi) - bytes_at(lo)))
        out.append(part)
        before = passes
    return out


def tile_packets(head: Head, k: int, blocks: list[tuple[Place, t1.CodedBlock]], cuts: list[float]) -> list[bytes]:
    """Packets of a tile in stream order; ``cuts`` are those of the image."""
    need(len(cuts) == head.layers - 1, "a cut for each layer but the last")
    bands = {(c, b): band for c in range(len(head.components)) for b, band in enumerate(head.bands(k, c))}
    upto = [layer_passes(coded, band_weight(head, bands[place.component, place.band]), cuts) for place, coded in blocks]
    homes: dict[tuple[int, int, int], list[int]] = {}
    for n, (place, _) in enumerate(blocks):
        homes.setdefault((place.component, place.band, place.precinct), []).append(n)
    states: dict[tuple[int, int, int], t2.BandState] = {}
    grids = {c: places(head, k, c)[1] for c in range(len(head.components))}
    cuts = {n: _cuts(coded, upto[n]) for n, (_, coded) in enumerate(blocks)}
    used = dict.fromkeys(cuts, 0)
    out = []
    for r, c, p, layer in packet_order(head, k):
        here = []
        for b, band in enumerate(head.bands(k, c)):
            if band.resolution != r:
                continue
            members = sorted(homes.get((c, b, p), []), key=lambda n: (blocks[n][0].y, blocks[n][0].x))
            key = (c, b, p)
            if key not in states:
                w, h = grids[c].get((b, p), (0, 0))
                state = t2.BandState(w, h, [t2.BlockState(blocks[n][0].x, blocks[n][0].y) for n in members])
                if members:
                    never = head.layers + 1
                    state.inclusion.fill([next((i for i, v in enumerate(upto[n]) if v), never) for n in members])
                    state.zero.fill([band.planes - blocks[n][1].planes for n in members])
                    need(all(band.planes >= blocks[n][1].planes for n in members), "too many bit planes")
                states[key] = state
            part = []
            for n in members:
                cut = cuts[n][layer]
                size = sum(s for _, s in cut)
                part.append((sum(q for q, _ in cut), [v for pair in cut for v in pair], blocks[n][1].payload[used[n] : used[n] + size]))
                used[n] += size
            here.append((states[key], part))
        out.append(t2.write_packet([s for s, _ in here], layer, [p_ for _, p_ in here]))
    return out


# ---- markers --------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">HH", marker, len(body) + 2) + body


def main_header(head: Head) -> bytes:
    siz = struct.pack(">HIIIIIIIIH", 0, head.x1, head.y1, head.x0, head.y0, head.tile_w, head.tile_h, head.tile_x0, head.tile_y0, len(head.components))
    siz += b"".join(bytes([precision - 1 | signed << 7, sx, sy]) for precision, signed, sx, sy in head.components)
    own = head.precincts != ((32768, 32768),)
    exp = lambda v: v.bit_length() - 1
    cod = bytes([int(own), PROGRESSIONS.index(head.progression)]) + struct.pack(">HB", head.layers, int(head.colour))
    cod += bytes([head.levels, exp(head.block_w) - 2, exp(head.block_h) - 2, head.style, int(head.reversible)])
    if own:
        cod += bytes(exp(head.precinct(r)[1]) << 4 | exp(head.precinct(r)[0]) for r in range(head.levels + 1))
    if head.reversible:
        qcd = bytes([head.guard << 5]) + bytes(v << 3 for v in head.quantisers)
    else:
        qcd = bytes([head.guard << 5 | 2]) + b"".join(struct.pack(">H", v) for v in head.quantisers)
    return struct.pack(">H", SOC) + _segment(SIZ, siz) + _segment(COD, cod) + _segment(QCD, qcd)


def varint(n: int) -> bytes:
    out = [n & 127]
    while n := n >> 7:
        out.append(n & 127 | 128)
    return bytes(out[::-1])


def tile_part(k: int, packets: list[bytes], packet_lengths: bool = False) -> bytes:
    body = b"".join(packets)
    plt = b""
    if packet_lengths:
        group, index, parts = b"", 0, []
        for p in packets:
            v = varint(len(p))
            if len(group) + len(v) > 65000:
                parts.append(group)
                group = b""
            group += v
        for index, g in enumerate([*parts, group]):
            plt += _segment(PLT, bytes([index]) + g)
    return struct.pack(">HHHIBB", SOT, 10, k, 14 + len(plt) + len(body), 0, 1) + plt + struct.pack(">H", SOD) + body


def assemble(head: Head, parts: dict[int, bytes], part_lengths: bool = True) -> bytes:
    """Tiles in order, with their lengths in the main header."""
    tlm = b""
    if part_lengths:
        rows = sorted(parts)
        for index, at in enumerate(range(0, len(rows), 10000)):
            tlm += _segment(TLM, bytes([index, 0x60]) + b"".join(struct.pack(">HI", k, len(parts[k])) for k in rows[at : at + 10000]))
    return main_header(head) + tlm + b"".join(parts[k] for k in sorted(parts)) + struct.pack(">H", EOC)


def encode(raster: Raster, options: Options = Options(), coder: Callable[[np.ndarray, str, int], t1.CodedBlock] = t1.encode_block) -> bytes:
    head = head_for(raster, options)
    coded = {k: [(place, coder(block, kind, head.style)) for place, kind, block in tile_blocks(head, k, tile_samples(head, k, raster))] for k in range(head.tiles)}
    return finished(head, coded, options)


def finished(head: Head, coded: dict[int, list[tuple[Place, t1.CodedBlock]]], options: Options) -> bytes:
    """Layers, packets and markers of an image whose blocks are coded, by tile."""
    cuts: list[float] = []
    if head.layers > 1:
        hulls = [block_hull(c, band_weight(head, head.bands(k, place.component)[place.band])) for k, blocks in coded.items() for place, c in blocks]
        cuts = layer_cuts(hulls, sum(len(c.payload) for blocks in coded.values() for _, c in blocks), options.rates, head.layers)
    parts = {}
    for k, blocks in coded.items():
        packets = tile_packets(head, k, blocks, cuts)
        if options.audit:
            audit_tile(head, k, packets, blocks)
        parts[k] = tile_part(k, packets, options.packet_lengths)
    return assemble(head, parts, options.part_lengths)


def audit_tile(head: Head, k: int, packets: list[bytes], blocks: list[tuple[Place, t1.CodedBlock]]) -> None:
    """Reads packets back and holds them against the blocks they were made of; a difference is an error."""
    found = {place: (planes, payload, sum(n for n, _ in parts)) for place, _, planes, parts, payload in read_blocks(head, k, b"".join(packets))}
    want = {place: (coded.planes, coded.payload, coded.passes) for place, coded in blocks if coded.passes}
    need(found == want, f"packets of tile {k} do not give back their blocks")


def tile_samples(head: Head, k: int, raster: Raster) -> list[np.ndarray]:
    out = []
    for c, plane in enumerate(raster.planes):
        x0, y0, x1, y1 = head.tile_component(k, c)
        ox, oy = -(-head.x0 // plane.x_step), -(-head.y0 // plane.y_step)
        out.append(plane.samples[y0 - oy : y1 - oy, x0 - ox : x1 - ox])
    return out


def tile_blocks(head: Head, k: int, samples: list[np.ndarray]):
    for c, plane in enumerate(tile_coefficients(head, k, samples)):
        bands = head.bands(k, c)
        for place in places(head, k, c)[0]:
            yield place, bands[place.band].kind, plane[place.top : place.top + place.h, place.left : place.left + place.w]


# ---- decoding -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    tile: int | None = None
    region: tuple[int, int, int, int] | None = None  # x, y, w, h on the reference grid
    reduce: int = 0
    layers: int | None = None


def segments(data: bytes) -> list[tuple[int, int, bytes]]:
    """(offset, marker, body) of the main header, up to the first tile-part."""
    need(data[:2] == struct.pack(">H", SOC), "not a codestream")
    at, out = 2, []
    while True:
        need(at + 4 <= len(data), "header ends early")
        marker, size = struct.unpack(">HH", data[at : at + 4])
        if marker == SOT:
            return out
        need(marker >= 0xFF00 and size >= 2 and at + 2 + size <= len(data), "marker segment")
        out.append((at, marker, data[at + 4 : at + 2 + size]))
        at += 2 + size


def read_head(data: bytes) -> Head:
    found = segments(data)
    need(bool(found) and found[0][1] == SIZ, "SIZ is not second")
    for marker in (SIZ, COD, QCD):
        need(sum(m == marker for _, m, _ in found) == 1, f"marker {marker:04x} does not occur once")
    need(not any(m in (RGN, POC, 0xFF60, 0xFF61) for _, m, _ in found), "unsupported marker")
    body = {m: b for _, m, b in found}
    siz = body[SIZ]
    need(len(siz) >= 36, "SIZ")
    _, x1, y1, x0, y0, tw, th, tx, ty, n = struct.unpack(">HIIIIIIIIH", siz[:36])
    need(n > 0 and len(siz) == 36 + 3 * n and x1 > x0 and y1 > y0 and tw > 0 and th > 0 and tx <= x0 < tx + tw and ty <= y0 < ty + th, "SIZ")
    components = [((siz[36 + 3 * k] & 127) + 1, bool(siz[36 + 3 * k] >> 7), siz[37 + 3 * k], siz[38 + 3 * k]) for k in range(n)]
    need(all(p <= 38 and sx and sy for p, _, sx, sy in components), "component")
    head = Head(x0, y0, x1, y1, tw, th, tx, ty, components)
    cod = body[COD]
    need(len(cod) >= 10 and cod[0] < 8 and cod[1] < 5, "COD")
    head.start_marks, head.end_marks = bool(cod[0] & 2), bool(cod[0] & 4)
    head.progression, head.layers = PROGRESSIONS[cod[1]], int.from_bytes(cod[2:4], "big")
    need(cod[4] < 2 and head.layers > 0, "COD")
    head.colour = bool(cod[4])
    need(not head.colour or n >= 3, "colour transform")
    # a component's own style counts before the general one; all have to come to the same
    styles = {c: (b[0], b[1:]) for c, b in _overrides(found, COC, n).items()}
    chosen = {_style(*styles.get(c, (cod[0] & 1, cod[5:]))) for c in range(n)}
    need(len(chosen) == 1, "components of different coding styles")
    head.levels, head.block_w, head.block_h, head.style, head.reversible, head.precincts = chosen.pop()
    own = {c: _quantiser_list(b, head) for c, b in _overrides(found, QCC, n).items()}
    if len(own) < n:  # else the general one counts for none
        head.guard, head.quantisers = _quantiser_list(body[QCD], head)
    else:
        head.guard, head.quantisers = own[0]
    head.own_quantisers = own
    return head


def _overrides(found: list[tuple[int, int, bytes]], marker: int, n: int) -> dict[int, bytes]:
    """Bodies of a marker that names a component, without its number; each component at most once."""
    size, out = 1 if n < 257 else 2, {}
    for _, m, body in found:
        if m == marker:
            need(len(body) > size, "component segment")
            c = int.from_bytes(body[:size], "big")
            need(c < n and c not in out, "component of a segment")
            out[c] = body[size:]
    return out


def _style(own: int, body: bytes) -> tuple[int, int, int, int, bool, tuple[tuple[int, int], ...]]:
    """Levels, block size, style, reversibility and precincts of a coding style's bytes."""
    need(own < 2 and len(body) >= 5 and body[0] <= 32 and body[4] < 2 and body[3] < 64 and body[1] + body[2] <= 8, "coding style")
    levels = body[0]
    need(len(body) == (6 + levels if own else 5), "coding style length")
    precincts = tuple((1 << (v & 15), 1 << (v >> 4)) for v in body[5:]) if own else Head.precincts
    return levels, 4 << body[1], 4 << body[2], body[3], bool(body[4]), precincts


def _quantiser_list(body: bytes, head: Head) -> tuple[int, list[int]]:
    """Guard bits, and the exponent or exponent and mantissa of each band."""
    need(bool(body), "quantisers")
    guard, bands = body[0] >> 5, 1 + 3 * head.levels
    if head.reversible:
        need(body[0] & 31 == 0 and len(body) == 1 + bands, "quantisers")
        return guard, [v >> 3 for v in body[1:]]
    if body[0] & 31 == 1:
        need(len(body) == 3, "quantisers")
        first = int.from_bytes(body[1:], "big")
        order = [head.levels] + [level for level in range(head.levels, 0, -1) for _ in range(3)]
        return guard, [max(0, (first >> 11) - (head.levels - level)) << 11 | first & 2047 for level in order]
    need(body[0] & 31 == 2 and len(body) == 1 + 2 * bands, "quantisers")
    return guard, list(struct.unpack(f">{bands}H", body[1:]))


def tile_parts(data: bytes, head: Head) -> dict[int, bytes]:
    """Packet bytes of each tile, its parts in order."""
    at = 2 + sum(4 + len(b) for _, _, b in segments(data))
    out: dict[int, bytes] = {}
    count: dict[int, int] = {}
    while data[at : at + 2] != struct.pack(">H", EOC):
        need(at + 12 <= len(data), "tile-part ends early")
        marker, size, k, length, part, _ = struct.unpack(">HHHIBB", data[at : at + 12])
        need(marker == SOT and size == 10 and k < head.tiles, "SOT")
        need(part == count.get(k, 0), "tile-part order")
        count[k] = part + 1
        end = at + length if length else len(data) - 2
        need(at + 14 <= end <= len(data), "tile-part length")
        pos = at + 12
        while data[pos : pos + 2] != struct.pack(">H", SOD):
            need(pos + 4 <= end, "tile-part header")
            marker, size = struct.unpack(">HH", data[pos : pos + 4])
            need(marker in (PLT, COM), "unsupported marker in a tile-part")
            pos += 2 + size
        out[k] = out.get(k, b"") + data[pos + 2 : end]
        at = end
    need(at + 2 == len(data), "bytes behind the end")
    return out


def read_blocks(head: Head, k: int, data: bytes, layers: int | None = None):
    """Code blocks of a tile: (place, band, planes, segments, payload); later layers are checked, not kept."""
    bands = [head.bands(k, c) for c in range(len(head.components))]
    states: dict[tuple[int, int, int], tuple[t2.BandState, list[Place]]] = {}
    for c in range(len(head.components)):
        found, grids = places(head, k, c)
        homes: dict[tuple[int, int], list[Place]] = {}
        for place in found:
            homes.setdefault((place.band, place.precinct), []).append(place)
        for (b, p), (w, h) in grids.items():
            members = sorted(homes.get((b, p), []), key=lambda q: (q.y, q.x))
            states[c, b, p] = (t2.BandState(w, h, [t2.BlockState(q.x, q.y) for q in members]), members)
    at = 0
    kept: dict[int, tuple[int, int]] = {}
    for r, c, p, layer in packet_order(head, k):
        if layers is not None and layer == layers:
            for b, band in enumerate(bands[c]):
                if band.resolution == r and (c, b, p) in states:
                    for block in states[c, b, p][0].blocks:
                        kept[id(block)] = (len(block.segments), len(block.data))
        if head.start_marks and data[at : at + 2] == b"\xff\x91":
            at += 6
        here = [(states[c, b, p][0], band.planes) for b, band in enumerate(bands[c]) if band.resolution == r and (c, b, p) in states]
        try:
            at = t2.read_packet(data, at, [s for s, _ in here], layer, head.style, [n for _, n in here], head.end_marks)
        except ValueError as error:
            need(False, str(error))
    need(at == len(data), "bytes behind the last packet")
    for (c, b, _), (state, members) in states.items():
        band = bands[c][b]
        for block, place in zip(state.blocks, members, strict=True):
            if id(block) in kept:
                n, size = kept[id(block)]
                block.segments, block.data = block.segments[:n], block.data[:size]
            if block.segments:
                planes = band.planes - block.zero_planes
                yield place, band, planes, t2.joined_segments(block, planes, head.style), bytes(block.data)


def rebuild_tile(head: Head, k: int, decoded: Iterable[tuple[Place, Band, np.ndarray, np.ndarray]], reduce: int = 0) -> list[np.ndarray]:
    """Samples of a tile's components from decoded blocks (coefficients and lowest known planes)."""
    planes = []
    for c in range(len(head.components)):
        x0, y0, x1, y1 = head.tile_component(k, c)
        planes.append(np.zeros((y1 - y0, x1 - x0), np.int64 if head.reversible else np.float32))
    for place, band, q, low in decoded:
        if not head.reversible:
            q = np.where(q == 0, 0.0, (np.abs(q) + 0.5 * (1 << low)) * np.sign(q) * band.step).astype(np.float32)
        planes[place.component][place.top : place.top + place.h, place.left : place.left + place.w] = q
    out = []
    for c, plane in enumerate(planes):
        x0, y0, _, _ = head.tile_component(k, c)
        out.append(kernels.synthesise(plane, head.levels, "5/3" if head.reversible else "9/7", y0, x0, reduce))
    if head.colour:
        a, b, c = out[:3]
        if head.reversible:
            g = a - ((b + c) >> 2)
            out[:3] = [c + g, g, b + g]
        else:
            f = np.float32
            out[:3] = [a + f(1.402) * c, a - f(0.34413) * b - f(0.71414) * c, a + f(1.772) * b]
    done = []
    for plane, (precision, signed, _, _) in zip(out, head.components, strict=True):
        up = 0 if signed else 1 << (precision - 1)
        low, high = (-(1 << (precision - 1)), (1 << (precision - 1)) - 1) if signed else (0, (1 << precision) - 1)
        v = plane if head.reversible else np.where(plane >= 0, np.floor(plane + np.float32(0.5)), np.ceil(plane - np.float32(0.5)))
        done.append(np.clip(v.astype(np.int64) + up, low, high))
    return done


def decode(data: bytes, selection: Selection = Selection(), reader: Callable[..., tuple[np.ndarray, np.ndarray]] = t1.decode_block) -> Raster:
    """The image, or the part that the selection asks for; tiles outside it are not decoded."""
    head = read_head(data)
    need(selection.tile is None or selection.region is None, "tile and region exclude each other")
    need(0 <= selection.reduce <= head.levels, "reduction")
    parts = tile_parts(data, head)
    need(sorted(parts) == list(range(head.tiles)), "tile missing")
    box = (head.x0, head.y0, head.x1, head.y1)
    if selection.tile is not None:
        need(0 <= selection.tile < head.tiles, "tile index")
        box = head.tile(selection.tile)
    elif selection.region is not None:
        x, y, w, h = selection.region
        need(w > 0 and h > 0 and head.x0 <= x and head.y0 <= y and x + w <= head.x1 and y + h <= head.y1, "region")
        box = (x, y, x + w, y + h)
    scale = 1 << selection.reduce
    cut = lambda v, step: -(-(-(-v // step)) // scale)
    planes = []
    for precision, signed, sx, sy in head.components:
        shape = (cut(box[3], sy) - cut(box[1], sy), cut(box[2], sx) - cut(box[0], sx))
        planes.append(Plane(np.zeros(shape, np.int64), precision, signed, sx, sy))
    for k in range(head.tiles):
        x0, y0, x1, y1 = head.tile(k)
        if x1 <= box[0] or box[2] <= x0 or y1 <= box[1] or box[3] <= y0:
            continue
        blocks = [
            (place, band, *reader(payload, found, depth, place.h, place.w, band.kind, head.style))
            for place, band, depth, found, payload in read_blocks(head, k, parts[k], selection.layers)
            if band.resolution <= head.levels - selection.reduce
        ]
        for c, samples in enumerate(rebuild_tile(head, k, blocks, selection.reduce)):
            _, _, sx, sy = head.components[c]
            ox, oy = cut(x0, sx) - cut(box[0], sx), cut(y0, sy) - cut(box[1], sy)
            target = planes[c].samples
            top, left = max(0, oy), max(0, ox)
            bottom, right = min(target.shape[0], oy + samples.shape[0]), min(target.shape[1], ox + samples.shape[1])
            if bottom > top and right > left:
                target[top:bottom, left:right] = samples[top - oy : bottom - oy, left - ox : right - ox]
    layout = {1: "gray", 3: "rgb"}.get(len(planes), "planar") if all((p.x_step, p.y_step, p.signed) == (1, 1, False) for p in planes) else "planar"
    return Raster(planes, layout, origin=(box[0], box[1]), extra={"extent": (box[2], box[3])})
