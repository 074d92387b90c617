"""The boxed container around a codestream: parse, validate, wrap, metadata."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from . import codestream
from .raster import Raster, need

#: UUIDs of the managed metadata boxes (fixed values).
UUIDS = {
    "exif": bytes.fromhex("4a706754696666457869662d3e4a5032"),
    "xmp": bytes.fromhex("be7acfcb97a942e89c71999491e3afac"),
    "iptc": bytes.fromhex("33c7a4d2b81d4723a0baf1a3e097ad38"),
}
COLOUR_SPACES = {16: "srgb", 17: "gray", 18: "sycc"}
SIGNATURE = b"\r\n\x87\n"


@dataclass(frozen=True)
class Box:
    offset: int
    kind: str
    depth: int
    payload: bytes


@dataclass
class Info:
    width: int = 0
    height: int = 0
    components: int = 0
    bits: tuple[int, ...] = ()
    colour: str | None = None
    icc: bytes | None = None
    palette: np.ndarray | None = None
    mapping: tuple[tuple[int, int, int], ...] = ()
    channels: tuple[tuple[int, int, int], ...] = ()
    resolution: dict[str, tuple[float, float]] = field(default_factory=dict)
    metadata: dict[str, bytes] = field(default_factory=dict)
    codestream: bytes = b""


def boxes(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> list[Box]:
    """All boxes in order; superboxes are followed by what they hold."""
    end = len(data) if end is None else end
    at, out = start, []
    while at < end:
        need(at + 8 <= end, "box ends early")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            need(at + 16 <= end, "box ends early")
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        elif size == 0:
            need(depth == 0, "open-ended box inside another")
            size = end - at
        need(size >= head and at + size <= end, "box length")
        name = kind.decode("latin-1")
        out.append(Box(at, name, depth, data[at + head : at + size]))
        if name in ("jp2h", "res "):
            out += boxes(data, at + head, at + size, depth + 1)
        at += size
    return out


def parse(data: bytes) -> Info:
    found = boxes(data)
    top = [b for b in found if b.depth == 0]
    need(len(top) >= 3 and top[0].kind == "jP  " and top[0].payload == SIGNATURE, "signature box")
    need(top[1].kind == "ftyp" and len(top[1].payload) >= 12 and (len(top[1].payload) - 8) % 4 == 0 and b"jp2 " in [top[1].payload[k : k + 4] for k in range(8, len(top[1].payload), 4)], "file type box")
    names = [b.kind for b in top]
    for name in ("jp2h", "jp2c"):
        need(names.count(name) == 1, f"box {name} does not occur once")
    need(names.index("jp2h") < names.index("jp2c"), "box order")
    info = Info()
    inner = [b for b in found if b.depth > 0]
    need(bool(inner) and inner[0].kind == "ihdr" and len(inner[0].payload) == 14, "image header box is not first")
    info.height, info.width, info.components, bpc, packing, unknown, _ = struct.unpack(">IIHBBBB", inner[0].payload)
    need(info.width > 0 and info.height > 0 and info.components > 0 and packing == 7 and unknown < 2, "image header box")
    bits = [bpc] * info.components
    seen = set()
    for box in inner[1:]:
        if box.kind in ("bpcc", "pclr", "cmap", "cdef", "res "):
            need(box.kind not in seen, f"box {box.kind} repeats")
            seen.add(box.kind)
        p = box.payload
        if box.kind == "bpcc":
            need(len(p) == info.components, "bits per component box")
            bits = list(p)
        elif box.kind == "colr" and info.colour is None:
            need(len(p) >= 3, "colour box")
            if p[0] == 1:
                need(len(p) == 7 and int.from_bytes(p[3:7], "big") in COLOUR_SPACES, "enumerated colour space")
                info.colour = COLOUR_SPACES[int.from_bytes(p[3:7], "big")]
            elif p[0] == 2:
                need(len(p) >= 135 and int.from_bytes(p[3:7], "big") == len(p) - 3, "ICC profile")
                info.colour, info.icc = "icc", p[3:]
        elif box.kind == "pclr":
            n, k = struct.unpack(">HB", p[:3])
            need(0 < n <= 1024 and k > 0 and len(p) == 3 + k + n * k and all(v < 8 for v in p[3 : 3 + k]), "palette box")
            info.palette = np.frombuffer(p, np.uint8, n * k, 3 + k).reshape(n, k).astype(np.int64)
        elif box.kind == "cmap":
            need(len(p) % 4 == 0, "component mapping box")
            info.mapping = tuple(struct.unpack(">HBB", p[k : k + 4]) for k in range(0, len(p), 4))
        elif box.kind == "cdef":
            n = int.from_bytes(p[:2], "big")
            need(n > 0 and len(p) == 2 + 6 * n, "channel definition box")
            info.channels = tuple(struct.unpack(">HHH", p[2 + 6 * k : 8 + 6 * k]) for k in range(n))
            need(len({c[0] for c in info.channels}) == n, "channel defined twice")
        elif box.kind in ("resc", "resd"):
            need(len(p) == 10, "resolution box")
            vn, vd, hn, hd, ve, he = struct.unpack(">HHHHbb", p)
            need(vd > 0 and hd > 0 and vn > 0 and hn > 0, "resolution box")
            info.resolution[box.kind] = (vn / vd * 10.0**ve, hn / hd * 10.0**he)
    need(info.colour is not None, "no colour box")
    need((info.palette is None) == (not info.mapping), "palette and mapping come together")
    need(255 not in bits, "bits per component")
    info.bits = tuple(bits)
    for box in top:
        if box.kind == "uuid":
            need(len(box.payload) >= 16, "UUID box")
            for name, ident in UUIDS.items():
                if box.payload[:16] == ident:
                    need(name not in info.metadata, f"{name} repeats")
                    info.metadata[name] = box.payload[16:]
    validate_metadata(info.metadata)
    info.codestream = next(b.payload for b in top if b.kind == "jp2c")
    head = codestream.read_head(info.codestream)
    need(len(head.components) == info.components and (head.x1 - head.x0, head.y1 - head.y0) == (info.width, info.height), "container and codestream differ")
    need(all((b & 127) + 1 == c[0] and bool(b >> 7) == c[1] for b, c in zip(bits, head.components, strict=True)), "bit depths differ")
    return info


def validate_metadata(found: dict[str, bytes]) -> None:
    """TIFF header of Exif, UTF-8 and a root element of XMP, datasets of IPTC."""
    if "exif" in found:
        need(found["exif"][:4] in (b"II*\0", b"MM\0*"), "Exif")
    if "xmp" in found:
        try:
            text = found["xmp"].decode("utf-8")
        except UnicodeDecodeError:
            need(False, "XMP is not UTF-8")
        need("<" in text and ">" in text, "XMP")
    if "iptc" in found:
        at, data = 0, found["iptc"]
        while at < len(data):
            need(at + 5 <= len(data) and data[at] == 0x1C, "IPTC dataset")
            size = int.from_bytes(data[at + 3 : at + 5], "big")
            need(size < 0x8000 and at + 5 + size <= len(data), "IPTC dataset")
            at += 5 + size


def _box(kind: bytes, payload: bytes) -> bytes:
    return struct.pack(">I4s", len(payload) + 8, kind) + payload


def wrap(stream: bytes, colour: str | None = None, icc: bytes | None = None, alpha_mode: str | None = None, palette: np.ndarray | None = None, metadata: dict[str, bytes] | None = None) -> bytes:
    """A container for a codestream; the colour space follows from the components where it is not given."""
    head = codestream.read_head(stream)
    n = len(head.components)
    bits = [p - 1 | s << 7 for p, s, _, _ in head.components]
    ihdr = struct.pack(">IIHBBBB", head.y1 - head.y0, head.x1 - head.x0, n, bits[0] if len(set(bits)) == 1 else 255, 7, 0, 0)
    inner = _box(b"ihdr", ihdr)
    if len(set(bits)) > 1:
        inner += _box(b"bpcc", bytes(bits))
    if icc is not None:
        inner += _box(b"colr", b"\x02\0\0" + icc)
    else:
        name = colour or ("srgb" if palette is not None or n >= 3 else "gray")
        code = next(k for k, v in COLOUR_SPACES.items() if v == name)
        inner += _box(b"colr", b"\x01\0\0" + struct.pack(">I", code))
    if palette is not None:
        k = palette.shape[1]
        inner += _box(b"pclr", struct.pack(">HB", len(palette), k) + bytes([7] * k) + palette.astype(np.uint8).tobytes())
        inner += _box(b"cmap", b"".join(struct.pack(">HBB", 0, 1, c) for c in range(k)))
    if alpha_mode is not None:
        rows = [(c, 0, c + 1) for c in range(n - 1)] + [(n - 1, 1 if alpha_mode == "unassociated" else 2, 0)]
        inner += _box(b"cdef", struct.pack(">H", n) + b"".join(struct.pack(">HHH", *r) for r in rows))
    out = _box(b"jP  ", SIGNATURE) + _box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + _box(b"jp2h", inner)
    for name, body in (metadata or {}).items():
        out += _box(b"uuid", UUIDS[name] + body)
    return out + _box(b"jp2c", stream)


def attach(data: bytes, metadata: dict[str, bytes]) -> bytes:
    """Metadata boxes before the codestream; what is there already is not replaced but refused."""
    info = parse(data)
    need(not set(metadata) & set(info.metadata), "metadata is there already")
    validate_metadata(metadata)
    at = next(b.offset for b in boxes(data) if b.kind == "jp2c")
    out = data[:at] + b"".join(_box(b"uuid", UUIDS[k] + v) for k, v in metadata.items()) + data[at:]
    parse(out)
    return out


def read_jp2(data: bytes, selection: codestream.Selection = codestream.Selection(), **more) -> Raster:
    info = parse(data)
    out = codestream.decode(info.codestream, selection, **more)
    if info.palette is not None:
        index = out.planes[0].samples
        need(int(index.max()) < len(info.palette), "index is not in the palette")
        out.planes = [codestream.Plane(info.palette[index][:, :, column], 8) for _, _, column in info.mapping]
        out.layout = "rgb" if len(out.planes) == 3 else "planar"
    kinds = {asoc_type for _, asoc_type, _ in info.channels}
    if kinds & {1, 2} and len(out.planes) in (2, 4):
        out.layout, out.alpha_mode = {2: "graya", 4: "rgba"}[len(out.planes)], "unassociated" if 1 in kinds else "associated"
    out.icc, out.exif, out.xmp, out.iptc = info.icc, info.metadata.get("exif"), info.metadata.get("xmp"), info.metadata.get("iptc")
    out.extra["colour"] = info.colour
    return out


def write_jp2(raster: Raster, options: codestream.Options = codestream.Options(), stream: bytes | None = None) -> bytes:
    """``stream``: the raster's codestream, where it is there already; its samples are not looked at then."""
    metadata = {k: v for k, v in (("exif", raster.exif), ("xmp", raster.xmp), ("iptc", raster.iptc)) if v}
    return wrap(codestream.encode(raster, options) if stream is None else stream, icc=raster.icc, alpha_mode=raster.alpha_mode, metadata=metadata)
