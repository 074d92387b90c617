"""Tone curves, 3x3 matrices and ICC matrix/TRC profiles."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: D50-adapted sRGB matrix and its inverse transfer curve, as s15Fixed16 columns hold them (fixed values).
SRGB = (
    (0.43603515625, 0.385101318359375, 0.14306640625),
    (0.222442626953125, 0.7169342041015625, 0.0606231689453125),
    (0.0139007568359375, 0.097076416015625, 0.71392822265625),
)
SRGB_GAMMA, SRGB_A, SRGB_B, SRGB_C, SRGB_D = 2.4000396728515625, 0.9478607177734375, 0.0521392822265625, 0.077392578125, 0.0404510498046875
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
D50 = (0.9642, 1.0, 0.8249)


def parametric(x: Column, kind: int, p: list[float]) -> Column:
    """ICC parametric curve of type 0 to 4."""
    if not 0 <= kind <= 4 or len(p) < (1, 3, 4, 5, 7)[kind]:
        raise ValueError("not a parametric curve")
    if kind == 0:
        return F.pow(x, F.lit(p[0]))
    bent = F.pow(F.lit(p[1]) * x + F.lit(p[2]), F.lit(p[0]))
    if kind <= 2:
        up = p[3] if kind == 2 else 0.0
        return F.when(x >= -p[2] / p[1], bent + F.lit(up)).otherwise(F.lit(up))
    if kind == 3:
        return F.when(x >= p[4], bent).otherwise(F.lit(p[3]) * x)
    return F.when(x >= p[4], bent + F.lit(p[5])).otherwise(F.lit(p[3]) * x + F.lit(p[6]))


def table_curve(x: Column, entries: list[int]) -> Column:
    """A sampled curve of 16-bit entries, interpolated linearly; no join, the table is a literal."""
    table = F.array(*[F.lit(e / 65535.0) for e in entries])
    at = x * (len(entries) - 1)
    low = F.floor(at).cast("int")
    a = F.get(table, low)
    return F.when(low + 1 >= len(entries), a).otherwise(a + (F.get(table, low + 1) - a) * (at - low))


def apply_matrix(m, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(F.lit(float(row[0])) * v[0] + F.lit(float(row[1])) * v[1] + F.lit(float(row[2])) * v[2] for row in m)


def invert(m) -> np.ndarray:
    a = np.asarray(m, dtype=np.float64)
    if not np.isfinite(a).all() or abs(np.linalg.det(a)) < 1e-12:
        raise ValueError("singular matrix")
    return np.linalg.inv(a)


def srgb_encoded(linear: Column) -> Column:
    """Linear light to the sRGB curve."""
    return F.when(linear < SRGB_C * SRGB_D, linear / SRGB_C).otherwise((F.pow(linear, F.lit(1.0 / SRGB_GAMMA)) - SRGB_B) / SRGB_A)


def to_srgb(channels: tuple[Column, Column, Column], matrix, curve, depth: int = 8) -> tuple[Column, Column, Column]:
    """Samples through a profile's curve and matrix to sRGB samples."""
    top = float((1 << depth) - 1)
    xyz = apply_matrix(matrix, tuple(curve(c / top) for c in channels))
    linear = apply_matrix(invert(SRGB), xyz)
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return tuple(F.floor(unit(srgb_encoded(unit(v))) * top + 0.5).cast("bigint") for v in linear)


def chromaticities_to_d50(red, green, blue, white) -> np.ndarray:
    """RGB-to-XYZ matrix of primaries and white (xy), adapted to D50 by Bradford cones."""
    xyz = lambda c: np.array([c[0] / c[1], 1.0, (1.0 - c[0] - c[1]) / c[1]])
    primaries = np.stack([xyz(c) for c in (red, green, blue)], axis=1)
    source = primaries * (invert(primaries) @ xyz(white))
    cones = np.array(BRADFORD)
    scale = (cones @ np.array(D50)) / (cones @ xyz(white))
    return invert(cones) @ np.diag(scale) @ cones @ source


def camera_to_xyz(forward, neutral) -> np.ndarray:
    """Forward matrix with each column divided by the neutral of its channel."""
    n = np.asarray(neutral, dtype=np.float64)
    if n.shape != (3,) or not np.isfinite(n).all() or (n <= 0).any():
        raise ValueError("neutral is not positive")
    return np.asarray(forward, dtype=np.float64) / n


@dataclass(frozen=True)
class Curve:
    kind: str  # identity, gamma, table, parametric
    values: tuple[float, ...] = ()
    function: int = 0

    def column(self, x: Column) -> Column:
        if self.kind == "identity":
            return x
        if self.kind == "gamma":
            return F.pow(x, F.lit(self.values[0]))
        if self.kind == "table":
            return table_curve(x, [int(v) for v in self.values])
        return parametric(x, self.function, list(self.values))

    def sampled(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "identity":
            return x
        if self.kind == "gamma":
            return x ** self.values[0]
        if self.kind == "table":
            return np.interp(x, np.linspace(0, 1, len(self.values)), np.array(self.values) / 65535.0)
        g, *rest = (*self.values, *[0.0] * 7)
        a, b, c, d, e, f = rest[:6]
        bent = np.power(np.maximum(a * x + b, 0.0), g)
        return [lambda: x**g, lambda: np.where(x >= -b / a, bent, 0.0), lambda: np.where(x >= -b / a, bent + c, c), lambda: np.where(x >= d, bent, c * x), lambda: np.where(x >= d, bent + e, c * x + f)][self.function]()


def _fixed(data: bytes) -> float:
    return struct.unpack(">i", data)[0] / 65536.0


def parse_profile(data: bytes) -> tuple[np.ndarray, tuple[Curve, Curve, Curve]]:
    """Matrix and curves of an RGB matrix/TRC profile; anything else is refused."""
    if len(data) < 132 or int.from_bytes(data[:4], "big") != len(data) or data[36:40] != b"acsp" or data[16:20] != b"RGB " or data[20:24] != b"XYZ ":
        raise ValueError("not an RGB matrix profile")
    tags = {}
    for k in range(int.from_bytes(data[128:132], "big")):
        name, offset, size = struct.unpack(">4sII", data[132 + 12 * k : 144 + 12 * k])
        if name in tags or offset + size > len(data):
            raise ValueError("bad tag table")
        tags[name] = data[offset : offset + size]
    if any(t.startswith(b"A2B") for t in tags):
        raise ValueError("lookup-table profile")
    columns = []
    for name in (b"rXYZ", b"gXYZ", b"bXYZ"):
        if len(tags[name]) < 20 or tags[name][:4] != b"XYZ ":
            raise ValueError("bad colorant")
        columns.append([_fixed(tags[name][8 + 4 * k : 12 + 4 * k]) for k in range(3)])
    curves = tuple(_curve(tags[name]) for name in (b"rTRC", b"gTRC", b"bTRC"))
    grid = np.linspace(0.0, 1.0, 257)
    for curve in curves:
        y = curve.sampled(grid)
        if not np.isfinite(y).all() or (np.diff(y) < 0).any():
            raise ValueError("curve is not monotone")
    return np.array(columns).T, curves


def _curve(data: bytes) -> Curve:
    if data[:4] == b"curv":
        n = int.from_bytes(data[8:12], "big")
        values = struct.unpack(f">{n}H", data[12 : 12 + 2 * n])
        if n == 0:
            return Curve("identity")
        return Curve("gamma", (values[0] / 256.0,)) if n == 1 else Curve("table", tuple(map(float, values)))
    if data[:4] == b"para":
        function = int.from_bytes(data[8:10], "big")
        if function > 4:
            raise ValueError("unknown curve function")
        return Curve("parametric", tuple(_fixed(data[12 + 4 * k : 16 + 4 * k]) for k in range((1, 3, 4, 5, 7)[function])), function)
    raise ValueError("unknown curve type")


def build_linear_profile(matrix) -> bytes:
    """A version 4 display profile with the given matrix and linear curves."""
    fixed = lambda v: struct.pack(">i", round(float(v) * 65536))
    xyz = lambda c: b"XYZ " + bytes(4) + b"".join(fixed(v) for v in c)
    text = lambda s: b"mluc" + bytes(4) + struct.pack(">IIHHII", 1, 12, 0x656E, 0x5553, 2 * len(s), 28) + s.encode("utf-16-be")
    m = np.asarray(matrix)
    parts = [(b"desc", text("linear RGB")), (b"cprt", text("none")), (b"wtpt", xyz(D50)), (b"rXYZ", xyz(m[:, 0])), (b"gXYZ", xyz(m[:, 1])), (b"bXYZ", xyz(m[:, 2]))]
    line = b"curv" + bytes(8)
    body, table, at = b"", b"", 132 + 12 * (len(parts) + 3)
    for name, data in [*parts, (b"rTRC", line), (b"gTRC", line), (b"bTRC", line)]:
        data += bytes(-len(data) % 4)
        table += struct.pack(">4sII", name, at + len(body), len(data))
        body += data
    head = struct.pack(">I4sI4s4s4s", at + len(body), b"\0\0\0\0", 0x04000000, b"mntr", b"RGB ", b"XYZ ") + bytes(12) + b"acsp" + bytes(28) + b"".join(fixed(v) for v in D50) + bytes(48)
    return head + struct.pack(">I", len(parts) + 3) + table + body
