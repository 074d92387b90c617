"""What every image format decodes to, and how a bad file is refused."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class FormatError(ValueError):
    """The file breaks its format, or uses a part of it that is not supported."""


def need(sound: bool, fault: str) -> None:
    if not sound:
        raise FormatError(fault)


@dataclass
class Plane:
    """One component; ``samples`` is a 2D array.  Steps and origins place it on the reference grid."""

    samples: np.ndarray
    precision: int = 8
    signed: bool = False
    x_step: int = 1
    y_step: int = 1
    x0: int = 0
    y0: int = 0
    x_registration: int = 0
    y_registration: int = 0

    def check(self) -> None:
        low, high = (-(1 << (self.precision - 1)), (1 << (self.precision - 1)) - 1) if self.signed else (0, (1 << self.precision) - 1)
        need(1 <= self.precision <= 38 and self.x_step > 0 and self.y_step > 0, "component layout")
        need(self.samples.ndim == 2 and self.samples.size > 0, "empty component")
        need(int(self.samples.min()) >= low and int(self.samples.max()) <= high, "sample out of range")


@dataclass
class Raster:
    planes: list[Plane]
    layout: str = "rgb"  # rgb, gray, graya, rgba, planar
    alpha_mode: str | None = None  # associated, unassociated
    white_is_zero: bool = False
    icc: bytes | None = None
    exif: bytes | None = None
    xmp: bytes | None = None
    iptc: bytes | None = None
    matrix: np.ndarray | None = None
    origin: tuple[int, int] = (0, 0)
    extra: dict[str, object] = field(default_factory=dict)

    @property
    def height(self) -> int:
        return self.planes[0].samples.shape[0]

    @property
    def width(self) -> int:
        return self.planes[0].samples.shape[1]

    @property
    def depth(self) -> int:
        return self.planes[0].precision

    def check(self) -> Raster:
        need(bool(self.planes), "no component")
        for plane in self.planes:
            plane.check()
        return self


LAYOUTS = {1: "gray", 2: "graya", 3: "rgb", 4: "rgba"}


def interleaved(samples: np.ndarray, depth: int, **more) -> Raster:
    """From ``height x width x components``."""
    planes = [Plane(np.ascontiguousarray(samples[:, :, k]).astype(np.int64), depth) for k in range(samples.shape[2])]
    return Raster(planes, LAYOUTS[len(planes)], **more).check()


def pixels(raster: Raster) -> np.ndarray:
    """``height x width x components``; all components must share one grid."""
    shape = raster.planes[0].samples.shape
    need(all(p.samples.shape == shape and p.precision == raster.depth and not p.signed for p in raster.planes), "components differ")
    return np.stack([p.samples for p in raster.planes], axis=2)
