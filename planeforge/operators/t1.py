"""Bit-plane coding of one code block: three passes a plane over stripes of four rows.

Sequential by nature, so a block is a unit of work: blocks are coded in parallel, each by itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .mq import Decoder, Encoder, RawReader, RawWriter

BYPASS, RESET, TERMINATE, CAUSAL, PREDICTABLE, SEGMENTED = 1, 2, 4, 8, 16, 32
RUN, UNIFORM = 17, 18
SIGNIFICANCE, REFINEMENT, CLEANUP = "significance", "refinement", "cleanup"


def _zero_context(kind: str, h: int, v: int, d: int) -> int:
    if kind == "HH":
        s = h + v
        if d >= 3:
            return 8
        if d == 2:
            return 7 if s else 6
        if d == 1:
            return 3 + min(s, 2)
        return min(s, 2)
    if kind == "HL":
        h, v = v, h
    if h == 2:
        return 8
    if h == 1:
        return 7 if v else 6 if d else 5
    return 2 + v if v else min(d, 2)


#: Context by ``15 h + 5 v + d`` for each kind of band, from the rule above.
ZERO = {kind: [_zero_context(kind, k // 15, k // 5 % 3, k % 5) for k in range(45)] for kind in ("LL", "HL", "LH", "HH")}


def sign_coding(h: int, v: int) -> tuple[int, int]:
    """Context and predicted bit from contributions in -1..1."""
    flip = int(h < 0 or (h == 0 and v < 0))
    if flip:
        h, v = -h, -v
    return (12 + v if h else 9 + v), flip


#: Sign coding by summed contributions of a row and a column, each in -2..2.
SIGNS = [[sign_coding(max(-1, min(1, h)), max(-1, min(1, v))) for v in range(-2, 3)] for h in range(-2, 3)]


def fresh_contexts() -> list[list[int]]:
    out = [[0, 0] for _ in range(19)]
    out[0][0], out[RUN][0], out[UNIFORM][0] = 4, 3, 46
    return out


def pass_kind(index: int) -> str:
    return (CLEANUP, SIGNIFICANCE, REFINEMENT)[index % 3]


def pass_plane(planes: int, index: int) -> int:
    return planes - 1 - (index + 2) // 3


def is_raw(index: int, style: int) -> bool:
    return bool(style & BYPASS) and index >= 10 and index % 3 != 0


def ends_segment(index: int, count: int, style: int) -> bool:
    if index == count - 1 or style & TERMINATE:
        return True
    return bool(style & BYPASS) and index >= 9 and index % 3 != 1


def segment_passes(count: int, style: int) -> list[int]:
    """Passes of each terminated segment."""
    out, n = [], 0
    for k in range(count):
        n += 1
        if ends_segment(k, count, style):
            out.append(n)
            n = 0
    return out


@dataclass
class CodedBlock:
    planes: int
    payload: bytes = b""
    passes: int = 0
    segments: list[tuple[int, int]] = field(default_factory=list)  # passes, bytes
    cum_bytes: list[int] = field(default_factory=list)  # a length that holds each pass
    gains: list[float] = field(default_factory=list)  # squared error that each pass takes away


class _Field:
    """Significance, signs and marks of a block with a border of one.

    ``near`` holds ``15 h + 5 v + d`` of each sample's significant neighbours; a sample that becomes
    significant adds itself to its eight, which is rarer than asking for them.
    """

    def __init__(self, height: int, width: int, kind: str, style: int):
        self.h, self.w, self.step = height, width, width + 2
        n = (height + 2) * self.step
        self.sig, self.chi, self.seen, self.refined, self.near = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        self.zero, self.causal = ZERO[kind], bool(style & CAUSAL)

    def sign(self, at: int, y: int) -> tuple[int, int]:
        c, w = self.chi, self.step
        h = c[at - 1] + c[at + 1]
        v = c[at - w] + (0 if self.causal and y & 3 == 3 else c[at + w])
        return SIGNS[h + 2][v + 2]

    def set(self, at: int, y: int, negative: int) -> None:
        self.sig[at] = 1
        self.chi[at] = -1 if negative else 1
        near, up, down = self.near, at - self.step, at + self.step
        near[at - 1] += 15
        near[at + 1] += 15
        near[down] += 5
        near[down - 1] += 1
        near[down + 1] += 1
        if not (self.causal and y & 3 == 0):  # the stripe above does not look down
            near[up] += 5
            near[up - 1] += 1
            near[up + 1] += 1

    def order(self):
        """Places in scan order: stripes of four rows, column by column."""
        for top in range(0, self.h, 4):
            rows = range(top, min(top + 4, self.h))
            for x in range(self.w):
                for y in rows:
                    yield y, x, (y + 1) * self.step + x + 1


class _Coder:
    """What both directions share; ``_bit`` codes or reads a decision."""

    def __init__(self, height: int, width: int, kind: str, style: int):
        self.f, self.style = _Field(height, width, kind, style), style
        self.contexts = fresh_contexts()
        self.places = list(self.f.order())

    # the two directions differ in these
    def _bit(self, context: int, at: int, plane: int, known: int | None = None) -> int:
        raise NotImplementedError

    def _raw(self, at: int, plane: int) -> int:
        raise NotImplementedError

    def _negative(self, at: int, context: int | None, flip: int) -> int:
        raise NotImplementedError

    def _became(self, at: int, plane: int) -> None:
        raise NotImplementedError

    def _refine(self, at: int, plane: int, context: int | None) -> None:
        raise NotImplementedError

    def _signed(self, at: int, y: int, plane: int, raw: bool) -> None:
        negative = self._negative(at, None, 0) if raw else self._negative(at, *self.f.sign(at, y))
        self.f.set(at, y, negative)
        self._became(at, plane)

    def significance(self, plane: int, raw: bool) -> None:
        f = self.f
        sig, near, seen, zero = f.sig, f.near, f.seen, f.zero
        for y, _, at in self.places:
            if near[at] and not sig[at]:
                if self._raw(at, plane) if raw else self._bit(zero[near[at]], at, plane):
                    self._signed(at, y, plane, raw)
                seen[at] = 1

    def refinement(self, plane: int, raw: bool) -> None:
        f = self.f
        sig, near, seen, refined = f.sig, f.near, f.seen, f.refined
        for _, _, at in self.places:
            if sig[at] and not seen[at]:
                self._refine(at, plane, None if raw else 16 if refined[at] else 15 if near[at] else 14)
                refined[at] = 1

    def cleanup(self, plane: int) -> None:
        f, skip = self.f, 0
        sig, near, seen, zero, step, last = f.sig, f.near, f.seen, f.zero, f.step, f.h - 4
        for y, _, at in self.places:
            if skip:
                skip -= 1
                continue
            if not y & 3 and y <= last:
                column = (at, at + step, at + 2 * step, at + 3 * step)
                # four samples without a significant one in or around them, none coded in this plane
                if not any([sig[c] or near[c] or seen[c] for c in column]):
                    first = self._run(column, plane)
                    if first is not None:
                        self._signed(column[first], y + first, plane, False)
                        for k in range(first + 1, 4):
                            self._clean(column[k], y + k, plane)
                    skip = 3
                    continue
            if not sig[at] and not seen[at] and self._bit(zero[near[at]], at, plane):
                self._signed(at, y, plane, False)
        f.seen = [0] * len(seen)
        if self.style & SEGMENTED:
            self._marks()

    def _clean(self, at: int, y: int, plane: int) -> None:
        f = self.f
        if not f.sig[at] and not f.seen[at] and self._bit(f.zero[f.near[at]], at, plane):
            self._signed(at, y, plane, False)

    def _run(self, column: list[int], plane: int) -> int | None:
        raise NotImplementedError

    def _marks(self) -> None:
        raise NotImplementedError


class _Writer(_Coder):
    def __init__(self, block: np.ndarray, kind: str, style: int):
        super().__init__(*block.shape, kind, style)
        padded = np.zeros((block.shape[0] + 2, block.shape[1] + 2), dtype=np.int64)
        padded[1:-1, 1:-1] = block
        self.mag, self.neg = np.abs(padded).ravel().tolist(), (padded < 0).ravel().tolist()
        self.mq, self.raw, self.gain = Encoder(), RawWriter(), 0.0

    def _bit(self, context, at, plane, known=None):
        bit = self.mag[at] >> plane & 1 if known is None else known
        self.mq.encode(self.contexts[context], bit)
        return bit

    def _raw(self, at, plane):
        bit = self.mag[at] >> plane & 1
        self.raw.write(bit)
        return bit

    def _negative(self, at, context, flip):
        negative = int(self.neg[at])
        if context is None:
            self.raw.write(negative)
        else:
            self.mq.encode(self.contexts[context], negative ^ flip)
        return negative

    def _error(self, at: int, plane: int) -> float:
        """Squared error when the planes down to ``plane`` are known."""
        low = self.mag[at] >> plane << plane
        return (self.mag[at] - (low + (1 << plane) / 2)) ** 2 if low else float(self.mag[at] ** 2)

    def _became(self, at, plane):
        self.gain += self.mag[at] ** 2 - self._error(at, plane)

    def _refine(self, at, plane, context):
        bit = self.mag[at] >> plane & 1
        if context is None:
            self.raw.write(bit)
        else:
            self.mq.encode(self.contexts[context], bit)
        self.gain += self._error(at, plane + 1) - self._error(at, plane)

    def _run(self, column, plane):
        first = next((k for k, at in enumerate(column) if self.mag[at] >> plane & 1), None)
        self.mq.encode(self.contexts[RUN], int(first is not None))
        if first is not None:
            self.mq.encode(self.contexts[UNIFORM], first >> 1)
            self.mq.encode(self.contexts[UNIFORM], first & 1)
        return first

    def _marks(self):
        for bit in (1, 0, 1, 0):
            self.mq.encode(self.contexts[UNIFORM], bit)


def encode_block(block: np.ndarray, kind: str = "LL", style: int = 0) -> CodedBlock:
    """All passes of a block; an all-zero block has none."""
    top = int(np.abs(block).max()) if block.size else 0
    planes = top.bit_length()
    out = CodedBlock(planes)
    if not planes:
        return out
    coder = _Writer(block, kind, style)
    count, parts, done, passes = 3 * planes - 2, [], 0, 0
    for k in range(count):
        plane, raw = pass_plane(planes, k), is_raw(k, style)
        coder.gain = 0.0
        if pass_kind(k) == SIGNIFICANCE:
            coder.significance(plane, raw)
        elif pass_kind(k) == REFINEMENT:
            coder.refinement(plane, raw)
        else:
            coder.cleanup(plane)
        out.gains.append(coder.gain)
        passes += 1
        if ends_segment(k, count, style):
            data = coder.raw.finish() if raw else coder.mq.finish_predictably() if style & PREDICTABLE else coder.mq.finish()
            parts.append(data)
            done += len(data)
            out.segments.append((passes, len(data)))
            out.cum_bytes.append(done)
            coder.mq, coder.raw, passes = Encoder(), RawWriter(), 0
        else:
            # the coder still holds up to four bytes of what it has taken
            out.cum_bytes.append(done + (coder.raw.size + 1 if raw else coder.mq.size + 4))
        if style & RESET:
            coder.contexts = fresh_contexts()
    out.payload, out.passes = b"".join(parts), count
    ends, at, whole = [], 0, 0
    for n, size in out.segments:
        at, whole = at + n, whole + size
        ends += [whole] * n
    out.cum_bytes = [min(a, b) for a, b in zip(out.cum_bytes, ends, strict=True)]
    out.cum_bytes = np.maximum.accumulate(out.cum_bytes).tolist()
    return out


class _Reader(_Coder):
    def __init__(self, height: int, width: int, kind: str, style: int):
        super().__init__(height, width, kind, style)
        self.mag, self.low = [0] * len(self.f.sig), [0] * len(self.f.sig)
        self.mq: Decoder | None = None
        self.raw: RawReader | None = None

    def _bit(self, context, at, plane, known=None):
        return self.mq.decode(self.contexts[context])

    def _raw(self, at, plane):
        return self.raw.read()

    def _negative(self, at, context, flip):
        return self.raw.read() if context is None else self.mq.decode(self.contexts[context]) ^ flip

    def _became(self, at, plane):
        self.mag[at] = 1 << plane
        self.low[at] = plane

    def _refine(self, at, plane, context):
        bit = self.raw.read() if context is None else self.mq.decode(self.contexts[context])
        self.mag[at] |= bit << plane
        self.low[at] = plane

    def _run(self, column, plane):
        if not self.mq.decode(self.contexts[RUN]):
            return None
        return self.mq.decode(self.contexts[UNIFORM]) * 2 + self.mq.decode(self.contexts[UNIFORM])

    def _marks(self):
        if [self.mq.decode(self.contexts[UNIFORM]) for _ in range(4)] != [1, 0, 1, 0]:
            raise ValueError("segmentation mark")


def decode_block(payload: bytes, segments: list[tuple[int, int]], planes: int, height: int, width: int, kind: str = "LL", style: int = 0, most_passes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients, and for each the lowest plane that is known; ``segments`` are (passes, bytes) so far.

    With ``most_passes`` the passes behind it are left out.
    """
    coder = _Reader(height, width, kind, style)
    k, at = 0, 0
    for passes, size in segments:
        data = payload[at : at + size]
        at += size
        if passes:
            if is_raw(k, style):
                coder.raw = RawReader(data)
            else:
                coder.mq = Decoder(data)
        for _ in range(passes):
            if most_passes is not None and k >= most_passes:
                break
            plane, raw = pass_plane(planes, k), is_raw(k, style)
            if plane < 0:
                raise ValueError("more passes than bit planes")
            if pass_kind(k) == SIGNIFICANCE:
                coder.significance(plane, raw)
            elif pass_kind(k) == REFINEMENT:
                coder.refinement(plane, raw)
            else:
                coder.cleanup(plane)
            if style & RESET:
                coder.contexts = fresh_contexts()
            k += 1
    shape = (height + 2, width + 2)
    sign = np.array(coder.f.chi).reshape(shape)[1:-1, 1:-1]
    return np.array(coder.mag, dtype=np.int64).reshape(shape)[1:-1, 1:-1] * sign, np.array(coder.low).reshape(shape)[1:-1, 1:-1]
