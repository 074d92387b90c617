"""The MQ binary arithmetic coder and decoder."""

from __future__ import annotations

#: Probability, next state after the more and the less probable symbol, and whether the sense flips (fixed values).
STATES = (
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0),
    (0x5601, 7, 6, 1), (0x5401, 8, 14, 0), (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0),
    (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0), (0x5101, 17, 15, 0), (0x4801, 18, 16, 0),
    (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0),
    (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0), (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0),
    (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0), (0x0049, 41, 38, 0), (0x0025, 42, 39, 0),
    (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
)


class Encoder:
    """Adaptive contexts are kept outside as ``[state, sense]`` pairs, so that they outlive a segment."""

    def __init__(self) -> None:
        self.a, self.c, self.ct = 0x8000, 0, 12
        self.out = bytearray(1)  # one byte before the first, which may take a carry of none

    def encode(self, context: list[int], bit: int) -> None:
        qe, up, down, flip = STATES[context[0]]
        self.a -= qe
        if bit == context[1]:
            if self.a & 0x8000:
                self.c += qe
                return
            if self.a < qe:
                self.a = qe
            else:
                self.c += qe
            context[0] = up
        else:
            if self.a < qe:
                self.c += qe
            else:
                self.a = qe
            context[1] ^= flip
            context[0] = down
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.ct -= 1
            if not self.ct:
                self._byte()

    def _byte(self) -> None:
        out = self.out
        if out[-1] != 0xFF and self.c >= 0x8000000:
            out[-1] += 1
            if out[-1] == 0xFF:
                self.c &= 0x7FFFFFF
        stuffed = out[-1] == 0xFF
        shift = 20 if stuffed else 19
        out.append(self.c >> shift & 0xFF)
        self.c &= (1 << shift) - 1
        self.ct = 7 if stuffed else 8

    @property
    def size(self) -> int:
        return len(self.out) - 1

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.ct
            self._byte()
        if self.out[-1] == 0xFF:
            self.out.pop()
        return bytes(self.out[1:])

    def finish_predictably(self) -> bytes:
        """Fills the last bytes in the one way that an error check expects."""
        left = 12 - self.ct
        while left > 0:
            self.c <<= self.ct
            self.ct = 0
            self._byte()
            left -= self.ct
        if self.out[-1] != 0xFF:  # a last carry may reach the byte; what would follow it is not part of the code
            self._byte()
            self.out.pop()
        if self.out[-1] == 0xFF:
            self.out.pop()
        return bytes(self.out[1:])


class Decoder:
    """Reads ones behind the end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        self.c = (data[0] if data else 0xFF) << 16
        self.ct = 0
        self._byte()
        self.c <<= 7
        self.ct -= 7
        self.a = 0x8000

    def _byte(self) -> None:
        data, at = self.data, self.at
        here = data[at] if at < len(data) else 0xFF
        after = data[at + 1] if at + 1 < len(data) else 0xFF
        if here == 0xFF:
            if after > 0x8F:
                self.c += 0xFF00
                self.ct = 8
            else:
                self.at += 1
                self.c += after << 9
                self.ct = 7
        else:
            self.at += 1
            self.c += after << 8
            self.ct = 8

    def decode(self, context: list[int]) -> int:
        qe, up, down, flip = STATES[context[0]]
        self.a -= qe
        if self.c >> 16 < qe:
            less = self.a >= qe
            self.a = qe
        else:
            self.c -= qe << 16
            if self.a & 0x8000:
                return context[1]
            less = self.a < qe
        bit = context[1] ^ less
        if less:
            context[1] ^= flip
            context[0] = down
        else:
            context[0] = up
        while not self.a & 0x8000:
            if not self.ct:
                self._byte()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.ct -= 1
        return int(bit)


class RawWriter:
    """Bits as they are; behind a byte of ones only seven follow."""

    def __init__(self) -> None:
        self.out, self.hold, self.left = bytearray(), 0, 8

    def write(self, bit: int) -> None:
        self.left -= 1
        self.hold |= bit << self.left
        if not self.left:
            self.out.append(self.hold)
            self.left = 7 if self.hold == 0xFF else 8
            self.hold = 0

    @property
    def size(self) -> int:
        return len(self.out)

    def finish(self) -> bytes:
        width = 7 if self.out[-1:] == b"\xff" else 8
        if self.left != width:
            # alternating fill, zero first
            bit = 0
            while self.left:
                self.left -= 1
                self.hold |= bit << self.left
                bit ^= 1
            self.out.append(self.hold)
        if self.out[-1:] == b"\xff":
            self.out.pop()
        return bytes(self.out)


class RawReader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.hold, self.left = data, 0, 0, 0

    def read(self) -> int:
        if not self.left:
            before = self.hold
            self.hold = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.left = 7 if before == 0xFF and self.at else 8
            self.at += 1
        self.left -= 1
        return self.hold >> self.left & 1
