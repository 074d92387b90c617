"""Signature sniffing of media columns (operator 2).

An Aho-Corasick automaton over all magic byte strings finds every place in a blob where a medium might
begin, in one pass.  A validator for each format then confirms the structure there (lengths, checksums,
markers) and gives the medium's end.  What begins at offset 0 and fills the blob is the blob's true
type, whatever was declared; valid media further in are carved out.

No size is beyond a validator: what is compressed is inflated in constant memory.  Chains of parts are gone through
once a blob, end marks are listed once, so hostile blobs full of magic bytes cost linear time; the exceptions are
gzip members and RIFF forms begun over and over inside one another, each of which must be tried by itself.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, map_arrow, text_bytes

UNKNOWN = "application/octet-stream"
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


@dataclass(frozen=True)
class Medium:
    start: int
    end: int
    mime: str


class Blob:
    """A blob with what its validators look up more than once, so that many magics cost no more than one.

    ``ends`` keeps, for a format and a place in a chain of its parts, where the chain ends.
    """

    def __init__(self, raw: bytes):
        self.raw = raw
        self.ends: dict[tuple, int | None] = {}
        self._marks: dict[bytes, list[int]] = {}
        self._zips: dict[int, int] | None = None

    def marks(self, mark: bytes) -> list[int]:
        """All places of a mark, in order."""
        if mark not in self._marks:
            self._marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.raw)]
        return self._marks[mark]

    def next_mark(self, mark: bytes, at: int) -> int | None:
        found = self.marks(mark)
        k = bisect_left(found, at)
        return found[k] if k < len(found) else None

    def zips(self) -> dict[int, int]:
        """Start and end of the archives that end records tell of (the first to name a start)."""
        if self._zips is None:
            self._zips = {}
            for end in self.marks(b"PK\x05\x06"):
                if end + 22 <= len(self.raw):
                    size, offset, comment = struct.unpack_from("<IIH", self.raw, end + 12)
                    start = end - size - offset
                    sound = start >= 0 and (not size or self.raw[start + offset : start + offset + 4] == b"PK\x01\x02") and end + 22 + comment <= len(self.raw)
                    if sound:
                        self._zips.setdefault(start, end + 22 + comment)
        return self._zips

    def follow(self, kind: str, at: int, step: Callable[[int], tuple[int, bool] | None]) -> int | None:
        """The end of a chain of parts: ``step`` gives the next place and whether it is the end, None at a fault.

        A place is gone through once, however many chains lead to it.
        """
        path, end = [], None
        while True:
            if (kind, at) in self.ends:
                end = self.ends[kind, at]
                break
            path.append((kind, at))
            after = step(at)
            if after is None:
                break
            at, last = after
            if last:
                end = at
                break
        self.ends.update(dict.fromkeys(path, end))
        return end


def _png(blob: Blob, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    raw = blob.raw

    def chunk(pos: int) -> tuple[int, bool] | None:
        if pos + 12 > len(raw):
            return None
        end = pos + 12 + int.from_bytes(raw[pos : pos + 4], "big")
        if end > len(raw) or zlib.crc32(memoryview(raw)[pos + 4 : end - 4]) != int.from_bytes(raw[end - 4 : end], "big"):
            return None
        return end, raw[pos + 4 : pos + 8] == b"IEND"

    return blob.follow("png", at + 8, chunk) if raw[at + 12 : at + 16] == b"IHDR" else None


def _jpeg(blob: Blob, at: int) -> int | None:
    """Marker segments by their lengths, a frame among them, then scans up to EOI."""
    raw = blob.raw

    def segment(pos: int) -> tuple[int, bool] | None:
        while raw[pos : pos + 2] == b"\xff\xff":
            pos += 1
        if pos + 2 > len(raw) or raw[pos] != 0xFF:
            return None
        marker = raw[pos + 1]
        if marker == 0xD9:
            return pos + 2, True
        size = int.from_bytes(raw[pos + 2 : pos + 4], "big")
        if marker < 0xC0 or 0xD0 <= marker <= 0xD8 or size < 2 or pos + 2 + size > len(raw):
            return None
        pos += 2 + size
        if marker != 0xDA:
            return pos, False
        behind = _SCAN_END.search(raw, pos)  # neither a stuffed byte nor a restart
        return (behind.start(), False) if behind else None

    def framed(pos: int) -> tuple[int, bool] | None:
        while raw[pos : pos + 2] == b"\xff\xff":
            pos += 1
        if raw[pos + 1 : pos + 2] in (b"\xc0", b"\xc1", b"\xc2"):
            return pos, True
        after = segment(pos)
        return None if after is None or after[1] else after

    frame = blob.follow("jpeg before the frame", at + 2, framed)
    return None if frame is None else blob.follow("jpeg", frame, segment)


def _gif(blob: Blob, at: int) -> int | None:
    """Logical screen, colour tables, blocks with their sub-blocks, trailer."""
    raw = blob.raw

    def colours(flags: int) -> int:
        return 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def sub_block(pos: int) -> tuple[int, bool] | None:
        if pos >= len(raw):
            return None
        return pos + 1 + raw[pos], not raw[pos]

    def block(pos: int) -> tuple[int, bool] | None:
        kind = raw[pos : pos + 1]
        if kind == b"\x3b":
            return pos + 1, True
        if kind == b"\x21":
            pos += 2
        elif kind == b"\x2c" and pos + 10 < len(raw):
            pos += 11 + colours(raw[pos + 9])
        else:
            return None
        end = blob.follow("gif sub-blocks", pos, sub_block)
        return None if end is None else (end, False)

    return blob.follow("gif", at + 13 + colours(raw[at + 10]), block) if at + 13 <= len(raw) else None


def _bmp(blob: Blob, at: int) -> int | None:
    raw = blob.raw
    if at + 30 > len(raw):
        return None
    size, _, data, header = struct.unpack_from("<IIII", raw, at + 2)
    planes, bits = struct.unpack_from("<HH", raw, at + 26)
    sound = header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= data <= size
    return at + size if sound and at + size <= len(raw) else None


def _riff(blob: Blob, at: int) -> int | None:
    """RIFF chunks that fill the stated length exactly."""
    raw = blob.raw
    if at + 12 > len(raw) or raw[at + 8 : at + 12] not in _RIFF_TYPES:
        return None
    end = at + 8 + int.from_bytes(raw[at + 4 : at + 8], "little")
    if end > len(raw):
        return None

    def chunk(pos: int) -> tuple[int, bool] | None:
        if pos + 8 > end:
            return None
        size = int.from_bytes(raw[pos + 4 : pos + 8], "little")
        pos += 8 + size + (size & 1)
        return pos, pos in (end, end + 1)

    return end if blob.follow(f"riff up to {end}", at + 12, chunk) is not None else None


def _gzip(blob: Blob, at: int) -> int | None:
    """A whole member of any size: inflates, in constant memory, and its checksum and length agree."""
    raw = memoryview(blob.raw)
    if at + 18 > len(raw) or raw[at + 3] & 0xE0:
        return None
    inflate, pos, rest = zlib.decompressobj(31), at, b""
    try:
        while not inflate.eof:
            if not rest:
                if pos >= len(raw):
                    return None
                rest = raw[pos : pos + 65536]
                pos += len(rest)
            inflate.decompress(rest, 1 << 20)
            rest = inflate.unconsumed_tail
    except zlib.error:
        return None
    return pos - len(inflate.unused_data)


def _pdf(blob: Blob, at: int) -> int | None:
    """Up to the first end mark with a cross-reference pointer before it."""
    pointer = blob.next_mark(b"startxref", at)
    end = None if pointer is None else blob.next_mark(b"%%EOF", pointer + 9)
    return None if end is None else end + 5


def _zip(blob: Blob, at: int) -> int | None:
    """Up to the end record that names this place as its archive's start; archives may lie in archives."""
    return blob.zips().get(at)


def _pnm(blob: Blob, at: int) -> int | None:
    """Binary grey or RGB: width, height, maximum with blanks and comments between, then exactly that many samples."""
    raw = blob.raw

    def blank(pos: int) -> tuple[int, bool] | None:
        """Over blanks or one comment; the end is where something else starts."""
        kind = raw[pos : pos + 1]
        if kind == b"#":
            ends = [e for e in (blob.next_mark(b"\n", pos), blob.next_mark(b"\r", pos)) if e is not None]
            return (min(ends) + 1, False) if ends else None
        if kind.isspace():
            return _NOT_BLANK.match(raw, pos).end(), False
        return pos, True

    pos, values = at + 2, []
    for _ in range(3):
        before, pos = pos, blob.follow("pnm", pos, blank)
        digits = _DIGITS.match(raw, pos) if pos is not None and pos > before else None
        if digits is None:
            return None
        number = digits[0].lstrip(b"0") or b"0"
        if len(number) > 18:
            return None
        values.append(int(number))
        pos = digits.end()
    width, height, most = values
    if not 0 < most < 65536 or not width or not height or not raw[pos : pos + 1].isspace():
        return None
    end = pos + 1 + width * height * (3 if raw[at + 1] == 0x36 else 1) * (2 if most > 255 else 1)
    return end if end <= len(raw) else None


_SCAN_END = re.compile(rb"\xff(?![\x00\xd0-\xd7])(?=[\x00-\xff])", re.DOTALL)
_NOT_BLANK = re.compile(rb"[ \t-\r]*+")
_DIGITS = re.compile(rb"[0-9]++")
#: Magic bytes, type and validator (fixed values).
SIGNATURES: tuple[tuple[bytes, str, Callable[[Blob, int], int | None]], ...] = (
    (PNG_MAGIC, "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "", _riff),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"P5", "image/x-portable-graymap", _pnm),
    (b"P6", "image/x-portable-pixmap", _pnm),
)
#: Marks without which a type cannot end (fixed values); looked up once a blob.
END_MARKS = ((b"%%EOF", "application/pdf"), (b"PK\x05\x06", "application/zip"))
_RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


class Sniffer:
    def __init__(self) -> None:
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(SIGNATURES):
            self._automaton.add_word(magic.decode("latin-1"), k)
        self._automaton.make_automaton()

    def media(self, blob: bytes) -> list[Medium]:
        """All valid media that lie in no other one, in order."""
        whole, out, covered = Blob(blob), [], 0
        hopeless = {mime for mark, mime in END_MARKS if mark not in blob}
        for last, k in self._automaton.iter(blob.decode("latin-1")):
            magic, mime, valid = SIGNATURES[k]
            at = last - len(magic) + 1
            if at >= covered and mime not in hopeless and (end := valid(whole, at)) is not None:
                out.append(Medium(at, end, mime or _RIFF_TYPES[blob[at + 8 : at + 12]]))
                covered = end
        return out

    def kind(self, blob: bytes, media: list[Medium] | None = None) -> str:
        """The type of the whole blob: that of a medium which starts at 0, else unknown."""
        media = self.media(blob) if media is None else media
        return media[0].mime if media and media[0].start == 0 else UNKNOWN


def write_png(samples: bytes, width: int, level: int = 1) -> bytes:
    """8-bit grey PNG of ``len(samples) // width`` unfiltered rows."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), dtype=np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def read_grey_png(blob: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG with unfiltered rows, as ``write_png`` makes it."""
    pos, width, height, data = 8, 0, 0, []
    while pos < len(blob):
        size, kind = int.from_bytes(blob[pos : pos + 4], "big"), blob[pos + 4 : pos + 8]
        body = blob[pos + 8 : pos + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, lace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, lace) != (8, 0, 0):
                raise ValueError("not an 8-bit grey PNG without interlace")
        elif kind == b"IDAT":
            data.append(body)
        pos += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:]


_SNIFFERS: list[Sniffer] = []


def sniffer() -> Sniffer:
    if not _SNIFFERS:
        _SNIFFERS.append(Sniffer())
    return _SNIFFERS[0]


def sniff_media(df: DataFrame, id_col: str, blob_col: str, declared_col: str | None = None) -> DataFrame:
    """``id, declared, actual, corrected, media`` for a binary column.

    ``media`` lists all valid media in the blob (``start, end, mime``; end exclusive) with their bytes;
    those after the first that starts at 0 are embedded.  A null or empty blob is of unknown type and
    has no media; ``corrected`` is true when a declared type is not the actual one.
    """
    declared = F.col(f"`{declared_col}`").cast("string") if declared_col else F.lit(None).cast("string")
    picked = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{blob_col}`").cast("binary").alias("blob"), declared.alias("declared"))

    def make():
        own = sniffer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            actual, corrected, lists = [], [], []
            for blob, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                media = own.media(blob or b"")
                kind = own.kind(blob or b"", media)
                actual.append(kind)
                corrected.append(said is not None and said != kind)
                lists.append([{"start": m.start, "end": m.end, "mime": m.mime, "data": blob[m.start : m.end]} for m in media])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("mime", pa.string()), ("data", pa.binary())]))
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(actual, pa.string()), pa.array(corrected, pa.bool_()), pa.array(lists, kind)],
                names=["id", "declared", "actual", "corrected", "media"],
            )

        return step

    return map_arrow(picked, make, "id string, declared string, actual string, corrected boolean, media array<struct<start:bigint,end:bigint,mime:string,data:binary>>")


def text_media(df: DataFrame, block: int = 576, fill: int = 255, declared: str = UNKNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a grey PNG, sniff and read the stored bytes back, describe them.

    The payload is the UTF-8 text and ``fill`` up to a positive multiple of ``block``, so a null or
    empty text is one block of ``fill``.  ``feature`` holds the sniffed type, the size in samples, the
    count of carved media inside the payload, and the payload's 16-bin histogram in 1/255 of it.
    """

    def make():
        own = sniffer()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[] for _ in range(8)]
            for text in text_bytes(batch.column(1)):
                n = len(text)
                whole = max(1, -(-n // block)) * block
                stored = write_png(text + bytes([fill]) * (whole - n), block)
                first = next(iter(own.media(stored)), None)
                if first is None or (first.start, first.end, first.mime) != (0, len(stored), "image/png"):
                    raise ValueError("the stored form was not recognised")
                samples = read_grey_png(stored)
                payload = samples.tobytes()
                inside = own.media(payload)
                bins = np.bincount(samples.ravel() >> 4, minlength=16) * 255 // whole
                feature = f"{first.mime};{samples.shape[1]}x{samples.shape[0]};embedded={len(inside)};hist={bytes(bins.tolist()).hex()}"
                values = (n, whole, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, first.mime != declared)
                for row, value in zip(rows, values, strict=True):
                    row.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=names)

        return step

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "corrected"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected boolean"
    return map_arrow(df.select(*doc_text(id_col, text_col)), make, schema)
