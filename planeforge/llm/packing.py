"""Vector bin packing of token sequences (operator 1).

A sequence is a bin with three capacities: tokens, segments, and tokens that bear loss.  An example
is cut into parts that reach a capacity by themselves, and a rest.  What does not fill a bin waits in a pool of bounded
size.  A bin is filled by the dot-product heuristic: of the parts that fit, it takes the one with the largest dot
product of its vector (tokens, one segment, loss) and the bin's remaining capacities, all in units of the
capacities.  When none fits and room is left, the part of which most fits is cut to fill it.  A bin that
cannot be filled is cut to a power of two, and what is cut off goes back to the pool; so no sequence needs padding.

A plain document is taken as instruction data whose lines are turns: the first line is a prompt, the next one its answer,
and so on.  Ids of the even lines (counted from 0; an id belongs to the line it begins in) bear no loss, those of the
odd lines do.

Each task packs the documents it reads.  There is no shuffle, a task holds ``pool`` rests at most,
and a task that is run again gives the same sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, lean

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 32
    loss: int = 640


@dataclass
class Rest:
    """A part of a document; ``bears`` marks the tokens that bear loss (None: all do)."""

    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    bears: np.ndarray | None = None

    @property
    def loss(self) -> int:
        return len(self.ids) if self.bears is None else int(np.count_nonzero(self.bears))

    @property
    def lead(self) -> int:
        """How many ids from the start on bear no loss."""
        if self.bears is None:
            return 0
        first = int(self.bears.argmax())
        return first if self.bears[first] else len(self.ids)

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest prefix within both limits."""
        most = min(tokens, len(self.ids))
        if self.bears is None:
            return min(most, loss)
        return int(np.searchsorted(np.cumsum(self.bears[:most]), loss, side="right"))

    def cut(self, at: int) -> tuple[Rest, Rest]:
        parts = (None, None) if self.bears is None else (self.bears[:at], self.bears[at:])
        return (
            Rest(self.doc, self.start, self.ids[:at], self.doc_tokens, parts[0]),
            Rest(self.doc, self.start + at, self.ids[at:], self.doc_tokens, parts[1]),
        )


@dataclass
class VectorPacker:
    limits: Limits
    pool: int = 1024
    first_id: int = 0
    rows: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._items: list[Rest | None] = []
        self._size = np.zeros((0, 2))
        self._lead = np.zeros(0)
        self._free: list[int] = []
        self._n = 0
        self._next = self.first_id

    def add(self, rest: Rest) -> None:
        """Cut where a capacity is reached; bins are filled while the pool holds too many."""
        limits = self.limits
        while len(rest.ids):
            part, rest = rest.cut(rest.fitting(limits.tokens, limits.loss))
            if len(part.ids) == limits.tokens:
                self._emit([part])
                continue
            self._keep(part)
            while self._n > self.pool:
                self._fill()

    def finish(self) -> None:
        while self._n:
            self._fill()

    def take_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def _keep(self, rest: Rest) -> None:
        if not self._free:
            at = len(self._items)
            self._items += [None] * 256
            self._size = np.vstack([self._size, np.full((256, 2), np.inf)])
            self._lead = np.r_[self._lead, np.zeros(256)]
            self._free = list(range(at + 255, at - 1, -1))
        at = self._free.pop()
        self._items[at] = rest
        self._size[at] = len(rest.ids), rest.loss
        self._lead[at] = rest.lead
        self._n += 1

    def _drop(self, at: int) -> Rest:
        rest = self._items[at]
        self._items[at] = None
        self._size[at] = np.inf
        self._free.append(at)
        self._n -= 1
        return rest

    def _choose(self, left: np.ndarray, segments: int) -> int | None:
        limits = self.limits
        fits = (self._size[:, 0] <= left[0]) & (self._size[:, 1] <= left[1])
        if not fits.any():
            return None
        gain = self._size @ (left / np.square([limits.tokens, limits.loss]))
        gain += segments / limits.segments**2
        gain[~fits] = -1.0
        return int(gain.argmax())

    def _fill(self) -> None:
        limits, inside = self.limits, []
        left, segments = np.array([limits.tokens, limits.loss], dtype=float), limits.segments
        while self._n and segments and left[0]:
            at = self._choose(left, segments)
            if at is not None:
                rest = self._drop(at)
            else:
                # at least so many ids of each part fit
                sure = np.minimum(np.minimum(self._size[:, 0], left[0]), self._lead + left[1])
                at = int(np.where(np.isfinite(self._size[:, 0]), sure, -1).argmax())
                fitting = self._items[at].fitting(int(left[0]), int(left[1]))
                if not fitting:
                    break
                rest, behind = self._drop(at).cut(fitting)
                self._keep(behind)
            inside.append(rest)
            left -= len(rest.ids), rest.loss
            segments -= 1
        used = int(limits.tokens - left[0])
        over = used - _power(used) if used < limits.tokens else 0
        while over:
            rest = inside.pop()
            if len(rest.ids) > over:
                rest, behind = rest.cut(len(rest.ids) - over)
                inside.append(rest)
                over = 0
            else:
                behind, over = rest, over - len(rest.ids)
            self._keep(behind)
        self._emit(inside)

    def _emit(self, inside: list[Rest]) -> None:
        offset = 0
        for rest in inside:
            ids = np.ascontiguousarray(rest.ids, dtype="<u4")
            self.rows.append((rest.doc, rest.start, len(ids), zlib.crc32(ids), rest.doc_tokens, self._next, offset, rest.loss))
            offset += len(ids)
        self._next += 1


def _power(n: int) -> int:
    """The largest power of two up to ``n``."""
    return 1 << (n.bit_length() - 1)


class VocabularyEncoder:
    """Ids of a tokenizer file (a byte-level BPE), as the tokenizers library gives them by default.

    Strings of the file's added tokens become these tokens' ids.  A test compares with the library; the merges of
    the same file run in tiktoken, which is several times faster on whole texts.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        added = found.get("added_tokens", [])
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on what is around them are not known here")
        special = {x["content"]: x["id"] for x in added}
        plain = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
        others = (b for b in range(256) if b not in plain)
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(map(letters.__getitem__, token)): rank for token, rank in found["model"]["vocab"].items() if token not in special}
        self._special = tuple(special)
        #: Line breaks in each token.
        self._breaks = np.zeros(1 + max([*ranks.values(), *special.values()]), dtype=np.int32)
        for token, rank in ranks.items():
            self._breaks[rank] = token.count(b"\n")
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if any(x in text for x in self._special):
            return np.array(self._encoding.encode(text, allowed_special="all"), dtype=np.uint32)
        return np.array(self._encoding.encode_ordinary(text), dtype=np.uint32)

    def odd_lines(self, ids: np.ndarray) -> np.ndarray:
        """Which ids begin in an odd line."""
        breaks = self._breaks[ids]
        return (np.cumsum(breaks) - breaks) % 2 == 1


_ENCODERS: dict[tuple[str, str], VocabularyEncoder] = {}


def _encoder(path: str, pattern: str) -> VocabularyEncoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = VocabularyEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def _output(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in zip(*rows, strict=True)], names=names)


def pack_documents(
    df: DataFrame,
    tokenizer_path: str | None = None,
    limits: Limits = Limits(),
    end_id: int = 0,
    pool: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack whole texts; returns the pieces (``PIECES``), every id in exactly one of them.

    A document is its ids and ``end_id``, so null and empty texts are one id long, which bears no loss.  Repeated rows are packed as often as they occur.  No rows: no pieces.
    """
    import public_tokenizers

    path, pattern = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        packer = VectorPacker(limits, pool, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], dtype=np.uint32)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encoder.ids(text), end]) if text else end
                packer.add(Rest(doc, 0, ids, len(ids), encoder.odd_lines(ids)))
            if len(packer.rows) > 20_000:
                yield _output(packer.take_rows())
        packer.finish()
        if packer.rows:
            yield _output(packer.take_rows())

    return df.select(*doc_text(id_col, text_col)).mapInArrow(lean(run), PIECES)


def pack_examples(df: DataFrame, limits: Limits = Limits(), pool: int = 1024) -> DataFrame:
    """Pack instruction examples given as ``doc_id long, ids array<int>, bears array<boolean>``.

    ``bears`` marks the tokens that bear loss; null (or null entries): all (none) of them do.  Null or
    empty ids give no piece.  ``bears`` must be as long as ``ids``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = VectorPacker(limits, pool, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, ids, bears in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if ids:
                    if bears is not None and len(bears) != len(ids):
                        raise ValueError(f"document {doc}: {len(ids)} ids and {len(bears)} loss marks")
                    marks = None if bears is None else np.array([bool(x) for x in bears])
                    packer.add(Rest(doc, 0, np.array(ids, dtype=np.uint32), len(ids), marks))
            if len(packer.rows) > 20_000:
                yield _output(packer.take_rows())
        packer.finish()
        if packer.rows:
            yield _output(packer.take_rows())

    shaped = df.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"), F.col("bears").cast("array<boolean>"))
    return shaped.mapInArrow(lean(run), PIECES)


def pack_conversations(df: DataFrame, tokenizer_path: str | None = None, limits: Limits = Limits(), end_id: int = 0, trained_roles: tuple[str, ...] = ("assistant",), pool: int = 1024) -> DataFrame:
    """Pack conversations (``conv_id, turn, role, text``): a turn is its ids and ``end_id``.

    A turn is a segment of its own that may share a sequence with others; only turns of
    ``trained_roles`` bear loss.  ``doc_id`` is the conversation, ``start`` counts within the turn.
    Turns with null text are one id long; a null role is not trained.
    """
    import public_tokenizers

    path, pattern = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        packer = VectorPacker(limits, pool, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = np.append(encoder.ids(text), np.uint32(end_id)) if text else np.array([end_id], dtype=np.uint32)
                packer.add(Rest(doc, 0, ids, len(ids), None if role in trained_roles else np.zeros(len(ids), dtype=bool)))
            if len(packer.rows) > 20_000:
                yield _output(packer.take_rows())
        packer.finish()
        if packer.rows:
            yield _output(packer.take_rows())

    shaped = df.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return shaped.mapInArrow(lean(run), PIECES)
