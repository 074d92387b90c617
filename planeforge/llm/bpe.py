"""Byte-level BPE encoding and decoding by prefix dynamic programming (operator 4).

The BPE code of a byte string ends in exactly one token, so every prefix ``p[:i]`` of a string has
one *last token*.  Storing those gives the code of all prefixes at once: walk back from the end,
token by token.  ``t`` is the last token of ``p[:i]`` when ``p[:i]`` ends in the bytes of ``t`` and
``t`` stays a token of its own beside the last token of the rest.  Whether two neighbours stay
apart is decided from the merge table alone (``_apart``) and remembered.

Appending bytes only extends the table, exactly.  After an edit the entries before it stand, and
those behind it are computed anew until they agree with the old ones for as long as the longest
token; from there on the old entries are taken over.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import doc_text, map_arrow, text_bytes


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBpe:
    """Encoder over a rank file: every non-byte token is the merge of two tokens of lower rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.rank = ranks
        size = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks))
        self._left = list(range(size))
        self._right = list(range(size))
        self._merged: dict[tuple[int, int], int] = {}
        self._known: dict[tuple[int, int], bool] = {}
        for rank, token in enumerate(self.bytes_of):
            if len(token) > 1:
                for cut in range(1, len(token)):
                    a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                    if a is not None and b is not None and a < rank and b < rank and self._apart(a, b):
                        self._left[rank], self._right[rank] = a, b
                        self._merged[a, b] = rank
                        break
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            lengths.setdefault(token[-2:], set()).add(len(token))
        #: The lengths of the tokens that end in two given bytes, long ones first.
        self._tails = {tail: sorted(found, reverse=True) for tail, found in lengths.items() if len(tail) == 2}

    def _apart(self, a: int, b: int) -> bool:
        """True if the code of ``a``'s and ``b``'s bytes together is just ``a, b``.

        Undoes merges on both sides of the border, latest first.  The pair that faces the border
        at some moment must not have a merge that would have come before the one undone next.
        """
        bound = len(self.bytes_of) * 2
        while True:
            merge = self._merged.get((a, b))
            if merge is not None and merge < bound:
                return False
            a_whole, b_whole = self._right[a] == a, self._left[b] == b
            if a_whole and b_whole:
                return True
            if not a_whole and (b_whole or a > b):
                bound, a = a, self._right[a]
            else:
                bound, b = b + 1, self._left[b]

    def apart(self, a: int, b: int) -> bool:
        found = self._known.get((a, b))
        if found is None:
            if len(self._known) > 1_000_000:
                self._known.clear()
            found = self._known[a, b] = self._apart(a, b)
        return found

    def _last_token(self, data: bytes, end: int, last: list[int]) -> int:
        rank = self.rank
        if end > 1:
            for length in self._tails.get(data[end - 2 : end], ()):
                if length <= end:
                    token = rank.get(data[end - length : end])
                    if token is not None and (length == end or self.apart(last[end - length], token)):
                        return token
        return rank[data[end - 1 : end]]

    def last_tokens(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The table for ``data``; with ``last``, the table of a prefix, it is extended in place."""
        last = [-1] if last is None else last
        for end in range(len(last), len(data) + 1):
            last.append(self._last_token(data, end, last))
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        ids.reverse()
        return ids

    def encode(self, data: bytes) -> list[int]:
        whole = self.rank.get(data)
        return [whole] if whole is not None else self.walk(self.last_tokens(data))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixBuffer:
    """One growing piece of bytes whose code is at hand for every prefix."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data = bpe, data
        self.last = bpe.last_tokens(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.bpe.last_tokens(self.data, self.last)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Replace ``[start, end)``; returns how many entries had to be computed."""
        old, shift = self.last, len(data) - (end - start)
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[: start + 1]
        agree, done = 0, 0
        for at in range(start + 1, len(self.data) + 1):
            token = self.bpe._last_token(self.data, at, self.last)
            self.last.append(token)
            done += 1
            agree = agree + 1 if at - shift > end and at > start + len(data) and old[at - shift] == token else 0
            if agree >= self.bpe.longest:
                self.last += old[at - shift + 1 :]
                break
        return done

    def count(self, end: int | None = None) -> int:
        return len(self.ids(end))

    def ids(self, end: int | None = None) -> list[int]:
        return self.bpe.walk(self.last if end is None else self.last[: end + 1])


class TextCoder:
    """Whole texts: each match of the pattern is coded by itself; codes of pieces are kept.

    Ids are handled as their little-endian unsigned 32-bit bytes.  At most ``keep`` pieces stay.
    """

    def __init__(self, ranks_path: str, pattern: str, keep: int = 700_000):
        self.bpe = PrefixBpe(read_ranks(ranks_path))
        self.find = regex.compile(pattern).findall
        self.keep = keep
        self._codes: dict[str, bytes] = {}

    def _code(self, piece: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.bpe.encode(piece.encode()))

    def encode(self, text: str) -> bytes:
        codes = self._codes
        pieces = self.find(text)
        for piece in set(pieces).difference(codes):
            codes[piece] = self._code(piece)
        out = b"".join(map(codes.__getitem__, pieces))
        if len(codes) > self.keep:
            codes.clear()
        return out

    def decode(self, code: bytes) -> bytes:
        return self.bpe.decode(memoryview(code).cast("I"))


_CODERS: dict[tuple[str, str], TextCoder] = {}


def coder(ranks_path: str, pattern: str) -> TextCoder:
    """One coder for each worker process and vocabulary."""
    if (ranks_path, pattern) not in _CODERS:
        _CODERS[ranks_path, pattern] = TextCoder(ranks_path, pattern)
    return _CODERS[ranks_path, pattern]


def encode_texts(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, ids`` (ids as little-endian unsigned 32-bit bytes).

    Null and empty texts give no ids.  Equal texts give equal ids, repeated rows stay.
    """
    path, rule = _vocabulary(ranks_path, pattern)

    def make():
        code = coder(path, rule)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [code.encode(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

        return step

    return map_arrow(df.select(*doc_text(id_col, text_col)), make, "doc_id long, text string, ids binary")


def decode_ids(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, decoded`` (the bytes); null ids decode to no bytes."""
    path, rule = _vocabulary(ranks_path, pattern)

    def make():
        code = coder(path, rule)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [code.decode(x or b"") for x in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

        return step

    return map_arrow(df.select("doc_id", "ids"), make, "doc_id long, decoded binary")


def code_digests(df: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip``.

    Null and empty texts have no tokens and the digests of no bytes.
    """
    path, rule = _vocabulary(ranks_path, pattern)
    hexed = lambda data: hashlib.sha256(data).hexdigest()

    def make():
        code = coder(path, rule)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[], [], [], []]
            for text, raw in zip(batch.column(1).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids = code.encode(text)
                back = code.decode(ids)
                for row, value in zip(rows, (len(ids) // 4, hexed(ids), hexed(back), back == raw), strict=True):
                    row.append(value)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1]), pa.array(rows[2]), pa.array(rows[3], pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

        return step

    return map_arrow(df.select(*doc_text(id_col, text_col)), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def _vocabulary(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return ranks_path or default_ranks(), pattern
