r"""Secret scans by assignment-aware lexing (operator 7).

Two layers.  The base layer is three patterns (``assign``, ``access``, ``hex``).  The lexer (``lexer.py``) reads the
text as source or configuration and hands over name-value pairs; a value is made of literals, which are scored
by the target name's words, by whether they look random, and by length, and of names, which are followed
through the constants known by then, however many, to theirs.  What is found beyond the base spans is added:
``named`` for a literal of a sensitive target (in its value or, if the value is a call, among the arguments) and
``flow`` for one that reaches it through constants.  Code that is given as a value is never reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from . import lexer
from .common import doc_text, map_arrow, replace_text

#: The base patterns (fixed values).  A match of ``assign`` counts if its value has 6 characters.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A shorter run can hold no counting match, so the least lengths stand in the patterns themselves.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "named", "flow")

#: Words of sensitive target names with their scores (fixed values).
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "key": 0.5,
    "signature": 0.4, "salt": 0.4, "session": 0.3, "cookie": 0.3, "dsn": 0.6,
}

#: Without one of these a text has no sensitive target: a word of one in a name that is given something, or in a tag.
_TARGET = re.compile(rf"""(?:{"|".join(sorted(SENSITIVE))})[\w.$-]*+["'`]*+[\x20\t]*+(?::|=)|<[A-Za-z_][\w.:-]*""", re.IGNORECASE | re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(frozen=True)
class SecretParams:
    least_score: float = 0.8
    least_length: int = 6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Start, end (exclusive, code points) and kind; leftmost and not overlapping in each kind."""
    out = []
    folded = text.lower()
    if any(word in folded for word in ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return in_order(out)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def name_score(name: str) -> float:
    """How sensitive a target name is: the best of its words, neighbouring words taken together too."""
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = [a + b for a, b in zip(words, words[1:], strict=False)]
    found = [SENSITIVE[w] for w in words + joined if w in SENSITIVE]
    return min(1.0, max(found, default=0.0) + 0.3 * (len(found) > 1))


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks made up: its entropy in bits a character, digits mixed in."""
    if not value:
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return min(1.0, bits / 4.0) * (1.0 if mixed else 0.5) * min(1.0, n / 12.0)


def _sound(target: float, value: float, length: int, params: SecretParams) -> bool:
    return length >= params.least_length and target + value >= 1.0 + params.least_score / 2


class _Known:
    """What a constant holds: its own literals with their score, and the constants it is made from."""

    __slots__ = ("spans", "score", "length", "parts", "told")

    def __init__(self, spans: list[tuple[int, int]], value: str, parts: list[_Known]):
        self.spans, self.parts, self.told = spans, parts, False
        self.score = max([literal_score(value), *(p.score for p in parts)])
        self.length = max([len(value), *(p.length for p in parts)])

    def untold(self) -> list[tuple[int, int]]:
        """The literals in reach that were not handed out before."""
        out, open_ = [], [self]
        while open_:
            at = open_.pop()
            if not at.told:
                at.told = True
                out += at.spans
                open_ += at.parts
        return out


def lexed_spans(text: str, params: SecretParams = SecretParams()) -> list[tuple[int, int, str]]:
    """The literals of sensitive targets, direct (``named``) or through constants (``flow``).

    A target's constants are those assigned before it; names without one by then take the last one assigned behind.
    The parts of a value that is put together are scored together; constants of which a value is made, each by itself.
    """
    folded = text.lower()
    if not any(word in folded for word in SENSITIVE) or not _TARGET.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    known: dict[str, list[_Known]] = {}  # by name, the innermost block's last
    blocks: list[list[str]] = [[]]  # the names that each open block has given something
    late: list[tuple[float, str]] = []

    def look(name: str) -> _Known | None:
        held = known.get(name)
        return held[-1] if held else None

    for event in lexer.events(text):
        if event == "{":
            blocks.append([])
            continue
        if event == "}":
            if len(blocks) > 1:
                for name in blocks.pop():
                    known[name].pop()
            continue
        target = name_score(event.name)
        value = "".join(text[a:b] for a, b in event.literals)
        if target and event.literals and _sound(target, literal_score(value), len(value), params):
            found += [(a, b, "named") for a, b in event.literals]
        parts = []
        for name in event.names:
            held = look(name)
            if held is not None:
                parts.append(held)
                if target and _sound(target, held.score, held.length, params):
                    found += [(a, b, "flow") for a, b in held.untold()]
            elif target:
                late.append((target, name))
        if event.constant:  # a name that is given to itself keeps what it holds
            known.setdefault(event.name, []).append(_Known(event.literals, value, parts))
            blocks[-1].append(event.name)
        for a, b in event.arguments:
            if _sound(target, literal_score(text[a:b]), b - a, params):
                found.append((a, b, "named"))
    for target, name in late:
        held = look(name)
        if held is not None and _sound(target, held.score, held.length, params):
            found += [(a, b, "flow") for a, b in held.untold()]
    return found


def secret_spans(text: str, params: SecretParams = SecretParams()) -> list[tuple[int, int, str]]:
    """Base spans, and of the lexer's those that lie in no base span."""
    base = base_spans(text)
    more = lexed_spans(text, params)
    if base and more:
        starts = [s[0] for s in base]
        reach = list(accumulate((s[1] for s in base), max))
        more = [s for s in more if not (k := bisect_right(starts, s[0])) or reach[k - 1] < s[1]]
    return in_order(base + more)


def written_out(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(df: DataFrame, params: SecretParams = SecretParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row, null and empty texts having none; ``array<struct<start, end, kind>>``."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [[{"start": s, "end": e, "kind": k} for s, e, k in secret_spans(t, params)] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

        return step

    return map_arrow(df.select(*doc_text(id_col, text_col)), make, "doc_id long, spans array<struct<start:int,end:int,kind:string>>")


def secret_digests(df: DataFrame, params: SecretParams = SecretParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: counts of the base kinds, the base spans' digest, all spans written out."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[], [], [], [], []]
            for text in batch.column(1).to_pylist():
                spans = secret_spans(text, params)
                base = [s for s in spans if s[2] in KINDS[:3]]
                counts = [sum(s[2] == kind for s in base) for kind in KINDS[:3]]
                for row, value in zip(rows, (*counts, hashlib.sha256(written_out(base).encode()).hexdigest(), written_out(spans)), strict=True):
                    row.append(value)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

        return step

    return map_arrow(df.select(*doc_text(id_col, text_col)), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, params: SecretParams = SecretParams(), mark: str = "[SECRET]") -> str:
    out, at = [], 0
    for start, end, _ in secret_spans(text, params):
        if end > at:
            if start >= at:
                out += [text[at:start], mark]
            at = end
    return "".join(out) + text[at:]


def redact_secrets(df: DataFrame, params: SecretParams = SecretParams(), mark: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """Every span of a secret becomes ``mark`` (overlapping ones a single one); null texts stay null."""

    def make():
        return lambda texts: [None if t is None else redacted(t, params, mark) for t in texts]

    return replace_text(df, make, text_col)
