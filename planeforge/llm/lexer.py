r"""Assignments in source and configuration syntax, for secret scans (operator 7).

One pass from left to right.  It knows strings in single, double, back and triple quotes with escapes and prefixes,
comments (``#``, ``//``, ``/* */``, ``<!-- -->``), braces, parentheses, XML elements, and what joins a name to a value:
``=``, ``:=``, ``=>``, ``:`` (also with a type between: ``name: str = ...``).  A value is one or more literals and names
that follow each other or are joined by ``+``, ``.``, ``..``, ``&`` or ``||``.

An unquoted word is a literal if it cannot be code: it holds a digit and is no dotted path of short names, or it is all of
a ``name = word`` line.  Otherwise it is a name, or, before ``(`` or ``[``, a call or subscript, whose string arguments are
handed over by themselves.  Inside comments and strings pairs are found too, but name no constants.

Every character is looked at a bounded number of times.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

Span = tuple[int, int]


@dataclass
class Pair:
    """``name`` is given ``literals`` (spans, without quotes) and ``names``; ``arguments``: literals handed to calls in its value.

    ``constant``: whether it names something that may be used further on.
    """

    name: str
    literals: list[Span] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    arguments: list[Span] = field(default_factory=list)
    constant: bool = False


_COMMENT = r"""(?P<line>(?:(?<=\s)|^)\#[^\n]*+|(?:(?<=[\s;{}(),])|^)//[^\n]*+)|(?P<block>/\*|<!--)|"""
_PLAIN = (
    r"""(?P<string>(?:(?<![\w])[rRbBuUfF]{1,2}(?=["'])|(?<![\w](?=')))(?:\"{3}|'{3}|["'`]))"""
    r"""|(?P<name>(?:(?<![\w.$-])|(?<=--))[A-Za-z_$][\w.$-]*+)[\x20\t]*+(?P<join>:=|=>|=(?!=)|:(?![:/]))"""
    r"""|(?P<tag><[A-Za-z_][\w.:-]*+[^<>\n]*+>)"""
    r"""|(?P<mark>[{}()]|\n[\x20\t]*\n)"""
)
#: What is looked for in a text, and inside its comments and strings.
_EVENT, _EVENT_INSIDE = (re.compile(x, re.ASCII | re.MULTILINE) for x in (_COMMENT + _PLAIN, _PLAIN))
_JOIN = re.compile(r"[\x20\t]*+(?P<join>:=|=>|=(?!=)|:(?![:/]))")
_TYPED = re.compile(r"[\x20\t]*+&?(?P<type>[A-Za-z_][\w.]*+)(?:\[[\w.,|\x20]*+\]|<[\w.,|\x20]*+>)?(?:\x20*+\|\x20*+[\w.]++)*+[\x20\t]*+=(?![=>])[\x20\t]*+", re.ASCII)
_LEAD = re.compile(r"(?:[\x20\t]|\\\r?\n|(?P<paren>\((?:[\x20\t]|\r?\n)*+))*+")
_STRING = re.compile(r"""(?:[rRbBuUfF]{1,2}(?=["']))?(?P<quote>\"{3}|'{3}|["'`])""")
_BARE = re.compile(r"""(?:\$\{[^}\s]*+\}|[^\s"'`,;()\[\]{}<>\\=&])++(?:={1,2}(?![\w=]))?""", re.ASCII)
_PLUS = re.compile(r"""[\x20\t]*+(?:(?:\+|\|\||\.\.|[.&](?=[\x20\t]))[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?(?=["'`A-Za-z_$])|(?=["'`]))""")
_NEXT_LINE = re.compile(r"""(?:[\x20\t]|\r?\n)*+(?:\+[\x20\t]*+)?(?=["'`])""")
_INSIDE = {'"': re.compile(r'[^"\\\n]*+(?:\\.[^"\\\n]*+)*+', re.DOTALL), "'": re.compile(r"[^'\\\n]*+(?:\\.[^'\\\n]*+)*+", re.DOTALL), "`": re.compile(r"[^`\\\n]*+(?:\\.[^`\\\n]*+)*+", re.DOTALL)}
_PATH = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)+(?:\.)?", re.ASCII)
_NAME = re.compile(r"[A-Za-z_$][\w.$-]*", re.ASCII)
_LINE_END = re.compile(r"[\x20\t]*+(?:,[\x20\t]*+)?(?:\#[^\n]*+)?(?:\r?\n|$)")
_LINE_START = re.compile(r"""[\x20\t]*+(?:(?:export|set|ENV|-)\x20++)?""")
#: Strings in strings and comments are taken apart so deep; deeper ones are read with what is around them.
_DEPTH = 3
#: A path with so long a part that holds a digit is a literal (a signed token, say).
_LONG_PART = 16


class _Text:
    def __init__(self, text: str, level: int = 0):
        self.text, self.level = text, level
        self.depth, self.assigned = 0, set()
        self._spent: dict[str, int] = {}
        self._line, self._seen, self._alone = 0, 0, False

    def string(self, at: int) -> tuple[Span, int] | None:
        """The inside and the end of the string literal that starts at ``at``; None if it is not closed."""
        text, m = self.text, _STRING.match(self.text, at)
        if not m:
            return None
        quote, start = m["quote"], m.end()
        if self._spent.get(quote, -1) > at:  # an opening before this one found no end up to there
            return self._string_of(quote[0], start - 2) if len(quote) == 3 else None
        if len(quote) == 3:
            end = text.find(quote, start)
            if end < 0:
                self._spent[quote] = len(text)
                return self._string_of(quote[0], start - 2)
            return (start, end), end + 3
        return self._string_of(quote, start)

    def _string_of(self, quote: str, start: int) -> tuple[Span, int] | None:
        end = _INSIDE[quote].match(self.text, start).end()
        if self.text[end : end + 1] == quote:
            return (start, end), end + 1
        self._spent[quote] = end
        return None

    def _literal(self, word: str, end: int) -> bool:
        """Whether an unquoted word is a literal and not code."""
        if self.text[end : end + 1] in ("(", "["):
            return False
        if _PATH.fullmatch(word):
            return any(len(part) >= _LONG_PART and any(c.isdigit() for c in part) for part in word.split("."))
        if word.startswith(("$", "&", "*", "@", "%")) or "://" in word[:12]:
            return False
        if any(c.isdigit() for c in word):
            return True
        return self._alone and _LINE_END.match(self.text, end) is not None

    def value(self, at: int, pair: Pair) -> tuple[int, bool]:
        """Reads a value into ``pair``; where to go on, and whether the value is a call."""
        text = self.text
        lead = _LEAD.match(text, at)
        paren, at = lead["paren"] is not None, lead.end()
        if paren:
            self.depth += text.count("(", lead.start(), at)
        while True:
            if string := self.string(at):
                pair.literals.append(string[0])
                at = string[1]
            elif bare := _BARE.match(text, at):
                word, end = bare[0], bare.end()
                while end - at > 1 and word[-1] in ".:!?":
                    word, end = word[:-1], end - 1
                if text[end : end + 1] == "(":
                    return end, True
                plain = word.removeprefix("${").removesuffix("}").lstrip("$")
                if _NAME.fullmatch(plain):
                    pair.names.append(plain)
                if plain not in self.assigned and self._literal(word, end):
                    pair.literals.append((at, end))
                if self._joins(plain, end):  # ``a=b=c`` and the like: the word is a target itself
                    return at, False
                at = end
            else:
                return at, False
            more = _PLUS.match(text, at) or (_NEXT_LINE.match(text, at) if paren else None)
            if not more or not pair.literals and not pair.names:
                return at, False
            at = more.end()

    def _starts_line(self, at: int) -> bool:
        """Whether only a keyword or a dash stands before ``at`` in its line; to be asked from left to right."""
        last = self.text.rfind("\n", self._seen, at)
        if last >= 0:
            self._line = last + 1
        self._seen = at
        return _LINE_START.match(self.text, self._line).end() == at

    def _joins(self, plain: str, end: int) -> bool:
        return _NAME.fullmatch(plain) is not None and _JOIN.match(self.text, end) is not None

    def events(self) -> Iterator[Pair | str]:
        text = self.text
        search = (_EVENT_INSIDE if self.level else _EVENT).search
        calls: list[tuple[int, Pair]] = []  # pairs whose value is a call that is still open
        at = 0
        while m := search(text, at):
            kind, at = m.lastgroup, m.end()
            if kind == "join":
                kind = "name"
            if kind == "line":
                yield from self._apart(m.start() + 1, at)
            elif kind == "block":
                close = "*/" if m[0] == "/*" else "-->"
                if self._spent.get(close, -1) >= 0:
                    continue
                end = text.find(close, at)
                if end < 0:
                    self._spent[close] = at
                    continue
                yield from self._apart(at, end)
                at = end + len(close)
            elif kind == "mark":
                if m[0] in "{}":
                    if not self.level:
                        yield m[0]
                elif m[0] == "(":
                    self.depth += 1
                elif m[0] == ")":
                    self.depth = max(0, self.depth - 1)
                    while calls and calls[-1][0] > self.depth:
                        yield calls.pop()[1]
                else:
                    self.depth = 0
                    while calls:
                        yield calls.pop()[1]
                    at = m.end() - 1
            elif kind == "tag":
                name = re.match(r"[\w.:-]+", m[0][1:])[0]
                end = text.find("<", at)
                inside = text[at:end] if end >= 0 else ""
                if inside.strip() and "\n" not in inside.strip() and text.startswith(f"</{name}", end):
                    lead = len(inside) - len(inside.lstrip())
                    yield Pair(name.rsplit(":", 1)[-1], [(at + lead, at + lead + len(inside.strip()))])
                at = m.start() + 1 + len(name)  # attributes are pairs
            else:
                if kind == "string":
                    string = self.string(m.start()) if self.level < _DEPTH else None
                    if string is None:
                        continue
                    (start, end), at = string
                    join = _JOIN.match(text, at)
                    if join and end > start and _NAME.fullmatch(text, start, end):
                        name, at, sep, key = text[start:end], join.end(), join["join"], m.start()
                    else:
                        if calls:
                            calls[-1][1].arguments.append((start, end))
                        yield from self._within(start, end)
                        continue
                else:
                    name, sep, key = m["name"], m["join"], m.start()
                self._alone = self._starts_line(key)
                names = [name.lstrip("$")]
                if sep == ":" and (typed := _TYPED.match(text, at)):
                    names.append(typed["type"])
                    at = typed.end()
                pair = Pair(names[0], constant=not self.level)
                at, call = self.value(at, pair)
                for start, end in pair.literals:
                    if start and text[start - 1] in "\"'`":
                        yield from self._within(start, end)
                if pair.literals or pair.names:
                    self.assigned.add(pair.name)
                if names[1:]:  # what looks like a type may be the target
                    yield Pair(names[1], list(pair.literals), list(pair.names))
                if call:
                    calls.append((self.depth + 1, pair))
                else:
                    yield pair
        while calls:
            yield calls.pop()[1]

    def _within(self, start: int, end: int) -> Iterator[Pair]:
        """Pairs inside a string."""
        if self.level < _DEPTH and (self.text.find("=", start, end) >= 0 or self.text.find(":", start, end) >= 0):
            yield from self._apart(start, end)

    def _apart(self, start: int, end: int) -> Iterator[Pair]:
        """Pairs inside a comment or a string, which name no constants."""
        for pair in _Text(self.text[start:end], self.level + 1).events():
            pair.literals = [(a + start, b + start) for a, b in pair.literals]
            pair.arguments = [(a + start, b + start) for a, b in pair.arguments]
            pair.names = []
            yield pair


def events(text: str) -> Iterator[Pair | str]:
    """The pairs of a text in order, and between them ``{`` and ``}`` where blocks open and close."""
    return _Text(text).events()
