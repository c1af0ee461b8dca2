"""The seven index statements.  Anything else is Spark's."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class StatementError(ValueError):
    """A statement that begins as one of ours and doesn't end as one."""


@dataclass(frozen=True)
class Statement:
    kind: str  # create, drop, refresh, show, check, enable, disable
    index: str | None = None
    table: str | None = None
    columns: tuple[tuple[str, bool], ...] = ()  # (name, ascending)
    using: str = "BTREE"
    partition: dict[str, str] = field(default_factory=dict)
    lenient: bool = False  # IF [NOT] EXISTS


_TOKEN = re.compile(r"\s+|(?P<quoted>`(?:[^`]|``)+`)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<word>[\w.+-]+)|(?P<mark>[(),=;])")


def _tokens(sql: str) -> list[tuple[str, str]]:
    found, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise StatementError(f"unexpected {sql[at]!r} at {at}")
        at = m.end()
        if m.lastgroup:
            found.append((m.lastgroup, m[0]))
    return found


class _Reader:
    def __init__(self, sql: str):
        self.tokens, self.at = _tokens(sql), 0
        while self.tokens and self.tokens[-1] == ("mark", ";"):
            self.tokens.pop()

    def peek(self, *words: str) -> bool:
        ahead = self.tokens[self.at : self.at + len(words)]
        return len(ahead) == len(words) and all(k in ("word", "mark") and t.upper() == w for (k, t), w in zip(ahead, words))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise StatementError(f"{word} expected" + (f", not {self.tokens[self.at][1]}" if self.at < len(self.tokens) else " at the end"))

    def name(self, dotted: bool = False) -> str:
        parts = []
        while True:
            if self.at == len(self.tokens) or self.tokens[self.at][0] not in ("word", "quoted"):
                raise StatementError("a name expected")
            kind, text = self.tokens[self.at]
            self.at += 1
            parts.append(text[1:-1].replace("``", "`") if kind == "quoted" else text)
            # Between quoted parts the dot is a word of its own or the start of one.
            if dotted and self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and self.tokens[self.at][1].startswith("."):
                rest = self.tokens[self.at][1][1:]
                if rest:
                    self.at += 1
                    parts.append(rest)
                    break
                self.at += 1
                continue
            break
        return ".".join(parts)

    def value(self) -> str:
        if self.at == len(self.tokens):
            raise StatementError("a value expected")
        kind, text = self.tokens[self.at]
        if kind not in ("word", "text"):
            raise StatementError("a value expected: partition keys need one each")
        self.at += 1
        return re.sub(r"\\(.)", r"\1", text[1:-1]) if kind == "text" else text

    def end(self) -> None:
        if self.at != len(self.tokens):
            raise StatementError(f"unexpected {self.tokens[self.at][1]}")


def _partition(r: _Reader) -> dict[str, str]:
    found: dict[str, str] = {}
    if r.take("PARTITION"):
        r.need("(")
        while True:
            key = r.name()
            r.need("=")
            if key in found:
                raise StatementError(f"partition key {key} is given twice")
            found[key] = r.value()
            if not r.take(","):
                break
        r.need(")")
    return found


_OURS = re.compile(r"\s*(CREATE|DROP|REFRESH|SHOW|CHECK|ENABLE|DISABLE)\s+[OS]INDEX\b", re.I)


def parse(sql: str) -> Statement | None:
    """The statement, or None if the text is not one of ours."""
    m = _OURS.match(sql)
    if not m:
        return None
    r, kind = _Reader(sql), m[1].lower()
    r.at = 2
    if kind == "create":
        lenient = r.take("IF", "NOT", "EXISTS")
        index = r.name()
        r.need("ON")
        table = r.name(dotted=True)
        r.need("(")
        columns = []
        while True:
            column = r.name()
            ascending = not r.take("DESC")
            if ascending:
                r.take("ASC")
            columns.append((column, ascending))
            if not r.take(","):
                break
        r.need(")")
        using = "BTREE"
        if r.take("USING"):
            using = r.name().upper()
            if using not in ("BTREE", "BITMAP"):
                raise StatementError(f"no index type {using}")
        found = Statement(kind, index, table, tuple(columns), using, _partition(r), lenient)
    elif kind == "drop":
        lenient = r.take("IF", "EXISTS")
        index = r.name()
        r.need("ON")
        found = Statement(kind, index, r.name(dotted=True), partition=_partition(r), lenient=lenient)
    elif kind in ("refresh", "check"):
        r.need("ON")
        found = Statement(kind, None, r.name(dotted=True), partition=_partition(r))
    elif kind == "show":
        if not r.take("FROM"):
            r.need("IN")
        found = Statement(kind, None, r.name(dotted=True))
    else:
        found = Statement(kind, r.name())
    r.end()
    return found
