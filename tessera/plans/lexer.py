"""Tokens of the query language, by a hand-written scanner.

A token is (kind, text, start, end, value).  The longest reading wins; words are
told apart afterwards, without regard to case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from tessera.errors import LexError

# fixed values: the words and symbols of the language
SQL_STARTS = ("select", "update", "insert", "upsert", "delete")
SQL_MIDDLES = ("from", "group", "where", "order", "limit", "values", "set", "on")
CONTROL = ("def", "function", "if", "do", "while", "for", "else", "return", "self", "this")
NUMBER_WORDS = {"inf": float("inf"), "infinity": float("inf"), "nan": float("nan")}
NAME_WORDS = {"nil": None, "null": None, "true": True, "false": False}
ADVERBS = {"\\/": "fold", "\\\\": "unfold", "\\=": "mapdown", "\\<": "mapleft", "\\>": "mapright", "\\~": "mapback"}
THREE = ("<<=", ">>=")
TWO = ("==", ">=", "<=", "!=", "<>", "**", "<<", ">>")
ONE = "~!@#$%^&*_-+=|<>.?/"
UNITS = {"y": "years", "m": "months", "d": "days", "h": "hours", "i": "minutes", "s": "seconds"}

_SCAN = [
    ("comment", re.compile(r"//[^\n]*")),
    ("newline", re.compile(r"\n")),
    ("blank", re.compile(r"[ \t\r]+")),
    ("datetime", re.compile(r"\d{1,4}[.-]\d{1,2}[.-]\d{1,2}T\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?")),
    ("time", re.compile(r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?")),
    ("date", re.compile(r"\d{1,4}\.\d{1,2}\.\d{1,2}(?![.\d])")),
    ("span", re.compile(r"(?:\d+[YMDHISymdhis])+(?![A-Za-z0-9_.])")),
    ("number", re.compile(r"(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?")),
    ("string", re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', re.S)),
    ("symbol", re.compile(r"`[A-Za-z0-9_.$]*")),
    ("name", re.compile(r"[A-Za-z$_][A-Za-z0-9$._]*")),
]
_NESTED = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    value: Any = None


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def _unescape(body: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def _word(text: str) -> tuple[str, Any]:
    low = text.lower()
    if low in NUMBER_WORDS:
        return "number", NUMBER_WORDS[low]
    if low in NAME_WORDS:
        return "constant", NAME_WORDS[low]
    if low in SQL_STARTS:
        return "sql", low
    if low in SQL_MIDDLES:
        return "clause", low
    if low in CONTROL:
        return "control", low
    return "name", text


def _scan(text: str, at: int) -> tuple[str, int, Any]:
    for symbol, name in ADVERBS.items():
        if text.startswith(symbol, at):
            return "adverb", at + 2, name
    best: tuple[str, int, str] | None = None
    for kind, rx in _SCAN:
        m = rx.match(text, at)
        if m and m.end() > (best[1] if best else at):
            best = (kind, m.end(), m[0])
    if best:
        kind, end, body = best
        if kind == "number":
            return kind, end, float(body) if re.search(r"[.eE]", body) else int(body)
        if kind == "string":
            return kind, end, _unescape(body[1:-1])
        if kind == "symbol":
            return kind, end, body[1:]
        if kind == "span":
            parts: dict[str, int] = {}
            for n, unit in re.findall(r"(\d+)([A-Za-z])", body):
                parts[UNITS[unit.lower()]] = parts.get(UNITS[unit.lower()], 0) + int(n)
            return kind, end, parts
        if kind == "name":
            kind, value = _word(body)
            return kind, end, value
        return kind, end, body
    c = text[at]
    if text[at : at + 3] in THREE:
        return "verb", at + 3, text[at : at + 3]
    if text[at : at + 2] in TWO:
        return "verb", at + 2, text[at : at + 2]
    if c in "([{":
        return "open", at + 1, c
    if c in ")]}":
        return "close", at + 1, c
    if c in ",;":
        return ("comma" if c == "," else "semicolon"), at + 1, c
    if c == ":":
        return "colon", at + 1, c
    if c in ONE:
        return "verb", at + 1, c
    raise LexError(f"no token begins with {c!r} at {at}")


def tokens(text: str, blanks: bool = False) -> list[Token]:
    """All tokens of a text; without blanks and comments unless asked for."""
    out, at = [], 0
    while at < len(text):
        kind, end, value = _scan(text, at)
        if blanks or kind not in ("blank", "comment"):
            out.append(Token(kind, text[at:end], at, end, value))
        at = end
    return out
