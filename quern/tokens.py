"""Splitting of SQL text into tokens, and finding one's way among them."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|[A-Za-z_]\w*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|->>|->|::|<=>|<>|!=|<=|>=|\|\||//|.", re.S)


def split(text: str) -> list[str]:
    return _TOKEN.findall(text)


def blank(t: str) -> bool:
    return t.isspace() or t.startswith(("--", "/*"))


def skip(tokens: list[str], i: int) -> int:
    while i < len(tokens) and blank(tokens[i]):
        i += 1
    return i


def following(tokens: list[str], i: int) -> str:
    i = skip(tokens, i + 1)
    return tokens[i].upper() if i < len(tokens) else ""


def close(tokens: list[str], i: int) -> int:
    """The bracket that closes the one at i."""
    deep = 0
    for j in range(i, len(tokens)):
        deep += (tokens[j] in "([" and len(tokens[j]) == 1) - (tokens[j] in ")]" and len(tokens[j]) == 1)
        if not deep:
            return j
    raise ValueError("unbalanced brackets")


def opened(tokens: list[str], i: int) -> int:
    deep = 0
    for j in range(i, -1, -1):
        deep += (tokens[j] in (")", "]")) - (tokens[j] in ("(", "["))
        if not deep:
            return j
    raise ValueError("unbalanced brackets")


def arguments(tokens: list[str]) -> list[list[str]]:
    out, deep = [[]], 0
    for t in tokens:
        deep += (t in ("(", "[")) - (t in (")", "]"))
        if t == "," and not deep:
            out.append([])
        else:
            out[-1].append(t)
    return [a for a in out if any(not blank(t) for t in a)]
