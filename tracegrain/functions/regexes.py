"""Patterns of rules as Spark's regular expressions (Java's), with the meaning that they have in Python."""

from __future__ import annotations

import re

_JAVA_META = set("\\^$.|?*+()[]{}&-~#\"' \t\n/")


def literal(text: str) -> str:
    """text as a pattern that matches it alone."""
    return "".join("\\" + c if c in _JAVA_META and c not in "\"'/\n\t" else c for c in text)


_PIECE = re.compile(r"\\([*?\\])|(\*)|(\?)|([^*?\\]+|\\)", re.S)


def wildcard(value: str) -> str | None:
    """Of a value in which * stands for any characters and ? for one, a pattern without anchors; None if it has neither.

    A backslash before *, ? or itself takes its meaning away.
    """
    pieces = [(m.lastindex, m[m.lastindex]) for m in _PIECE.finditer(value)]
    if not any(kind in (2, 3) for kind, _ in pieces):
        return None
    return "".join(".*" if kind == 2 else "." if kind == 3 else literal(text) for kind, text in pieces)


def unescaped(value: str) -> str:
    return re.sub(r"\\([*?\\])", r"\1", value)


_PART = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?P<\w+>|\{,(\d+)\}|.", re.S)


def from_python(pattern: str, ignore_case: bool = False) -> str:
    """A Python pattern for rlike: Unicode classes, only \\n ends lines. Raises ValueError on what can't be carried over."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a pattern: {pattern} ({e})") from e
    if re.search(r"\(\?P=|\(\?\(", pattern):
        raise ValueError(f"the pattern can't be used in Spark: {pattern}")
    out, names = [], 0
    for m in _PART.finditer(pattern):
        part = m[0]
        if part == "\\Z":
            part = "\\z"
        elif part.startswith("(?P<"):
            names += 1
            part = f"(?<g{names}>"
        elif m[1] is not None:
            part = f"{{0,{m[1]}}}"
        elif part.startswith("[") and len(part) > 1 and ("[" in part[1:] or "&&" in part):
            raise ValueError(f"the pattern can't be used in Spark: {pattern}")
        out.append(part)
    return f"(?{'i' if ignore_case else ''}Ud){''.join(out)}"


def glob(pattern: str) -> str:
    """A file name pattern (*, ?, [set]) as a whole pattern."""
    out, i = [], 0
    while i < len(pattern):
        c, end = pattern[i], pattern.find("]", i + 2)
        if c == "[" and end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end
        else:
            out.append(".*" if c == "*" else "." if c == "?" else literal(c))
        i += 1
    return f"(?s)^{''.join(out)}$"
