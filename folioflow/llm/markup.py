"""A pushdown parser for the nesting of replies: JSON, loosely written JSON, fences and quotations."""

from __future__ import annotations

import json
import re

_DECODER = json.JSONDecoder(strict=False)
_OPEN = re.compile(r"[\[{]")
#: A bracket that opens JSON wherever it stands in prose: objects with a key, arrays of anything but numbers (these only where left open).
_VALUE = re.compile(r"""\{\s*(?:["'}]|$|[A-Za-z_]\w*\s*:\s*(?:["'\[{\d-]|true\b|false\b|null\b|$))|\[\s*(?:["'{]|\[\s*["'{\[\d]|-?\d[^\]]*$)""")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[\]{}:,]|(?<=[\[{,:\s])\'', re.S)
_QUOTE_END = re.compile(r"(?<!\\)'(?=\s*[,:}\]])")
_PAIR = {"]": "[", "}": "{"}
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "", "f": ""}


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _PLAIN.get(m[1], m[1]), s)


def strings_of(value, key: str = "", out: list | None = None) -> list[tuple[str, str]]:
    """(field, string) of all strings in a parsed value, without recursion, in order."""
    out = [] if out is None else out
    stack = [(key, value)]
    while stack:
        k, v = stack.pop()
        if isinstance(v, str):
            out.append((k, v))
        elif isinstance(v, dict):
            stack.extend(reversed(list(v.items())))
        elif isinstance(v, list):
            stack.extend((k, x) for x in reversed(v))
    return out


def scan(text: str, start: int) -> tuple[bool, list[tuple[str, str]], int]:
    """Scan loosely written JSON from the bracket at ``start``: (left open, closed strings, end).

    Keys may be bare or in single quotes, commas may trail. Brackets are pushed and popped; the value
    is over where the stack is empty.
    """
    stack: list[str] = []
    values: list[tuple[str, str]] = []
    key, pending, at = "", None, start
    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            return True, values, len(text)
        t, at = m[0], m.end()
        if t in "[{":
            stack.append(t)
            pending = None
        elif t in "]}":
            if pending is not None:
                values.append((key, pending))
                pending = None
            while stack and stack[-1] != _PAIR[t]:
                stack.pop()
            if stack:
                stack.pop()
            if not stack:
                return False, values, at
        elif t == ":":
            if pending is not None:
                key, pending = pending, None
            else:
                bare = re.search(r"([A-Za-z_]\w*)\s*$", text[max(0, m.start() - 40) : m.start()])
                key = bare[1] if bare else key
        elif t == ",":
            if pending is not None:
                values.append((key, pending))
                pending = None
        elif t == "'":
            end = _QUOTE_END.search(text, at)
            if end is None:
                return True, values, len(text)
            pending, at = _unescape(text[at : end.start()]), end.end()
        else:
            if len(t) < 2 or t[-1] != '"' or (len(t) - len(t[:-1].rstrip("\\")) - 1) % 2:
                return True, values, len(text)
            pending = _unescape(t[1:-1])


def carried(text: str) -> tuple[bool, list[tuple[str, str]]]:
    """(left open, values) of a reply: the strings of its JSON payload and the prose around it.

    A reply without payload is one value of the field ``prose``; prose after a payload is ``after``. A bracket near the
    beginning is taken for the payload's unless it is a remark ("[sic]"); further on it must look like JSON.
    """
    body = text.strip().lstrip("﻿")
    at = _OPEN.search(body)
    fenced = body.startswith("```")
    if at is not None and ((at.start() > 200 and not fenced) or (at[0] == "[" and not re.match(r"\[\s*[\[{\"'\]\d]", body[at.start() : at.start() + 20]))):
        at = _VALUE.search(body, at.start())
    if at is None:
        return False, [("prose", body)] if body else []
    try:
        value, end = _DECODER.raw_decode(body, at.start())
        left_open, values = False, strings_of(value)
    except (ValueError, RecursionError):
        left_open, values, end = scan(body, at.start())
    if left_open:
        return True, values
    after = body[end:].strip().strip("`").strip()
    if after:
        values.append(("after", after))
    elif fenced and not body.endswith("```"):
        return True, values
    return False, values
