"""A pushdown parser for running text: fences, code, brackets, quotations, emphasis, tags and lists left open."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"```|`|\*\*|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<[A-Za-z][A-Za-z0-9]*\s[^<>]*$|[()\[\]{}«»“”„\"]|\n")
_NUMBERS = re.compile(r"[\s\d.,;+∞−-]*(?:inf(?:inity)?|∞)?[\s\d.,;+∞−-]*")
_ITEM = re.compile(r"[ \t]*(?:[-*•+]|\d{1,3}[.)]|[a-z][.)])(?:[ \t]+\S|[ \t]*$)")
_BARE_ITEM = re.compile(r"[ \t]*(?:[-*•+]|\d{1,3}[.)]|[a-z][.)])[ \t]*$")
_CLOSERS = {")": "(", "]": "[", "}": "{"}
# Elements of markup that must be closed.
ELEMENTS = frozenset("a b i u em strong code pre sub sup span div ul ol table blockquote h1 h2 h3 h4 h5 h6 math".split())


def _numeric(text: str, start: int, end: int) -> bool:
    """Whether only numbers stand between two brackets, as in the interval "[0, 1)"."""
    return any(c.isdigit() for c in text[start:end]) and bool(_NUMBERS.fullmatch(text, start, end))


def left_open(text: str) -> list[str]:
    """What is still open at the end of ``text``, outermost first; empty if nothing is.

    Each opening mark is pushed and popped by the mark that closes it; a closing mark closes the innermost opening of its kind and all
    that was opened inside that, and one without any opening ("a) first", ":)") says nothing. Inside a fence only its end counts, inside
    inline code only the next backtick of the line. A straight quotation mark opens behind a space or bracket and before a word, else
    it closes; one after a digit is a unit. Emphasis (``**``) opens before and closes after a character that is no space. The
    result names fences ```` ``` ````, brackets, quotation marks, ``**``, elements of markup and ``item`` for a list
    marker that nothing follows. Single quotation marks are left out, since apostrophes look alike. Empty text gives none.
    """
    stack: list[tuple[str, int]] = []

    def close(mark: str) -> bool:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == mark:
                del stack[k:]
                return True
        return False

    for m in _TOKEN.finditer(text):
        t, at, end = m[0], m.start(), m.end()
        top = stack[-1][0] if stack else ""
        if top == "```":
            if t == "```":
                stack.pop()
            continue
        if top == "`":
            if t in ("`", "\n"):
                stack.pop()
            continue
        if t == "\n":
            continue
        before, after = text[at - 1 : at], text[end : end + 1]
        opens = (not before or before.isspace() or before in "([{«„“\"—–-:*") and bool(after) and not after.isspace()
        if t in ("```", "`"):
            stack.append((t, at))
        elif t == "**":
            if not (before and not before.isspace() and close("**")) and opens:
                stack.append((t, at))
        elif t == '"':
            if not close('"') and opens:
                stack.append((t, at))
        elif t in "([{":
            if not (before in (":", ";") and t == "(" and (not after or after.isspace())):  # ":(" is a face
                stack.append((t, at))
        elif t in _CLOSERS:
            if top in ("(", "[") and top != _CLOSERS[t] and t in ")]" and _numeric(text, stack[-1][1] + 1, at):
                stack.pop()
            else:
                close(_CLOSERS[t])
        elif t in "„«":
            if t == "„" or not close("»"):
                stack.append((t, at))
        elif t == "“":
            if not close("„"):
                stack.append((t, at))
        elif t == "”":
            close("„") if any(s[0] == "„" for s in stack) else close("“")
        elif t == "»":
            if not close("«") and opens:
                stack.append((t, at))
        elif t[0] == "<":
            name = re.match(r"</?([A-Za-z0-9]+)", t)[1].lower()
            if name in ELEMENTS:
                if t[1] == "/":
                    close(f"<{name}>")
                elif not t.endswith("/>"):
                    stack.append((f"<{name}>", at))
    found = [s[0] for s in stack if s[0] != "`"]
    lines = text.rstrip().rsplit("\n", 2)
    if len(lines) > 1 and _BARE_ITEM.match(lines[-1]) and _ITEM.match(lines[-2]) and "```" not in found:
        found.append("item")
    return found
