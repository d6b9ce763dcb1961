"""What the brace languages share: sources with comments and literals blanked, brackets, and the callee before a bracket.

A source is handled as Latin-1 text of its bytes, so that every index is a byte offset.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import accumulate

WORD = r"[A-Za-z_$\x80-\xff][A-Za-z0-9_$\x80-\xff]*"
_WORD_CHARACTER = re.compile(r"[A-Za-z0-9_$\x80-\xff]")


def blank(text: str, start: int, end: int) -> str:
    return text[:start] + re.sub(r"[^\n]", " ", text[start:end]) + text[end:]


@dataclass
class Source:
    """text: as it is; code: without comments and literals; close: closing bracket of each opening one."""

    text: str
    code: str
    close: dict[int, int] = field(default_factory=dict)
    open: dict[int, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        stack: list[tuple[str, int]] = []
        pairs = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c, i = m[0], m.start()
            if c in "([{":
                stack.append((c, i))
            else:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == pairs[c]), None)
                if at is not None:  # an unclosed bracket inside is dropped
                    self.close[stack[at][1]], self.open[i] = i, stack[at][1]
                    del stack[at:]

    def string(self, start: int, end: int) -> str:
        """The source text of a byte range."""
        return self.text[start:end].encode("latin-1").decode("utf-8", "replace")

    def next(self, at: int) -> int:
        """The first index from at that isn't white space."""
        m = re.compile(r"\S").search(self.code, at)
        return m.start() if m else len(self.code)

    def last(self, at: int) -> int:
        """The last index below at that isn't white space, or -1."""
        while at > 0 and self.code[at - 1].isspace():
            at -= 1
        return at - 1

    def body(self, at: int, stop: str = ";") -> int | None:
        """The first "{" from at that isn't inside brackets, before any character of stop."""
        while at < len(self.code):
            c = self.code[at]
            if c == "{":
                return at
            if c in stop or c in ")]}":
                return None
            at = self.close.get(at, at) + 1 if c in "([" else at + 1
        return None

    def end_of(self, brace: int) -> int:
        return self.close.get(brace, len(self.code) - 1) + 1


def last_part(code: str, at: int, tokens: int = 1) -> str:
    """The end of code[:at] that holds its last words or signs, so many, and the character before them: what a pattern that ends
    with "$" has to see, however long the code is."""
    k = at
    for _ in range(tokens):
        while k and code[k - 1].isspace():
            k -= 1
        if k and _WORD_CHARACTER.match(code[k - 1]):
            while k and _WORD_CHARACTER.match(code[k - 1]):
                k -= 1
        elif k:
            k -= 1
    return code[max(k - 1, 0) : at]


def within(spans: list[tuple[int, int]]) -> Callable[[int], bool]:
    """Whether a place is in one of the spans (start, end), end excluded."""
    spans = sorted(spans)
    starts, ends = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def inside(at: int) -> bool:
        n = bisect_right(starts, at)
        return n > 0 and at < ends[n - 1]

    return inside


def literals(text: str, pattern: re.Pattern, nested: bool = False) -> str:
    """text with the pattern's matches blanked; nested: block comments may hold block comments."""
    out, at = [], 0
    while m := pattern.search(text, at):
        start, end = m.start(), m.end()
        if nested and m[0].startswith("/*"):
            depth, k = 1, start + 2
            while depth and (n := re.compile(r"/\*|\*/").search(text, k)):
                depth, k = depth + (1 if n[0] == "/*" else -1), n.end()
            end = k if not depth else len(text)
        out += [text[at:start], re.sub(r"[^\n]", " ", text[start:end])]
        at = max(end, start + 1)
    return "".join(out) + text[at:]


def callee(source: Source, bracket: int, joints: tuple[str, ...], arguments: bool = False) -> tuple[int, int] | None:
    """The range of the expression that is called at an opening bracket; joints: what joins its parts; arguments: "<...>" may
    end it. None if nothing stands there."""
    code = source.code
    end = source.last(bracket) + 1
    start, at = end, end
    while at > 0:
        at = source.last(at) + 1
        c = code[at - 1] if at else ""
        if c in ")]" and at - 1 in source.open:
            start = at = source.open[at - 1]
            before = source.last(at)
            if before >= 0 and (_WORD_CHARACTER.match(code[before]) or code[before] in ")]?"):
                continue
        elif c == "?" or (c == "!" and start < end):
            at -= 1
            continue
        elif arguments and c == ">" and code[at - 2 : at - 1] not in ("-", "="):
            depth, k = 0, at - 1
            while k >= 0:
                depth += (code[k] == ">") - (code[k] == "<")
                if not depth:
                    break
                k -= 1
            if k < 0:
                break
            at = k
            joined = code.endswith("::", 0, at)
            start = at = at - 2 if joined else at
            if not joined and not (at and _WORD_CHARACTER.match(code[at - 1])):
                break
            continue
        elif c and _WORD_CHARACTER.match(c):
            while at and _WORD_CHARACTER.match(code[at - 1]):
                at -= 1
            start = at
        else:
            break
        before = source.last(at) + 1
        joint = next((j for j in joints if code.endswith(j, 0, before)), None)
        if joint is None:
            break
        at = before - len(joint)
    return (start, end) if start < end else None


def in_order(ranges: list[tuple]) -> list[tuple]:
    """Rows whose first two values are start and end, outer ones first."""
    return sorted(ranges, key=lambda r: (r[0], -r[1]))


def symbol(kind: str, name: str, span: tuple[int, int], name_span: tuple[int, int], signature: str | None, visibility: str = "private", is_async: bool = False) -> dict:
    return {"kind": kind, "name": name, "start": span[0], "end": span[1], "name_start": name_span[0], "name_end": name_span[1], "signature": signature, "visibility": visibility, "is_async": is_async}


def call(name: str, start: int, end: int, kind: str) -> dict:
    return {"name": name, "start": start, "end": end, "kind": kind}


def imported(module_path: str, start: int, end: int, items: list[str] | None = None, alias: str | None = None, is_wildcard: bool = False) -> dict:
    return {"module_path": module_path, "items": items, "alias": alias, "start": start, "end": end, "is_wildcard": is_wildcard}
