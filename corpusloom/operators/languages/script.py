"""TypeScript and JavaScript: function and class declarations, arrow functions, interfaces and type aliases; calls and new; imports."""

from __future__ import annotations

import re
from collections.abc import Callable
from types import SimpleNamespace

from corpusloom.operators.languages.scan import WORD, Source, call, callee, imported, in_order, literals, last_part, symbol, within

_LITERAL = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'|(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_NOT_CALLED = set("if for while switch catch function return typeof await async with import export void delete in of do else case yield throw instanceof".split())


def _templates(text: str) -> str:
    """Template texts blanked, their ${...} expressions kept."""
    out, at, stack = list(text), 0, []
    inside = False
    while at < len(text):
        c = text[at]
        if inside:
            if c == "\\":
                out[at : at + 2] = [" " if x != "\n" else x for x in text[at : at + 2]]
                at += 2
                continue
            if c == "`":
                inside = False
            elif text.startswith("${", at):
                out[at], out[at + 1] = " ", "("
                stack.append(0)
                inside = False
                at += 2
                continue
            if c != "\n":
                out[at] = " "
        elif c == "`":
            out[at], inside = " ", True
        elif stack and c == "{":
            stack[-1] += 1
        elif stack and c == "}":
            if stack[-1]:
                stack[-1] -= 1
            else:
                stack.pop()
                out[at], inside = ")", True
        at += 1
    return "".join(out)


def _source(raw: bytes) -> Source:
    text = raw.decode("latin-1")
    return Source(text, _templates(literals(text, _LITERAL)))


def _type_end(source: Source, at: int, stop: str) -> int:
    """The end of a type that begins at at, before a character of stop outside brackets."""
    code = source.code
    while at < len(code) and code[at] not in stop and code[at] not in ")]}":
        at = source.close.get(at, at) + 1 if code[at] in "([{" else at + 1
    return at


def _exported(source: Source, spans: Callable[[int], bool], start: int) -> bool:
    words = 1
    while words <= len(re.findall(r"\b(?:default|declare|abstract)\b", head := last_part(source.code, start, words))):
        words += 1
    return bool(re.search(r"\bexport\s+(default\s+)?(declare\s+|abstract\s+)*$", head)) or spans(start)


def _export_spans(source: Source) -> list[tuple[int, int]]:
    out = []
    for m in re.finditer(r"\bexport\b", source.code):
        brace = source.body(m.end())
        out.append((m.start(), source.end_of(brace) if brace is not None else _type_end(source, m.end(), ";\n")))
    return out


_GOES_ON = re.compile(r"\s*[.|&?:=,+\-*/]")


def _statement_end(source: Source, at: int) -> int:
    code = source.code
    while at < len(code) and code[at] not in ";}":
        if code[at] == "\n" and not _GOES_ON.match(code, at) and not re.search(r"[=|&,(+\-*/:>]\s*$", last_part(code, at)):
            return at
        at = source.close.get(at, at) + 1 if code[at] in "([{" else at + 1
    return at + 1 if code[at : at + 1] == ";" else at


def _symbols(raw: bytes, typed: bool) -> list[dict]:
    source = _source(raw)
    code, out = source.code, []
    exports = within(_export_spans(source))

    def seen(start: int) -> str:
        return "public" if _exported(source, exports, start) else "private"

    def returns(at: int, stop: str) -> tuple[str, int]:
        """": T" and its end, of a return type after a parameter list."""
        k = source.next(at)
        if code[k : k + 1] != ":":
            return "", at
        begin = source.next(k + 1)
        end = begin
        while end < len(code) and not (code[end] in stop and end > begin and code[end] != "{") and not (code[end] == "{" and end > begin and re.search(r"[^|&:<,(=\s]\s*$", code[begin:end])) and not code.startswith("=>", end):
            end = source.close.get(end, end) + 1 if code[end] in "([{" else end + 1
        return ": " + source.string(begin, end).strip(), end

    for m in re.finditer(rf"(?<![\w$.])(?P<async>async\s+)?function\s*\*?\s*(?P<name>{WORD})\s*", code):
        if re.search(r"[=(,:?&|]\s*$|\breturn\s+$", last_part(code, m.start())):
            continue  # an expression
        at = source.next(m.end())
        if code[at : at + 1] == "<":
            at = code.find("(", at)
        if at not in source.close:
            continue
        params = source.string(at, source.close[at] + 1)
        kind, after = returns(source.close[at] + 1, ";\n")
        brace = source.body(after)
        if brace is None:
            continue
        out.append(symbol("function", m["name"], (m.start(), source.end_of(brace)), m.span("name"), m["name"] + params + kind, seen(m.start()), bool(m["async"])))
    for m in re.finditer(rf"(?<![\w$.])(?:const|let)\s+(?P<name>{WORD})\s*", code):
        at = m.end()
        if code[at : at + 1] == ":":
            at = _type_end(source, at, "=;")
            while code.startswith("=>", at):
                at = _type_end(source, at + 2, "=;")
        if code[at : at + 1] != "=" or code[at : at + 2] == "==":
            continue
        begin = source.next(at + 1)
        is_async = bool(re.match(r"async\b", code[begin:]))
        at = source.next(begin + 5) if is_async else begin
        if typed and code[at : at + 1] == "<":
            at = code.find("(", at)
        if code[at : at + 1] == "(" and at in source.close:
            params, kind, after = source.string(at, source.close[at] + 1), *returns(source.close[at] + 1, ";\n")
        elif word := re.match(WORD, code[at:]):
            params, kind, after = word[0], "", at + word.end()
        else:
            continue
        arrow = source.next(after)
        if not code.startswith("=>", arrow):
            continue
        first = source.next(arrow + 2)
        end = _statement_end(source, source.end_of(first) if code[first : first + 1] == "{" else first)
        out.append(symbol("function", m["name"], (m.start(), end), m.span("name"), f"{m['name']} = {params}{kind} => ...", seen(m.start()), is_async))
    for m in re.finditer(rf"(?<![\w$.])class\s+(?P<name>{WORD})", code):
        brace = source.body(m.end())
        if brace is None or re.search(r"[=(,:?]\s*$", last_part(code, m.start())):
            continue
        heritage = re.search(r"\b(extends|implements)\b[\s\S]*", code[m.end() : brace])
        tail = " " + source.string(m.end() + heritage.start(), brace).strip() if heritage else ""
        out.append(symbol("class", m["name"], (m.start(), source.end_of(brace)), m.span("name"), m["name"] + tail, seen(m.start())))
    if typed:
        for m in re.finditer(rf"(?<![\w$.])interface\s+(?P<name>{WORD})", code):
            brace = source.body(m.end())
            if brace is None:
                continue
            heritage = re.search(r"\bextends\b[\s\S]*", code[m.end() : brace])
            tail = " " + source.string(m.end() + heritage.start(), brace).strip() if heritage else ""
            out.append(symbol("interface", m["name"], (m.start(), source.end_of(brace)), m.span("name"), m["name"] + tail, seen(m.start())))
        for m in re.finditer(rf"(?<![\w$.])type\s+(?P<name>{WORD})\s*(?:<[^=]*>)?\s*=", code):
            begin = source.next(m.end())
            end = _statement_end(source, begin)
            out.append(symbol("type_alias", m["name"], (m.start(), end), m.span("name"), f"{m['name']} = {source.string(begin, end).strip().removesuffix(';')}", seen(m.start())))
    return out


def _calls(raw: bytes) -> list[dict]:
    source = _source(raw)
    code = source.code
    plain, made = [], []
    types = [(b, source.end_of(b)) for m in re.finditer(rf"(?<![\w$.])interface\s+{WORD}", code) if (b := source.body(m.end())) is not None]
    typed = within(types)
    for m in re.finditer(r"\(", code):
        at = m.start()
        found = callee(source, at, ("?.", "."), arguments=True) if at in source.close else None
        if not found or typed(at):
            continue
        start, end = found
        stop = source.close[at] + 1
        written = re.sub(r"<[\s\S]*>$", "", code[start:end])
        last = re.search(rf"({WORD})$", written)
        if last and last[1] in _NOT_CALLED or re.search(r"\bfunction\s*\*?\s*$", last_part(code, start, 2)):
            continue
        head = last_part(code, start)
        new = re.search(r"\bnew\s+$", head)
        after = re.compile(r"[ \t]*(?::[^;={}()\n]*)?[ \t]*\{").match(code, stop)
        if after and "." not in written and not new:
            continue  # a method's definition
        begin = start - len(head) + new.start() if new else start
        if new and "(" not in written:
            made.append((begin, stop, call(source.string(start, start + len(written)), begin, stop, "constructor")))
        else:
            start = begin  # a call on what new made
            name = source.string(start, found[0] + len(written))
            method = bool(last and re.search(r"\.\s*$", written[: last.start()]))
            plain.append((start, stop, call(name, start, stop, "method" if method else "function")))
    return [r[2] for r in in_order(plain) + in_order(made)]


def _imports(raw: bytes) -> list[dict]:
    source = _source(raw)
    out = []
    for m in re.finditer(r"(?<![\w$.])import\b(?!\s*[(.])", source.code):
        found = re.compile(r"(?:\s+type)?\s*(?P<clause>[^'\";]*?)\s*(?:\bfrom\b)?\s*['\"](?P<module>[^'\"]*)['\"]\s*;?").match(source.text, m.end())
        if not found:
            continue
        end = found.end()
        clause, module = found["clause"].strip(), found["module"].encode("latin-1").decode("utf-8", "replace")
        if "* as" in clause:
            out.append(imported(module, m.start(), end, None, clause.split("* as")[1].strip(), True))
        elif "{" in clause:
            names = [re.sub(r"^type\s+", "", p.strip()).split(" as ")[0].strip() for p in clause[clause.index("{") + 1 :].rstrip("} \n").split(",")]
            out.append(imported(module, m.start(), end, [n for n in names if n]))
        elif clause:
            out.append(imported(module, m.start(), end, None, clause.split(",")[0].strip()))
        else:
            out.append(imported(module, m.start(), end))
    return out


TYPESCRIPT = SimpleNamespace(symbols=lambda raw: _symbols(raw, True), calls=_calls, imports=_imports)
JAVASCRIPT = SimpleNamespace(symbols=lambda raw: _symbols(raw, False), calls=_calls, imports=_imports)
