"""Go: functions, methods and types; calls; import declarations."""

from __future__ import annotations

import re

from corpusloom.operators.languages.scan import Source, call, callee, imported, in_order, literals, last_part, symbol, within

_LITERAL = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\[^\n]{1,9}?|[^'\\\n]+)'")
_NAME = r"[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*"
_NOT_CALLED = set("func if for switch select return go defer range case type var const import package else map chan struct interface".split())


def _source(raw: bytes) -> Source:
    text = raw.decode("latin-1")
    return Source(text, literals(text, _LITERAL))


def _visibility(name: str) -> str:
    return "public" if name.encode("latin-1").decode("utf-8", "replace")[:1].isupper() else "private"


def _result(source: Source, at: int) -> tuple[str, int | None]:
    """" T" of a result after the parameters, and the body's brace."""
    code, begin = source.code, source.next(at)
    if "\n" in code[at:begin] or begin >= len(code):
        return "", None
    end = begin
    while end < len(code) and code[end] != "\n":
        if code[end] == "{" and not re.search(r"\b(interface|struct)\s*$", code[begin:end]):
            result = source.string(begin, end).strip()
            return (f" {result}" if result else ""), end
        end = source.close.get(end, end) + 1 if code[end] in "([{" else end + 1
    result = source.string(begin, end).strip()
    return (f" {result}" if result else ""), None


def symbols(raw: bytes) -> list[dict]:
    source = _source(raw)
    code, functions, methods, types = source.code, [], [], []
    for m in re.finditer(rf"(?m)^[ \t]*func\s*(?P<receiver>\([^)]*\))?\s*(?P<name>{_NAME})\s*(?:\[[^\]]*\])?\s*\(", code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        at = m.end() - 1
        if at not in source.close:
            continue
        result, brace = _result(source, source.close[at] + 1)
        end = source.end_of(brace) if brace is not None else source.close[at] + 1 + len(result)
        sign = f"{m['name']}{source.string(at, source.close[at] + 1)}{result}"
        if m["receiver"]:
            methods.append(symbol("method", m["name"], (start, end), m.span("name"), f"{source.string(*m.span('receiver'))} {sign}", _visibility(m["name"])))
        else:
            functions.append(symbol("function", m["name"], (start, end), m.span("name"), sign, _visibility(m["name"])))
    for m in re.finditer(r"(?m)^[ \t]*type\b\s*", code):
        at = m.end()
        block = code[at : at + 1] == "(" and at in source.close
        stop = source.close[at] if block else len(code)
        at = at + 1 if block else at
        while spec := re.compile(rf"\s*(?P<name>{_NAME})[ \t]*(?:\[[^\]\n]*[A-Za-z][^\]\n]*\][ \t]*)?(?!=)").match(code, at, stop):
            begin = source.next(spec.end())
            if begin >= stop or "\n" in code[spec.end() : begin] or code[begin] == "=":
                at = code.find("\n", spec.end()) % (len(code) + 1)
                if not block or at >= stop:
                    break
                continue
            end = begin
            while end < stop and code[end] not in "\n;":
                end = source.close.get(end, end) + 1 if code[end] in "([{" else end + 1
            text = source.string(begin, end).strip()
            kind = "struct" if text.startswith("struct") else "interface" if text.startswith("interface") else "type_alias"
            name_at = spec.start("name")
            types.append(symbol(kind, spec["name"], (name_at, begin + len(text.encode())), spec.span("name"), f"{spec['name']} {text}", _visibility(spec["name"])))
            at = end
            if not block:
                break
    return functions + methods + types


def calls(raw: bytes) -> list[dict]:
    source = _source(raw)
    code = source.code
    specs = [(m.end() - 1, source.end_of(m.end() - 1)) for m in re.finditer(r"\binterface\s*\{", code)]
    out, specified = [], within(specs)
    for m in re.finditer(r"\(", code):
        at = m.start()
        found = callee(source, at, (".",)) if at in source.close else None
        if not found or specified(at):
            continue
        start, end = found
        written = code[start:end]
        last = re.search(rf"({_NAME})$", written)
        receiver = source.last(start)
        head = code[max(code.rfind(")", 0, receiver), 0) : start] if code[receiver : receiver + 1] == ")" else last_part(code, start)
        if not last or last[1] in _NOT_CALLED or re.search(r"\bfunc\s*(\([^)]*\)\s*)?$", head) or written.startswith("func"):
            continue
        stop = source.close[at] + 1
        method = bool(re.search(r"\.\s*$", written[: last.start()]))
        out.append((start, stop, call(source.string(start, end), start, stop, "method" if method else "function")))
    return [r[2] for r in in_order(out)]


def imports(raw: bytes) -> list[dict]:
    source = _source(raw)
    spec = re.compile(r"(?:(?P<alias>[A-Za-z_.][\w]*)\s+)?\"(?P<path>[^\"\n]*)\"")
    out = []
    for m in re.finditer(r"(?m)^[ \t]*import\b", source.code):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        at = m.end() + len(source.text[m.end() :]) - len(source.text[m.end() :].lstrip())
        block = at in source.close
        stop = source.close[at] + 1 if block else source.text.find("\n", at) % (len(source.text) + 1)
        inner = literals(source.text[at:stop], re.compile(r"//[^\n]*"))
        found = list(spec.finditer(inner))
        end = stop if block else at + (found[0].end() if found else 0)
        for s in found if block else found[:1]:
            out.append(imported(s["path"], start, end, None, None if s["alias"] == "." else s["alias"], s["alias"] == "."))
    return out
