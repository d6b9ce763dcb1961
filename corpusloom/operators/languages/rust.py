"""Rust: items by category, calls (method calls twice: as written, and by bare name), use declarations."""

from __future__ import annotations

import re

from corpusloom.operators.languages.scan import Source, call, callee, imported, in_order, literals, last_part, symbol, within

_LITERAL = re.compile(r"//[^\n]*|/\*|b?r(#*)\"[\s\S]*?\"\1|b?\"(?:\\[\s\S]|[^\"\\])*\"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^\\'\n])'")
_VISIBILITY = r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?"
_NAME = r"(?P<name>(?:r#)?[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)"
_ITEMS = {
    "function": re.compile(rf"(?<![\w])(?:{_VISIBILITY})(?P<mods>(?:(?:const|async|unsafe|extern(?:\s+ +)?|default)\s+)*)fn\s+{_NAME}"),
    "struct": re.compile(rf"(?<![\w]){_VISIBILITY}struct\s+{_NAME}"),
    "enum": re.compile(rf"(?<![\w]){_VISIBILITY}enum\s+{_NAME}"),
    "trait": re.compile(rf"(?<![\w]){_VISIBILITY}(?:unsafe\s+|auto\s+)*trait\s+{_NAME}"),
    "impl": re.compile(r"(?<![\w])(?:unsafe\s+)?impl(?=[\s<])"),
    "module": re.compile(rf"(?<![\w]){_VISIBILITY}mod\s+{_NAME}"),
    "const": re.compile(rf"(?<![\w]){_VISIBILITY}const\s+{_NAME}\s*:"),
    "static": re.compile(rf"(?<![\w]){_VISIBILITY}static\s+(?:mut\s+)?{_NAME}\s*:"),
    "type_alias": re.compile(rf"(?<![\w]){_VISIBILITY}type\s+{_NAME}"),
    "macro": re.compile(rf"(?<![\w])macro_rules!\s*{_NAME}"),
}
_NOT_CALLED = set("if while for match return let in fn loop as move else pub where use mod impl dyn ref mut unsafe async await break".split())


def _source(raw: bytes) -> Source:
    text = raw.decode("latin-1")
    code = literals(text, _LITERAL, nested=True)
    return Source(text, re.sub(r"#!?\[(?:[^\[\]]|\[[^\]]*\])*\]", lambda m: re.sub(r"[^\n]", " ", m[0]), code))


def _without_macros(source: Source) -> Source:
    """Arguments of macros are tokens, not expressions."""
    code = source.code
    for m in re.finditer(r"\w!\s*(?:\w+\s*)?([(\[{])", code):
        at = m.start(1)
        if at in source.close:
            code = code[: at + 1] + re.sub(r"[^\n]", " ", code[at + 1 : source.close[at]]) + code[source.close[at] :]
    return Source(source.text, code)


def _visibility(text: str | None) -> str:
    text = re.sub(r"\s+", "", text or "")
    for start, name in (("pub(crate)", "public_crate"), ("pub(super)", "public_super"), ("pub(self)", "public_self"), ("pub(in", "public_in")):
        if text.startswith(start):
            return name
    return "public" if text == "pub" else "private"


def _statement_end(source: Source, at: int) -> int:
    while at < len(source.code) and source.code[at] != ";":
        at = source.close.get(at, at) + 1
    return min(at + 1, len(source.code))


def symbols(raw: bytes) -> list[dict]:
    whole = _source(raw)
    source = _without_macros(whole)
    code = source.code
    owners = []  # bodies of impls and traits
    for m in [*_ITEMS["impl"].finditer(code), *_ITEMS["trait"].finditer(code)]:
        brace = source.body(m.end())
        if brace is not None:
            owners.append((brace, source.end_of(brace)))
    out = []
    for kind, pattern in _ITEMS.items():
        for m in pattern.finditer(whole.code if kind == "macro" else code):
            start = m.start()
            if kind == "impl":
                brace = source.body(m.end())
                if brace is None or not re.search(r"(^|[;{}\]\s])$", code[max(start - 1, 0) : start]):
                    continue
                head = code[m.end() : brace]
                skip = 0
                if head.lstrip().startswith("<"):
                    depth = 0
                    for k, c in enumerate(head):
                        depth += (c == "<") - (c == ">" and head[k - 1 : k] != "-")
                        if c == ">" and not depth:
                            skip = k + 1
                            break
                head = re.split(r"\bwhere\b", head[skip:])[0]
                parts = re.split(r"\sfor\s(?!\s*<)", head, maxsplit=1)
                name = " for ".join(re.sub(r"\s+", " ", p).strip() for p in parts)
                type_text = parts[-1].strip()
                at = code.index(type_text, m.end()) if len(parts) == 1 else m.end() + skip + head.index(parts[-1]) + len(parts[-1]) - len(parts[-1].lstrip())
                out.append(symbol("impl", name, (start, source.end_of(brace)), (at, at + len(type_text)), source.string(start, brace).strip()))
                continue
            name, name_at = m["name"], m.start("name")
            vis = _visibility(m.groupdict().get("vis"))
            if kind == "function":
                if any(a < start < b for a, b in owners):
                    continue
                brace = source.body(m.end())
                end = source.end_of(brace) if brace is not None else _statement_end(source, m.end())
                sign = source.string(name_at, brace if brace is not None else end).strip()
                out.append(symbol(kind, name, (start, end), m.span("name"), sign, vis, "async" in (m["mods"] or "")))
            elif kind in ("struct", "enum", "trait", "module"):
                brace = source.body(m.end())
                end = source.end_of(brace) if brace is not None else _statement_end(source, m.end())
                sign = f"mod {name}" if kind == "module" and brace is None else source.string(name_at, end).strip()
                out.append(symbol(kind, name, (start, end), m.span("name"), sign, vis))
            elif kind == "macro":
                brace = next((i for i in range(m.end(), len(whole.code)) if whole.code[i] in "({["), None)
                end = whole.end_of(brace) if brace is not None else m.end()
                out.append(symbol(kind, name, (start, end), m.span("name"), f"macro_rules! {name}"))
            else:
                if kind == "type_alias" and any(a < start < b for a, b in owners):
                    continue  # an associated type
                end = _statement_end(source, m.end())
                out.append(symbol(kind, name, (start, end), m.span("name"), source.string(start, end).strip(), vis))
    return out


def calls(raw: bytes) -> list[dict]:
    source = _without_macros(_source(raw))
    code = source.code
    fields = []  # bodies of enums and fields of tuple structs: types, not calls
    for kind in ("enum", "struct"):
        for m in _ITEMS[kind].finditer(code):
            brace = source.body(m.end())
            fields.append((m.start(), source.end_of(brace) if brace is not None else _statement_end(source, m.end())))
    written, bare, typed = [], [], within(fields)
    for m in re.finditer(r"\(", code):
        at = m.start()
        if at not in source.close or typed(at):
            continue
        found = callee(source, at, (".", "::"), arguments=True)
        if not found:
            continue
        start, end = found
        name = source.string(start, end)
        last = re.search(r"([A-Za-z_0-9\x80-\xff]+)(?:::<[\s\S]*>)?\s*$", code[start:end])
        if not last or name in _NOT_CALLED or last[1] in _NOT_CALLED or re.search(r"\b(fn|struct|enum)\s+$", last_part(code, start)) or code[end - 1] in "!?":
            continue
        stop = source.close[at] + 1
        head = code[start : start + last.start(1)].rstrip()
        kind = "method" if head.endswith(".") else "associated" if "::" in name else "function"
        written.append((start, stop, call(name, start, stop, kind)))
        if kind == "method":
            bare.append((start, stop, call(last[1], start, stop, "method")))
    return [r[2] for r in in_order(written) + in_order(bare)]


def imports(raw: bytes) -> list[dict]:
    source = _source(raw)
    out = []
    for m in re.finditer(r"(?<![\w])(?:pub(?:\s*\([^)]*\))?\s+)?use\s+([^;]+);", source.code):
        text = source.string(*m.span(1)).strip()
        span = m.start(), m.end()
        if "{" in text:
            base, rest = text.split("{", 1)
            inner, depth, items, part = rest.rsplit("}", 1)[0], 0, [], ""
            for c in inner + ",":
                depth += (c == "{") - (c == "}")
                if c == "," and not depth:
                    item = part.split(" as ")[0].strip()
                    if item and item != "*" and not item.endswith("::*"):
                        items.append(item)
                    part = ""
                else:
                    part += c
            out.append(imported(base.strip().removesuffix("::"), *span, items or None))
        elif " as " in text:
            path, alias = text.split(" as ", 1)
            out.append(imported(path.strip(), *span, None, alias.strip(), "::*" in text))
        else:
            out.append(imported(text, *span, None, None, "::*" in text))
    return out
