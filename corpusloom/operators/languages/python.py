"""Python by the standard library's parser; files it rejects are read line by line."""

from __future__ import annotations

import ast
import re

from corpusloom.operators.languages.scan import call, imported, in_order, symbol


class _File:
    def __init__(self, raw: bytes):
        self.raw = raw
        self.tree = ast.parse(raw)
        self.lines = [0]
        for line in re.findall(rb"[^\n]*\n", raw):
            self.lines.append(self.lines[-1] + len(line))

    def at(self, line: int, column: int) -> int:
        return self.lines[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def text(self, start: int, end: int) -> str:
        return self.raw[start:end].decode("utf-8", "replace")

    def node(self, node: ast.AST) -> str:
        return self.text(*self.span(node))


def _open(raw: bytes) -> _File | None:
    try:
        return _File(raw)
    except (SyntaxError, ValueError, RecursionError):
        return None


def _bracket(raw: bytes, at: int) -> int:
    """The end of the bracketed text that begins at at; literals and comments don't count."""
    depth, i = 0, at
    token = re.compile(rb"#[^\n]*|'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|[()\[\]{}]")
    while m := token.search(raw, i):
        depth += (m[0] in (b"(", b"[", b"{")) - (m[0] in (b")", b"]", b"}"))
        i = m.end()
        if not depth:
            return i
    return len(raw)


def symbols(raw: bytes) -> list[dict]:
    f = _open(raw)
    if f is None:
        return _loose_symbols(raw)
    functions, classes, constants = [], [], []

    def walk(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if not in_class:
                    span = f.span(child)
                    head = re.compile(rb"(?:async\s+)?def\s+").match(raw, span[0])
                    name = head.end(), head.end() + len(child.name.encode())
                    start = raw.index(b"(", name[1])
                    returns = f" -> {f.node(child.returns)}" if child.returns else ""
                    sign = child.name + f.text(start, _bracket(raw, start)) + returns
                    functions.append(symbol("function", child.name, span, name, sign, "public", isinstance(child, ast.AsyncFunctionDef)))
                walk(child, in_class)
            elif isinstance(child, ast.ClassDef):
                span = f.span(child)
                head = re.compile(rb"class\s+").match(raw, span[0])
                name = head.end(), head.end() + len(child.name.encode())
                after = re.compile(rb"\s*").match(raw, name[1]).end()
                bases = f.text(after, _bracket(raw, after)) if raw[after : after + 1] == b"(" else ""
                classes.append(symbol("class", child.name, span, name, child.name + bases, "public"))
                walk(child, True)
            else:
                walk(child, in_class)

    walk(f.tree, False)
    for child in f.tree.body:
        target = child.target if isinstance(child, ast.AnnAssign) else child.targets[0] if isinstance(child, ast.Assign) else None
        if isinstance(target, ast.Name) and not (target.id.startswith("__") and target.id.endswith("__") and target.id != "__all__"):
            kind = f": {f.node(child.annotation)}" if isinstance(child, ast.AnnAssign) else ""
            constants.append(symbol("const", target.id, f.span(child), f.span(target), target.id + kind, "public"))
    return functions + classes + constants


def _loose_symbols(raw: bytes) -> list[dict]:
    """Definitions of a file that doesn't parse, each up to the next line that isn't indented deeper."""
    text, out, classes = raw.decode("latin-1"), [], []
    for m in re.finditer(r"(?m)^(?P<indent>[ \t]*)(?P<head>(?P<async>async\s+)?(?P<what>def|class)\s+)(?P<name>[A-Za-z_\x80-\xff][\w\x80-\xff]*)(?P<rest>\([^:]*\)(?:\s*->[^:\n]*)?)?", text):
        inner = re.compile(rf"(?m)^(?!{m['indent']}[ \t]|\s*$|\s*#)").search(text, text.find("\n", m.end()) + 1 or len(text))
        end = len(text[: inner.start() if inner else len(text)].rstrip())
        start = m.start("head")
        name = m["name"].encode("latin-1").decode("utf-8", "replace")
        sign = (m["name"] + re.sub(r"\s+->", " ->", m["rest"] or "")).encode("latin-1").decode("utf-8", "replace")
        if m["what"] == "class":
            classes.append(symbol("class", name, (start, end), m.span("name"), sign, "public"))
        elif not any(c["start"] < start < c["end"] and len(m["indent"]) for c in classes):
            out.append(symbol("function", name, (start, end), m.span("name"), sign, "public", bool(m["async"])))
    return out + classes


def calls(raw: bytes) -> list[dict]:
    f = _open(raw)
    if f is None:
        return []
    out = []
    for node in ast.walk(f.tree):
        if isinstance(node, ast.Call):
            start, end = f.span(node)
            name = f.node(node.func)
            kind = "method" if isinstance(node.func, ast.Attribute) else "constructor" if name[:1].isupper() else "function"
            out.append((start, end, call(name, start, end, kind)))
    return [r[2] for r in in_order(out)]


def imports(raw: bytes) -> list[dict]:
    """Plain imports (the first module of each) and then those by from, in order."""
    f = _open(raw)
    if f is None:
        return []
    plain, named = [], []
    for node in sorted((n for n in ast.walk(f.tree) if isinstance(n, (ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset)):
        span = f.span(node)
        if isinstance(node, ast.Import):
            plain.append(imported(node.names[0].name, *span, None, node.names[0].asname))
        else:
            module = "." * node.level + (node.module or "") or "."
            star = any(a.name == "*" for a in node.names)
            named.append(imported(module, *span, None if star else [a.name for a in node.names], None, star))
    return plain + named
