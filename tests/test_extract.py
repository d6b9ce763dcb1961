import time

import pytest

from corpusloom.operators.extract import extract_calls, extract_imports, extract_symbols
from corpusloom.operators.languages import EXTRACTORS
from corpusloom.operators.resolve import call_pairs, resolve_calls

SOURCES = {
    "rust": """use std::{io, fmt as f, net::*};
use a::b as c;
/// call()
#[derive(Debug)]
pub struct Point<T> { x: T }
pub(crate) enum E { A, B(u32) }
impl<T: Clone> Shape for Point<T> { fn area(&self) -> f64 { self.x.len(); 0.0 } }
pub async fn fetch_data() -> Result<String, Error> { let s = "no()"; Vec::new(); x.iter().map(|c| c).collect() }
async fn process() { println!("{}", no()); helper() }
""",
    "python": """import os, sys
from .x import (y, z as w)
from m import *
X: int = 3
__v__ = 1
@deco
async def run(a, b=(1, 2)) -> dict:
    "doc no()"
    return obj.m(Foo(1))
class K(Base):
    def m(self): return helper()
""",
    "typescript": """import * as ns from "a"; import { b, c as d } from 'c';
import def from "d"; import "side";
export async function run<T>(x: T): Promise<T> { return `a ${g(x)}`; }
export const go = async (a: number): Promise<void> => { await run(a); };
class K extends Base { m(a) { return new ns.C(1); } }
export interface I extends J { a(x: number): string }
export type U = A | { b: string };
""",
    "go": """package main
import "fmt"
import (
  f "net/http"
  . "dot"
)
type T struct { a int }
type I interface { M(x int) string }
func (t *T) Run(a int) (int, error) { return t.a.b(helper()), nil }
func helper() string { fmt.Println("no()"); return "x" }
""",
}
SYMBOLS = {
    "rust": [("function", "fetch_data", "public", True), ("function", "process", "private", True), ("struct", "Point", "public", False), ("enum", "E", "public_crate", False), ("impl", "Shape for Point<T>", "private", False)],
    "python": [("function", "run", "public", True), ("class", "K", "public", False), ("const", "X", "public", False)],
    "typescript": [("function", "run", "public", True), ("function", "go", "public", True), ("class", "K", "private", False), ("interface", "I", "public", False), ("type_alias", "U", "public", False)],
    "go": [("function", "helper", "private", False), ("method", "Run", "public", False), ("struct", "T", "public", False), ("interface", "I", "public", False)],
}
CALLS = {
    "rust": [("self.x.len", "method"), ("Vec::new", "associated"), ("x.iter().map(|c| c).collect", "method"), ("x.iter().map", "method"), ("x.iter", "method"), ("helper", "function"), ("len", "method"), ("collect", "method"), ("map", "method"), ("iter", "method")],
    "python": [("obj.m", "method"), ("Foo", "constructor"), ("helper", "function")],
    "typescript": [("g", "function"), ("run", "function"), ("ns.C", "constructor")],
    "go": [("t.a.b", "method"), ("helper", "function"), ("fmt.Println", "method")],
}
IMPORTS = {
    "rust": [("std", ["io", "fmt"], None, False), ("a::b", None, "c", False)],
    "python": [("os", None, None, False), (".x", ["y", "z"], None, False), ("m", None, None, True)],
    "typescript": [("a", None, "ns", True), ("c", ["b", "c"], None, False), ("d", None, "def", False), ("side", None, None, False)],
    "go": [("fmt", None, None, False), ("net/http", None, "f", False), ("dot", None, None, True)],
}


@pytest.mark.parametrize("language", SOURCES)
def test_extractors(language):
    raw, x = SOURCES[language].encode(), EXTRACTORS[language]
    assert [(s["kind"], s["name"], s["visibility"], s["is_async"]) for s in x.symbols(raw)] == SYMBOLS[language]
    assert [(c["name"], c["kind"]) for c in x.calls(raw)] == CALLS[language]
    assert [(i["module_path"], i["items"], i["alias"], i["is_wildcard"]) for i in x.imports(raw)] == IMPORTS[language]


@pytest.mark.parametrize("language", EXTRACTORS)
def test_damaged_sources_stay_in_range(language):
    raw, x = SOURCES.get(language, SOURCES["typescript"]).encode(), EXTRACTORS[language]
    for bad in (b"", b"}{)(", b"\xff\xfe'\"`/*", *(raw[:n] for n in range(0, len(raw), 17)), raw[::-1]):
        for f in (x.symbols, x.calls, x.imports):
            assert all(0 <= r["start"] <= r["end"] <= len(bad) for r in f(bad))


def test_signatures():
    rust = EXTRACTORS["rust"].symbols(SOURCES["rust"].encode())
    assert rust[0]["signature"] == "fetch_data() -> Result<String, Error>" and rust[4]["signature"] == "impl<T: Clone> Shape for Point<T>"
    assert EXTRACTORS["python"].symbols(SOURCES["python"].encode())[0]["signature"] == "run(a, b=(1, 2)) -> dict"
    assert [s["signature"] for s in EXTRACTORS["typescript"].symbols(SOURCES["typescript"].encode())][:3] == ["run(x: T): Promise<T>", "go = (a: number): Promise<void> => ...", "K extends Base"]
    assert EXTRACTORS["go"].symbols(SOURCES["go"].encode())[1]["signature"] == "(t *T) Run(a int) (int, error)"


def test_tables_and_resolution(spark):
    rows = [(f"f.{k}", k, v) for k, v in SOURCES.items()] + [("null.py", "python", None), ("odd.x", "cobol", "text")]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    symbols, calls = extract_symbols(files), extract_calls(files)
    assert symbols.count() == sum(map(len, SYMBOLS.values())) and extract_imports(files).count() == sum(map(len, IMPORTS.values()))
    found = {(r["file_path"], r["name"]): r["symbol_id"] for r in resolve_calls(calls, symbols).collect()}
    assert found["f.typescript", "run"] == "sym_f.typescript::run" and found["f.go", "fmt.Println"] is None and found["f.rust", "helper"] == "sym_f.go::helper"
    assert resolve_calls(calls, symbols).count() == calls.count()
    assert ("sym_f.typescript::go", "sym_f.typescript::run") in {tuple(r) for r in call_pairs(calls, symbols).collect()}


def test_deep_nesting_does_not_stop_other_files(spark):
    files = spark.createDataFrame([("deep.py", "python", "x = " + "+".join(["a"] * 5000)), ("ok.py", "python", "def f():\n    pass\n")], "path string, language string, content string")
    assert [r["name"] for r in extract_symbols(files).collect()] == ["f"]


LARGE = {
    "rust": "pub fn run_{i}(x: u32) -> u32 {{\n    println!(\"{{}}\", x);\n    foo::bar(helper(x)).baz({i})\n}}\npub enum E{i} {{ A(u32) }}\n",
    "typescript": "export async function run{i}(x: number): Promise<number> {{\n  return new Thing(await helper(x)).value({i});\n}}\nexport interface I{i} {{ m(a: string): void }}\n",
    "javascript": "function run{i}(x) {{\n  foo.bar(helper(x));\n}}\nconst f{i} = (a) => call(a);\n",
    "go": "func (r *T) Run{i}(x int) int {{\n\ty := helper(x)\n\treturn pkg.Call(y)\n}}\ntype I{i} interface {{\n\tM(int)\n}}\n",
    "python": "def run_{i}(x):\n    return a.b(helper(x))\n\n",
}


@pytest.mark.parametrize("language", LARGE)
def test_time_grows_with_the_size(language):
    x, n = EXTRACTORS[language], (1 << 19) // len(LARGE[language])
    raw = "".join(LARGE[language].format(i=i) for i in range(n)).encode()
    begin = time.process_time()
    symbols, calls = x.symbols(raw), x.calls(raw)
    assert time.process_time() - begin < 20  # two seconds here; minutes if each look back took the whole text
    assert len(symbols) >= n and len(calls) >= 2 * n
    small = LARGE[language].format(i=0).encode()
    assert len(calls) == n * len(x.calls(small)) and len(symbols) == n * len(x.symbols(small))
