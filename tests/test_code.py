"""Parsers and readers of sources, and the analysis from end to end, on small files."""

import pytest

from tesserae.operators import analyze
from tesserae.sources import code, files

RUST = '''
use std::{collections::{HashMap, HashSet as Set}, fmt::*, io::{self, Read}};
/// Adds one.
#[inline]
pub async fn add(a: i64, b: Vec<(u8, u8)>) -> Result<i64, E> {
    if a > 1 && b.is_empty() { helper(a); }
    self::other::call(a)
}
fn helper(x: i64) -> i64 { match x { 1 => 2, _ => { let s = "fn fake() { }"; x } } }
struct P;
impl Display for P { fn fmt(&self) { self.inner(); } }
'''
PYTHON = '''
import os.path
from .pkg import thing as t, other

class A(Base):
    @property
    def x(self):
        """Doc."""
        return self.y() if self.z else t(1)

async def _hidden(a, *, b=1) -> int:
    for i in range(a):
        if i and b or a:
            os.path.join("x")
'''
CASES = [
    ("rust", RUST, [("add", None, True, True, 3.0), ("helper", None, False, False, 2.0), ("fmt", "P", False, False, 1.0)]),
    ("python", PYTHON, [("x", "A", True, False, 2.0), ("_hidden", None, False, True, 5.0)]),
    ("go", 'package m\nimport (\n\t"fmt"\n)\nfunc (s *Server) Run(x int) error {\n\tif x > 0 { fmt.Println(x) }\n\treturn nil\n}\nfunc low() {}\ntype Server struct {}\n', [("Run", "Server", True, False, 2.0), ("low", None, False, False, 1.0)]),
    ("javascript", "import { a, b } from './m';\nexport function f(x) { return g(x); }\nconst h = async (y) => { while (y) { f(y); } };\nclass K extends L { m(z) { this.n(z); } }\n", [("f", None, True, False, 1.0), ("h", None, False, True, 2.0), ("m", "K", False, False, 1.0)]),
    ("java", "import java.util.List;\npublic class A extends B {\n  public int f(List<String> x) { for (String s : x) { g(s); } return 1; }\n  private void g(String s) { }\n}\n", [("f", "A", True, False, 2.0), ("g", "A", False, False, 1.0)]),
    ("csharp", "using System;\nclass A : B { public async Task F(int x) { if (x > 1) { G(); } } private static void G() { } }\n", [("F", "A", True, True, 2.0), ("G", "A", False, False, 1.0)]),
    ("cpp", "#include <vector>\nint add(int a, int b) { return a + b; }\nclass C { void m() { add(1, 2); } };\n", [("add", None, True, False, 1.0), ("m", "C", True, False, 1.0)]),
    ("php", "<?php\nuse App\\Models;\nclass A { public function f($x) { if ($x) { $this->g(); } } private function g() { } }\n", [("f", "A", True, False, 2.0), ("g", "A", False, False, 1.0)]),
    ("dart", "import 'package:a/b.dart';\nclass W extends S { Widget build(BuildContext c) { return Text('x'); } void _p() { } }\n", [("build", "W", True, False, 1.0), ("_p", "W", False, False, 1.0)]),
]


@pytest.mark.parametrize("case", range(len(CASES)), ids=[c[0] for c in CASES])
def test_functions(case):
    language, source, want = CASES[case]
    got = code.parse("f", language, source)
    assert got["error"] is None
    assert [(f["name"], f["container"], f["is_public"], f["is_async"], f["complexity"]) for f in got["functions"]] == want
    assert got["imports"]


def test_facts_of_functions():
    add, helper, fmt = code.parse("f", "rust", RUST)["functions"]
    assert (add["doc"], add["decorators"], add["params"], add["returns"], add["line"]) == ("Adds one.", ["#[inline]"], ["a: i64", "b: Vec<(u8, u8)>"], ["Result<i64, E>"], 5)
    assert [(c["kind"], c["name"]) for c in add["calls"]] == [("OnReceiver", "is_empty"), ("Bare", "helper"), ("Qualified", "call")]
    assert fmt["trait_impl"] == "Display" and [c["kind"] for c in fmt["calls"]] == ["SelfMethod"]
    assert helper["calls"] == []  # what stands in a string isn't code
    x, hidden = code.parse("f", "python", PYTHON)["functions"]
    assert x["doc"] == "Doc." and x["decorators"] == ["@property"] and [(c["kind"], c["qualifier"], c["name"]) for c in x["calls"]] == [("SelfMethod", "self", "y"), ("Bare", None, "t")]
    assert hidden["params"] == ["a", "b"] and hidden["returns"] == ["int"]


def test_imports_and_types():
    rust = code.parse("f", "rust", RUST)
    assert {(i["module"], tuple(i["items"])) for i in rust["imports"]} == {("std::collections", ("HashMap", "Set")), ("std::fmt", ("*",)), ("std::io", ("io", "Read"))}
    python = code.parse("f", "python", PYTHON)
    assert [(i["module"], i["items"]) for i in python["imports"]] == [("os.path", []), (".pkg", ["t", "other"])]
    assert python["types"] == [{"name": "A", "kind": "class", "line": 5, "supers": ["Base"]}]
    assert code.parse("f", "python", "def (")["error"].startswith("SyntaxError")
    assert code.parse("f", "javascript", "import { a, b } from './m';")["imports"] == [{"module": "./m", "items": ["a", "b"], "line": 1}]


def test_golden_project(spark):
    source = "pub fn main() { helper(); }\nfn helper() { }\nfn unused() { }\n"
    df = spark.createDataFrame([("p/lib_a.rs", "rust", source), ("p/bad.py", "python", "def ("), ("p/empty.py", "python", "")], "path string, language string, source string")
    f, e = analyze.facts(df)
    rows = {r.name: r for r in f.collect()}
    assert sorted(rows) == ["helper", "main", "unused"]
    assert [(r.src, r.dst, r.method, r.line) for r in e.collect()] == [("p/lib_a.rs::main", "p/lib_a.rs::helper", "same_file", 1)]
    assert {n for n, r in rows.items() if r.reachable} == {"main", "helper"} and rows["helper"].depth == 1
    v = {r.node: r for r in analyze.verdicts_of(df).collect()}
    assert v["p/lib_a.rs::main"].state == "DefinitelyAlive" and v["p/lib_a.rs::unused"].recommendation == "SafeToDelete"


def test_calls_across_files(spark):
    df = spark.createDataFrame([("a.py", "python", "from util import go\ndef top():\n    go()\n"), ("util.py", "python", "def go():\n    pass\n"), ("other.py", "python", "def go():\n    pass\n")], "path string, language string, source string")
    _, e = analyze.facts(df)
    assert [(r.src, r.dst, r.method) for r in e.collect()] == [("a.py::top", "util.py::go", "import")]


PROJECT = {
    "src/store.rs": "pub struct Store;\nimpl Store { pub fn new() -> Store { Store }\n fn load(&self) { self.open(); }\n fn open(&self) { } }\n",
    "src/cache.rs": "pub struct Cache;\nimpl Cache { fn load(&self) { } }\nfn warm(c: &Cache) { c.load(); }\n",
    "src/main.rs": "use crate::store::Store;\nuse crate::tools::*;\nuse crate::names;\nfn main() { let s = Store::new(); s.load(); tidy(); names::shout(); missing(); }\n",
    "src/tools.rs": "fn tidy() { }\nfn shout() { }\n",
    "src/other.rs": "fn tidy() { }\n",
    "src/names.rs": "fn shout() { }\n",
}


def test_members_are_resolved(spark):
    df = spark.createDataFrame([(p, "rust", s) for p, s in PROJECT.items()], "path string, language string, source string")
    _, edges = analyze.facts(df)
    got = {(r.src.replace("src/", ""), r.dst.replace("src/", ""), r.method) for r in edges.collect()}
    assert got == {
        ("main.rs::main", "store.rs::Store::new", "qualified"), ("main.rs::main", "store.rs::Store::load", "receiver"), ("main.rs::main", "tools.rs::tidy", "wildcard"), ("main.rs::main", "names.rs::shout", "module_alias"),
        ("store.rs::Store::load", "store.rs::Store::open", "scope"), ("cache.rs::warm", "cache.rs::Cache::load", "receiver"),
    }


def test_overloads_dynamic_references_and_frameworks_count(spark):
    rows = [
        ("src/A.java", "java", "class A { private void f(int x) { } private void f(String s) { } private void g() { } private void h() { } }\n"),
        ("src/b.py", "python", "def _called():\n    pass\n\ndef _other():\n    return getattr(x, '_called')\n\n@app.route('/')\ndef _page():\n    return _made()\n\ndef _made():\n    return 1\n"),
    ]
    v = {r.node.rpartition("::")[2]: r for r in analyze.verdicts_of(spark.createDataFrame(rows, "path string, language string, source string")).collect()}
    assert {"f@1", "f@2", "g", "h", "_called", "_other", "_page", "_made"} == set(v)
    assert v["_called"].state == "DefinitelyAlive" and v["_called"].recommendation == "DoNotDelete"
    assert v["_made"].reachable and not v["_other"].reachable


def test_import_candidates(spark):
    files = ["web/src/util/a.ts", "web/src/lib/index.js", "web/b.jsx", "web/src/c.tsx", "web/src/util/c.ts"]
    asked = [("web/src/util/x.ts", "./a"), ("web/src/util/x.ts", "../lib"), ("web/src/util/x.ts", "'@/c'"), ("web/src/util/x.ts", "~/b"), ("web/src/util/x.ts", "react"), ("web/src/util/x.ts", "./nothing"), ("x.ts", "../../y")]
    from tesserae.operators import resolve

    df = spark.createDataFrame(asked, "src string, target string")
    got = {(r.src, r.dst) for r in resolve.relative_imports(df, spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == {("web/src/util/x.ts", f) for f in ("web/src/util/a.ts", "web/src/lib/index.js", "web/src/util/c.ts", "web/b.jsx")}


def test_scan(spark, tmp_path):
    for name, text in {"src/a.rs": "fn a() {}", "src/b.txt": "no", "node_modules/c.js": "x", "src/d.min.js": "x", "src/e.py": "", "src/f.go": "y" * 50, "src/skipme/g.py": "z"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.scan(spark, str(tmp_path), files.ScanConfig(most_bytes=20, exclude=("/skipme/",))).collect()
    assert [(r.path.rpartition("/")[2], r.language, r.source) for r in got] == [("a.rs", "rust", "fn a() {}")]


def test_records(spark, tmp_path):
    (tmp_path / "log").write_text("@h1|Ann|1700000000\n\n3\t1\tsrc/a.rs\n-\t-\timg.png\n@h2|Bob, J|1700000100\n\n1\t0\tsrc/a.rs\n")
    got = sorted(map(tuple, files.commits(spark, str(tmp_path / "log")).select("file", "hash", "author", "added", "removed").collect()))
    assert got == [("img.png", "h1", "Ann", 0, 0), ("src/a.rs", "h1", "Ann", 3, 1), ("src/a.rs", "h2", "Bob, J", 1, 0)]
    (tmp_path / "ledger.json").write_text('[{"id": "a", "confidence": 0.5},\n {"id": "b", "outcome": "Kept"}]')
    assert sorted((r.id, r.outcome) for r in files.ledger(spark, str(tmp_path / "ledger.json")).collect()) == [("a", "Pending"), ("b", "Kept")]
    (tmp_path / "lines.json").write_text('{"id": "a"}\n\n{"id": "b", "outcome": "Removed"}\n{"id": "c"}\n')
    assert sorted((r.id, r.outcome) for r in files.ledger(spark, str(tmp_path / "lines.json")).collect()) == [("a", "Pending"), ("b", "Removed"), ("c", "Pending")]
    (tmp_path / "log2").write_text("@h3|Eve | Sons|1700000000\n\n3\t1\tsrc/a.rs\n")
    assert [r.author for r in files.commits(spark, str(tmp_path / "log2")).collect()] == ["Eve | Sons"]
    (tmp_path / "repo1.jsonl").write_text('{"full_path": "x", "label": "Dead"}\n{"full_path": "y", "repository_id": "r"}\n')
    assert sorted((r.full_path, r.repository_id, r.label, r.confidence) for r in files.examples(spark, str(tmp_path / "repo1.jsonl")).collect()) == [("x", "repo1", "Dead", 1.0), ("y", "r", "Unknown", 1.0)]


def test_comments(spark):
    df = spark.createDataFrame([("a.rs", "rust", "/// doc\n// TODO x\nfn f() {} /* b\nc */ /** d */"), ("b.py", "python", 'x = 1  # one\n"""Doc."""\n')], "path string, language string, source string")
    got = sorted(map(tuple, code.comments(df).collect()))
    assert got == sorted([("a.rs", "doc", "doc"), ("a.rs", "line", "TODO x"), ("a.rs", "block", "b\nc"), ("a.rs", "doc", "d"), ("b.py", "line", "one"), ("b.py", "doc", "Doc.")])


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from pyspark.sql import SparkSession

    from tesserae.__main__ import main

    monkeypatch.setattr(SparkSession.builder, "appName", lambda name: SparkSession.builder)
    body = "\n".join(f"    let v{i} = call{i}(x, y, {i});" for i in range(8))
    (tmp_path / "a.rs").write_text(f"pub fn main() {{ used(1); }}\nfn used(x: i64) {{\n{body}\n}}\nfn copied(x: i64) {{\n{body}\n}}\n")
    assert main(["deadcode", str(tmp_path)]) == 0 and '"a.rs::copied"' in capsys.readouterr().out.replace(f"file:{tmp_path}/", "")
    assert main(["check", str(tmp_path)]) == 1 and main(["check", str(tmp_path), "--max-dead", "1"]) == 0
    capsys.readouterr()
    assert main(["dedup", str(tmp_path)]) == 0 and '"size":2' in capsys.readouterr().out
    for command in ("analyze", "list", "important", "graph", "report", "stats"):
        assert main([command, str(tmp_path)]) == 0 and capsys.readouterr().out
