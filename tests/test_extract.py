"""Parsers on literal documents."""

import json

import pytest

from granary.sources import extract as X


def test_rows_of(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [{"c": 1}]}, "d": null}'), (2, "{broken"), (3, None)], "id long, text string")
    got = X.rows_of(df, ["id"], "text", X.tree_keys(4), X.KEYS).orderBy("id", "n").collect()
    assert [(r.id, r.key, r.depth, r.kind) for r in got if r.error is None] == [(1, "a", 1, "object"), (1, "a.b", 2, "array"), (1, "a.b[0].c", 4, "number"), (1, "d", 1, "null")]
    assert [(r.id, r.error[:15]) for r in got if r.error] == [(2, "JSONDecodeError")]
    assert X.rows_of(df, ["id"], "text", X.tree_keys(), X.KEYS, empty=True).where("id = 3").count() == 1
    assert X.value_at({"a": {"b": [{"c": 5}]}}, "a.b[0].c") == 5 and X.value_at([1], "") == [1]
    with pytest.raises((KeyError, IndexError)):
        X.value_at({"a": []}, "a[0]")


def test_markdown():
    text = "# One\ntext\n```\n# not\n```\n## `Two` #\nx\n~~~\n```\n# no\n~~~\n# Three\n#no space\n####### seven"
    assert X.markdown_headings(text) == [(1, "One", "one", 1, 11), (2, "Two", "two", 6, 11), (1, "Three", "three", 12, 14)]
    assert X.section(text, "two").startswith("## `Two`") and X.section(text, "none") is None


def test_code():
    py = "class A:\n    def f(self):\n        return 1\n\ndef g(x) -> int:\n    return x\n"
    assert X.code_symbols("py")(py) == [("class", "A", "class A", 1, 3), ("method", "f", "def f(self)", 2, 3), ("function", "g", "def g(x) -> int", 5, 6)]
    rs = 'pub fn a(x: u8) -> u8 {\n    let s = "}";\n    x\n}\nstruct B;\nimpl B {\n}\n'
    assert X.code_symbols("rs")(rs) == [("function", "a", "pub fn a(x: u8) -> u8", 1, 4), ("struct", "B", "struct B;", 5, 5), ("impl", "B", "impl B", 6, 7)]
    ts = "export const f = async (x) => {\n}\nexport interface I {\n a: string\n}\ntype T = string;"
    assert [(k, n, a, b) for k, n, _, a, b in X.code_symbols("ts")(ts)] == [("function", "f", 1, 2), ("interface", "I", 3, 5), ("type", "T", 6, 6)]
    assert X.api_surface("py")("def _a(): pass\ndef b(): pass\nclass C: pass") == [("b", "function", 2, "public"), ("C", "class", 3, "public")]
    assert X.api_surface("go")("func A() {}\nfunc b() {}\n") == [("A", "function", 1, "public")]
    assert X.api_surface("rs", True)("pub(crate) fn a() {}\nfn b() {}\npub struct C;") == [("a", "function", 1, "crate"), ("C", "struct", 3, "public")]
    assert X.imports('from a.b import c\nimport d\nuse x::y;\nimport { z } from "./z"\nconst q = require("q")\nimport (\n  "fmt"\n)') == [
        ("from a.b import c", "a.b"), ("import d", "d"), ("use x::y;", "x::y"), ('import { z } from "./z"', "./z"), ('const q = require("q")', "q"), ('"fmt"', "fmt"),
    ]


@pytest.mark.parametrize(
    ("ext", "text", "want"),
    [
        ("cs", "namespace N {\n  public sealed class A {\n    public int Get(int x) => x;\n    public static void Run(\n        string a,\n        string b)\n    {\n    }\n  }\n}", [("class", "A", 2, 9), ("method", "Get", 3, 3), ("method", "Run", 4, 8)]),
        ("kt", "data class P(val a: Int)\nfun main() {\n}\nobject O {\n}", [("class", "P", 1, 1), ("function", "main", 2, 3), ("object", "O", 4, 5)]),
        ("rb", "module M\n  class C\n    def go?(x)\n      if x\n      end\n    end\n  end\nend", [("module", "M", 1, 8), ("class", "C", 2, 7), ("method", "go?", 3, 6)]),
        ("php", "<?php\nclass A {\n  public function run() {\n  }\n}\nfunction f() {}", [("class", "A", 2, 5), ("function", "run", 3, 4), ("function", "f", 6, 6)]),
        ("swift", "protocol P {\n}\npublic struct S {\n  func go() -> Int {\n  }\n}", [("protocol", "P", 1, 2), ("struct", "S", 3, 6), ("function", "go", 4, 5)]),
        ("cpp", "namespace n {\nclass A {\n};\n}\nint main(int argc, char** argv) {\n  return f(1);\n}\nvoid A::go() {\n}", [("namespace", "n", 1, 4), ("class", "A", 2, 3), ("function", "main", 5, 7), ("function", "A::go", 8, 9)]),
        ("lua", "local function a()\n  if x then\n  end\nend\nM.b = function(y)\nend", [("function", "a", 1, 4), ("function", "M.b", 5, 6)]),
        ("java", "public class A {\n    @Override\n    public String name(int a,\n        int b) {\n    }\n}", [("class", "A", 1, 6), ("method", "name", 3, 5)]),
    ],
)
def test_grammars(ext, text, want):
    assert [(k, n, a, b) for k, n, _, a, b in X.code_symbols(ext)(text)] == want


def test_signatures_and_docstrings():
    py = 'def f(a,\n      b: int = 3) -> int:\n    """\n    def no():\n    """\n    return a\n'
    assert X.code_symbols("py")(py) == [("function", "f", "def f(a, b: int = 3) -> int", 1, 6)]
    rs = "pub fn a(\n    x: u8,\n) -> u8 {\n    x\n}"
    assert X.code_symbols("rs")(rs) == [("function", "a", "pub fn a( x: u8, ) -> u8", 1, 5)]


def test_fences_setext_and_sections():
    text = "````\n```\n# not\n````\n# Yes\nTitle\n=====\nbody\nTwo\n---\n\n---\n- item\n---\nend"
    assert X.markdown_headings(text) == [(1, "Yes", "yes", 5, 5), (1, "Title", "title", 6, 15), (2, "Two", "two", 9, 15)]
    md = "# A\none\n## B\ntwo\n# C"
    assert X.sections(["c", "none", "b"])(md) == [("c", "C", "# C"), ("b", "B", "## B\ntwo")]


def test_deps_resolve():
    assert X.code_deps("src/a/b.ts")('import { x, y as z } from "../c"\nimport "lib"') == [('import { x, y as z } from "../c"', "../c", "src/c.ts", "x,y"), ('import "lib"', "lib", None, "")]
    assert X.code_deps("p/q/m.py")("from ..r import s, t\nimport os.path") == [("from ..r import s, t", "..r", "p/r.py", "s,t"), ("import os.path", "os.path", "os/path.py", "")]


def test_nested_marked_tests():
    rs = "mod a {\n    #[test]\n    fn x() {\n    }\n}\n#[test]\n\nfn no() {}\n#[test]\nfn y() {}"
    assert X.test_skeleton("rust")(rs) == [(0, "suite", "a", 1), (1, "test", "x", 3), (0, "test", "y", 10)]
    assert X.test_results("auto")("PASS: one\nFAIL - two") == [("", "one", "passed"), ("", "two", "failed")]
    assert X.test_results("auto")("a.py::t PASSED") == [("a.py", "t", "passed")]


def test_stack_frames():
    text = 'Traceback\n  File "a.py", line 3, in f\n  File "a.py", line 3, in f\n    at go (/x/b.js:10:5)\n    at com.x.Y.z(Y.java:7)\n  at src/m.rs:5:1\n\tmain.go:12 +0x1'
    assert X.stack_frames(text) == [("a.py", 3, "f"), ("/x/b.js", 10, "go"), ("Y.java", 7, "com.x.Y.z"), ("src/m.rs", 5, None), ("main.go", 12, None)]


def test_definitions():
    assert X.proto("message M {\n  repeated string a = 1; // x\n}\nservice S {\n  rpc Get (Q) returns (R);\n}\nenum E {\n  Z = 0;\n}") == [("M", "field", "a", "repeated string"), ("S", "rpc", "Get", "(Q) → (R)"), ("E", "value", "Z", "0")]
    assert X.graphql("type T {\n  a(x: Int): String! # c\n  b: [Int],\n}\nenum E {\n  ONE\n}") == [("T", "field", "a", "(x: Int)String!"), ("T", "field", "b", "[Int]"), ("E", "value", "ONE", "")]
    assert X.css("@import 'x';\n.a, .b { color: red; margin: 0 }\n@media p { .c { d: e } }\n#d{}") == [(".a, .b", "rule", "", "2"), ("#d", "rule", "", "0")]
    assert X.openapi("paths:\n  /u:\n    post:\n      summary: s\n      parameters:\n        - {name: id, in: query, required: true}\n      responses:\n        200: {description: ok}\n") == [("/u", "post", "summary", "s"), ("/u", "post", "id", "id (query, required)"), ("/u", "post", "200", "200 ok")]
    assert X.db_schema("CREATE TABLE IF NOT EXISTS t (id INT PRIMARY KEY, n DECIMAL(1,2), -- c\n PRIMARY KEY (id));\nmodel U {\n  id Int @id\n  @@index([id])\n}") == [("U", "column", "id", "Int"), ("t", "column", "id", "INT"), ("t", "column", "n", "DECIMAL(1,2)")]
    assert X.env("# the port\nPORT=80\n\n# lost\n\nKEY=\nexport PORT=9") == [("PORT", "80", False, "the port"), ("KEY", None, True, None)]
    assert X.notebook(json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"], "outputs": [{}]}, {"cell_type": "markdown", "source": "# x"}]})) == [("code", "a", 2, 1, None), ("markdown", "# x", 1, 0, None)]
    assert X.notebook(json.dumps({"cells": [{"cell_type": "code", "source": "", "outputs": [{"text": ["x\n", "y"]}, {"traceback": ["E", "F"]}]}]}))[0][4] == "x\ny\nE\nF"


@pytest.mark.parametrize(
    ("name", "text", "want"),
    [
        ("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}, "peerDependencies": {"c": "3"}}', [("a", "1", "runtime"), ("b", "2", "dev"), ("c", "3", "optional")]),
        ("Cargo.toml", '[dependencies]\na = "1"\nb = {path = "x"}\n[build-dependencies]\nc = {version = "2"}', [("a", "1", "runtime"), ("b", "*", "runtime"), ("c", "2", "build")]),
        ("pyproject.toml", '[tool.poetry.dependencies]\npython = "3"\na = "^1"\n[tool.poetry.group.dev.dependencies]\nb = "2"', [("a", "^1", "runtime"), ("b", "2", "dev")]),
        ("pyproject.toml", '[project]\ndependencies = ["a>=1", "b"]\n[project.optional-dependencies]\ntest = ["c"]', [("a", ">=1", "runtime"), ("b", "*", "runtime"), ("c", "*", "dev")]),
        ("requirements.txt", "# c\n-r x\na==1\nb[x]>2", [("a", "==1", "runtime"), ("b", "[x]>2", "runtime")]),
        ("go.mod", "require (\n\tx/y v1.0.0\n\tz v2 // indirect\n)\nrequire q v3", [("x/y", "v1.0.0", "runtime"), ("z", "v2", "optional"), ("q", "v3", "runtime")]),
        ("pom.xml", "<dependency><artifactId>a</artifactId><version>1</version><scope>test</scope></dependency>", [("a", "1", "dev")]),
        ("build.gradle", "  testImplementation 'g:a:1'\n  api(\"g:b\")", [("g:a", "1", "dev"), ("g:b", "*", "runtime")]),
    ],
)
def test_manifests(name, text, want):
    assert X.manifest(name)(text) == want


def test_pipelines():
    github = "on: push\njobs:\n  b:\n    needs: a\n    steps:\n      - uses: x@v1\n      - name: N\n        run: echo ${{ secrets.K }}\n      - run: |\n          one\n          two\n"
    assert X.pipeline("github")(github) == [("b", "a", 0, "uses: x@v1", ""), ("b", "a", 1, "N", "secrets.K"), ("b", "a", 2, "run: one", "")]
    assert X.pipeline("gitlab")("stages: [a]\nj:\n  script:\n    - x\n    - y\n") == [("j", "", 0, "x", ""), ("j", "", 1, "y", "")]
    assert X.pipeline("circleci")("jobs:\n  j:\n    steps: [checkout, {run: x}]\nworkflows:\n  version: 2\n  w:\n    jobs: [{j: {requires: [k]}}, missing]\n") == [("j", "k", 0, "checkout", ""), ("j", "k", 1, "run", "")]


def test_audits():
    npm = {"vulnerabilities": {"a": {"severity": "high", "range": "<2", "fixAvailable": {"version": "2"}, "via": ["x", {"url": "u", "title": "t"}]}}}
    assert X.audit("npm")(json.dumps(npm)) == [("a", "high", "u", "<2", "2", "t")]
    cargo = {"vulnerabilities": {"list": [{"advisory": {"id": "R", "title": "t", "cvss": "9.8"}, "package": {"name": "a", "version": "1"}, "versions": {"patched": [">=2"]}}, {"advisory": {"cvss": "CVSS:3.1/AV:N"}, "package": {"name": "b"}}]}}
    assert [r[:2] for r in X.audit("cargo")(json.dumps(cargo))] == [("a", "critical"), ("b", "unknown")]
    assert X.audit("pip")(json.dumps([{"name": "a", "version": "1", "vulns": [{"id": "V", "fix_versions": ["2", "3"]}]}])) == [("a", "unknown", "V", "1", "2, 3", "")]
    osv = {"results": [{"packages": [{"package": {"name": "a", "version": "1"}, "groups": [{"max_severity": "5.0"}], "vulnerabilities": [{"id": "G", "summary": "s"}]}]}]}
    assert X.audit("osv")(json.dumps(osv)) == [("a", "moderate", "G", "1", None, "s")]


def test_diagnostics():
    cargo = json.dumps({"reason": "compiler-message", "message": {"level": "error", "code": {"code": "E1"}, "message": "m", "spans": [{"file_name": "a", "line_start": 1, "column_start": 2, "is_primary": False}, {"file_name": "b", "line_start": 3, "column_start": 4, "is_primary": True}]}})
    assert X.diagnostics("cargo")(cargo + "\nnoise") == [("b", 3, 4, "error", "E1", "m")]
    assert X.diagnostics("tsc")("a.ts(1,2): error TS1: m") == [("a.ts", 1, 2, "error", "TS1", "m")]
    assert X.diagnostics("mypy")("a.py:3: error: bad  [arg-type]\na.py:4:5: note: n") == [("a.py", 3, 0, "error", "arg-type", "bad"), ("a.py", 4, 5, "hint", None, "n")]
    assert X.diagnostics("govet")("vet: x.go:1:2: m") == [("x.go", 1, 2, "error", None, "m")]
    assert X.diagnostics("pyright")(json.dumps({"generalDiagnostics": [{"file": "a", "severity": "error", "message": "x\ny", "rule": "r", "range": {"start": {"line": 0, "character": 4}}}]})) == [("a", 1, 5, "error", "r", "x y")]


def test_test_reports():
    assert X.test_results("cargo")("Running src/lib.rs (x)\ntest a ... ok\ntest b ... FAILED") == [("src/lib.rs", "a", "passed"), ("src/lib.rs", "b", "failed")]
    assert X.test_results("pytest")("t/a.py::x PASSED [ 1%]\nt/a.py::T::y FAILED") == [("t/a.py", "x", "passed"), ("t/a.py", "T::y", "failed")]
    assert X.test_results("jest")("PASS a.test.js\n  ✓ works (3 ms)\n  ✕ breaks\n  ○ later") == [("a.test.js", "works", "passed"), ("a.test.js", "breaks", "failed"), ("a.test.js", "later", "skipped")]
    assert X.test_results("go")("--- PASS: A (0.0s)\nok  \tp/q\t0.1s\n--- FAIL: B (0s)\nFAIL\tp/r\t0.1s") == [("p/q", "A", "passed"), ("p/r", "B", "failed")]


def test_test_skeletons():
    assert X.test_skeleton("jest")("describe('a', () => {\n  it('b', () => {\n  describe('c', () => {\n    test('d', x)") == [(0, "suite", "a", 1), (1, "test", "b", 2), (1, "suite", "c", 3), (2, "test", "d", 4)]
    assert X.test_skeleton("pytest")("class TestA:\n\n    def test_x(self):\n        pass\n\ndef test_y():\n    pass") == [(0, "suite", "TestA", 1), (1, "test", "test_x", 3), (0, "test", "test_y", 6)]
    assert X.test_skeleton("rust")("#[test]\nfn a() {}\n#[tokio::test]\nasync fn b() {}\n#[test]\n\nfn c() {}") == [(0, "test", "a", 2), (0, "test", "b", 4)]
    assert X.test_skeleton("go")("func TestA(t *T) {}\nfunc x() {}") == [(0, "test", "TestA", 1)]
    assert X.test_skeleton("junit")("@Test\n  public void a() {") == [(0, "test", "a", 2)]


def test_coverage_reports():
    assert X.coverage("lcov")("SF:a\nDA:1,2\nDA:2,0\nend_of_record") == [("a", 1, True), ("a", 2, False)]
    assert X.coverage("coverage.py")(json.dumps({"files": {"a": {"executed_lines": [2], "missing_lines": [1]}}})) == [("a", 1, False), ("a", 2, True)]
    assert X.coverage("cobertura")('<c><class filename="a"><lines><line number="1" hits="0"/></lines></class></c>') == [("a", 1, False)]


def test_types_and_conformance():
    assert X.type_skeleton("ts")("interface I {\n  a: string;\n  f(x: number): void\n}\nenum E {\n  ONE,\n}") == [("I", "interface", "a", "string", 2), ("I", "interface", "f", "void", 3), ("E", "enum", "ONE", "", 6)]
    assert X.type_skeleton("go")("type T struct {\n\tA int `json:\"a\"`\n}") == [("T", "struct", "A", "int", 2)]
    assert X.type_skeleton("rs")("pub struct S {\n    pub a: Vec<u8>,\n    b: u8,\n}") == [("S", "struct", "a", "Vec<u8>", 2), ("S", "struct", "b", "u8", 3)]
    assert X.conforms_to("Shape", "ts")("class A implements Shape, B {\n}\nclass C extends D {}\ninterface E extends Shape {}") == [("A", "interface", 1), ("E", "interface", 4)]
    assert X.conforms_to("Draw", "rs")("impl Draw for Circle {}\nimpl<T> x::Draw<T> for Box {}") == [("Circle", "interface", 1), ("Box", "interface", 2)]
    assert X.conforms_to("Base", "py")("class A(Base, X):\n    pass") == [("A", "interface", 1)]


def test_outlines():
    assert X.outline("a/README.md")("# A\n## B") == [("h1", "A", 1), ("h2", "B", 2)]
    assert X.outline("x.json")('{"a": {"b": 1}}') == [("object", "a", 0), ("number", "a.b", 0)]
    assert X.outline("m.py")("def f():\n    pass") == [("function", "f", 1)]
    assert X.outline("Makefile")("all:") == [("unknown", None, None)]


def test_docx():
    import io
    import zipfile

    from granary.sources import web

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", body)
    assert web.docx_markdown(buffer.getvalue()) == "## Title\n\na b"
    assert web.docx_markdown(b"no zip") is None and web.docx_markdown(None) is None


def test_compact_text():
    from granary.functions import render

    tree = {"a": 1, "none": None, "rows": [{"x": 1, "y": "p"}, {"x": 2, "z": True}], "tags": ["u", "v"], "deep": {"k": [], "v": "t"}}
    assert render.compact(tree) == "a: 1\nrows:\n  x | y | z\n  1 | p | \n  2 |  | true\ntags: u, v\ndeep:\n  v: t"


def test_yaml_is_read_by_the_compiled_loader():
    import time

    import yaml

    text = "openapi: 3.0.0\npaths:\n" + "".join(f"  /p{i}:\n    get:\n      summary: part {i}\n      responses:\n        200: {{description: ok}}\n" for i in range(400))
    at = time.perf_counter()
    got = X.openapi(text)
    fast = time.perf_counter() - at
    at = time.perf_counter()
    want = yaml.safe_load(text)
    assert len(got) == 800 and [g[0] for g in got[::2]] == list(want["paths"]) and 2 * fast < time.perf_counter() - at


def test_rows_keep_long_keys_beside_nulls_and_leave_in_order(spark):
    df = spark.createDataFrame([(None, "a,b"), ((1 << 53) + 1, ",".join(map(str, range(9000)))), (2, None), (3, "!")], "k bigint, t string")

    def parse(text):
        if text == "!":
            raise ValueError("odd")
        return [(x,) for x in text.split(",")]

    got = X.rows_of(df, ["k"], "t", parse, "x string").collect()
    assert [(r.k, r.n, r.x) for r in got if r.k == (1 << 53) + 1] == [((1 << 53) + 1, i, str(i)) for i in range(9000)]
    assert [tuple(r) for r in got if r.k != (1 << 53) + 1] == [(None, 0, "a", None), (None, 1, "b", None), (3, None, None, "ValueError: odd")]
    assert [tuple(r) for r in X.rows_of(df.where("k = 2"), ["k"], "t", parse, "x string", empty=True).collect()] == [(2, None, None, None)]
