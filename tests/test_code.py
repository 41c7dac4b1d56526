"""The scanner on sources with comments, strings, nesting and odd lines, in every grammar."""

import random
import re
import time

import pytest

from granary.sources import code

CASES = {
    "ts-members": ("ts", "export class Box<T> extends Base {\n  private x = 1;\n  constructor(a: string) { super(a); }\n  get size(): number { return 1; }\n  static async make<T>(x: T): Promise<T> {\n    if (x) { return x; }\n  }\n  run = async (a: number): Promise<void> => {\n    for (;;) { }\n  };\n  name(): string;\n}\n",
        [("class", "Box", 1, 12, None), ("method", "constructor", 3, 3, "Box"), ("method", "size", 4, 4, "Box"), ("method", "make", 5, 7, "Box"), ("method", "run", 8, 10, "Box")]),
    "ts-hidden": ("ts", "/* function a() {\n} */\nconst t = `\nfunction b() {\n${ x ? `class C { ${y} }` : '}' }\n`;\n// function d() {}\nconst r = /[{/}\"]function e() {/g;\nfunction real() {\n  const s = \"}\";\n}\n", [("function", "real", 9, 11, None)]),
    "ts-more": ("ts", "export default function (a) {\n}\nexport const f = (a: { b: number }, c = { d: 1 }) => ({\n  e: a,\n});\ntype T = { a: number }\n  | { b: string };\nenum E { A, B }\nconst n = (a + b) * c;\nconst m = list.map((x) => x);\nnamespace N {\n  export interface I { go(): void }\n}\nfunction g(): { a: number } {\n  function inner() {}\n}\nlet h = x => x;\n",
        [("function", "default", 1, 2, None), ("function", "f", 3, 5, None), ("type", "T", 6, 7, None), ("enum", "E", 8, 8, None), ("interface", "I", 12, 12, None), ("function", "g", 14, 16, None), ("function", "inner", 15, 15, "g"), ("function", "h", 17, 17, None)]),
    "js-objects": ("js", "module.exports = {\n  a: 1,\n  go() {\n  },\n  stay: function () {},\n};\ndescribe('x', () => {\n  function helper() {\n  }\n});\nfunction* gen() {}\n", [("method", "go", 3, 4, None), ("function", "helper", 8, 9, None), ("function", "gen", 11, 11, None)]),
    "rs": ("rs", "//! fn no() {}\n/* outer /* fn inner() {} */ fn still() {} */\nconst S: &str = r#\"fn raw() { \" }\"#;\n#[derive(Debug, Clone)]\npub struct A<'a> { x: &'a str, c: [char; 2] }\nimpl<'a, T: Into<Vec<u8>>> fmt::Display for A<'a> where T: Copy {\n    fn fmt(&self) -> fmt::Result {\n        let q = '{';\n        let v = A { x: \"}\" };\n    }\n}\npub(crate) type Map = HashMap<String, A>;\nmod tests { use super::*; #[test] fn t() {} }\npub extern \"C\" fn ext(x: u8) -> u8 { x }\nmacro_rules! my { ($x:expr) => { $x }; }\npub trait Tr { fn must(&self); fn may(&self) -> u8 { 1 } }\nmod other;\npub const fn k() -> u8 { 1 }\nstruct U;\n",
        [("const", "S", 3, 3, None), ("struct", "A", 5, 5, None), ("impl", "A<'a>", 6, 11, None), ("function", "fmt", 7, 10, "A<'a>"), ("type", "Map", 12, 12, None), ("mod", "tests", 13, 13, None), ("function", "t", 13, 13, "tests"), ("function", "ext", 14, 14, None), ("macro", "my", 15, 15, None), ("trait", "Tr", 16, 16, None), ("function", "must", 16, 16, "Tr"), ("function", "may", 16, 16, "Tr"), ("mod", "other", 17, 17, None), ("function", "k", 18, 18, None), ("struct", "U", 19, 19, None)]),
    "go": ("go", "package x\n\n// func no() {}\nvar s = `\nfunc raw() {\n`\n\ntype (\n\tA struct {\n\t\tx int\n\t}\n\tB interface {\n\t\tGo(x int) error\n\t}\n\tC = map[string]struct{}\n)\n\ntype F func(a int, b struct{ c int }) (int, error)\n\nfunc (r *A) Run(x interface{}) interface{} {\n\tv := A{x: 1}\n\tif v == (A{}) {\n\t}\n\treturn func() {}\n}\n\nfunc Max[T int | float64](a, b T) T {\n\treturn a\n}\n",
        [("struct", "A", 9, 11, None), ("interface", "B", 12, 14, None), ("type", "C", 15, 15, None), ("type", "F", 18, 18, None), ("method", "Run", 20, 25, "A"), ("function", "Max", 27, 29, None)]),
    "py": ("py", "@deco\nclass A(Base):\n    '''def no(): class No:'''\n    s = \"def fake():\"\n    async def run(self,\n        a: dict[str, int] = {},\n    ) -> None:\n        x = '''\n    def no(self): pass\n'''\n        def inner(): pass\n\n    # def gone():\n    def last(self): return 1\n\ndef top(): pass\n",
        [("class", "A", 2, 14, None), ("method", "run", 5, 11, "A"), ("method", "inner", 11, 11, "run"), ("method", "last", 14, 14, "A"), ("function", "top", 16, 16, None)]),
    "java": ("java", "package a;\n/* class No { */\n@Deco(x = {1, 2})\npublic abstract class A<T extends B> implements C {\n  private static final String S = \"class X {\";\n  int[] v = {1, 2};\n  static { init(); }\n  public A(int a) throws E {\n    this.r = () -> { go(); };\n  }\n  @Override public <K> Map<K, List<T>> get(K k, int... n) { if (n == null) { return null; } }\n  abstract void must(int x);\n  record P(int x, int y) {}\n  enum E { ONE(1), TWO(2); E(int i) {} int v() { return 1; } }\n  String t = \"\"\"\n    void text() {\n    \"\"\";\n}\n@interface Mark { int value() default 1; }\n",
        [("class", "A", 4, 18, None), ("constructor", "A", 8, 10, "A"), ("method", "get", 11, 11, "A"), ("method", "must", 12, 12, "A"), ("record", "P", 13, 13, "A"), ("enum", "E", 14, 14, "A"), ("constructor", "E", 14, 14, "E"), ("method", "v", 14, 14, "E"), ("interface", "Mark", 19, 19, None), ("method", "value", 19, 19, "Mark")]),
    "cs": ("cs", "using System;\nnamespace N.M\n{\n  [Serializable]\n  public record R(int X);\n  public class A : B\n  {\n    #region void no() {\n    string v = @\"class \"\" {\";\n    public int X { get; set; } = 1;\n    public A(int a) : base(a) { }\n    public async Task<List<int>> Get<T>(T x) where T : class\n    {\n      foreach (var y in x) { }\n    }\n    void IFoo.Bar() => Run();\n  }\n  struct S { }\n  interface I { void M(); }\n}\n",
        [("record", "R", 5, 5, None), ("class", "A", 6, 17, None), ("constructor", "A", 11, 11, "A"), ("method", "Get", 12, 15, "A"), ("method", "Bar", 16, 16, "A"), ("struct", "S", 18, 18, None), ("interface", "I", 19, 19, None), ("method", "M", 19, 19, "I")]),
    "kt": ("kt", "/* a /* fun no() {} */ fun no2() {} */\nval s = \"\"\"fun text() { \"\"\"\nsealed interface I\ndata class P(\n  val a: Int,\n) : B()\nclass C {\n  companion object {\n    fun make() = C()\n  }\n  override suspend fun <T> List<T>.second(x: Int): T =\n    this[x]\n}\nobject O { fun o() {} }\n",
        [("interface", "I", 3, 3, None), ("class", "P", 4, 6, None), ("class", "C", 7, 13, None), ("function", "make", 9, 9, "C"), ("function", "second", 11, 12, "C"), ("object", "O", 14, 14, None), ("function", "o", 14, 14, "O")]),
    "swift": ("swift", "/* a /* func no() {} */ func no2() {} */\nlet s = #\"func raw() { \" \"#\npublic protocol P {\n  func must() -> Int\n}\nextension S: P {\n  func must() -> Int {\n    return 1\n  }\n}\n@objc final class C {\n  class func make() -> C { C() }\n  class var x: Int { 1 }\n}\nindirect enum E { case a }\n",
        [("protocol", "P", 3, 5, None), ("function", "must", 4, 4, "P"), ("function", "must", 7, 9, None), ("class", "C", 11, 14, None), ("function", "make", 12, 12, "C"), ("enum", "E", 15, 15, None)]),
    "php": ("php", "<h1>function no() {}</h1>\n<?php\n# function no() {\n#[Attr]\nabstract class A {\n  public static function &go(array $a = ['}']) {\n    $s = <<<EOT\n    function text() {\n    EOT;\n  }\n  abstract protected function must();\n}\nfunction f() { $g = function () { }; }\n?>\nfunction no() {}\n",
        [("class", "A", 5, 12, None), ("function", "go", 6, 10, "A"), ("function", "must", 11, 11, "A"), ("function", "f", 13, 13, None)]),
    "cpp": ("cpp", "#define NO(x) void x() {\n// void no() {}\nauto raw = R\"x(void no() { )\" )x\";\nint n = 1'000'000;\nnamespace a::b {\ntemplate <typename T, class U = std::vector<int>>\nT bar(T x) {\n  return x;\n}\nclass Foo final : public Base<int> {\n public:\n  explicit Foo(int a) : x_(a), y_{a} {\n    if (a) { }\n  }\n  ~Foo() {}\n  int get() const noexcept { return x_; }\n  void declared(int);\n  bool operator==(const Foo& o) const { return true; }\n private:\n  int x_ = 0;\n};\n}\nFoo::Foo() : x_{1} {}\nstd::string Foo::name(int a,\n    int b) const {\n}\nstruct Bar *make(int x) { static int t[] = {1, 2}; return 0; }\nextern \"C\" {\nint c_fn(void) { return 0; }\n}\nenum class E : int { A, B };\ntypedef struct Node { int v; } Node;\nint declared_only(int x);\n",
        [("namespace", "a::b", 5, 22, None), ("function", "bar", 7, 9, "a::b"), ("class", "Foo", 10, 21, "a::b"), ("method", "Foo", 12, 14, "Foo"), ("method", "~Foo", 15, 15, "Foo"), ("method", "get", 16, 16, "Foo"), ("method", "operator==", 18, 18, "Foo"), ("function", "Foo::Foo", 23, 23, None), ("function", "Foo::name", 24, 26, None), ("function", "make", 27, 27, None), ("function", "c_fn", 29, 29, None), ("enum", "E", 31, 31, None), ("struct", "Node", 32, 32, None)]),
    "rb": ("rb", "=begin\ndef no\nend\n=end\nmodule M\n  class C < B # def no\n    def self.make(a, b = \"def x\")\n      if a\n        1\n      end\n    end\n    TEXT = <<~SQL\n      def no\n      end\n    SQL\n    def short = 1\n    def one; end\n    def ==(o)\n      o =~ /def no/\n    end\n  end\nend\n",
        [("module", "M", 5, 22, None), ("class", "C", 6, 21, "M"), ("method", "make", 7, 11, "C"), ("method", "short", 16, 16, "C"), ("method", "one", 17, 17, "C"), ("method", "==", 18, 20, "C")]),
    "lua": ("lua", "--[==[ function no()\nend ]==]\nlocal s = [[\nfunction text()\nend\n]]\nlocal function a(x)\n  if x then return \"end\" end\n  -- end\nend\nfunction M.sub:go() return 1 end\nM.b = function(y)\nend\n", [("function", "a", 7, 10, None), ("function", "M.sub:go", 11, 11, None), ("function", "M.b", 12, 13, None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_definitions(name):
    ext, text, want = CASES[name]
    assert [(k, n, a, b, o) for k, n, _, a, b, o in code.definitions(ext)(text)] == want


@pytest.mark.parametrize("name", CASES)
def test_blanked_text_keeps_lines_and_places(name):
    ext, text, _ = CASES[name]
    out = code.blank(text, code.FAMILY.get(ext, ext))
    assert len(out) == len(text) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


def test_signatures():
    got = {n: s for _, n, s, *_ in code.definitions("ts")(CASES["ts-members"][1])}
    assert got["make"] == "static async make<T>(x: T): Promise<T>" and got["Box"] == "export class Box<T> extends Base"
    got = {n: s for _, n, s, *_ in code.definitions("cpp")(CASES["cpp"][1])}
    assert got["bar"] == "T bar(T x)" and got["Foo::name"] == "std::string Foo::name(int a, int b) const"
    assert {n: s for _, n, s, *_ in code.definitions("py")(CASES["py"][1])}["run"] == "async def run(self, a: dict[str, int] = {}, ) -> None"


def test_cut_and_shuffled_sources_do_not_fail():
    rng = random.Random(4)
    for ext, text, _ in CASES.values():
        parse = code.definitions(ext)
        for _ in range(60):
            a, b = sorted(rng.randrange(len(text) + 1) for _ in range(2))
            lines = text[a:b].split("\n")
            rng.shuffle(lines)
            for odd in (text[a:b], text[:a] + text[b:], "\n".join(lines)):
                assert all(1 <= first <= last for _, _, _, first, last, _ in parse(odd))


@pytest.mark.parametrize("ext", ["ts", "rs", "go", "java", "cs", "kt", "swift", "php", "cpp", "py", "rb", "lua"])
def test_long_texts_take_time_in_proportion(ext):
    took = []
    for n in (4000, 16000):
        texts = ["x = {a: [1, {b: 2}], c: f({d: 3}, {e: 4})}, " * n, "a(" * n, "{" * n, "x + \n" * n, "`${" * n, "/* " * n, '"' * n, "f(a, {}, " * n, "<" * n, "def " * n, "x: {\n" * n]
        began = time.perf_counter()
        for text in texts:
            code.definitions(ext)(text)
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 1, took


def test_methods_without_a_class():
    got = lambda ext, text: [(k, n, a, b, o) for k, n, _, a, b, o in code.definitions(ext)(text)]
    assert got("java", "import b.c;\n@Deco(1)\npublic int one(int x) {\n  if (x) { go(2); }\n  return x;\n}\nvoid main() {}\nint none(int x);\n") == [("method", "one", 3, 6, None), ("method", "main", 7, 7, None)]
    text = "using System;\nvar x = F(1);\nawait G(2);\nstatic int F(\n    int x) { return x; }\nint H(int x) => x + 1;\nif (a(1)) { b(); }\nreturn new Foo(1) { A = 1 };\nthrow new X(1);\nawait foreach (var y in z()) { }\n"
    assert got("cs", text) == [("method", "F", 4, 5, None), ("method", "H", 6, 6, None)]


@pytest.mark.parametrize("family, new, old", [("py", code._TRIPLE, r'"""(?:\\.|[^\\])*?(?:"""|\Z)'), ("py", code._TRIPLE_SQ, r"'''(?:\\.|[^\\])*?(?:'''|\Z)"), ("c", code._STARS, r"/\*.*?(?:\*/|\Z)"), ("rs", code._STRINGS["rs"][0], r'r(?P<hash>#*)".*?(?:"(?P=hash)|\Z)'), ("c", code._STRINGS["c"][0], r'R"(?P<delim>[^()\\\s]{0,16})\(.*?(?:\)(?P=delim)"|\Z)')])
def test_strings_end_where_the_lazy_form_ends(family, new, old):
    rng = random.Random(family + new)
    assert "*?" not in new  # a step for each character of a long text
    for _ in range(4000):
        text = rng.choice(['"""', "'''", "/*", 'r"', 'r#"', 'r##"', 'R"(', 'R"x(']) + "".join(rng.choice(list("\"'\\#*/()ax\n") + ['"""', "*/", '"#', ')x"', ')"']) for _ in range(rng.randint(0, 9)))
        spans = [[m.span() for m in re.compile(p, re.DOTALL | re.MULTILINE).finditer(text)] for p in (new, old)]
        assert spans[0] == spans[1], text
