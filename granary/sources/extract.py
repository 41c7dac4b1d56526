"""Structure extraction: one document gives many rows.

A parser is a function from a text to a list of tuples; ``rows_of`` runs it over a column in Arrow
batches and gives a row for each, so every parser is a generator operator. A text that a parser cannot
read gives its error as a row.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from granary.session import bound_batches
from granary.sources import code

#: Texts that Python holds at once, and rows read from them that it holds before they go out.
SLICE_ROWS, OUT_ROWS = 256, 4096


def rows_of(df: DataFrame, keys: list[str], text: str, parse: Callable[[str], list[tuple]], fields: str, empty: bool = False) -> DataFrame:
    """(keys…, n, fields…, error): the rows that ``parse`` gives for each text, in order as column ``n``.

    A text that ``parse`` cannot read gives one row with its error and nulls; one that holds nothing
    gives none, or with ``empty`` one of nulls. ``parse`` may take (path, text): see ``rows_by_path``.
    """
    return _rows(df.select(*keys, F.col(text).alias("_a")), keys, lambda a: parse(a[0]), fields, empty)


def rows_by_path(df: DataFrame, keys: list[str], path: str, text: str, parse: Callable[[str], Callable[[str], list[tuple]]], fields: str, empty: bool = False) -> DataFrame:
    """As ``rows_of`` where the parser depends on the path."""
    return _rows(df.select(*keys, F.col(text).alias("_a"), F.col(path).alias("_b")), keys, lambda a: parse(a[1] or "")(a[0]), fields, empty)


def _rows(given: DataFrame, keys: list[str], parse: Callable[[tuple], list[tuple]], fields: str, empty: bool) -> DataFrame:
    """Rows leave Python as they are told to the table: flat, and at most OUT_ROWS (and a text's own) at a time, whatever an Arrow batch holds."""
    from pyspark.sql.pandas.types import to_arrow_type

    bound_batches(given)
    told = StructType.fromDDL(fields)
    schema = StructType([*given.schema.fields[: len(keys)], StructField("n", LongType()), *told.fields, StructField("error", StringType())])
    kinds, names, width = [to_arrow_type(f.dataType) for f in schema.fields[len(keys) :]], schema.fieldNames(), len(told.fields)

    def table(part: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
        held = part.select(range(len(keys))).take(pa.array(at, pa.int64()))
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([*held.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * (width + 1)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                at, rows = [], []
                for i, a in enumerate(zip(*[part.column(c).to_pylist() for c in range(len(keys), part.num_columns)], strict=True)):
                    try:
                        got, error = (parse(a) if isinstance(a[0], str) else []), None
                    except Exception as e:  # a broken text is a row's error, not the job's
                        got, error = [], f"{type(e).__name__}: {e}"
                    if got:
                        at += [i] * len(got)
                        rows += [(n, *r, None) for n, r in enumerate(got)]
                    elif error is not None or empty:
                        at.append(i)
                        rows.append((*none, error))
                    if len(rows) >= OUT_ROWS:
                        yield table(part, at, rows)
                        at, rows = [], []
                yield table(part, at, rows)

    return given.mapInArrow(run, schema)


# --- markdown

HEADINGS = "level int, title string, anchor string, first int, last int"


def markdown_headings(text: str, setext: bool = True) -> list[tuple]:
    """Headings outside fences: (level, title, anchor, first line, last line of the section); underlined ones too unless told not to.

    A fence is closed by at least as many of its own marks, alone on a line.
    """
    lines = text.split("\n")
    found, fence = [], ""
    for i, line in enumerate(lines, 1):
        s = line.strip()
        mark = m[0] if (m := re.match(r"`{3,}|~{3,}", s)) else ""
        if fence:
            fence = "" if mark.startswith(fence) and mark == s else fence
        elif mark:
            fence = mark
        elif m := re.match(r"(#{1,6})[ \t]+(.*)$", line):
            found.append((len(m[1]), re.sub(r"\s+#+\s*$", "", m[2]), i))
        elif setext and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line) and i > 1 and _paragraph(lines[i - 2]) and not (found and found[-1][2] == i - 1):
            found.append((1 if s[0] == "=" else 2, lines[i - 2].strip(), i - 1))
    ends, open_ = [len(lines)] * len(found), []
    for k, (level, _, first) in enumerate(found):
        while open_ and found[open_[-1]][0] >= level:
            ends[open_.pop()] = first - 1
        open_.append(k)
    plain = [(level, t.replace("`", "").replace("**", "").strip(), first, end) for (level, t, first), end in zip(found, ends, strict=True)]
    return [(level, t, anchor_of(t), first, end) for level, t, first, end in plain]


def _paragraph(line: str) -> bool:
    return bool(line.strip()) and not re.match(r"\s*(?:[#>|]|[-*+] |\d+[.)] |`{3}|~{3}|(?:=+|-+)\s*$)", line) and not line.startswith(("    ", "\t"))


def anchor_of(title: str) -> str:
    return "".join(c if c.isalnum() or c == "-" else "-" if c == " " else "" for c in title.lower())


SECTIONS = "anchor string, title string, content string"


def sections(anchors: list[str]) -> Callable[[str], list[tuple]]:
    """The sections of the anchors, in their order: the first heading of each, up to the next of its level or above; missing ones are passed over."""

    def parse(text: str) -> list[tuple]:
        lines, first_of = text.split("\n"), {}
        for _, title, a, first, last in markdown_headings(text, setext=False):
            first_of.setdefault(a, (title, first, last))
        return [(a, first_of[a][0], "\n".join(lines[first_of[a][1] - 1 : first_of[a][2]])) for a in anchors if a in first_of]

    return parse


def section(text: str, anchor: str) -> str | None:
    """The first section with that anchor, up to the next heading of its level or above."""
    found = sections([anchor])(text)
    return found[0][2] if found else None


# --- trees

KEYS = "key string, depth int, kind string"


def load(text: str, kind: str = "json"):
    if kind == "toml":
        return tomllib.loads(text)
    if kind == "yaml":
        import yaml

        return yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    return json.loads(text)


def tree_keys(depth: int = 3, kind: str = "json") -> Callable[[str], list[tuple]]:
    """Keys in pre-order, dotted; of an array the first element stands for all and takes up a level."""

    def name(x) -> str:
        return "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string"

    def walk(x, at: str, level: int) -> Iterator[tuple]:
        if level > depth:
            return
        if isinstance(x, dict):
            for k, v in x.items():
                here = f"{at}.{k}" if at else str(k)
                yield here, level, name(v)
                yield from walk(v, here, level + 1)
        elif isinstance(x, list) and x:
            yield from walk(x[0], f"{at}[0]", level + 1)

    return lambda text: list(walk(load(text, kind), "", 1))


def value_at(tree, path: str):
    """The value at ``a.b[0].c``; raises where a key or index is missing; the empty path is the root."""
    for part in re.findall(r"[^.\[\]]+|\[\d+\]", path):
        tree = tree[int(part[1:-1])] if part[0] == "[" else tree[part]
    return tree


VALUE = "kind string, value string"


def values(path: str, kind: str = "json") -> Callable[[str], list[tuple]]:
    """The value at a path as (kind, JSON text); a missing key or index is an error."""

    def parse(text: str) -> list[tuple]:
        v = value_at(load(text, kind), path)
        name = "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
        return [(name, json.dumps(v, ensure_ascii=False, default=str))]

    return parse


# --- code

SYMBOLS = code.SYMBOLS


def code_symbols(ext: str) -> Callable[[str], list[tuple]]:
    """(kind, name, signature, first line, last line) of each definition: ``code.definitions`` without owners."""
    parse = code.definitions(ext)
    return lambda text: [x[:5] for x in parse(text)]


_BARE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|`[^`]*`")


def _brace_end(lines: list[str], at: int) -> int:
    """The line of the brace that closes a definition; its own last line where it has no body."""
    depth, seen, round_ = 0, False, 0
    for i in range(at, len(lines)):
        bare = _BARE.sub("", lines[i])
        depth += bare.count("{") - bare.count("}")
        round_ += bare.count("(") - bare.count(")")
        seen |= "{" in bare
        if seen and depth <= 0 or not seen and bare.rstrip().endswith(";"):
            return i
        if not seen and round_ <= 0 and not bare.rstrip().endswith((",", "(", "=", ":", "->", "=>", "&", "|")):
            after = next((x.strip() for x in lines[i + 1 : i + 3] if x.strip()), "")
            if not after.startswith(("{", "where", ":", "implements", "extends", "throws", "=>", "->", "=", "const", "noexcept", "override")):
                return i
    return at if not seen else len(lines) - 1


IMPORTS = "raw string, target string"
_IMPORTS = [
    re.compile(r"^\s*from\s+([.\w]+)\s+import\b.*"), re.compile(r"^\s*import\s+([\w.]+)(?:\s+as\s+\w+)?\s*$"), re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)"),
    re.compile(r"""^\s*(?:import|export)\b.*?from\s+["']([^"']+)["']"""), re.compile(r"""^\s*import\s+["']([^"']+)["']"""), re.compile(r"""require\(\s*["']([^"']+)["']\s*\)"""),
]


def imports(text: str) -> list[tuple]:
    """(raw line, target) of import-like lines; Go's import block included."""
    out, block = [], False
    for line in text.split("\n"):
        if re.match(r"^import\s*\($", line.strip()):
            block = True
        elif block:
            if m := re.search(r'"([^"]+)"', line):
                out.append((line.strip(), m[1]))
            block = ")" not in line
        else:
            for p in _IMPORTS:
                if m := p.search(line):
                    out.append((line.strip(), m[1]))
                    break
    return out


DEPS = "raw string, target string, resolved string, symbols string"


def code_deps(path: str) -> Callable[[str], list[tuple]]:
    """Imports of a file with the path that a relative or package import points to, and the names it brings in."""
    ext = path.rsplit(".", 1)[-1] if "." in path else ""
    here = path.rsplit("/", 1)[0] + "/" if "/" in path else ""

    def resolved(target: str) -> str | None:
        if ext in ("js", "ts", "tsx", "jsx", "mjs") and target.startswith("."):
            parts = (here + target).split("/")
        elif ext == "py" and target.startswith("."):
            up = len(target) - len(target.lstrip("."))
            parts = here.split("/")[:-1]
            parts = [*parts[: len(parts) - up + 1], *[x for x in target.lstrip(".").split(".") if x]]
        elif ext == "py":
            return target.replace(".", "/") + ".py"
        elif ext == "rs" and target.startswith("crate::"):
            return "src/" + "/".join(target.split("::")[1:2]) + ".rs"
        else:
            return None
        out: list[str] = []
        for x in parts:
            if x == "..":
                out = out[:-1]
            elif x not in ("", "."):
                out.append(x)
        return "/".join(out) + ("" if out and "." in out[-1] else f".{ext}")

    def symbols(raw: str) -> str:
        names = m[1] if (m := re.search(r"import\s+(?:type\s+)?\{([^}]*)\}", raw) or re.search(r"\bimport\s+(?!.*\bfrom\b)\(?([\w, *]+?)\)?\s*$", raw) if raw.startswith(("from", "import")) else re.search(r"::\{([^}]*)\}", raw)) else ""
        return ",".join(x.strip().split(" as ")[0] for x in names.split(",") if x.strip())

    return lambda text: [(raw, target, resolved(target), symbols(raw)) for raw, target in imports(text)]


API = "name string, kind string, line int, visibility string"


def api_surface(ext: str, crate_visible: bool = False) -> Callable[[str], list[tuple]]:
    """Public names: Rust pub (and pub(crate) if asked), exported JavaScript, Python names at the margin without underscore or in __all__, Go names in capitals."""

    def parse(text: str) -> list[tuple]:
        listed = set()
        if ext == "py" and (m := re.search(r"(?s)__all__\s*=\s*[\[(](.*?)[\])]", text)):
            listed = set(re.findall(r"[\"'](\w+)[\"']", m[1]))
        out, lines = [], text.split("\n")
        for kind, name, _, start, _ in code_symbols(ext)(text):
            line = lines[start - 1].lstrip()
            inner = ext == "rs" and bool(re.match(r"pub\((?:crate|super)\)", line))
            public = {"py": not lines[start - 1][:1].isspace() and (name in listed if listed else not name.startswith("_")), "rs": line.startswith("pub "), "go": name[:1].isupper()}.get(ext, line.startswith(("export ", "public ")))
            if public or crate_visible and inner:
                out.append((name, kind, start, "crate" if inner else "public"))
        return out

    return parse


FRAMES = "file string, line int, function string"
_FRAMES = [
    (re.compile(r'File "([^"]+)", line (\d+)(?:, in (\S+))?'), (1, 2, 3)), (re.compile(r"at (\S+?)\([^)]*\) in (\S+):line (\d+)"), (2, 3, 1)),
    (re.compile(r"at (?:(\S+) \()?((?:[A-Za-z]:)?[^\s():]+\.[jt]sx?):(\d+):\d+"), (2, 3, 1)), (re.compile(r"at ([\w.$<>]+)\(([\w$]+\.(?:java|kt|scala)):(\d+)\)"), (2, 3, 1)),
    (re.compile(r"at (\S+\.rs):(\d+)(?::\d+)?"), (1, 2, None)), (re.compile(r"(\S+\.go):(\d+)"), (1, 2, None)),
]


def stack_frames(text: str) -> list[tuple]:
    """Frames of stack traces, the first pattern that fits a line; each place once."""
    seen, out = set(), []
    for line in text.split("\n"):
        for p, (f, n, fn) in _FRAMES:
            if m := p.search(line):
                place = (m[f], int(m[n]))
                if place not in seen:
                    seen.add(place)
                    out.append((*place, m[fn] if fn else None))
                break
    return out


# --- interface definitions

MEMBERS = "type string, kind string, name string, detail string"


def _blocks(text: str, head: re.Pattern) -> Iterator[tuple[re.Match, list[str]]]:
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        if m := head.match(lines[i]):
            end = _brace_end(lines, i)
            inside = "\n".join(lines[i : end + 1]).partition("{")[2].rpartition("}")[0]
            yield m, inside.split("\n")
            i = end
        i += 1


def proto(text: str) -> list[tuple]:
    """Messages, services and enums with their fields, calls and values."""
    out = []
    for m, body in _blocks(text, re.compile(r"^\s*(message|service|enum)\s+(\w+)")):
        for line in body:
            s = re.sub(r"//.*", "", line).strip()
            if m[1] == "message" and (f := re.match(r"(?:(repeated|optional|required)\s+)?([\w.<>, ]+?)\s+(\w+)\s*=\s*(\d+)", s)):
                out.append((m[2], "field", f[3], " ".join(x for x in (f[1], f[2]) if x)))
            elif m[1] == "service" and (f := re.match(r"rpc\s+(\w+)\s*\(([^)]*)\)\s*returns\s*\(([^)]*)\)", s)):
                out.append((m[2], "rpc", f[1], f"({f[2].strip()}) → ({f[3].strip()})"))
            elif m[1] == "enum" and (f := re.match(r"(\w+)\s*=\s*(-?\d+)", s)):
                out.append((m[2], "value", f[1], f[2]))
    return out


def graphql(text: str) -> list[tuple]:
    """Types with their fields, arguments and types; values of enums."""
    out = []
    for m, body in _blocks(text, re.compile(r"^\s*(type|interface|input|enum)\s+(\w+)")):
        for line in body:
            s = line.partition("#")[0].strip().rstrip(",")
            if m[1] == "enum" and re.fullmatch(r"\w+", s):
                out.append((m[2], "value", s, ""))
            elif f := re.match(r"(\w+)\s*(\([^)]*\))?\s*:\s*(.+)$", s):
                out.append((m[2], "field", f[1], (f[2] or "") + f[3].strip()))
    return out


def css(text: str) -> list[tuple]:
    """(selector, "rule", "", number of properties) of top-level rules; at-rules are passed over."""
    text = re.sub(r"(?s)/\*.*?\*/", "", text)
    out, depth, head, body = [], 0, "", ""
    for c in text:
        if c == "{":
            depth += 1
            if depth == 1:
                body = ""
                continue
        elif c == "}":
            depth -= 1
            if depth == 0:
                name = " ".join(head.split())
                if name and not name.startswith("@"):
                    out.append((name, "rule", "", str(sum(":" in p for p in body.split(";")))))
                head = ""
                continue
        if depth == 0:
            head = "" if c == ";" else head + c
        elif depth == 1:
            body += c
    return out


def openapi(text: str) -> list[tuple]:
    """(path, method, parameter or response, detail) of an OpenAPI document in YAML or JSON."""
    out = []
    for path, ops in (load(text, "yaml").get("paths") or {}).items():
        for method in ("get", "post", "put", "patch", "delete", "head", "options"):
            op = (ops or {}).get(method)
            if isinstance(op, dict):
                out.append((path, method, "summary", op.get("summary") or ""))
                out += [(path, method, p.get("name", ""), f"{p.get('name', '')} ({p.get('in', '')}{', required' if p.get('required') else ''})") for p in op.get("parameters") or [] if isinstance(p, dict)]
                out += [(path, method, str(code), f"{code} {(r or {}).get('description', '')}".strip()) for code, r in (op.get("responses") or {}).items()]
    return out


def db_schema(text: str) -> list[tuple]:
    """Tables of SQL and models of Prisma: (table, "column", name, type)."""
    out = []
    for m, body in _blocks(text, re.compile(r"^\s*(model|enum|type)\s+(\w+)\s*\{")):
        for line in body:
            s = re.sub(r"//.*", "", line).strip()
            if s and not s.startswith("@@"):
                p = s.split()
                out.append((m[2], "value" if m[1] == "enum" else "column", p[0], " ".join(p[1:2])))
    for m in re.finditer(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)[\"`\]]?\s*\((.*?)\)\s*(?:;|\Z)", text):
        for part in re.split(r",(?![^(]*\))", re.sub(r"--[^\n]*", "", m[2])):
            p = part.split()
            if p and p[0].upper() not in ("PRIMARY", "FOREIGN", "UNIQUE", "CONSTRAINT", "CHECK", "KEY", "INDEX"):
                out.append((m[1], "column", p[0].strip('"`[]'), p[1] if len(p) > 1 else ""))
    return out


ENV = "key string, value string, required boolean, description string"


def env(text: str) -> list[tuple]:
    """KEY=default lines with the comments just above; required if there is no default; the first of a key counts."""
    out, notes, seen = [], [], set()
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("#"):
            notes.append(s.lstrip("# ").strip())
        elif m := re.match(r"(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*)$", s):
            value = m[2].strip().strip("\"'")
            if m[1] not in seen:
                seen.add(m[1])
                out.append((m[1], value or None, not value, " ".join(notes) or None))
            notes = []
        else:
            notes = []
    return out


CELLS = "kind string, preview string, lines int, outputs int, output string"


def notebook(text: str) -> list[tuple]:
    """Cells with their first line, lines and outputs: an output's text, or else its traceback."""

    def joined(x, sep: str = "") -> str:
        return sep.join(x) if isinstance(x, list) else x or ""

    out = []
    for c in json.loads(text).get("cells", []):
        src = joined(c.get("source", ""))
        outputs = c.get("outputs") or []
        shown = [joined(o.get("text")) or joined((o.get("data") or {}).get("text/plain")) or joined(o.get("traceback"), "\n") for o in outputs]
        out.append((c.get("cell_type", ""), src.split("\n")[0][:100], len(src.splitlines()), len(outputs), "\n".join(x for x in shown if x) or None))
    return out


# --- packages, pipelines

PACKAGES = "name string, version string, kind string"


def manifest(name: str) -> Callable[[str], list[tuple]]:
    """Dependencies of a package manifest by its file name."""

    def npm(text: str) -> list[tuple]:
        j = json.loads(text)
        return [(k, str(v), kind) for field, kind in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "optional"), ("optionalDependencies", "optional")) for k, v in (j.get(field) or {}).items()]

    def cargo(text: str) -> list[tuple]:
        t = tomllib.loads(text)
        return [(k, v if isinstance(v, str) else v.get("version", "*"), kind) for field, kind in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")) for k, v in (t.get(field) or {}).items()]

    def spec(s: str) -> tuple[str, str]:
        m = re.match(r"\s*([A-Za-z0-9._-]+)\s*(.*)$", s)
        return (m[1], m[2].strip() or "*") if m else (s, "*")

    def pyproject(text: str) -> list[tuple]:
        t = tomllib.loads(text)
        poetry = t.get("tool", {}).get("poetry")
        if poetry:
            version = lambda v: v if isinstance(v, str) else v.get("version", "*") if isinstance(v, dict) else "*"
            out = [(k, version(v), "runtime") for k, v in (poetry.get("dependencies") or {}).items() if k != "python"]
            groups = [poetry.get("dev-dependencies") or {}] + [g.get("dependencies", {}) for g in (poetry.get("group") or {}).values()]
            return out + [(k, version(v), "dev") for g in groups for k, v in g.items()]
        project = t.get("project", {})
        out = [(*spec(s), "runtime") for s in project.get("dependencies") or []]
        return out + [(*spec(s), "dev" if "dev" in g or "test" in g else "optional") for g, deps in (project.get("optional-dependencies") or {}).items() for s in deps]

    def requirements(text: str) -> list[tuple]:
        return [(*spec(s), "runtime") for line in text.split("\n") if (s := line.strip()) and s[0] not in "#-"]

    def gomod(text: str) -> list[tuple]:
        out, block = [], False
        for line in text.split("\n"):
            s = line.strip()
            if s.startswith("require ("):
                block = True
            elif block and s.startswith(")"):
                block = False
            elif (block or s.startswith("require ")) and (m := re.match(r"(?:require\s+)?(\S+)\s+(v\S+)(.*)$", s)):
                out.append((m[1], m[2], "optional" if "// indirect" in m[3] else "runtime"))
        return out

    def pom(text: str) -> list[tuple]:
        scopes = {"test": "dev", "provided": "optional", "system": "build"}
        field = lambda d, n: (m[1].strip() if (m := re.search(rf"(?s)<{n}>(.*?)</{n}>", d)) else None)
        return [(field(d, "artifactId"), field(d, "version") or "*", "optional" if field(d, "optional") == "true" else scopes.get(field(d, "scope") or "", "runtime")) for d in re.findall(r"(?s)<dependency>(.*?)</dependency>", text)]

    def gradle(text: str) -> list[tuple]:
        kinds = {"testImplementation": "dev", "testRuntimeOnly": "dev", "androidTestImplementation": "dev", "compileOnly": "optional", "annotationProcessor": "optional"}
        return [(n, v or "*", kinds.get(c, "runtime")) for c, n, v in re.findall(r"(?m)^\s*(implementation|api|runtimeOnly|compileOnly|annotationProcessor|testImplementation|testRuntimeOnly|androidTestImplementation)\s*\(?\s*[\"']([^:\"']+:[^:\"']+)(?::([^\"']+))?[\"']", text)]

    return {"package.json": npm, "Cargo.toml": cargo, "pyproject.toml": pyproject, "requirements.txt": requirements, "go.mod": gomod, "pom.xml": pom, "build.gradle": gradle, "build.gradle.kts": gradle}[name]


JOBS = "job string, needs string, step int, label string, env string"


def pipeline(kind: str) -> Callable[[str], list[tuple]]:
    """Jobs and steps of a CI definition: github, gitlab or circleci."""

    def refs(x) -> str:
        return ",".join(sorted(set(re.findall(r"\$\{\{\s*((?:env|secrets|vars)\.\w+)\s*\}\}", json.dumps(x)))))

    def listed(x) -> list:
        return x if isinstance(x, list) else [] if x is None else [x]

    def parse(text: str) -> list[tuple]:
        t = load(text, "yaml") or {}
        out = []
        if kind == "github":
            for job, j in (t.get("jobs") or {}).items():
                for i, s in enumerate(j.get("steps") or []):
                    label = s.get("name") or (f"uses: {s['uses']}" if "uses" in s else f"run: {(s.get('run') or '').strip().split(chr(10))[0]}")
                    out.append((job, ",".join(listed(j.get("needs"))), i, label, refs(s)))
        elif kind == "gitlab":
            reserved = {"stages", "variables", "default", "include", "workflow", "image", "services", "before_script", "after_script", "cache"}
            out = [(job, "", i, str(s), refs(s)) for job, j in t.items() if job not in reserved and isinstance(j, dict) for i, s in enumerate(listed(j.get("script")))]
        else:
            jobs = t.get("jobs") or {}
            for name, w in (t.get("workflows") or {}).items():
                for entry in (w.get("jobs") or []) if name != "version" and isinstance(w, dict) else []:
                    job, opts = (entry, {}) if isinstance(entry, str) else next(iter(entry.items()))
                    if job in jobs:
                        out += [(job, ",".join(listed((opts or {}).get("requires"))), i, s if isinstance(s, str) else next(iter(s)), refs(s)) for i, s in enumerate(jobs[job].get("steps") or [])]
        return out

    return parse


# --- reports

# The weights of the CVSS 3 base metrics, as the standard gives them.
CVSS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}, "PR": {"N": 0.85, "L": 0.62, "H": 0.27},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0}, "I": {"H": 0.56, "L": 0.22, "N": 0.0}, "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
CVSS_CHANGED = {"N": 0.85, "L": 0.68, "H": 0.5}


def cvss_score(vector: str) -> float:
    """The base score of a CVSS 3 vector."""
    m = dict(x.split(":", 1) for x in vector.split("/")[1:])
    changed = m["S"] == "C"
    w = {k: v[m[k]] for k, v in CVSS.items()}
    w["PR"] = CVSS_CHANGED[m["PR"]] if changed else w["PR"]
    base = 1 - (1 - w["C"]) * (1 - w["I"]) * (1 - w["A"])
    impact = 7.52 * (base - 0.029) - 3.25 * (base - 0.02) ** 15 if changed else 6.42 * base
    if impact <= 0:
        return 0.0
    total = min((1.08 if changed else 1.0) * (impact + 8.22 * w["AV"] * w["AC"] * w["PR"] * w["UI"]), 10)
    whole = round(total * 100_000)
    return whole / 100_000 if whole % 10_000 == 0 else (whole // 10_000 + 1) / 10


FINDINGS = "package string, severity string, id string, affected string, patched string, title string"


def audit(kind: str) -> Callable[[str], list[tuple]]:
    """Findings of dependency audits: npm, cargo, pip or osv."""

    def npm(j) -> list[tuple]:
        out = []
        for name, v in (j.get("vulnerabilities") or {}).items():
            via = next((x for x in v.get("via") or [] if isinstance(x, dict)), {})
            fix = v.get("fixAvailable")
            patched = fix.get("version") if isinstance(fix, dict) else "fix available" if fix else None
            out.append((name, v.get("severity", "unknown"), str(via.get("url") or via.get("source") or ""), v.get("range"), patched, via.get("title", "")))
        return out

    def severity(score) -> str:
        try:
            s = cvss_score(score) if isinstance(score, str) and score.startswith("CVSS:3") else float(score)
        except (TypeError, ValueError, KeyError):
            return "unknown"
        return "critical" if s >= 9 else "high" if s >= 7 else "moderate" if s >= 4 else "low" if s > 0 else "unknown"

    def cargo(j) -> list[tuple]:
        out = []
        for v in (j.get("vulnerabilities") or {}).get("list") or []:
            a = v.get("advisory") or {}
            out.append(((v.get("package") or {}).get("name"), severity(a.get("cvss")), a.get("id"), (v.get("package") or {}).get("version"), ", ".join((v.get("versions") or {}).get("patched") or []) or None, a.get("title", "")))
        return out

    def pip(j) -> list[tuple]:
        deps = j.get("dependencies", []) if isinstance(j, dict) else j
        return [(d.get("name"), "unknown", v.get("id"), d.get("version"), ", ".join(v.get("fix_versions") or []) or None, v.get("description", "")) for d in deps for v in d.get("vulns") or []]

    def osv(j) -> list[tuple]:
        out = []
        for r in j.get("results") or []:
            for p in r.get("packages") or []:
                s = severity(((p.get("groups") or [{}])[0]).get("max_severity"))
                out += [((p.get("package") or {}).get("name"), s, v.get("id"), (p.get("package") or {}).get("version"), None, v.get("summary", "")) for v in p.get("vulnerabilities") or []]
        return out

    return lambda text: {"npm": npm, "cargo": cargo, "pip": pip, "osv": osv}[kind](json.loads(text))


DIAGNOSTICS = "file string, line int, col int, severity string, code string, message string"


def diagnostics(kind: str) -> Callable[[str], list[tuple]]:
    """Findings of type checkers: cargo, tsc, pyright, mypy or govet."""

    def cargo(text: str) -> list[tuple]:
        out = []
        for line in text.split("\n"):
            j = json.loads(line) if line.startswith("{") else {}
            m = j.get("message") or {}
            spans = m.get("spans") if j.get("reason") == "compiler-message" else None
            # the trailers that sum up a run have no place and say nothing of their own
            if spans and not re.search(r"^(aborting due to|could not compile|\d+ warnings? emitted)", m.get("message") or ""):
                s = next((x for x in spans if x.get("is_primary")), spans[0])
                out.append((s["file_name"], s["line_start"], s["column_start"], {"error": "error", "warning": "warning"}.get(m.get("level"), "hint"), (m.get("code") or {}).get("code"), m.get("message")))
        return out

    def lines(pattern: str, of: Callable) -> Callable[[str], list[tuple]]:
        p = re.compile(pattern)
        return lambda text: [of(m) for line in text.split("\n") if (m := p.match(line.strip()))]

    def coded(said: str) -> tuple[str | None, str]:
        """The code in brackets at the end, behind white space, and what stands before it."""
        at = said.rfind("[") if said.endswith("]") else -1
        if at > 0 and said[at - 1].isspace() and re.fullmatch(r"[\w-]+", said[at + 1 : -1]):
            return said[at + 1 : -1], said[:at].rstrip()
        return None, said

    def pyright(text: str) -> list[tuple]:
        out = []
        for d in json.loads(text).get("generalDiagnostics") or []:
            at = (d.get("range") or {}).get("start") or {}
            out.append((d.get("file"), at.get("line", 0) + 1, at.get("character", 0) + 1, d.get("severity"), d.get("rule"), (d.get("message") or "").replace("\n", " ")))
        return out

    tsc = lines(r"(.+?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.*)$", lambda m: (m[1], int(m[2]), int(m[3]), m[4], m[5], m[6]))
    mypy = lines(r"([^:\s]+):(\d+):(?:(\d+):)? (error|warning|note): (.*)$", lambda m: (m[1], int(m[2]), int(m[3] or 0), "hint" if m[4] == "note" else m[4], *coded(m[5])))
    govet = lines(r"(?:vet: )?([^:\s]+\.go):(\d+):(?:(\d+):)? (.*)$", lambda m: (m[1], int(m[2]), int(m[3] or 0), "error", None, m[4]))
    return {"cargo": cargo, "tsc": tsc, "pyright": pyright, "mypy": mypy, "govet": govet}[kind]


RESULTS = "suite string, name string, outcome string"


def test_results(kind: str) -> Callable[[str], list[tuple]]:
    """Tests of a run's output: jest, pytest, cargo or go: (suite, name, passed | failed | skipped)."""

    def cargo(text: str) -> list[tuple]:
        words, suite, out = {"ok": "passed", "FAILED": "failed", "ignored": "skipped"}, "", []
        for line in text.split("\n"):
            if m := re.match(r"\s*Running (?:unittests )?(\S+)", line):
                suite = m[1]
            elif m := re.match(r"test (\S+) \.\.\. (ok|FAILED|ignored)", line):
                out.append((suite, m[1], words[m[2]]))
        return out

    def pytest(text: str) -> list[tuple]:
        words = {"PASSED": "passed", "FAILED": "failed", "ERROR": "failed", "SKIPPED": "skipped", "XFAIL": "skipped", "XPASS": "passed"}
        return [(m[1], m[2], words[m[3]]) for m in re.finditer(r"(?m)^(\S+\.py)::(\S+) (PASSED|FAILED|ERROR|SKIPPED|XFAIL|XPASS)", text)]

    def jest(text: str) -> list[tuple]:
        suite, out = "", []
        for line in text.split("\n"):
            if m := re.match(r"\s*(?:PASS|FAIL)\s+(\S+)", line):
                suite = m[1]
            elif m := re.match(r"\s*([✓✔√✕✗×○])\s+(.*?)(?: \(\d+ ?m?s\))?$", line):
                out.append((suite, m[2], "passed" if m[1] in "✓✔√" else "skipped" if m[1] == "○" else "failed"))
        return out

    def go(text: str) -> list[tuple]:
        """A package's line comes after its tests."""
        out, waiting = [], []
        for line in text.split("\n"):
            if m := re.match(r"\s*--- (PASS|FAIL|SKIP): (\S+)", line):
                waiting.append((m[2], {"PASS": "passed", "FAIL": "failed", "SKIP": "skipped"}[m[1]]))
            elif m := re.match(r"(?:ok|FAIL)\s+(\S+)", line):
                out += [(m[1], n, o) for n, o in waiting]
                waiting = []
        return out + [("", n, o) for n, o in waiting]

    def generic(text: str) -> list[tuple]:
        words = {"pass": "passed", "passed": "passed", "ok": "passed", "fail": "failed", "failed": "failed", "error": "failed", "skip": "skipped", "skipped": "skipped"}
        return [("", m[2].strip(), words[m[1].lower()]) for m in re.finditer(r"(?im)^\s*(pass|passed|ok|fail|failed|error|skip|skipped)\s*[:\-]\s*(\S.*)$", text)]

    every = {"jest": jest, "pytest": pytest, "cargo": cargo, "go": go, "generic": generic}
    if kind != "auto":
        return every[kind]

    def detected(text: str) -> list[tuple]:
        """The first dialect that finds a test."""
        return next((got for parse in every.values() if (got := parse(text))), [])

    return detected


TESTS = "level int, kind string, name string, line int"


def test_skeleton(kind: str) -> Callable[[str], list[tuple]]:
    """Tests that a file defines: jest, pytest, rust, go, junit or rspec, with their nesting."""

    def nested(suite: str, case: str) -> Callable[[str], list[tuple]]:
        def parse(text: str) -> list[tuple]:
            stack, out = [], []
            for i, line in enumerate(text.split("\n"), 1):
                indent = len(line) - len(line.lstrip())
                if m := re.match(suite, line):
                    stack = [s for s in stack if s < indent]
                    out.append((len(stack), "suite", m[1], i))
                    stack.append(indent)
                elif m := re.match(case, line):
                    out.append((len([s for s in stack if s < indent]), "test", m[1], i))
            return out

        return parse

    def marked(mark: str, fn: str, suite: str) -> Callable[[str], list[tuple]]:
        """Tests whose mark stands on the line just before; their level is how many suites are open around them."""

        def parse(text: str) -> list[tuple]:
            before, out, lines, open_ = False, [], text.split("\n"), []
            for i, line in enumerate(lines, 1):
                while open_ and i > open_[-1]:
                    open_.pop()
                if m := re.match(suite, line):
                    out.append((len(open_), "suite", m[1], i))
                    open_.append(_brace_end(lines, i - 1) + 1)
                elif before and (m := re.match(fn, line)):
                    out.append((len(open_), "test", m[1], i))
                before = bool(re.match(mark, line))
            return out

        return parse

    quote = r"[\"'`](.*?)[\"'`]"
    return {
        "jest": nested(rf"\s*describe(?:\.\w+)?\(\s*{quote}", rf"\s*(?:it|test)(?:\.\w+)?\(\s*{quote}"), "rspec": nested(rf"\s*(?:RSpec\.)?(?:describe|context)\s+(?:{quote}|.+ do)", rf"\s*it\s+{quote}"),
        "pytest": nested(r"\s*class\s+(Test\w*)", r"\s*(?:async\s+)?def\s+(test_\w+)"), "rust": marked(r"\s*#\[(?:\w+::)?test\b", r"\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", r"\s*(?:pub\s+)?mod\s+(\w+)\s*\{"),
        "junit": marked(r"\s*@(?:Parameterized|Repeated)?Test\b", r".*?\b(?:void|fun)\s+(\w+)\s*\(", r"\s*(?:(?:public|private|protected|static|final|abstract|inner)\s+)*class\s+(\w+)"), "go": lambda t: [(0, "test", m[1], t.count("\n", 0, m.start()) + 1) for m in re.finditer(r"(?m)^func\s+((?:Test|Benchmark|Example)\w*)\(", t)],
    }[kind]


LINES = "file string, line_no int, hit boolean"


def coverage(kind: str) -> Callable[[str], list[tuple]]:
    """Instrumented lines of a report: lcov, coverage.py or cobertura."""

    def lcov(text: str) -> list[tuple]:
        file, out = "", []
        for line in text.split("\n"):
            if line.startswith("SF:"):
                file = line[3:].strip()
            elif m := re.match(r"DA:(\d+),(\d+)", line):
                out.append((file, int(m[1]), int(m[2]) > 0))
        return out

    def coveragepy(text: str) -> list[tuple]:
        out = []
        for f, d in (json.loads(text).get("files") or {}).items():
            hit, missed = set(d.get("executed_lines") or []), set(d.get("missing_lines") or [])
            out += [(f, n, n in hit) for n in sorted(hit | missed)]
        return out

    def cobertura(text: str) -> list[tuple]:
        import xml.etree.ElementTree as ET

        return [(c.get("filename"), int(x.get("number")), int(x.get("hits")) > 0) for c in ET.fromstring(text).iter("class") for x in c.iter("line")]

    return {"lcov": lcov, "coverage.py": coveragepy, "cobertura": cobertura}[kind]


# --- types

FIELDS = "type string, kind string, name string, detail string, line int"


def type_skeleton(ext: str) -> Callable[[str], list[tuple]]:
    """Types and their members at the first level: TypeScript interfaces, types and enums, Go and Rust structs, enums, traits."""
    family = code.FAMILY.get(ext, ext)
    kinds = {"js": ("interface", "enum", "type"), "go": ("struct", "interface"), "rs": ("struct", "enum", "trait")}.get(family, ("class", "interface"))
    member = {
        "js": re.compile(r"^(?:readonly\s+)?([\w$]+\??)\s*(?:\(.*\))?\s*[:=]?\s*(.*?)[;,]?$"), "go": re.compile(r"^(\w+)(?:\s+(.+?))?(?:\s+`.*`)?$"),
        "rs": re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:fn\s+)?(\w+)\s*(?::\s*(.+?)|(\(.*))?[,;]?$"),
    }.get(family, re.compile(r"^(?:public |private |protected |static |final )*([\w<>\[\]]+)\s+(\w+)\s*[;=(]"))

    def parse(text: str) -> list[tuple]:
        lines = text.split("\n")
        out = []
        for kind, name, _, first, last in code_symbols(ext)(text):
            if kind not in kinds:
                continue
            depth = 0
            for i in range(first - 1, last):
                s = _BARE.sub("", lines[i]).strip()
                if i >= first and depth == 1 and s and not s.startswith(("}", "//", "#", "*")) and (m := member.match(s.rstrip("{").strip())):
                    out.append((name, kind, m[1], (m[2] or (m[3] if m.re.groups > 2 else "") or "").strip(), i + 1))
                depth += s.count("{") - s.count("}")
        return out

    return parse


CONFORMS = "type string, kind string, line int"


def conforms_to(name: str, ext: str) -> Callable[[str], list[tuple]]:
    """Types that implement or extend a named interface, by the language's own wording."""
    n = re.escape(name)
    family = code.FAMILY.get(ext, ext)
    patterns = {
        "js": [rf"class\s+(\w+)[^{{]*\b(?:implements|extends)\b[^{{]*\b{n}\b", rf"interface\s+(\w+)[^{{]*\bextends\b[^{{]*\b{n}\b"], "rs": [rf"impl(?:<[^>]*>)?\s+(?:\w+::)*{n}(?:<[^>]*>)?\s+for\s+(\w+)"],
        "java": [rf"(?:class|record|enum|interface)\s+(\w+)[^{{]*(?:implements|extends|:)[^{{]*\b{n}\b"], "go": [rf"var\s+_\s+(?:\w+\.)?{n}\s*=\s*(?:\(\*|&)?(\w+)"],
        "php": [rf"class\s+(\w+)[^{{]*\bimplements\b[^{{]*\b{n}\b"], "py": [rf"class\s+(\w+)\s*\([^)]*\b{n}\b"],
    }.get(family, [])
    kind = "interface" if name[:1].isupper() else "trait"

    def parse(text: str) -> list[tuple]:
        found = {}
        for p in patterns:
            for m in re.finditer(p, text):
                found.setdefault(m[1], text.count("\n", 0, m.start()) + 1)
        return sorted(((t, kind, line) for t, line in found.items()), key=lambda r: (r[2], r[0]))

    return parse


OUTLINE = "kind string, name string, line int"


def outline(path: str) -> Callable[[str], list[tuple]]:
    """The outline of a file by its name: headings, keys, cells, members or symbols."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext in ("md", "markdown", "mdx"):
        return lambda t: [(f"h{level}", title, first) for level, title, _, first, _ in markdown_headings(t)]
    if ext in ("json", "yaml", "yml", "toml"):
        return lambda t: [(kind, key, 0) for key, _, kind in tree_keys(2, "yaml" if ext == "yml" else ext)(t)]
    if ext == "ipynb":
        return lambda t: [(kind, preview, i) for i, (kind, preview, *_) in enumerate(notebook(t))]
    if ext in ("proto", "graphql", "gql"):
        return lambda t: [(kind, f"{owner}.{name}", 0) for owner, kind, name, _ in (proto if ext == "proto" else graphql)(t)]
    if code.FAMILY.get(ext, ext) not in code.FAMILIES:
        return lambda t: [("unknown", None, None)]
    return lambda t: [(kind, name, first) for kind, name, _, first, _ in code_symbols(ext)(t)]
