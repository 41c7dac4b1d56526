"""Definitions in source text, by one scanner for thirteen grammars.

First comments and strings are blanked in place (nested comments, raw strings, templates, here-documents and
regular expressions included), so what follows sees code only and every offset stays. Then languages with braces
are read statement by statement with a stack of scopes: what stands before a brace, or before the end of a
statement, is matched against the grammar's forms, which may ask for the scope around them (a method form only counts
in a class). Python goes by indentation, Ruby and Lua by ``end``. Each definition knows the one around it.

A scan is one pass; what is open at the end of a text ends with it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

SYMBOLS = "kind string, name string, signature string, start int, end int, owner string"

# --- blanking

_DQ, _SQ = r'"(?:\\.|[^"\\\n])*(?:"|$)', r"'(?:\\.|[^'\\\n])*(?:'|$)"
_LONG_DQ, _LONG_SQ = r'"(?:\\.|[^"\\])*(?:"|\Z)', r"'(?:\\.|[^'\\])*(?:'|\Z)"
# Runs without a mark are taken whole and never given back; where a form fails (a lone backslash at the end) it fails as a lazy one does.
_TRIPLE, _TRIPLE_SQ = r'"""(?:[^"\\]++|\\.|"(?!""))*+(?:"""|\Z)', r"'''(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\Z)"
_CHAR = r"'(?:\\.|[^'\\\n])+'"
_SLASHES, _STARS = r"//[^\n]*", r"/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)"
#: Of each family the forms of comments, and of strings; ``nest``, ``tick`` and ``slash`` are openings whose end a function finds.
_NOTES = {
    "py": [r"#[^\n]*"],
    "rs": [_SLASHES],
    "go": [_SLASHES, _STARS],
    "js": [_SLASHES, _STARS],
    "java": [_SLASHES, _STARS],
    "cs": [_SLASHES, _STARS, r"^[ \t]*#[^\n]*"],
    "kt": [_SLASHES],
    "swift": [_SLASHES],
    "php": [r"\A(?:(?!<\?).)*<\?(?:php\b|=)", r"\?>.*?(?:<\?(?:php\b|=)|\Z)", _SLASHES, r"#(?!\[)[^\n]*", _STARS],
    "c": [_SLASHES, _STARS, r"^[ \t]*#(?:\\\r?\n|[^\n])*"],
    "rb": [r"^=begin\b.*?(?:^=end[^\n]*|\Z)", r"#[^\n]*"],
    "lua": [r"--\[(?P<eq>=*)\[.*?(?:\](?P=eq)\]|\Z)", r"--[^\n]*"],
}
_STRINGS = {
    "py": [_TRIPLE, _TRIPLE_SQ, _DQ, _SQ],
    "rs": [r'r(?P<hash>#*)"(?:[^"]++|"(?!(?P=hash)))*+(?:"(?P=hash)|\Z)', _LONG_DQ, r"'(?:\\(?:u\{[^}]*\}|x\w\w|.)|[^'\\\n])'"],
    "go": [r"`[^`]*(?:`|\Z)", _DQ, _CHAR],
    "js": [_DQ, _SQ],
    "java": [_TRIPLE, _DQ, _CHAR],
    "cs": [r'(?P<raw>"{3,}).*?(?:(?P=raw)|\Z)', r'(?:@\$?|\$@)"(?:""|[^"])*(?:"|\Z)', _DQ, _CHAR],
    "kt": [r'""".*?(?:"""+|\Z)', _DQ, _CHAR],
    "swift": [r'(?P<hash>#+)".*?(?:"(?P=hash)|\Z)', _TRIPLE, _DQ],
    "php": [r"<<<[ \t]*(?P<mark>['\"]?)(?P<doc>\w+)(?P=mark)\r?\n.*?(?:^[ \t]*(?P=doc)\b|\Z)", _LONG_DQ, _LONG_SQ],
    "c": [r'R"(?P<delim>[^()\\\s]{0,16})\((?:[^)]++|\)(?!(?P=delim)"))*+(?:\)(?P=delim)"|\Z)', _DQ, r"(?<=[0-9a-fA-F])'(?=[0-9a-fA-F])", _CHAR],
    "rb": [r"<<[~-](?P<mark>['\"`]?)(?P<doc>[A-Za-z_]\w*)(?P=mark)[^\n]*\n.*?(?:^[ \t]*(?P=doc)\b|\Z)", _LONG_DQ, _LONG_SQ],
    "lua": [r"\[(?P<eq2>=*)\[.*?(?:\](?P=eq2)\]|\Z)", _DQ, _SQ],
}
_OPENINGS = {"rs": r"(?P<nest>/\*)", "kt": r"(?P<nest>/\*)", "swift": r"(?P<nest>/\*)", "js": r"(?P<tick>`)|(?P<slash>/)", "rb": r"(?P<slash>/)"}
_SKIP = {f: re.compile("|".join([f"(?P<note>{'|'.join(notes)})", *[x for x in [_OPENINGS.get(f)] if x], *_STRINGS[f]]), re.DOTALL | re.MULTILINE) for f, notes in _NOTES.items()}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\n\\])*\]|[^/\n\\\[])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?\[{+*%<>~^-]|\b(?:return|typeof|case|in|of|when|if|unless|and|or))\s*\Z")
_TEMPLATE, _IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.DOTALL), re.compile(r"[{}`]|" + _DQ + "|" + _SQ, re.DOTALL | re.MULTILINE)


def blank(text: str, family: str) -> str:
    """``text`` with comments as spaces and strings as quotation marks, from a string's second line on as \\x01; lines and offsets stay."""
    out, at, skip = [], 0, _SKIP[family]
    while m := skip.search(text, at):
        start, end, kind = m.start(), m.end(), m.lastgroup
        if kind == "nest":
            end = _nested_end(text, start)
        elif kind == "tick":
            end = _template_end(text, start)
        elif kind == "slash":
            found = _REGEX.match(text, start) if _BEFORE_REGEX.search(text, max(0, start - 80), start) else None
            if not found:
                out.append(text[at:end])
                at = end
                continue
            end = found.end()
        first, *more = text[start:end].split("\n")
        fill, rest = (" ", " ") if kind in ("note", "nest") else ('"', "\x01")
        out += [text[at:start], "\n".join([fill * len(first), *[rest * len(x) for x in more]])]
        at = max(end, start + 1)
    return "".join([*out, text[at:]])


def _nested_end(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template_end(text: str, at: int) -> int:
    """Past the template that opens at ``at``; templates in its expressions are counted on a stack."""
    depths, at = [0], at + 1  # of each open template the braces open in its expression; 0: in its text
    while depths:
        m = (_IN_TEMPLATE if depths[-1] else _TEMPLATE).search(text, at)
        if not m:
            return len(text)
        at = m.end()
        if m[0] == "`":
            depths.append(0) if depths[-1] else depths.pop()
        elif m[0] in ("${", "{"):
            depths[-1] += 1
        elif m[0] == "}":
            depths[-1] -= 1
    return at


# --- forms

_MODS = {
    "rs": r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|auto|extern(?:\s*\"+)?)\s+)*",
    "js": r"(?:(?:export|default|declare|abstract|async)\s+)*",
    "java": r"(?:(?:public|private|protected|abstract|final|static|sealed|non-sealed|strictfp|default|synchronized|native)\s+)*",
    "cs": r"(?:(?:public|private|protected|internal|abstract|sealed|static|partial|readonly|ref|file|unsafe|new|virtual|override|async|extern)\s+)*",
    "kt": r"(?:(?:public|private|protected|internal|open|abstract|data|sealed|inner|enum|annotation|value|inline|override|suspend|operator|infix|tailrec|external|expect|actual|final|companion)\s+)*",
    "swift": r"(?:(?:public|private|internal|open|final|fileprivate|indirect|static|class|override|mutating|nonmutating|convenience|required)\s+)*",
    "php": r"(?:(?:abstract|final|readonly|public|private|protected|static)\s+)*",
}
#: (kind, form, what ends it: "{" a block, ";" an end of statement, "" either); kinds in brackets open a scope and are not told.
_FORMS = {
    "rs": [("function", r"fn\s+(\w+)", ""), ("struct", r"struct\s+(\w+)", ""), ("enum", r"enum\s+(\w+)", "{"), ("trait", r"trait\s+(\w+)", "{"), ("mod", r"mod\s+(\w+)", ""), ("type", r"type\s+(\w+)", ";"), ("macro", r"macro_rules!\s*(\w+)", "{")],
    "js": [("class", r"class\b\s*(?!extends\b)(\w*)", "{"), ("function", r"function\b\s*\*?\s*([\w$]*)", "{"), ("interface", r"interface\s+(\w+)", "{"), ("enum", r"(?:const\s+)?enum\s+(\w+)", "{"), ("type", r"type\s+(\w+)\s*(?:<.*?>\s*)?=", ";"), ("(namespace)", r"(?:namespace|module)\s+([\w.]+)", "{")],
    "java": [("class", r"class\s+(\w+)", "{"), ("record", r"record\s+(\w+)\s*[<(]", "{"), ("interface", r"@?interface\s+(\w+)", "{"), ("enum", r"enum\s+(\w+)", "{")],
    "cs": [("(namespace)", r"namespace\s+([\w.]+)", "{"), ("class", r"class\s+(\w+)", ""), ("record", r"record\s+(?:class\s+|struct\s+)?(\w+)", ""), ("interface", r"interface\s+(\w+)", "{"), ("struct", r"struct\s+(\w+)", "{"), ("enum", r"enum\s+(\w+)", "{")],
    "kt": [("interface", r"(?:fun\s+)?interface\s+(\w+)", ""), ("class", r"class\s+(\w+)", ""), ("object", r"object\s+(\w+)", ""), ("(object)", r"object\b()", "{"), ("function", r"fun\s+(?:<.*?>\s*)?(?:[\w<>.?, ]+\.)?(\w+|`[^`]*`)\s*\(", "")],
    "swift": [("class", r"(?:class|actor)\s+(?!func\b|var\b|let\b)(\w+)", "{"), ("struct", r"struct\s+(\w+)", "{"), ("enum", r"enum\s+(\w+)", "{"), ("protocol", r"protocol\s+(\w+)", "{"), ("(extension)", r"extension\s+([\w.]+)", "{"), ("function", r"func\s+(\w+|[^\w\s(]+)", "")],
    "php": [("(namespace)", r"namespace\s+([\w\\]+)", "{"), ("class", r"class\s+(\w+)", "{"), ("interface", r"interface\s+(\w+)", "{"), ("trait", r"trait\s+(\w+)", "{"), ("enum", r"enum\s+(\w+)", "{"), ("function", r"function\s+&?\s*(\w+)\s*\(", "")],
}
_COMPILED = {f: [(kind, re.compile(_MODS.get(f, "") + form, re.DOTALL), by) for kind, form, by in forms] for f, forms in _FORMS.items()}
_CONST = re.compile(_MODS["rs"].replace("|const", "") + r"const\s+(\w+)\s*:")
_GO_FUNC = re.compile(r"func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*[\[(]")
_GO_TYPE = re.compile(r"(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+(=\s*)?(struct|interface)?")
_JS_MEMBER = re.compile(r"(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set|declare|accessor)\s+)*\*?\s*(#?[\w$]+|\[[^\]]*\])\s*\??\s*(?=[<(])")
_JS_ARROW = re.compile(r"(?:(?:(?:export|default|declare)\s+)*(?:const|let|var)\s+|(?:(?:public|private|protected|static|override|readonly)\s+)*)(#?[\w$]+)\s*(?::[^=]*(?:=>[^=]*)?)?=\s*(?:async\b\s*)?(?:<[^(]*>\s*)?(?=[(\w])")
_TYPED = re.compile(r"(?:[\w.<>\[\],?&*\s:]+[\s>\]*?])?([\w.]+)\s*(?:<[^()]*>)?\s*\(")
_C_BLOCK = re.compile(r"(?:typedef\s+|static\s+|inline\s+|export\s+)*(?:(struct|class|union|enum|namespace)\b(?:\s+(?:class|struct))?)\s*(?:\w+\s*\([^)]*\)\s*)?((?:\w+::)*\w+)?")
_C_CALL = re.compile(r"((?:\w+(?:<[^<>()]*>)?::)*(?:~?\w+|operator\s*(?:\(\s*\)|\[\s*\]|[^\w\s(]+|[\w:<> *&]+?)))\s*\(")
_C_EXTERN = re.compile(r"extern\s*\"+\s*\Z")
_NO_NAME = frozenset("if for while switch catch return function do else try new throw await typeof with using lock fixed foreach when sizeof alignas decltype noexcept __attribute__ __declspec requires static_assert defined delete case synchronized".split())
_CLASSES = frozenset(["class", "struct", "record", "interface", "enum", "trait", "protocol", "object", "union", "(object)", "(extension)"])
_FILES = frozenset(["", "(namespace)", "(extern)"])


def _balanced(s: str, at: int) -> int:
    """Past the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(s, at):
        depth += 1 if m[0] in "([{" else -1
        if not depth:
            return m.end()
    return len(s)


def _angles_end(s: str, at: int) -> int:
    """Past the angle bracket that closes the one at ``at``, arrows left aside."""
    depth = 0
    for m in re.compile(r"->|=>|[<>]").finditer(s, at):
        depth += {"<": 1, ">": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return len(s)


def _past_marks(s: str, family: str) -> int:
    """Past white space, attributes, annotations, access labels and template heads."""
    at = 0
    while True:
        at += len(s) - at - len(s[at:].lstrip(" \t\r\n,"))
        rest = s[at : at + 120]
        if family in ("rs", "php") and rest.startswith(("#[", "#![")):
            at = _balanced(s, s.index("[", at))
        elif family in ("cs", "c") and rest.startswith("["):
            at = _balanced(s, at)
        elif m := re.match(r"@(?!interface\b)[\w.]+", rest):
            at += m.end()
            if s[at : at + 1] == "(":
                at = _balanced(s, at)
        elif family == "c" and (m := re.match(r"(?:public|private|protected|signals|(?:public |private )?slots)\s*:(?!:)", rest)):
            at += m.end()
        elif family == "c" and (m := re.match(r"template\s*(?=<)", rest)):
            at = _angles_end(s, at + m.end())
        else:
            return at


def _match(family: str, head: str, scope: str, owner: str, by: str) -> tuple[str, str] | None:
    """(kind, name) of the form that the statement ``head`` has, ended by a block ("{") or not (";")."""
    for kind, form, ends in _COMPILED.get(family, ()):
        if ends in ("", by) and (m := form.match(head)):
            if m[1] or kind[0] == "(":
                return kind, m[1].strip("`") or kind
            if "default" in head[: m.end()]:
                return kind, "default"
    return _MORE[family](head, scope, owner, by) if family in _MORE else None


def _rust(head: str, scope: str, owner: str, by: str) -> tuple[str, str] | None:
    if m := re.match(r"(?:default\s+|unsafe\s+)*impl\b\s*", head):
        at = _angles_end(head, m.end()) if head[m.end() : m.end() + 1] == "<" else m.end()
        of = re.split(r"\bwhere\b", head[at:])[0]
        return "impl", " ".join(re.split(r"\bfor\b(?!\s*<)", of)[-1].split())
    if by == ";" and (m := _CONST.match(head)):
        return "const", m[1]
    return None


def _go(head: str, scope: str, owner: str, by: str) -> tuple[str, str] | None:
    if m := _GO_FUNC.match(head):
        return ("method", m[2]) if m[1] else ("function", m[2])
    if (scope == "(types)" or re.match(r"type\s", head)) and (m := _GO_TYPE.match(head)):
        if m[3] and by == "{":
            return m[3], m[1]
        return ("type", m[1]) if by == ";" else None
    return None


def _script(head: str, scope: str, owner: str, by: str) -> tuple[str, str] | None:
    declared = re.match(r"(?:(?:export|default|declare)\s+)*(?:const|let|var)\s", head)
    if (declared or scope in ("class", "(object)")) and (m := _JS_ARROW.match(head)):
        at = m.end()
        if re.match(r"function\b", head[at:]):
            return ("function" if declared else "method", m[1]) if by == "{" else None
        after = _balanced(head, at) if head[at] == "(" else at + len(re.match(r"\w*", head[at:])[0])
        if re.match(r"\s*(?::(?:[^={(]|=>|\([^)]*\))*)?=>", head[after:]):
            return "function" if declared else "method", m[1]
    if scope in ("class", "(object)") and by == "{" and (m := _JS_MEMBER.match(head)) and m[1] not in _NO_NAME:
        return "method", m[1]
    return None


def _typed(head: str, scope: str, owner: str, by: str) -> tuple[str, str] | None:
    """Methods and constructors of Java and C#: a name before a parenthesis, with a type before it or the class's own name, in a class or, with a body, at the top of a file."""
    if scope not in _CLASSES and scope != "" or re.match(r"(?:delegate|operator|event)\b", head):
        return None
    m = _TYPED.match(head)
    if not m or m[1] in _NO_NAME:
        return None
    if m[1] == owner:
        return "constructor", m[1]
    typed = re.sub(_MODS["cs"] + "|" + _MODS["java"], "", head[: m.start(1)]).strip()
    if not scope and (not (by == "{" or re.match(r"\s*=>", head[_balanced(head, m.end() - 1) :])) or _NO_NAME.intersection(re.findall(r"\w+", typed))):
        return None  # a statement
    return ("method", m[1].rsplit(".", 1)[-1]) if typed and typed != "new" else None


def _c(head: str, scope: str, owner: str, by: str) -> tuple[str, str] | None:
    if by != "{":
        return None
    if _C_EXTERN.match(head):
        return "(extern)", "(extern)"
    if (m := _C_BLOCK.match(head)) and "(" not in head[m.end() :].split(":")[0]:
        kind = {"namespace": "namespace", "union": "struct"}.get(m[1], m[1])
        return (kind, m[2]) if m[2] and m[1] != "union" else ("(namespace)" if m[1] == "namespace" else "(object)", "")
    if scope in _FILES or scope in ("namespace", *_CLASSES):
        for m in _C_CALL.finditer(head):
            if m[1].split("::")[-1] not in _NO_NAME:
                return None if "=" in head[: m.start()].replace("operator", "") else ("method" if scope in _CLASSES else "function", re.sub(r"\s+", " ", m[1]))
    return None


_MORE = {"rs": _rust, "go": _go, "js": _script, "java": _typed, "cs": _typed, "c": _c}
#: Families whose statements may end with a line, and what goes on nevertheless.
_BY_LINE = ("js", "go", "kt", "swift")
_OPEN_END = re.compile(r"(?:[,(=:&|+*/.<?\[-]|=>|->|\b(?:extends|implements|where|return|else))\Z")
_GOES_ON = re.compile(r"\s*(?:\{|where\b|:(?!:)|implements\b|extends\b|throws\b|=|->|[.|&?+,])")
#: What stands before a brace that begins a value, not a block.
_VALUE = {
    "js": re.compile(r"(?:[=(,\[?&|:]|\b(?:return|default|in|of|yield|await|extends))\s*\Z"),
    "go": re.compile(r"(?:[=(,\]:]|\b(?:return|interface|struct))\s*\Z"),
}
_ANY_VALUE = re.compile(r"(?:[=(,\[]|\breturn)\s*\Z")
_GO_STATEMENT, _GO_DECLARED = re.compile(r"\s*(?:func|if|for|switch|select|else|type|go|defer|case|default|\Z)\b"), re.compile(r"\s*(?:type\s+)?\w+(?:\[[^\]]*\])?\s+(?:struct|interface)\s*\Z")
_C_INITIAL = re.compile(r"\)\s*(?:noexcept\s*)?:[^:].*[\w>]\s*\Z", re.DOTALL)
#: Characters before a brace that are looked at, and before one in a list of initial values.
_LOOK, _LOOK_FAR = 160, 4000


def _is_value(code: str, family: str, began: int, at: int, inside: str) -> bool:
    """Whether the brace at ``at`` begins a value: a literal, a type, a member's initial value."""
    if inside == "(value)" and family != "js":
        return True
    if family == "go" and (inside == "(types)" or code.startswith("type", began + len(code[began : began + 9]) - len(code[began : began + 9].lstrip()))) and _GO_DECLARED.match(code, began, at):
        return False
    if _VALUE.get(family, _ANY_VALUE).search(code, max(began, at - _LOOK), at):
        return True
    if family == "go":
        return not _GO_STATEMENT.match(code, began, at) and bool(re.compile(r"[\w\]]\s*\Z").search(code, max(began, at - _LOOK), at))
    return family == "c" and bool(re.compile(r"[\w>]\s*\Z").search(code, max(began, at - _LOOK), at)) and bool(_C_INITIAL.search(code, max(began, at - _LOOK_FAR), at))


#: Line ends are events only where they may end a statement.
_EVENTS = {False: re.compile(r"[{}()\[\];,]"), True: re.compile(r"[{}()\[\];,\n]")}


class _Found:
    """A definition on its way: its text from ``start`` to ``body``, and ``end`` once that is met."""

    __slots__ = ("kind", "name", "start", "body", "end", "receiver")

    def __init__(self, kind, name, start, body, end, receiver=None):
        self.kind, self.name, self.start, self.body, self.end, self.receiver = kind, name, start, body, end, receiver


def _blocks(code: str, family: str) -> Iterator[_Found]:
    """Definitions of a language with braces, in no order."""
    stack: list[tuple] = []  # (closing bracket, scope, definition or None, where the statement around it began or None, name)
    began, by_line = 0, family in _BY_LINE

    def found(at: int, by: str, last: int) -> tuple[_Found | None, str, str]:
        top = stack[-1] if stack else ("", "", None, None, "")
        text = code[began:at]
        skipped = _past_marks(text, family)
        head = text[skipped:]
        got = _match(family, head, top[1], top[4], by) if head.strip() else None
        if got is None:
            return None, "", ""
        receiver = m[1] if family == "go" and (m := _GO_FUNC.match(head)) else None
        told = _Found(got[0], got[1], began + skipped, last, last, receiver) if got[0][0] != "(" else None
        return told, got[0], got[1]

    for m in _EVENTS[by_line].finditer(code):
        c, at = m[0], m.start()
        inside = stack[-1][1] if stack else ""
        if c == "{":
            if inside == "(paren)":
                stack.append(("}", "(value)", None, began, ""))
            else:
                value = _is_value(code, family, began, at, inside)
                told, scope, name = (None, "", "") if value else found(at, "{", at)
                if value:
                    stack.append(("}", "(object)" if family == "js" else "(value)", None, None if inside in ("(value)", "(object)") else began, ""))
                else:
                    stack.append(("}", scope or "(block)", told, None, name))
            began = at + 1
        elif c in "([":
            if family == "go" and c == "(" and code[began:at].strip() == "type":
                stack.append((")", "(types)", None, None, ""))
                began = at + 1
            else:
                stack.append((")" if c == "(" else "]", "(paren)", None, None, ""))
        elif c in "}])":
            while stack and stack[-1][0] != c and not (c != "}" and stack[-1][0] == "}"):
                stack.pop()
            if stack and stack[-1][0] == c:
                _, scope, told, back, _ = stack.pop()
                if told:
                    told.end = at
                    yield told
                if scope != "(paren)":
                    began = at + 1 if back is None else back
                    if family == "go" and scope == "(types)":
                        began = at + 1
        elif inside == "(paren)":
            continue
        elif c == ",":
            if inside == "(object)" and family == "js":
                began = at + 1
        elif c == ";" or by_line:
            if c == "\n":
                upto = at
                while upto > began and code[upto - 1].isspace():
                    upto -= 1
                if upto == began or _OPEN_END.search(code, max(began, upto - 12), upto) or _GOES_ON.match(code, at):
                    continue
            told, _, _ = found(at, ";", at + (c == ";"))
            if told:
                told.end = at - (c == "\n")
                yield told
            began = at + 1
    for _, _, told, _, _ in stack:
        if told:
            told.end = max(told.body, len(code.rstrip()) - 1)
            yield told


_PY = re.compile(r"^([ \t]*)(?:(class)|(?:async[ \t]+)?def)[ \t]+(\w+)", re.MULTILINE)
_RB = re.compile(r"^([ \t]*)(?:(class|module)[ \t]+([A-Z][\w:]*)|(?:private[ \t]+|protected[ \t]+|public[ \t]+)?def[ \t]+(?:self\.)?([\w?!=]+|[^\s\w(]+))", re.MULTILINE)
_LUA = re.compile(r"^([ \t]*)(?:(?:local[ \t]+)?function[ \t]+([\w.:]+)|(?:local[ \t]+)?([\w.]+)[ \t]*=[ \t]*function\b)", re.MULTILINE)


def _indented(code: str, family: str) -> Iterator[_Found]:
    """Definitions of Python: a block goes on to the last line that stands deeper."""
    starts = [0, *[m.end() for m in re.finditer("\n", code)]]
    deep = [len(line) - len(line.lstrip()) if line.strip() else None for line in code.split("\n")]
    for m in _PY.finditer(code):
        body = _colon(code, m.end())
        end = line = bisect_right(starts, body) - 1
        for i in range(line + 1, len(deep)):
            if deep[i] is not None:
                if deep[i] <= len(m[1]) and code[starts[i]] != "\x01":
                    break
                end = i
        last = (starts[end + 1] if end + 1 < len(starts) else len(code) + 1) - 2
        yield _Found("class" if m[2] else "method" if m[1] else "function", m[3], m.end(1), body, max(last, m.end(1)))


def _colon(code: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[()\[\]{}:\n]").finditer(code, at):
        depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(m[0], 0)
        if depth <= 0 and m[0] in ":\n":
            return m.start()
    return len(code)


def _worded(code: str, family: str) -> Iterator[_Found]:
    """Definitions of Ruby and Lua: a block goes on to the first ``end`` that stands no deeper."""
    for m in (_RB if family == "rb" else _LUA).finditer(code):
        line_end = code.find("\n", m.end()) % (len(code) + 1)
        first = code[m.end() : line_end]
        end = m.start()
        if not re.search(r"\bend[ \t;)]*\Z", first) and not (family == "rb" and not m[2] and re.match(r"(?:\([^()]*\))?[ \t]*=[^=~]", first)):
            deep = len(m[1].expandtabs())
            for x in re.compile(r"^([ \t]*)end\b", re.MULTILINE).finditer(code, line_end):
                if len(x[1].expandtabs()) <= deep:
                    end = x.start()
                    break
        name = m[3] or m[4] if family == "rb" else m[2] or m[3]
        kind = m[2] or ("method" if m[1] else "function") if family == "rb" else "function"
        yield _Found(kind, name, m.end(1), line_end, end)


FAMILY = {"ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "cjs": "js", "kts": "kt", "pyw": "py", "cpp": "c", "cc": "c", "cxx": "c", "h": "c", "hpp": "c", "hh": "c"}
FAMILIES = frozenset(_SKIP)
_READERS = {"py": _indented, "rb": _worded, "lua": _worded}


def _read(text: str, family: str) -> tuple[str, list[int], list[_Found]]:
    """The code without comments and strings, where its lines start, and its definitions in order."""
    code = blank(text, family)
    return code, [0, *[m.end() for m in re.finditer("\n", code)]], sorted(_READERS.get(family, _blocks)(code, family), key=lambda x: (x.start, -x.end))


def definitions(ext: str) -> Callable[[str], list[tuple]]:
    """(kind, name, signature, first line, last line, owner) of each definition, in order; none for an unknown extension.

    The signature is the text up to the body with single spaces; the owner is the definition around it, in Go the receiver's type.
    """
    family = FAMILY.get(ext, ext)
    return lambda text: _defined(text, *_read(text, family)) if family in _SKIP else []


def _defined(text: str, code: str, starts: list[int], known: list[_Found]) -> list[tuple]:
    line = lambda at: bisect_right(starts, at)
    out, open_ = [], []
    for x in known:
        while open_ and open_[-1].end < x.start:
            open_.pop()
        owner = x.receiver or (open_[-1].name if open_ else None)
        open_.append(x)
        out.append((x.kind, x.name, " ".join(text[x.start : x.body].split()), line(x.start), line(x.end), owner))
    return out


CALLS = "line int, callee string, receiver string, caller string, caller_owner string, caller_start int, caller_end int"
_CALL = re.compile(r"(?:(\w+)\s*(?:\.|::|->|\?\.)\s*)?(\w+)\s*(?:::<[^()]*>|<[\w, ]*>)?\(")


def calls(ext: str) -> Callable[[str], list[tuple]]:
    """(line, callee, receiver, caller, caller's owner, first and last line) of each call in code, with the innermost definition around it (nulls outside of any).

    The receiver is the name right before the callee's dot. What a definition calls itself in its own head is no call; strings and comments hold none.
    """
    family = FAMILY.get(ext, ext)
    return lambda text: _called(*_read(text, family)) if family in _SKIP else []


def _called(code: str, starts: list[int], known: list[_Found]) -> list[tuple]:
    out, open_, upcoming = [], [], 0
    for m in _CALL.finditer(code):
        while upcoming < len(known) and known[upcoming].start <= m.start(2):
            open_.append((known[upcoming], known[upcoming].receiver or next((x.name for x, _ in reversed(open_) if x.end >= known[upcoming].start), None)))
            upcoming += 1
        while open_ and open_[-1][0].end < m.start(2):
            open_.pop()
        if open_ and open_[-1][0].name == m[2] and m.start(2) < open_[-1][0].body:
            continue
        at, owner = open_[-1] if open_ else (None, None)
        where = (at.name, owner, bisect_right(starts, at.start), bisect_right(starts, at.end)) if at else (None,) * 4
        out.append((bisect_right(starts, m.start(2)), m[2], m[1], *where))
    return out


def definitions_and_calls(ext: str) -> Callable[[str], tuple[list[tuple], list[tuple]]]:
    """What ``definitions`` and ``calls`` give, from one reading of the text."""
    family = FAMILY.get(ext, ext)

    def parse(text: str) -> tuple[list[tuple], list[tuple]]:
        if family not in _SKIP:
            return [], []
        read = _read(text, family)
        return _defined(text, *read), _called(*read)

    return parse
