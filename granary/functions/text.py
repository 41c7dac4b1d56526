"""Scalar text functions as Column expressions; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that cost a token each.
WIDE = r"[\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]"
ASCII = r"[\x00-\x7F]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def est_tokens(text: Column | str) -> Column:
    """The estimated cost of a text: a token for four ASCII characters, for a wide character, for two others; at least one."""
    t = _col(text)
    n = F.length(t)
    # what stays when runs of ASCII go, and when wide characters go as well: n - rest of four, rest - other of one, other of two, each written once
    rest = F.length(F.regexp_replace(t, ASCII + "+", ""))
    other = F.length(F.regexp_replace(t, r"[\x00-\x7F\x{3000}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]+", ""))
    whole = F.when(n == F.octet_length(t), F.floor(n / 4)).otherwise(F.floor((n + 3 * rest) / 4) - F.ceil(other / 2))
    return F.greatest(F.lit(1), whole).cast("bigint")


def n_lines(text: Column | str) -> Column:
    """Lines of a text: a last line end opens no further line; the empty text has none."""
    t = _col(text)
    ends = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit("")))
    return (ends + F.when((t == "") | t.endswith("\n"), 0).otherwise(1)).cast("bigint")


def lines(text: Column | str) -> Column:
    """The lines of a text as an array, each without its line end and carriage return."""
    t = _col(text)
    parts = F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", "")))


def occurrences(text: Column, literal: Column | str) -> Column:
    """Non-overlapping occurrences of a literal, by the bytes that go with them (characters would be counted anew each time)."""
    lit = F.lit(literal) if isinstance(literal, str) else literal
    return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, lit, F.lit("")))) / F.octet_length(lit)).cast("bigint")


def compress_text(text: Column | str) -> Column:
    """Runs of three and more line ends to two, then trailing blanks of lines, then one-line comments, then the ends."""
    t = F.regexp_replace(_col(text), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"<!--[^\n]*?-->", "")
    return F.regexp_replace(t, r"\A\s+|\s+\z", "")


CUT_NOTE = "...\n\n[Conversation truncated to fit token budget]"


def summarize(text: Column | str, max_tokens: int = 500) -> Column:
    """A text of over four characters a token is cut there, back to the last sentence end if there is one."""
    t = _col(text)
    head = F.substring(t, 1, 4 * max_tokens)
    sentence = F.regexp_extract(head, r"(?s)\A(.*[.!?。！？])", 1)
    return F.when(F.length(t) <= 4 * max_tokens, t).otherwise(F.concat(F.when(sentence != "", sentence).otherwise(head), F.lit(CUT_NOTE)))


def anchor(title: Column | str) -> Column:
    """A heading's anchor: lower case, letters, digits and hyphens, blanks as hyphens."""
    return F.replace(F.regexp_replace(F.lower(_col(title)), r"[^\p{L}\p{N} -]", ""), F.lit(" "), F.lit("-"))


def short_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(_col(text).cast("binary"), 256), 1, 12)


# Words that are no keywords.
STOPWORDS = (
    "the", "and", "for", "with", "this", "that", "from", "into", "when", "should", "would", "could", "have", "has",
    "are", "was", "were", "not", "fix", "add", "implement", "make", "update", "change", "refactor", "function", "method", "file",
    "code", "bug", "error", "issue", "where", "how", "why", "what", "all", "any", "new", "old", "use", "using",
)


def keywords(query: str) -> list[str]:
    """The keywords of a query in order: of at least three bytes, no stopwords, once each; the parts of a compound before it."""
    import re

    out: list[str] = []
    for word in re.split(r"[^0-9A-Za-z_À-￿]+", query.lower()):
        for part in ([*word.split("_"), word] if "_" in word else [word]):
            if len(part.encode()) >= 3 and part not in STOPWORDS and part not in out:
                out.append(part)
    return out


def score_text(text: Column, words: list[str], cap: int) -> Column:
    """The sum over keywords of their occurrences, each up to ``cap``."""
    score = F.lit(0).cast("bigint")
    for w in words:
        score = score + F.least(occurrences(text, w), F.lit(cap))
    return score


# Decision points of the complexity heuristic, counted in trimmed lines that are no comments.
BRANCHES = [
    " if ", "\tif ", "(if ", "} else if", "else if(", " elif ", " elif(", "for ", "for(", "while ", "while(", "loop {", "match ",
    " case ", "catch ", "catch(", "except ", "except:", " && ", " || ", " ? ", " => ",
]
#: Each of them holds one of these.
BRANCH_STEMS = ["if", "for ", "for(", "while", "loop {", "match ", " case ", "catch", "except", " && ", " || ", " ? ", " => "]


def may_branch(line: Column) -> Column:
    """False only for lines without a decision point: one look for each stem."""
    return reduce(lambda a, b: a | b, [line.contains(x) for x in BRANCH_STEMS])


def complexity_of_line(line: Column) -> Column:
    t = F.trim(line)
    score = F.lit(0).cast("bigint")
    for b in BRANCHES:
        score = score + occurrences(t, b)
    return F.when(t.rlike(r"^(//|#|\*|/\*)"), 0).otherwise(score).cast("bigint")


def risk_label(score: Column) -> Column:
    return F.when(score.between(1, 5), "low").when(score.between(6, 10), "medium").when(score.between(11, 20), "high").otherwise("critical")


def log_level(line: Column | str) -> Column:
    u = _col(line)
    has = lambda *words: u.rlike("(?i)" + "|".join(words))
    return F.when(has("ERROR", "CRITICAL", "FATAL"), "ERROR").when(has("WARN"), "WARN").when(has("INFO"), "INFO").when(has("DEBUG", "TRACE"), "DEBUG").otherwise("OTHER")


def pct1(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """A percentage with one decimal, halves up; ``empty`` where the whole is zero."""
    return F.when(whole > 0, F.floor(part.cast("double") / whole.cast("double") * 1000.0 + 0.5) / 10.0).otherwise(F.lit(empty))


def budget_strategy(used: Column, budget: Column) -> Column:
    share = F.when(budget > 0, used.cast("double") / budget.cast("double") * 100.0).otherwise(F.lit(0.0))
    return F.when(share < 50, "normal").when(share < 75, "conservative").when(share < 90, "aggressive").otherwise("critical")


def zoom_level(strategy: Column) -> Column:
    return F.when(strategy == "critical", "skeleton").when(strategy == "aggressive", "sketch").otherwise("body")


def cvss_severity(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "moderate").when(score > 0, "low").otherwise("unknown")


# Ranks by which findings are ordered.
RANKS = {
    "confidence": {"high": 2, "medium": 1, "low": 0},
    "severity": {"critical": 3, "high": 2, "medium": 1, "low": 0},
    "audit": {"critical": 4, "high": 3, "moderate": 2, "medium": 2, "low": 1},
    "diagnostics": {"error": 3, "warning": 2, "hint": 1, "unknown": 2},
}


def rank(kind: str, value: Column) -> Column:
    out = F.lit(0)
    for name, n in RANKS[kind].items():
        out = F.when(value == name, F.lit(n)).otherwise(out)
    return out


def truncate_title(title: Column | str) -> Column:
    t = F.replace(_col(title), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > 160, F.concat(F.substring(t, 1, 157), F.lit("..."))).otherwise(t)


def trim_to_budget(text: Column | str, tokens: int) -> Column:
    t = _col(text)
    return F.when(F.length(t) > 4 * tokens, F.concat(F.substring(t, 1, 4 * tokens), F.lit("\n… (truncated)"))).otherwise(t)


def hunk_context(header: Column | str) -> Column:
    """What follows the second @@ of a hunk header, or (top-level)."""
    found = F.trim(F.regexp_extract(_col(header), r"@@[^@]*@@(.*)", 1))
    return F.when(found == "", "(top-level)").otherwise(found)


# How telling a file's stem is as an entry point.
NAME_SCORES = {"main": 10, "lib": 9, "index": 9, "app": 8, "server": 8, "application": 8, "mod": 7, "__init__": 7, "cli": 6, "router": 5, "routes": 5, "handler": 5, "handlers": 5, "config": 4, "settings": 4}


def name_score(stem: Column) -> Column:
    """By a map, so the stem is worked out once; a chain of cases makes a method that the JVM does not compile, with all that stands beside it."""
    table = F.create_map(*[F.lit(x) for kv in NAME_SCORES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, stem), F.lit(0))


def unix_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def is_exported(signature: Column) -> Column:
    return signature.rlike(r"^(pub |export )|public |Public ")


# Extensions to languages.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript",
    "tsx": "tsx", "go": "go", "cpp": "c++", "cc": "c++", "cxx": "c++", "c": "c", "h": "c/c++ header", "hpp": "c/c++ header", "hh": "c/c++ header",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "rb": "ruby", "cs": "c#", "php": "php", "lua": "lua", "md": "markdown",
    "markdown": "markdown", "mdx": "markdown", "json": "json", "jsonc": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "html": "html",
    "htm": "html", "css": "css", "scss": "scss", "sass": "scss", "sh": "shell", "bash": "shell", "sql": "sql", "proto": "protobuf",
    "graphql": "graphql", "gql": "graphql", "tf": "terraform", "tfvars": "terraform", "": "no extension",
}


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), ext)


# The extensions that each operator takes for code; they differ.
CODE_EXTENSIONS = {
    "usages": ("rs", "py", "js", "jsx", "ts", "tsx", "go", "cpp", "cc", "cxx", "hpp", "hh", "h", "java", "rb", "c", "cs", "php"),
    "complexity": ("rs", "py", "js", "jsx", "ts", "tsx", "go", "cpp", "cc", "cxx", "c", "java", "rb", "cs", "php", "kt", "swift", "lua"),
    "dead_code": ("rs", "py", "js", "jsx", "ts", "tsx", "go", "cpp", "cc", "cxx", "c", "java", "rb", "cs", "php", "kt", "swift"),
    "context_pack": ("rs", "py", "js", "jsx", "ts", "tsx", "go", "cpp", "cc", "cxx", "hpp", "hh", "h", "c", "java", "kt", "rb", "cs", "php", "swift", "lua"),
    "security": ("rs", "py", "js", "jsx", "ts", "tsx", "go", "java", "rb", "cs", "php", "kt", "swift", "c", "cpp"),
    "outline": ("rs", "py", "js", "jsx", "ts", "tsx", "go", "c", "cpp", "h", "hpp", "java", "cs", "rb", "php", "swift", "kt", "scala"),
    "digest": ("rs", "py", "js", "jsx", "ts", "tsx", "go", "java", "kt", "rb", "cs", "php", "swift", "cpp", "cc", "c"),
}


def is_code(path: Column, operator: str) -> Column:
    """Whether a path's extension is code to an operator."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*CODE_EXTENSIONS[operator])


# Extensions of files that hold no text.
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "svg", "woff", "woff2", "ttf", "eot", "mp4", "webm", "mp3", "zip", "tar", "gz", "exe", "dll", "so", "dylib", "bin", "db", "sqlite", "lock")


def is_binary_path(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1).isin(*BINARY)


def glob_path(pattern: str) -> str:
    """A glob over paths: ** is anything, * and ? stay within a segment."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def glob_name(pattern: str) -> str:
    """A glob over names: * is anything, slashes included."""
    import re

    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def _any(col: Column, patterns: list[str]) -> Column:
    return col.rlike("|".join(patterns))


# What build output calls an error, a warning or noise.
ERROR_CASED = [
    r"^error\[", r"^error: ", r"^error$", r"error TS", r"^Error: ", r"^(Syntax|Type|Name|Value|Import|ModuleNotFound|Attribute|Runtime|FileNotFound|OS|Key|Index|ZeroDivision|Assertion|Indentation|UnicodeDecode)Error:",
    r"^Traceback \(most recent call last\):$", r"^FAILED$", r"^FAILED ",
]
ERROR_LOWER = [
    "could not compile", "failed to compile", "build failed", "^aborting due to.*error", "^found .*error", "^npm err!", r"\*\*\* error", r"^make: \*\*\*", "^cmake error", "cmake error:",
    "build failure", r"\[error\]", "compilation error", "^failed$", "^failures:", "^● ", ": error:", ": error ", " failed.* passed", " passed.* failed", " failed.* error", " error.* failed",
]
GO_ERRORS = ["undefined", "cannot", "invalid", "undeclared", "declared and not used", "imported and not used", "does not implement", "type mismatch", "not enough arguments", "too many arguments"]
WARNING_CASED = [r"^warning\[", r"^warning: ", "warning TS"]
WARNING_LOWER = ["^npm warn ", "^warn: ", "^warning: ", ": warning:", "deprecated.*warning", "warning.*deprecated"]
NOISE = ["^$", "^(Compiling|Downloading|Installing|Fetching|Resolving|Checking|Locking) "]


def is_go_error(line: Column) -> Column:
    return line.contains(".go:") & _any(F.lower(line), GO_ERRORS)


def is_error_line(line: Column) -> Column:
    t = F.trim(line)
    low = F.lower(t)
    return _any(t, ERROR_CASED) | _any(low, ERROR_LOWER) | (t.contains("Error: ") & low.rlike("unhandled|uncaught")) | is_go_error(line)


def is_warning_line(line: Column) -> Column:
    t = F.trim(line)
    return _any(t, WARNING_CASED) | _any(F.lower(t), WARNING_LOWER)


def is_noise_line(line: Column) -> Column:
    return _any(F.trim(line), NOISE)
