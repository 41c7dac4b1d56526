"""Ignore rules against git on a written tree."""

import os
import random
import shutil
import subprocess

import pytest

from granary.sources import ignore

LINES = ["*.log", "!keep.log", "build/", "/out", "a/b", "**/deep", "deep/**", "x?.txt", "[a-c]*.md", "![!a]z.md", "# note", "", "\\#odd", "*.tmp ", "!important/", "a/**/z", "foo", "!foo/", "/a/*.txt", "!/a/keep.txt", "doc/*/x.md", "\\!bang", "b*", "!build/keep.log"]
NAMES = ["keep.log", "x.log", "x1.txt", "keep.txt", "az.md", "bz.md", "#odd", "!bang", "t.tmp", "z", "foo", "x.md", "b.c", "out"]
DIRS = ["a", "b", "build", "deep", "out", "doc", "important", "foo", "c"]


def tree(rng):
    files = {}
    for _ in range(120):
        parts = [rng.choice(DIRS) for _ in range(rng.randint(0, 3))]
        files["/".join([*parts, rng.choice(NAMES)])] = "text"
    for folder in ["", *rng.sample(sorted({f.rsplit("/", 1)[0] + "/" for f in files if "/" in f}), 6)]:
        files[folder + ".gitignore"] = "\n".join(rng.sample(LINES, rng.randint(1, 7))) + "\n"
    folders = {f[:i] for f in files for i in range(len(f)) if f[i] == "/"}
    return {f: t for f, t in files.items() if f not in folders}


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
@pytest.mark.parametrize("seed", range(6))
def test_walk_equals_git(spark, tmp_path, seed):
    files = tree(random.Random(seed))
    for f, t in files.items():
        os.makedirs(tmp_path / os.path.dirname(f), exist_ok=True)
        (tmp_path / f).write_text(t)
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    told = subprocess.run(["git", "-c", "core.quotePath=false", "-c", "core.excludesFile=/dev/null", "ls-files", "-z", "--others", "--exclude-standard"], cwd=tmp_path, check=True, capture_output=True, text=True).stdout
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    assert sorted(r.path for r in ignore.walk(df).collect()) == sorted(x for x in told.split("\0") if x)


def test_order_of_files_and_odd_rows(spark):
    files = [(".gitignore", "*.a\n!x.a\r\n"), (".ignore", "!y.a\n*.b"), ("x.a", ""), ("y.a", ""), ("z.a", ""), ("d/x.b", ""), ("d/.gitignore", "!x.b"), (None, None), ("d/n", None), ("x.a", "again")]
    df = spark.createDataFrame(files, "path string, text string")
    assert sorted(r.path for r in ignore.walk(df).collect()) == [".gitignore", ".ignore", "d/.gitignore", "d/n", "x.a", "x.a", "y.a"]
    assert ignore.walk(df.limit(0)).collect() == []
