"""Change history: ownership, changed files, commits, structural diffs, blame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T


def code_ownership(numstat: DataFrame, top_n: int = 20, owners: int = 5) -> DataFrame:
    """numstat (path, author, added, date): per path its churn (rows), last change and up to five owners by lines added.

    The hottest paths are chosen first (churn falling, path rising), so only their authors are ranked.
    """
    hot = numstat.groupBy("path").agg(F.count("*").alias("churn"), F.max("date").alias("last_modified")).orderBy(F.col("churn").desc(), "path").limit(top_n)
    by = numstat.join(F.broadcast(hot.select("path")), "path", "left_semi").groupBy("path", "author").agg(F.sum(F.coalesce("added", F.lit(0))).alias("added"))
    whole = Window.partitionBy("path")
    ranked = by.withColumn("share", T.pct1(F.col("added"), F.sum("added").over(whole))).withColumn("rank", F.row_number().over(whole.orderBy(F.col("added").desc(), "author")))
    return ranked.where(F.col("rank") <= owners).join(F.broadcast(hot), "path").select("path", "churn", "last_modified", "rank", "author", "added", "share")


def changed_files(numstat: DataFrame, status: DataFrame) -> DataFrame:
    """Changed paths with lines added and deleted; the status is "modified" where none is known."""
    by = numstat.groupBy("path").agg(F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
    return by.join(status, "path", "left").withColumn("status", F.coalesce("status", F.lit("modified")))


def commit_log(commits: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """The newest commits with their files in order; the commits are chosen before the join."""
    newest = commits.orderBy(F.col("date").desc(), "sha").limit(limit)
    return newest.join(files, "sha", "left").groupBy("sha", "author", "date", "subject").agg(F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


def parse_log(lines: DataFrame) -> DataFrame:
    """Log lines (log, line_no, line) with "COMMIT:sha|email|date|subject" headers and file names to (log, n, sha7, email, date, subject, files): one row a commit, in order."""
    p = F.split(F.substring("line", 8, 1 << 30), "\\|", 4)
    head = F.when(F.col("line").startswith("COMMIT:"), F.struct(F.substring(p[0], 1, 7).alias("sha7"), p[1].alias("email"), p[2].alias("date"), p[3].alias("subject"), F.col("line_no").alias("at")))
    w = Window.partitionBy("log").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).where("head is not null")
    name = F.when(~F.col("line").startswith("COMMIT:") & (F.trim("line") != ""), F.struct("line_no", "line"))
    by = rows.groupBy("log", "head").agg(F.array_sort(F.collect_list(name)).alias("f"))
    return by.select("log", F.col("head.at").alias("n"), "head.sha7", "head.email", "head.date", "head.subject", F.transform("f", lambda x: x["line"]).alias("files"))


def diff_zoom(parsed: DataFrame, zoom: str) -> DataFrame:
    """Parsed diff lines at a zoom: body (all), sketch (headers only) or skeleton (counts by file and symbol)."""
    if zoom == "skeleton":
        return structural_diff(parsed)
    heads = F.col("kind").isin("hunk", "status") | F.col("line").startswith("diff --git ")
    return parsed.where(heads).select("diff", "line_no", "line") if zoom == "sketch" else parsed.select("diff", "line_no", "line")


def changed_report(changed: DataFrame) -> DataFrame:
    """Changed files, deleted ones last, then by path."""
    return changed.orderBy(F.col("status") == "deleted", "path")


def changed_totals(changed: DataFrame) -> DataFrame:
    """(files, added, deleted) over all changed files."""
    return changed.agg(F.count("*").alias("files"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))


def parse_numstat(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """Log text with "\\x1eauthor\\x1fdate" headers and numstat rows to (path, author, date, added, deleted); a binary count is zero.

    ``lines`` needs a column ``log`` naming the log; the header is carried forward within it.
    """
    head = F.when(F.col("line").startswith("\x1e"), F.struct(F.regexp_extract("line", "\x1e([^\x1f]*)\x1f", 1).alias("author"), F.regexp_extract("line", "\x1f(.*)$", 1).alias("date")))
    w = Window.partitionBy("log").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("head", F.last(head, ignorenulls=True).over(w)).withColumn("p", F.split("line", "\t")).where((F.size("p") == 3) & F.col("head").isNotNull())
    count = lambda i: F.coalesce(F.expr(f"try_cast(p[{i}] as bigint)"), F.lit(0))
    return rows.select("log", F.col("p")[2].alias("path"), F.col("head.author").alias("author"), F.col("head.date").alias("date"), count(0).alias("added"), count(1).alias("deleted"))


def parse_diff(lines: DataFrame) -> DataFrame:
    """Unified diff lines (diff, line_no, line) to (diff, line_no, line, path, context, kind): kind is added, deleted, hunk, status or other."""
    w = Window.partitionBy("diff").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    path = F.when(F.col("line").startswith("diff --git "), F.regexp_extract("line", r" b/(.*)$", 1))
    rows = lines.withColumn("path", F.last(path, ignorenulls=True).over(w))
    rows = rows.withColumn("context", F.last(F.when(F.col("line").startswith("@@"), T.hunk_context("line")).when(path.isNotNull(), F.lit("")), ignorenulls=True).over(w))
    kind = (
        F.when(F.col("line").startswith("@@"), "hunk").when(F.col("line").rlike(r"^(new file|deleted file|rename from)"), "status")
        .when(F.col("context") == "", "other").when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "deleted").otherwise("other")
    )
    return rows.withColumn("kind", kind)


def structural_diff(parsed: DataFrame) -> DataFrame:
    """Per file and enclosing symbol: hunks, lines added and deleted, and the file's status."""
    line = F.col("line")
    state = F.max(F.when(line.startswith("new file"), "added").when(line.startswith("deleted file"), "deleted").when(line.startswith("rename from"), "renamed"))
    by = parsed.where("path is not null and context is not null").groupBy("diff", "path", "context").agg(state.alias("state"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("hunk", "added", "deleted")])
    status = F.coalesce(F.max("state").over(Window.partitionBy("diff", "path")), F.lit("modified"))  # a row a symbol
    return by.withColumn("status", status).where("context <> ''").select("diff", "path", "status", F.col("context").alias("symbol"), "n_hunk", "n_added", "n_deleted")


def file_changes(parsed: DataFrame) -> DataFrame:
    """Per diff and path: its earlier path where it was renamed, the status, git's similarity, and hunks and lines added and deleted; a rename without hunks has a row too."""
    line, head = F.col("line"), F.col("context") == ""
    after = lambda x: F.max(F.when(head & F.col("line").startswith(x), F.expr(f"substring(line, {len(x) + 1})")))
    status = F.max(F.when(head, F.when(line.startswith("new file"), "added").when(line.startswith("deleted file"), "deleted").when(line.startswith("rename from"), "renamed")))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("hunk", "added", "deleted")]
    by = parsed.where("path is not null").groupBy("diff", "path").agg(after("rename from ").alias("old_path"), F.coalesce(status, F.lit("modified")).alias("status"), after("similarity index ").alias("s"), *counts)
    return by.select("diff", "path", "old_path", "status", F.expr("try_cast(rtrim('%', s) as bigint)").alias("similarity"), "n_hunk", "n_added", "n_deleted")


def parse_blame(lines: DataFrame) -> DataFrame:
    """Porcelain blame lines (blame, line_no, line) to (blame, at, sha7, author, date, content); a commit's author and date stand at its first line only."""
    w = Window.partitionBy("blame").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    sha = F.when(F.col("line").rlike(r"^[0-9a-f]{40} "), F.substring("line", 1, 40))
    at = F.when(sha.isNotNull(), F.regexp_extract("line", r"^[0-9a-f]{40} \d+ (\d+)", 1).cast("bigint"))
    rows = lines.withColumn("sha", F.last(sha, ignorenulls=True).over(w)).withColumn("at", F.last(at, ignorenulls=True).over(w))
    line, whole = F.col("line"), Window.partitionBy("blame", "sha")
    author = F.max(F.when(line.startswith("author "), F.substring("line", 8, 1000))).over(whole)
    seconds = F.max(F.when(line.startswith("author-time "), F.expr("try_cast(substring(line, 13) as bigint)"))).over(whole)
    # of a commit's lines only those that tell something, so a line is sorted by commit once and read once
    told = rows.where("sha is not null").where(line.startswith("\t") | line.startswith("author ") | line.startswith("author-time "))
    body = told.withColumns({"author": author, "seconds": seconds}).where(line.startswith("\t"))
    return body.select("blame", "at", F.substring("sha", 1, 7).alias("sha7"), "author", T.unix_date(F.col("seconds")).alias("date"), F.expr("substring(line, 2)").alias("content"))


def parse_stash(lines: DataFrame) -> DataFrame:
    """Lines "stash@{n}\\x1fdate\\x1fmessage" to (index, date, message, branch)."""
    p = F.split("line", "\x1f")
    branch = F.coalesce(F.nullif(F.regexp_extract(p[2], r"^(?:WIP on|On) ([^:]+):", 1), F.lit("")), F.lit("unknown"))
    return lines.select(F.regexp_extract(p[0], r"\{(\d+)\}", 1).cast("bigint").alias("index"), p[1].alias("date"), p[2].alias("message"), branch.alias("branch"))


def pr_context(numstat: DataFrame, status: DataFrame, files: DataFrame, commits: DataFrame, most_files: int = 10, most_commits: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a change is about: its largest files with their status, the tests related to them, and its newest commits."""
    from granary.sources.files import related_tests

    changed = changed_files(numstat, status).orderBy((F.col("added") + F.col("deleted")).desc(), "path").limit(most_files)
    return changed, related_tests(changed, files), commits.orderBy(F.col("date").desc(), "sha").limit(most_commits)
