"""Unified diffs as rows, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HUNK = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@"


def diff_lines(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """One row a line: keys, pos, line. Windows below run per diff, never over all of them."""
    return diffs.select(*keys, F.posexplode(F.split("diff", "\n")).alias("pos", "line"))


def parse_hunks(diffs: DataFrame, keys: list[str], naive_headers: bool = False) -> DataFrame:
    """(keys, path, side, start, count, pos) of ``diffs(keys, diff)``.

    ``---`` and ``+++`` lines are file headers only before the first hunk of a file; with
    ``naive_headers`` they always are. A missing count is 1; the path is the new one, else the old."""
    by = Window.partitionBy(*keys).orderBy("pos")
    rows = diff_lines(diffs, keys)
    rows = rows.withColumn("mark", F.when(F.startswith("line", F.lit("diff --git ")), "file").when(F.startswith("line", F.lit("@@ ")), "hunk"))
    # only these lines tell anything, and of them only names and numbers go through the windows
    rows = rows.where(F.col("mark").isNotNull() | F.startswith("line", F.lit("--- ")) | F.startswith("line", F.lit("+++ ")))

    def path_of(prefix: str, side: str):
        raw = F.regexp_replace(F.expr("substring(line, 5)"), r"\t.*$", "")
        name = F.when(raw == "/dev/null", F.lit("")).otherwise(F.regexp_replace(raw, f"^{side}/", ""))
        return F.when(F.startswith("line", F.lit(prefix)), name)

    rows = rows.select(*keys, "pos", "mark", path_of("--- ", "a").alias("old_here"), path_of("+++ ", "b").alias("new_here"), F.when(F.regexp_like("line", F.lit(HUNK)), F.col("line")).alias("line"))
    rows = rows.withColumn("last_mark", F.coalesce(F.last("mark", True).over(by), F.lit("file")))
    header = F.lit(True) if naive_headers else F.col("last_mark") == "file"
    last = lambda c: F.nullif(F.last(F.when(header, F.col(c)), True).over(by), F.lit(""))
    rows = rows.withColumn("old_path", last("old_here")).withColumn("new_path", last("new_here"))
    hunks = rows.where("line is not null")
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract("line", HUNK, k), F.lit("")).cast("int"), F.lit(1))
    sides = F.array(
        F.struct(F.lit("old").alias("side"), number(1).alias("start"), number(2).alias("count")), F.struct(F.lit("new").alias("side"), number(3).alias("start"), number(4).alias("count"))
    )
    out = hunks.select(*keys, "pos", F.coalesce("new_path", "old_path").alias("path"), F.explode(sides).alias("s"))
    return out.where("path is not null").select(*keys, "path", "s.side", "s.start", "s.count", "pos")


def changed_lines(hunks: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct line numbers of ranges with a positive count."""
    many = hunks.where("count > 0")
    return many.select(*keys, "path", "side", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)).alias("line")).distinct()


def patch_stats(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed and total lines of each patch, headers left out, and its files."""
    rows = diff_lines(diffs, keys)
    body = ~(F.startswith("line", F.lit("---")) | F.startswith("line", F.lit("+++")) | F.startswith("line", F.lit("@@")))
    added, removed = F.count_if(body & F.startswith("line", F.lit("+"))), F.count_if(body & F.startswith("line", F.lit("-")))
    return rows.groupBy(*keys).agg(added.alias("added_lines"), removed.alias("removed_lines"), (added + removed).alias("total_lines"), F.count_if(F.startswith("line", F.lit("+++ "))).alias("files_changed"))
