"""Changed definitions of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import names as N
from tremor.functions.checkpoints import cut, spread
from tremor.operators.diff import changed_lines, parse_hunks
from tremor.operators.parse import parse_defs
from tremor.operators.spans import first_by, innermost, last_by


def extract_seeds(diffs: DataFrame, new_files: DataFrame, old_files: DataFrame, legacy_old_side: bool = False, naive_headers: bool = False, parsed: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row a changed definition of ``diffs(commit, diff)``; files have (commit, path, source), where the
    old ones are those of the parent under the commit's name.

    A changed line outside every definition gives a ``module`` seed. Deleted lines give seeds too; with
    ``legacy_old_side`` only where the file has no new lines or no new version. ``parsed``: the definitions of both
    sides, if they are at hand."""
    parsed = parsed or {"new": cut(parse_defs(new_files)), "old": cut(parse_defs(old_files))}  # each text is parsed once
    lines = cut(changed_lines(parse_hunks(diffs, ["commit"], naive_headers), ["commit"]).where(N.is_python(F.col("path"))))
    sides = []
    for side, files in (("new", new_files), ("old", old_files)):
        defs = parsed[side].select("commit", "path", F.col("lineno").alias("lo"), F.col("end_lineno").alias("hi"), "kind", "qualname", "ordinal")
        here = lines.where(F.col("side") == side).select("commit", "path", "line")
        here = here.join(files.where("source is not null").select("commit", "path"), ["commit", "path"], "left_semi")
        sides.append(innermost(here, defs, ["commit", "path"]).withColumn("version", F.lit(side)))
    new, old = sides
    if legacy_old_side:
        old = old.join(new.select("commit", "path").distinct(), ["commit", "path"], "left_anti")
    hits = new.unionByName(old)
    module = N.module_qual(F.col("path"))
    inside = F.col("qualname").isNotNull()
    test = N.is_test_path(F.col("path"))
    rows = hits.select(
        "commit", "path", "version", "line", F.coalesce("kind", F.lit("module")).alias("kind"), F.coalesce("qualname", module).alias("qualname"),
        F.when(inside, F.array("lo", "hi")).alias("span"), F.concat(F.lit("diff_"), "version", F.when(inside, "_line_in_def").otherwise("_line_outside_defs")).alias("reason"),
        test.alias("is_test"), F.when(test, "test_change").otherwise("code_change").alias("seed_type"),
    )
    seeds = first_by(rows, ["commit", "path", "version", "qualname", "kind", "seed_type"], "line")
    return with_code(cut(seeds), new_files, old_files, parsed)


def with_code(seeds: DataFrame, new_files: DataFrame, old_files: DataFrame, parsed: dict[str, DataFrame]) -> DataFrame:
    """Adds new_code and old_code: the last definition of the qualname on each side; null for modules."""
    out = seeds
    for side, files in (("new", new_files), ("old", old_files)):
        defs = last_by(parsed[side].select("commit", "path", "qualname", "ordinal", "lineno", "end_lineno"), ["commit", "path", "qualname"], "ordinal")
        wanted = seeds.select("commit", "path", "qualname").distinct()
        code = defs.join(wanted, ["commit", "path", "qualname"]).join(files, ["commit", "path"]).select("commit", "path", "qualname", N.snippet(F.col("source"), F.col("lineno"), F.col("end_lineno")).alias(f"{side}_code"))
        out = out.join(code, ["commit", "path", "qualname"], "left")
    return out


def seeds_document(seeds: DataFrame, diffs: DataFrame, commits: DataFrame, repo: str) -> DataFrame:
    """One row a commit: counts and the array of its seeds, in a fixed order."""
    files = parse_hunks(spread(diffs, "commit"), ["commit"]).select("commit", "path").distinct()
    counts = files.groupBy("commit").agg(F.count(F.lit(1)).alias("num_files_in_diff"), F.count_if(N.is_python(F.col("path"))).alias("num_py_files_in_diff"))
    fields = ["path", "version", "line", "kind", "qualname", "span", "reason", "is_test", "seed_type", "new_code", "old_code"]
    arrays = spread(seeds.select("commit", *fields), "commit").groupBy("commit").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("seeds"))  # bounded by one commit
    none = F.array().cast(arrays.schema["seeds"].dataType)
    out = commits.select("commit", "parent").join(counts, "commit", "left").join(arrays, "commit", "left")
    return out.select(
        "commit", "parent", F.lit(repo).alias("repo"), F.coalesce("num_files_in_diff", F.lit(0)).alias("num_files_in_diff"), F.coalesce("num_py_files_in_diff", F.lit(0)).alias("num_py_files_in_diff"),
        F.coalesce(F.size("seeds"), F.lit(0)).cast("long").alias("num_seeds"), F.coalesce("seeds", none).alias("seeds"),
    )


def in_scope(seeds: DataFrame, scope: str = "code_only") -> DataFrame:
    kept = seeds.where("qualname is not null and qualname <> ''")
    return kept.where("seed_type = 'code_change'") if scope == "code_only" else kept
