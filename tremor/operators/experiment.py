"""Mutations of docstrings, the strict check, pass rates and convergence. All in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SETTINGS = ["original", "drop_param", "add_fake_param", "rename_param"]
_LINE = r"\r\n|\r|\n"


_END = r"(?:\r\n|\r|\n)"
_SECTION = rf"(?:\A|[\r\n])[ \t]*Args:[ \t]*{_END}((?:[ \t]*{_END}|[ \t]+[*]{{0,2}}[A-Za-z_][A-Za-z0-9_]*:[ \t]*(?:{_END}|\z))*+)"


def args_of(doc: Column) -> Column:
    """Names of the Args section, up to the first line that is not an indented ``name:``. Two patterns,
    each run once a text."""
    section = F.regexp_extract(F.coalesce(doc, F.lit("")), _SECTION, 1)
    return F.regexp_extract_all(section, F.lit(r"([*]{0,2}[A-Za-z_][A-Za-z0-9_]*):"), F.lit(1))


def strict_check(doc: Column, params: Column) -> Column:
    """struct(ok, missing, extra): the Args section names exactly the parameters."""
    return compared(args_of(doc), params)


def compared(own: Column, params: Column) -> Column:
    missing, extra = F.array_sort(F.array_except(params, own)), F.array_sort(F.array_except(own, params))
    return F.struct(((F.size(missing) == 0) & (F.size(extra) == 0)).alias("ok"), missing.alias("missing"), extra.alias("extra"))


def mutation_results(docs: DataFrame) -> DataFrame:
    """``docs(commit, qualname, docstring, params)`` under every setting: commit, qualname, setting, ok, note.

    Lines and places are columns of their own, so that each is worked out once a text."""
    first = F.try_element_at("params", F.lit(1))
    rows = docs.select("commit", "qualname", "params", "docstring", first.alias("first"), F.split("docstring", _LINE).alias("lines"))
    rows = rows.withColumn("start", F.array_position(F.transform("lines", lambda x: F.trim(x) == "Args:"), True).cast("int"))
    rows = rows.withColumn("hit", F.array_position(F.transform("lines", lambda x, i: (i + 1 > F.col("start")) & (F.trim(x) == F.concat("first", F.lit(":")))), True).cast("int"))
    found = (F.col("start") > 0) & (F.col("hit") > 0)
    head, tail = F.slice("lines", F.lit(1), F.greatest(F.col("hit") - 1, F.lit(0))), F.slice("lines", F.col("hit") + 1, F.size("lines"))
    renamed = F.array(F.concat(F.regexp_extract(F.try_element_at("lines", F.greatest("hit", F.lit(1))), r"^(\s*)", 1), "first", F.lit("_renamed:")))
    fake = F.concat(F.slice("lines", F.lit(1), F.col("start")), F.array(F.lit("    fake_param:")), F.slice("lines", F.col("start") + 1, F.size("lines")))
    docs_of = {
        "original": F.col("docstring"),
        "drop_param": F.when(found, F.array_join(F.concat(head, tail), "\n")).otherwise(F.col("docstring")),
        "add_fake_param": F.when(F.col("start") > 0, F.array_join(fake, "\n")).otherwise(F.col("docstring")),
        "rename_param": F.when(found, F.array_join(F.concat(head, renamed, tail), "\n")).otherwise(F.col("docstring")),
    }
    settings = F.explode(F.array(*(F.struct(F.lit(s).alias("setting"), docs_of[s].alias("doc")) for s in SETTINGS)))
    rows = rows.select("commit", "qualname", "params", settings.alias("s")).select("commit", "qualname", "params", "s.setting", args_of(F.col("s.doc")).alias("own"))
    rows = rows.select("commit", "qualname", "setting", compared(F.col("own"), F.col("params")).alias("c"))
    note = F.concat(F.lit("missing="), F.array_join("c.missing", ","), F.lit(" extra="), F.array_join("c.extra", ","))
    return rows.select("commit", "qualname", "setting", "c.ok", F.when(~F.col("c.ok"), note).alias("note"))


def commit_results(results: DataFrame) -> DataFrame:
    """A row a commit and setting: all pass, and the first five notes."""
    notes = F.slice(F.array_sort(F.collect_set("note")), 1, 5)
    return results.groupBy("commit", "setting").agg(F.bool_and("ok").alias("ok"), notes.alias("notes"))


def pass_rates(per_commit: DataFrame) -> DataFrame:
    return per_commit.groupBy("setting").agg(F.avg(F.col("ok").cast("double")).alias("pass_rate"), F.count(F.lit(1)).alias("num_commits"))


def convergence(all_impacted: DataFrame, code_only: DataFrame, by: list[str]) -> DataFrame:
    """Impacted counts under both scopes and their ratio."""
    a = all_impacted.groupBy(*by).agg(F.count(F.lit(1)).alias("impacted_all"))
    c = code_only.groupBy(*by).agg(F.count(F.lit(1)).alias("impacted_code_only"))
    both = a.join(c, by, "left").withColumn("impacted_code_only", F.coalesce("impacted_code_only", F.lit(0)))
    return both.withColumn("impacted_code_only_ratio", F.coalesce(F.try_divide("impacted_code_only", "impacted_all"), F.lit(0.0)))
