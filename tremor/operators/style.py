"""Docstring styles by section patterns, votes and the winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions import names as N
from tremor.operators.spans import top_per_key

#: Fixed section patterns of each style.
PATTERNS = {
    "google": [r"^\s*Args:\s*$", r"^\s*Returns:\s*$", r"^\s*Raises:\s*$", r"^\s*Yields:\s*$", r"^\s*Examples?:\s*$", r"^\s*Attributes:\s*$"],
    "numpy": [r"^\s*Parameters\s*$", r"^\s*-{3,}\s*$", r"^\s*Returns\s*$", r"^\s*Raises\s*$", r"^\s*See Also\s*$", r"^\s*Notes\s*$"],
    "sphinx": [r":param\s+\w+:", r":type\s+\w+:", r":returns?:", r":rtype:", r":raises?\s+\w+:"],
}
MIN_VOTES = 5


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(f"(?mU){pattern}")).cast("int")


def style_scores(text: Column) -> dict[str, Column]:
    """Matching patterns of each style; NumPy loses 2 without an underline."""
    out = {s: sum((_has(text, p) for p in ps[1:]), _has(text, ps[0])) for s, ps in PATTERNS.items()}
    underlined = _has(text, PATTERNS["numpy"][1]) > 0
    out["numpy"] = F.when(underlined, out["numpy"]).otherwise(F.greatest(out["numpy"] - 2, F.lit(0)))
    return out


def style_of(text: Column) -> Column:
    """google, numpy, sphinx or unknown; ties go to the first by name."""
    s = {k: F.coalesce(v, F.lit(0)) for k, v in style_scores(text).items()}
    best = F.greatest(*s.values())
    out = F.when(best == 0, "unknown")
    for name in sorted(s):
        out = out.when(s[name] == best, name)
    return out


def votes(docs: DataFrame, by: list[str], text: str = "docstring") -> DataFrame:
    """Votes a group: google, numpy, sphinx, unknown."""
    styled = docs.select(*by, style_of(F.col(text)).alias("style"))
    return styled.groupBy(*by).agg(*(F.count_if(F.col("style") == s).alias(s) for s in ("google", "numpy", "sphinx", "unknown")))


def winner(counted: DataFrame, min_votes: int = MIN_VOTES) -> DataFrame:
    """Adds style and confidence; under ``min_votes`` known votes it is google with 0.0."""
    known = F.col("google") + F.col("numpy") + F.col("sphinx")
    best = F.greatest("google", "numpy", "sphinx")
    name = F.when(F.col("google") == best, "google").when(F.col("numpy") == best, "numpy").otherwise("sphinx")
    return counted.withColumn("style", F.when(known < min_votes, "google").otherwise(name)).withColumn("confidence", F.when(known < min_votes, 0.0).otherwise(F.coalesce(F.try_divide(best, known), F.lit(0.0))))


def docstring_corpus(files: DataFrame, defs: DataFrame, max_files: int = 50, seed: int = 42, modules: DataFrame | None = None) -> DataFrame:
    """Docstrings over 20 characters of a fixed sample of non-test files: in each commit, those of least hash.
    ``modules(commit, path, docstring)`` has those of the modules themselves."""
    skipped = F.regexp_like("path", F.lit(r"(^|/)(venv|env|build|dist)/"))
    listed = files.where(~N.is_test_path(F.col("path")) & ~skipped).select("commit", "path").distinct()
    chosen = top_per_key(listed, ["commit"], [F.xxhash64("path", F.lit(seed)), "path"], max_files)
    defs = defs.select("commit", "path", "docstring")
    defs = defs if modules is None else defs.unionByName(modules.select("commit", "path", "docstring"))
    return defs.join(chosen, ["commit", "path"], "left_semi").where(F.length("docstring") > 20).select("commit", "path", "docstring")
