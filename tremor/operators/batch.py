"""Many commits and modes in one job: what to run, what is done, and the roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATES = ["ok", "verifier_ok"]
MEANS = ["duration_ms", "num_targets", "num_changed_targets", "num_files_changed", "patch_total_lines", "impacted_total", "impacted_internal", "impacted_internal_ratio"]
CALL_MEANS = ["llm_total_calls", "llm_success_rate", "llm_total_latency_ms", "llm_total_prompt_tokens"]


def work_list(commits: DataFrame, modes: list[str]) -> DataFrame:
    """Every commit in every mode; the modes are a short literal list."""
    return commits.select("commit", F.explode(F.array(*map(F.lit, modes))).alias("mode"))


def remaining(work: DataFrame, done: DataFrame) -> DataFrame:
    return work.join(done.where("commit is not null and mode is not null").select("commit", "mode").distinct(), ["commit", "mode"], "left_anti")


def mean(col: str) -> Column:
    """Mean of what is there, 0.0 if nothing is; booleans count as numbers."""
    return F.coalesce(F.avg(F.col(col).cast("double")), F.lit(0.0))


def rollup(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates and means over batch rows, for all or a mode each. Missing columns are skipped."""
    have = set(rows.columns)
    cols = [F.count(F.lit(1)).alias("num_runs")]
    cols += [mean(c).alias(f"{c}_rate") for c in RATES if c in have]
    cols += [mean(c).alias(f"avg_{c}") for c in [*MEANS, *CALL_MEANS] if c in have]
    return rows.groupBy(*(by or [])).agg(*cols)


def prefixed(rolled: DataFrame, modes: list[str]) -> DataFrame:
    """One row with a column a mode and metric."""
    names = [c for c in rolled.columns if c != "mode"]
    return rolled.agg(*(F.max(F.when(F.col("mode") == m, F.col(n))).alias(f"{m}_{n}" if len(modes) > 1 else n) for m in modes for n in names))


def sparse_union(parts: list[DataFrame]) -> DataFrame:
    """Rows with different columns under the sorted union of all columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def newest(rows: DataFrame, key: list[str], value: str, time: str) -> DataFrame:
    """The value at the latest time of each key; ties go to the greater value."""
    return rows.groupBy(*key).agg(F.max(F.struct(time, value)).alias("m")).select(*key, f"m.{value}", f"m.{time}")


def run_rows(history: DataFrame, report: DataFrame, labels: DataFrame) -> DataFrame:
    """Batch rows: run history with its verifier report and label counts, one each a run."""
    keys = ["commit", "mode"]
    v = report.select(*keys, F.col("ok").alias("verifier_ok"), F.col("num_targets_checked").alias("verifier_checked"))
    return history.join(v, keys, "left").join(labels, keys, "left")
