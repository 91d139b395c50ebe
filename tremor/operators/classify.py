"""Names to files by longest prefix, and the classes internal, test and external."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import names as N


def longest_prefix(names: DataFrame, files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``names`` with path: ``a/b.py`` before ``a/b/__init__.py`` at each depth, the deepest first.

    Prefixes are exploded on the names' side and equi-joined; the best file is a partial aggregate."""
    path = F.col("path")
    keys = files.where(N.is_python(path)).select(*by, "path", N.module_qual(path, strip_init=True).alias("module_key"), F.endswith(path, F.lit("__init__.py")).alias("is_init")).distinct()
    q = names.select(*by, "qualname").distinct()
    cut = q.select(*by, "qualname", F.posexplode(N.prefixes(F.col("qualname"))).alias("up", "module_key"))
    best = cut.join(keys, [*by, "module_key"]).groupBy(*by, "qualname").agg(F.min(F.struct("up", "is_init", "path")).alias("b")).select(*by, "qualname", "b.path")
    return names.join(best, [*by, "qualname"], "left")


def classify(names: DataFrame, files: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``names`` with path, is_internal, is_test, is_external."""
    found = longest_prefix(names, files, by)
    test = F.coalesce(N.is_test_path(F.col("path")), F.lit(False))
    return found.withColumns({"is_internal": F.col("path").isNotNull() & ~test, "is_test": test, "is_external": F.col("path").isNull()})


def label_counts(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals by class and the internal share, 0.0 when empty."""
    total = F.count(F.lit(1))
    internal = F.count_if("is_internal")
    return labelled.groupBy(*(by or [])).agg(
        total.alias("impacted_total"), internal.alias("impacted_internal"), F.count_if("is_test").alias("impacted_test"), F.count_if("is_external").alias("impacted_external"),
        F.coalesce(F.try_divide(internal, total), F.lit(0.0)).alias("impacted_internal_ratio"),
    )
