"""Which impacted functions get documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators.spans import top_per_key


def candidates(impacted: DataFrame, nodes: DataFrame, max_hops: int, include_external: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Impacted functions that can be documented: near enough, internal, a function.
    ``nodes(qualname, kind, path, params, lineno, end_lineno, docstring)`` has one row a qualname."""
    near = impacted.where(F.col("hop") <= max_hops)
    if not include_external:
        near = near.where("is_internal")
    found = near.join(nodes.where("kind in ('function', 'async_function')").withColumnRenamed("path", "rel_path"), [*by, "qualname"])
    has = F.col("docstring").isNotNull()
    return found.withColumns({"has_docstring": has, "target_action": F.when(has, "update").otherwise("insert")})


def limited(targets: DataFrame, limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``limit`` by hop and name, of each group of ``by``; a negative limit is 0."""
    if by:
        return top_per_key(targets, list(by), ["hop", "qualname"], limit)
    return targets.orderBy("hop", "qualname").limit(max(limit, 0))


def select_template(found: DataFrame, seeds: DataFrame, limit: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Hop 0 must be a seed, hop 1 must have been found from one. Two semi-joins, no OR join."""
    s = seeds.select(*by, "qualname").distinct()
    zero = found.where("hop = 0").join(s, [*by, "qualname"], "left_semi")
    one = found.where("hop = 1").join(s.withColumnRenamed("qualname", "source"), [*by, "source"], "left_semi").select(*zero.columns)
    return limited(zero.unionByName(one), limit, by)


def select_lineage(found: DataFrame, seeds: DataFrame, max_hops: int = 2, limit: int = 50, by: tuple[str, ...] = ()) -> DataFrame:
    """Each hop's source must be a seed or an accepted target of the hop before it."""
    s = seeds.select(*by, "qualname").distinct()
    accepted = found.where("hop = 0").join(s, [*by, "qualname"], "left_semi")
    ok = s.union(accepted.select(*by, "qualname"))
    for hop in range(1, max_hops + 1):
        step = found.where(F.col("hop") == hop).join(ok.distinct().withColumnRenamed("qualname", "source"), [*by, "source"], "left_semi").select(*accepted.columns)
        accepted = accepted.unionByName(step)
        ok = ok.union(step.select(*by, "qualname"))
    return limited(accepted, limit, by)


def add_generated(impacted: DataFrame, named: DataFrame) -> DataFrame:
    """Functions named by a generator that are not impacted yet, at hop 0."""
    new = named.select("qualname").distinct().join(impacted.select("qualname"), "qualname", "left_anti")
    return impacted.unionByName(new.withColumns({"hop": F.lit(0), "reason": F.lit("module_change")}), allowMissingColumns=True)
