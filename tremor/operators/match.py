"""Names that do not match exactly: cascades of equi-joins on dotted suffixes, within groups of ``by``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import names as N


def suffix_index(nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(suffix, qualname) for every dotted suffix of every node."""
    return nodes.select(*by, "qualname", F.explode(N.suffixes(F.col("qualname"))).alias("suffix")).distinct()


def unique_suffixes(nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Suffixes that belong to one node only."""
    one = suffix_index(nodes, by).groupBy(*by, "suffix").agg(F.min("qualname").alias("qualname"), F.max("qualname").alias("hi")).where("qualname = hi")
    return one.select(*by, "suffix", "qualname")


def match_seeds(seeds: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(seed_qualname, matched_qualname, match_type) of ``seeds(qualname)``: exact; the seed as a unique
    suffix of a node; the longest proper suffix of the seed that is one; the only node under the seed."""
    key = [*by, "seed_qualname"]
    s = seeds.where("qualname is not null and qualname <> ''").select(*by, F.col("qualname").alias("seed_qualname")).distinct()
    unique = unique_suffixes(nodes, by).withColumnRenamed("qualname", "matched_qualname")
    exact = s.join(nodes.select(*by, F.col("qualname").alias("seed_qualname")), key, "left_semi")
    exact = exact.select(*key, F.col("seed_qualname").alias("matched_qualname"), F.lit(0).alias("tier"))
    ends = s.select(*key, F.posexplode(N.suffixes(F.col("seed_qualname"))).alias("cut", "suffix"))
    by_suffix = ends.join(unique, [*by, "suffix"]).select(*key, "matched_qualname", (F.col("cut") + 1).alias("tier"))
    heads = nodes.select(*by, "qualname", F.explode(F.slice(N.prefixes(F.col("qualname")), 2, 1 << 20)).alias("seed_qualname"))
    under = heads.join(s, key).groupBy(*key).agg(F.min("qualname").alias("matched_qualname"), F.max("qualname").alias("hi"))
    under = under.where("matched_qualname = hi").select(*key, "matched_qualname", F.lit(1 << 20).alias("tier"))
    best = exact.unionByName(by_suffix).unionByName(under).groupBy(*key).agg(F.min(F.struct("tier", "matched_qualname")).alias("b"))
    kind = F.when(F.col("b.tier") == 0, "exact").when(F.col("b.tier") == 1, "suffix").when(F.col("b").isNotNull(), "prefix_strip").otherwise("none")
    return s.join(best, key, "left").select(*key, F.col("b.matched_qualname").alias("matched_qualname"), kind.alias("match_type"))


def resolve_callers(edges: DataFrame, nodes: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(qualname, caller, match_tier): the callers of each node. Callees are matched exactly (1), else by
    the node's longest suffix that is a callee (2), else by all callees that end in the node's name (3)."""
    if nodes is None:
        nodes = edges.select(*by, F.col("caller").alias("qualname")).union(edges.select(*by, "callee")).distinct()
    name, called = [*by, "qualname"], [*by, "callee"]
    keys = edges.select(*called).distinct()
    ends = nodes.select(*name, F.posexplode(N.suffixes(F.col("qualname"))).alias("cut", "callee"))
    near = ends.join(keys, called).groupBy(*name).agg(F.min(F.struct("cut", "callee")).alias("b"))
    near = near.select(*name, "b.callee", F.when(F.col("b.cut") == 0, 1).otherwise(2).alias("match_tier"))
    rest = nodes.join(near, name, "left_anti")
    longer = keys.select(*called, F.explode(N.suffixes(F.col("callee"))).alias("qualname"))
    far = rest.join(longer, name).select(*name, "callee", F.lit(3).alias("match_tier"))
    return near.unionByName(far).join(edges.select(*by, "caller", "callee"), called).select(*name, "caller", "match_tier").distinct()
