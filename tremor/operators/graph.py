"""Call graphs as edge tables: edges(caller, callee), nodes(qualname), inherits(child, ord, base).

With ``by``, every table has these columns too, and names of different groups never meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions import names as N


def edges_of(calls: DataFrame, own_packages: list[str] | DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (caller, callee) without external callees; the filter comes before the shuffle.
    ``own_packages`` may be a table (*by, top), where groups differ in them."""
    known = calls.where("callee is not null")
    if not isinstance(own_packages, DataFrame):
        return known.where(~N.is_external(F.col("callee"), own_packages)).select(*by, "caller", "callee").distinct()
    ours = own_packages.where(F.col("top").isin(list(N.EXTERNAL_MODULES))).select(*by, "top", F.lit(True).alias("own")).distinct()
    top = F.when(F.contains(F.col("callee"), F.lit(".")), F.element_at(F.split("callee", r"\."), 1))
    marked = known.select(*by, "caller", "callee", top.alias("top")).join(ours, [*by, "top"], "left")
    return marked.where(F.col("own") | ~N.is_external(F.col("callee"), [])).select(*by, "caller", "callee").distinct()


def nodes_of(defs: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return defs.select(*by, "qualname").union(edges.select(*by, "caller")).union(edges.select(*by, "callee")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(qualname, callees, callers), both sorted."""
    out = edges.groupBy(F.col("caller").alias("qualname")).agg(F.array_sort(F.collect_set("callee")).alias("callees"))
    back = edges.groupBy(F.col("callee").alias("qualname")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    none = F.array().cast("array<string>")
    return out.join(back, "qualname", "full").select("qualname", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))


def graph_stats(nodes: DataFrame, edges: DataFrame, inherits: DataFrame) -> DataFrame:
    """One row: functions, call relations, inheriting classes."""
    one = nodes.agg(F.count(F.lit(1)).alias("total_functions"))
    two = edges.agg(F.count(F.lit(1)).alias("total_call_relations"))
    three = inherits.agg(F.count_distinct("child").alias("inheriting_classes"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))  # single rows


def resolve_bases(inherits: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Bases that are no node, by suffix: the only candidate, else the shallowest, then lexical."""
    key = [*by, "base"]
    known = nodes.select(*by, F.col("qualname").alias("base"), F.lit(True).alias("known"))
    bases = inherits.select(*key).distinct().join(known, key, "left")
    open_bases = bases.where("known is null").select(*key)
    ends = nodes.select(*by, "qualname", F.explode(N.suffixes(F.col("qualname"))).alias("base"))
    found = open_bases.join(ends, key).groupBy(*key).agg(F.min(F.struct(N.depth(F.col("qualname")).alias("d"), "qualname")).alias("m"))
    found = found.select(*key, F.col("m.qualname").alias("resolved"))
    return inherits.join(found, key, "left").select(*by, "child", "ord", F.coalesce("resolved", "base").alias("base"))


def methods(nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(cls, method): every node under its parent name. An equi-join key, not a prefix scan."""
    q = F.col("qualname")
    return nodes.select(*by, N.parent_qual(q).alias("cls"), N.last_part(q).alias("method")).where("cls is not null")


def last_file(inherits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Of a class that several files define, the bases that the last file by path gives it."""
    last = inherits.groupBy(*by, "child").agg(F.max("path").alias("path"))
    return inherits.join(last, [*by, "child", "path"], "left_semi")


def inheritance_edges(nodes: DataFrame, edges: DataFrame, inherits: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(caller, callee, edge_type) from child methods to parent methods: OVERRIDES where both define
    the method, INHERITS where only the parent does and somebody refers to the child's."""
    if "path" in inherits.columns:
        inherits = last_file(inherits, by)
    known = nodes.select(*by, F.col("qualname").alias("base"))
    pairs = resolve_bases(inherits, nodes, by).join(known, [*by, "base"], "left_semi").select(*by, "child", "base").distinct()
    m = methods(nodes, by)
    of_base = pairs.join(m.withColumnRenamed("cls", "base"), [*by, "base"])
    of_child = m.withColumnRenamed("cls", "child")
    name = lambda c: F.concat_ws(".", c, "method")
    overrides = of_base.join(of_child, [*by, "child", "method"], "left_semi").select(*by, name("child").alias("caller"), name("base").alias("callee"), F.lit("OVERRIDES").alias("edge_type"))
    only = of_base.join(of_child, [*by, "child", "method"], "left_anti").select(*by, name("child").alias("caller"), name("base").alias("callee"))
    used = edges.select(*by, F.col("callee").alias("caller")).union(edges.select(*by, "caller")).distinct()
    inherited = only.join(used, [*by, "caller"], "left_semi").withColumn("edge_type", F.lit("INHERITS"))
    return overrides.unionByName(inherited).distinct()


def build(defs: DataFrame, calls: DataFrame, inherits: DataFrame | None = None, own_packages: list[str] | DataFrame | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges with edge_type) of a parsed repository."""
    edges = edges_of(calls, own_packages, by)
    nodes = nodes_of(defs, edges, by)
    typed = edges.withColumn("edge_type", F.lit("CALLS"))
    if inherits is not None:
        more = inheritance_edges(nodes, edges, inherits, by)
        typed = typed.unionByName(more)
        nodes = nodes.union(more.select(*by, "caller")).distinct()
    return nodes, typed
