"""One graph over many commits: rows that hold from one commit to another, ``since`` and ``until`` (ordinals, both
included), in place of a copy of every table a commit. Rows grow with what changes, not with commits times files.

``join``, ``subtract``, ``best`` and ``coalesce`` are the temporal forms of join, anti-join, least row a key and
distinct; at every ordinal they equal the plain operation on the rows that hold there. ``at`` gives these. What has
the same key and start is reduced to one row before any window, so a key has at most a row a commit there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions import names as N
from tremor.functions.checkpoints import cut, spread

TIME = ["since", "until"]


def intervals(changes: DataFrame, last: int) -> DataFrame:
    """(path, blob, since, until) of ``changes(ord, path, blob)``, where a null blob removes the path; ``last`` is
    the greatest ordinal. A path's window holds its own changes only."""
    upcoming = F.lead("ord").over(Window.partitionBy("path").orderBy("ord"))
    rows = changes.select("path", "blob", F.col("ord").alias("since"), F.coalesce(upcoming - 1, F.lit(last)).alias("until"))
    return coalesce(rows.where("blob is not null"), ["path", "blob"])


def coalesce(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with the fewest intervals that cover the same ordinals."""
    first = spread(rows.groupBy(*keys, "since").agg(F.max("until").alias("until")), *keys)  # a task's sort is a share of all rows
    by = Window.partitionBy(*keys).orderBy("since")
    before = F.max("until").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = first.withColumn("_new", (before.isNull() | (F.col("since") > before + 1)).cast("int"))
    return fresh.withColumn("_run", F.sum("_new").over(by)).groupBy(*keys, "_run").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_run")


def join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of rows with equal ``on``, for as long as both hold."""
    other = b.withColumnsRenamed({"since": "_since", "until": "_until"})
    both = a.join(other, on).where((F.col("since") <= F.col("_until")) & (F.col("_since") <= F.col("until")))
    return both.withColumns({"since": F.greatest("since", "_since"), "until": F.least("until", "_until")}).drop("_since", "_until")


def subtract(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a`` for as long as no row of ``b`` with equal ``on`` holds; equal rows of ``a`` come out once."""
    cover = coalesce(b.select(*on, *TIME), on).select(*on, F.col("since").alias("_since"), F.col("until").alias("_until"))
    hit = (F.col("_since") <= F.col("until")) & (F.col("_until") >= F.col("since"))
    held = F.when(hit, F.struct("_since", "_until"))
    spans = a.join(cover, on, "left").groupBy(*a.columns).agg(F.array_sort(F.collect_list(held)).alias("_held"))  # disjoint: a row a commit at most
    starts = F.concat(F.array("since"), F.transform("_held", lambda x: x["_until"] + 1))
    ends = F.concat(F.transform("_held", lambda x: x["_since"] - 1), F.array("until"))
    free = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["s"] <= x["e"])
    return spans.withColumn("_free", F.explode(free)).withColumns({"since": F.col("_free.s"), "until": F.col("_free.e")}).select(*a.columns)


def best(rows: DataFrame, keys: list[str], order: list[str], greatest: bool = False) -> DataFrame:
    """At every ordinal, the row of each key with the least (or greatest) ``order``, which also is all that is kept."""
    edges = rows.select(*keys, F.explode(F.array(F.col("since"), F.col("until") + 1)).alias("_at")).distinct()
    pieces = edges.withColumn("_to", F.lead("_at").over(Window.partitionBy(*keys).orderBy("_at")) - 1).where("_to is not null")
    inside = rows.join(pieces, keys).where(F.col("_at").between(F.col("since"), F.col("until")))
    pick = (F.max if greatest else F.min)(F.struct(*order)).alias("_b")
    won = inside.groupBy(*keys, "_at", "_to").agg(pick).select(*keys, "_b.*", F.col("_at").alias("since"), F.col("_to").alias("until"))
    return coalesce(won, [*keys, *order])


def at(rows: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The rows that hold at each of ``ordinals(ord)``."""
    return rows.join(ordinals, F.col("ord").between(F.col("since"), F.col("until"))).drop(*TIME)


def edges_of(calls: DataFrame, own_packages: DataFrame | None = None) -> DataFrame:
    """(caller, callee, since, until) without external callees; ``own_packages(top, since, until)``."""
    known = calls.where("callee is not null").select("caller", "callee", *TIME)
    outside = N.is_external(F.col("callee"), [])
    inside = known.where(~outside)
    if own_packages is not None:
        top = F.when(F.contains(F.col("callee"), F.lit(".")), F.element_at(F.split("callee", r"\."), 1))
        ours = own_packages.where(F.col("top").isin(list(N.EXTERNAL_MODULES))).select("top", *TIME)
        inside = inside.unionByName(join(known.where(outside).withColumn("top", top), coalesce(ours, ["top"]), ["top"]).drop("top"))
    return coalesce(inside, ["caller", "callee"])


def nodes_of(*parts: DataFrame) -> DataFrame:
    """(qualname, since, until) of tables whose first column is a name."""
    out = None
    for p in parts:
        named = p.select(F.col(p.columns[0]).alias("qualname"), *TIME)
        out = named if out is None else out.unionByName(named)
    return coalesce(out, ["qualname"])


def resolve_bases(inherits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(child, base, since, until): bases that are no node at a time, by suffix: the shallowest node, then lexical."""
    inherits = inherits.select("child", "base", *TIME)
    named = nodes.withColumnRenamed("qualname", "base")
    missing = subtract(coalesce(inherits.select("base", *TIME), ["base"]), named, ["base"])
    ends = nodes.select("qualname", N.depth(F.col("qualname")).alias("depth"), F.explode(N.suffixes(F.col("qualname"))).alias("base"), *TIME)
    found = best(join(missing, ends, ["base"]), ["base"], ["depth", "qualname"]).drop("depth")
    done = join(inherits, found, ["base"]).select("child", F.col("qualname").alias("base"), *TIME)
    return done.unionByName(subtract(inherits, found, ["base"]))


def inheritance_edges(nodes: DataFrame, edges: DataFrame, inherits: DataFrame) -> DataFrame:
    """(caller, callee, edge_type, since, until), as ``graph.inheritance_edges`` has them at each ordinal. Of a class
    that several files define, the last file's bases count, if ``inherits`` has a path."""
    if "path" in inherits.columns:
        inherits = join(inherits, best(inherits.select("child", "path", *TIME), ["child"], ["path"], greatest=True), ["child", "path"])
    pairs = resolve_bases(inherits, nodes)
    pairs = cut(coalesce(join(pairs, nodes.withColumnRenamed("qualname", "base"), ["base"]), ["child", "base"]))
    q = F.col("qualname")
    methods = nodes.select(N.parent_qual(q).alias("base"), N.last_part(q).alias("method"), *TIME).where("base is not null")
    of_base = cut(join(pairs, methods, ["base"]))
    of_child = methods.withColumnRenamed("base", "child")
    named = lambda d, kind: d.select(F.concat_ws(".", "child", "method").alias("caller"), F.concat_ws(".", "base", "method").alias("callee"), F.lit(kind).alias("edge_type"), *TIME)
    overrides = named(join(of_base, of_child, ["child", "method"]), "OVERRIDES")
    only = named(subtract(of_base, of_child, ["child", "method"]), "INHERITS")
    used = nodes_of(edges.select("callee", *TIME), edges.select("caller", *TIME)).withColumnRenamed("qualname", "caller")
    return coalesce(overrides.unionByName(join(only, used, ["caller"])), ["caller", "callee", "edge_type"])


def build(defs: DataFrame, calls: DataFrame, inherits: DataFrame | None = None, own_packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges with edge_type), each with since and until."""
    edges = cut(edges_of(calls, own_packages))
    nodes = cut(nodes_of(defs.select("qualname", *TIME), edges.select("caller", *TIME), edges.select("callee", *TIME)))
    typed = edges.withColumn("edge_type", F.lit("CALLS"))
    if inherits is not None:
        more = cut(inheritance_edges(nodes, edges, inherits))
        typed = typed.unionByName(more)
        nodes = nodes_of(nodes, more.select("caller", *TIME))
    return nodes, typed
