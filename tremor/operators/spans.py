"""Points in spans, and choices of one row among several."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bin(value, level):
    return F.call_function("shiftright", value.cast("long"), level)


def containing(points: DataFrame, spans: DataFrame, keys: list[str], point: str = "line", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """(keys, point, span): every pair of a distinct point and a span that holds it; ``span`` has the other columns.

    A containment join in levels: a span of up to 2^n positions stands in the one or two bins of that size that it
    touches, a point in its bin of every level that occurs (63 at most), and bins are joined with bins. So a point
    meets only spans of about a bin's size near it, not all of its key, and a crowded key is spread over its bins."""
    rest = [c for c in spans.columns if c not in keys]
    size = F.col(hi).cast("long") - F.col(lo).cast("long")
    s = spans.where(F.col(lo) <= F.col(hi)).select(*keys, F.struct(*rest).alias("span"), F.length(F.bin(size)).alias("_level"))
    ends = [_bin(F.col(f"span.{c}"), F.col("_level")) for c in (lo, hi)]
    s = s.select(*keys, "span", "_level", F.explode(F.array_distinct(F.array(*ends))).alias("_bin"))
    levels = sorted(r[0] for r in s.select("_level").distinct().collect())  # 63 numbers at most
    p = points.select(*keys, point).distinct()
    p = p.select(*keys, point, F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level"))
    p = p.withColumn("_bin", _bin(F.col(point), F.col("_level")))
    hit = p.join(s, [*keys, "_level", "_bin"])
    return hit.where(F.col(point).between(F.col(f"span.{lo}"), F.col(f"span.{hi}"))).select(*keys, point, "span")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: str = "line", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Each point with the shortest span that holds it (then the first), or nulls.

    Equal ranges are reduced to their first row, then a join in levels, then the best row of each point: an
    aggregate with map-side partials, so that a crowded key needs no sort of its pairs. Null points hold nothing."""
    p = points.select(*keys, point).distinct()
    rest = [c for c in spans.columns if c not in [*keys, lo, hi]]
    first = spans.groupBy(*keys, lo, hi).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, lo, hi, "_r.*") if rest else spans.select(*keys, lo, hi).distinct()
    columns = [c for c in spans.columns if c not in keys]
    order = F.struct((F.col(f"span.{hi}") - F.col(f"span.{lo}")).alias("_len"), F.col(f"span.{lo}").alias("_lo"), F.struct(*(F.col(f"span.{c}") for c in columns)).alias("span"))
    best = containing(p, first, keys, point, lo, hi).groupBy(*keys, point).agg(F.min(order).alias("_s")).select(*keys, point, "_s.span.*")
    return p.join(best, [*keys, point], "left")


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the least ``order``; ties go to the least row."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_r")).select(*keys, "_r.*")


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``; ties go to the greatest row."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_r")).select(*keys, "_r.*")


def top_per_key(rows: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark keeps only n a task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")
