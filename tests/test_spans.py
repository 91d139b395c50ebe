"""Containment joins in levels against all pairs."""

import random

from pyspark.sql import functions as F

from tremor.operators import spans


def plain(points, spans_):
    out = []
    for k, x in sorted(set(points)):
        inside = [(hi - lo, lo, hi, n) for key, lo, hi, n in spans_ if key == k and lo <= x <= hi]
        out.append((k, x, min(inside)[3] if inside else None))
    return out


def test_innermost_is_the_least_of_all_pairs(spark):
    r = random.Random(2)
    rows = []
    for k in ("a", "b", "hot", "hot", "hot"):
        for n in range(60):
            lo = r.randrange(-500, 3000)
            rows.append((k, lo, lo + r.choice([-1, 0, 0, 1, 2, 7, 63, 64, 65, 900]), f"s{n}"))
    points = [(r.choice(["a", "b", "hot", "none"]), r.randrange(-600, 4000)) for _ in range(800)] + [("a", rows[0][1]), ("a", rows[0][2])]
    p, s = spark.createDataFrame(points, "k string, line int"), spark.createDataFrame(rows, "k string, lo int, hi int, name string")
    got = spans.innermost(p, s, ["k"]).select("k", "line", "name").collect()
    assert sorted(map(tuple, got)) == plain(points, rows)
    pairs = spans.containing(p, s, ["k"]).count()
    assert pairs == sum(lo <= x <= hi for k, x in set(points) for key, lo, hi, _ in rows if key == k)


def test_one_file_with_many_spans_never_meets_all_pairs(spark):
    """100 k nested spans, 200 k points, one key: the join gives a few rows a point, where all pairs are 2e10."""
    s = spark.range(100_000).select(F.lit("f").alias("k"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + F.when(F.col("id") % 100 == 0, 999).otherwise(8)).alias("hi"), F.col("id").alias("name"))
    p = spark.range(0, 1_000_000, 5).select(F.lit("f").alias("k"), F.col("id").alias("line"))
    assert spans.containing(p, s, ["k"]).count() < 4 * 200_000
    got = spans.innermost(p, s, ["k"])
    wrong = got.withColumn("want", F.floor(F.col("line") / 10)).where("name <> want or name is null")
    assert got.count() == 200_000 and wrong.count() == 0


def test_empty_sides(spark):
    s = spark.createDataFrame([], "k string, lo int, hi int, name string")
    p = spark.createDataFrame([("a", 1), ("a", None)], "k string, line int")
    assert sorted(map(repr, (tuple(r) for r in spans.innermost(p, s, ["k"]).select("k", "line", "name").collect()))) == ["('a', 1, None)", "('a', None, None)"]
    assert spans.innermost(p.where("false"), s, ["k"]).count() == 0
