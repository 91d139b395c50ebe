import random

import duckdb
import pytest
from helpers import same

from tremor.operators import propagate
from tremor.plans import catalogue


def brute(edges, seeds, hops):
    found, level = {s: (0, None) for s in seeds}, set(seeds)
    for h in range(1, hops + 1):
        new = {}
        for caller, callee in edges:
            if callee in level and caller not in found:
                new[caller] = min(new.get(caller, callee), callee)
        found.update({n: (h, s) for n, s in new.items()})
        level = set(new)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_bfs_equals_brute_force(spark, seed):
    r = random.Random(seed)
    edges = sorted({(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(90)})
    got = propagate.impact(spark.createDataFrame(edges, "caller string, callee string"), spark.createDataFrame([("n1",), ("n2",)], "qualname string"), 3)
    assert {x.qualname: (x.hop, x.source) for x in got.collect()} == brute(edges, ["n1", "n2"], 3)


def test_typed_scores_follow_the_best_weights(spark):
    rows = [("b", "a", "DOCS"), ("c", "b", "DOCS"), ("c", "a", "DEFINES"), ("d", "c", "UNHEARD")]
    got = propagate.impact_typed(spark.createDataFrame(rows, "caller string, callee string, edge_type string"), spark.createDataFrame([("a",)], "qualname string"))
    out = {x.qualname: x for x in got.collect()}
    f = 0.85 * 0.85
    assert out["c"].score == pytest.approx(f * f) and out["c"].best_path == ["a", "b", "c"] and out["c"].edge_types_on_path == ["DOCS", "DOCS"]
    assert out["d"].score == pytest.approx(f * f * 0.5 * 0.85) and out["d"].hop == 3


def test_presets(spark):
    chain = [(f"n{k + 1}", f"n{k}") for k in range(5)]
    out = propagate.ablation(spark.createDataFrame(chain, "caller string, callee string"), spark.createDataFrame([("n0",)], "qualname string"))
    got = {(x.preset, x.hop): round(x.score, 6) for x in out.collect()}
    assert got[("full", 4)] == 0.067652 and got[("uniform", 4)] == 0.125334 and got[("no_decay", 3)] == 0.216
    assert ("no_decay", 4) not in got and ("high_decay", 4) not in got and got[("high_decay", 3)] == 0.027
    empty = propagate.score_distribution(out.where("score > 2")).first()
    assert empty.min_score is None and empty.above_05 == 0


def test_products_that_end_in_a_half_round_as_their_sql(spark, tmp_path):
    rows = [(1, 3), (2, 3), (2, 4), (1, 0), (5, 0), (5, 7), (9, 3), (9, 11)]  # 0.425 * 0.7225 * 0.51 = 0.156601875 among them
    spark.createDataFrame([(p, s) for p, s in rows], "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    same(catalogue.impact_mixed_types(spark, str(tmp_path)), c.sql(catalogue.SQL["impact_mixed_types"]))


def test_presets_share_a_walk_and_equal_those_walked_alone(spark, monkeypatch):
    r = random.Random(6)
    kinds = ["CALLED_BY", "DOCS", "DEFINES", "UNHEARD"]
    rows = sorted({(f"n{r.randrange(30)}", f"n{r.randrange(30)}", r.choice(kinds)) for _ in range(80)})
    edges, seeds = spark.createDataFrame(rows, "caller string, callee string, edge_type string"), spark.createDataFrame([("n1",), ("n2",)], "qualname string")
    tables, cut = [], propagate.cut
    monkeypatch.setattr(propagate, "cut", lambda df: tables.append(cut(df)) or tables[-1])
    got = {}
    for x in propagate.ablation(edges, seeds).collect():
        got.setdefault(x.preset, []).append(tuple(x.asDict()[c] for c in ("qualname", "score", "hop", "source", "best_path", "edge_types_on_path")))
    for t in tables[1:]:
        assert t.count() == t.select("qualname").distinct().count()  # a row a node and hop, not one a preset
    for name in ("full", "uniform", "no_decay", "high_decay", "calls_only"):
        alone = [tuple(x) for x in propagate.impact_typed(edges, seeds, propagate.preset(name)).collect()]
        assert sorted(got[name]) == sorted(alone) and all(p[-1] == q and len(p) == h + 1 == len(t) + 1 for q, _, h, _, p, t in alone)
