"""Impact over bounded hops: a frontier loop whose every hop is a join, a partial aggregate and an anti-join."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.checkpoints import cut

#: Fixed weights of edge types; other types weigh DEFAULT_WEIGHT.
WEIGHTS = {
    "CALLS": 0.70, "CALLED_BY": 0.60, "EXPOSES_CLI": 0.95, "READS_CONFIG": 0.90, "USES_ENV": 0.90, "DATA_DEP": 0.80, "CTRL_DEP": 0.75, "DOCS": 0.85,
    "OVERRIDES": 0.70, "IMPLEMENTS": 0.70, "DEFINES": 0.50,
}
DEFAULT_WEIGHT = 0.5
#: Scores are kept to 15 decimal places, so that products of decimal factors are what they are on paper: 1e15 is exact
#: in doubles, and so is the nearest double to a whole number divided by it.
PLACES = 1e15


@dataclass(frozen=True)
class Config:
    """Weights, decay a hop, least score, most hops."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    gamma: float = 0.85
    threshold: float = 0.01
    max_hops: int = 4


def preset(name: str) -> Config:
    """full, uniform, no_decay, high_decay or calls_only."""
    if name == "uniform":
        return Config(weights=dict.fromkeys(WEIGHTS, 0.7))
    if name == "no_decay":
        return Config(gamma=1.0, max_hops=3)
    if name == "high_decay":
        return Config(gamma=0.5)
    if name in ("full", "calls_only"):  # only CALLED_BY edges are walked, so both are the same
        return Config()
    raise ValueError(f"unknown preset {name}")


def impact(edges: DataFrame, seeds: DataFrame, max_hops: int = 2, direction: str = "callers", every: int = 1, by: tuple[str, ...] = (), at: str | None = None) -> DataFrame:
    """(qualname, hop, source, reason): nodes that reach a seed in at most ``max_hops`` calls.

    ``edges(caller, callee)``, ``seeds(qualname)``. ``source`` is the least node of the hop before that
    finds the node. ``direction`` both also walks to callees. The lineage is cut every ``every`` hops.
    Both tables may have columns ``by``: all their groups are walked together and never meet. With ``at``, the name of
    a column of ordinals in ``seeds``, edges have (since, until) and are walked where they hold at the seed's ordinal."""
    of_edges, times = by, ["since", "until"] if at else []
    by = (*by, at) if at else by
    key = [*by, "qualname"]
    step = edges.select(*of_edges, *times, F.col("callee").alias("qualname"), F.col("caller").alias("next"), F.lit("calls_changed_function").alias("why"))
    if direction == "both":
        step = step.union(edges.select(*of_edges, *times, F.col("caller").alias("qualname"), F.col("callee").alias("next"), F.lit("called_by_changed_function").alias("why")))
    step = cut(step)  # every hop reads it
    found = seeds.select(*key).distinct().select(*key, F.lit(0).alias("hop"), F.lit(None).cast("string").alias("source"), F.lit("direct_change").alias("reason"))
    frontier = found
    for hop in range(1, max_hops + 1):
        walk = frontier.join(step, [*of_edges, "qualname"])
        walk = walk.where(F.col(at).between(F.col("since"), F.col("until"))) if at else walk
        reached = walk.groupBy(*by, "next").agg(F.min(F.struct(F.col("qualname").alias("at"), "why")).alias("m"))
        new = reached.join(found.select(*by, F.col("qualname").alias("next")), [*by, "next"], "left_anti")
        frontier = new.select(*by, F.col("next").alias("qualname"), F.lit(hop).alias("hop"), F.col("m.at").alias("source"), F.col("m.why").alias("reason"))
        if hop % every == 0 and hop < max_hops:
            frontier = cut(frontier)
        found = found.unionByName(frontier)
    return found


def _typed(edges: DataFrame, seeds: DataFrame, configs: dict[str, Config], every: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """All presets in one loop, keyed by (preset, qualname) and ``by``.

    An edge is walked once a hop with a score for each different preset beside it, and only if it betters what its end
    is known to have; paths are put together from the rows of the hops at the end, a join of nodes and not of edges."""
    kind = F.col("edge_type") if "edge_type" in edges.columns else F.lit("CALLED_BY")
    step = cut(edges.select(*by, F.col("callee").alias("qualname"), F.col("caller").alias("next"), kind.alias("etype")))
    unlike: list[Config] = []
    for c in configs.values():
        unlike += [] if c in unlike else [c]
    score, best, every_one = [f"_s{i}" for i in range(len(unlike))], [f"_m{i}" for i in range(len(unlike))], range(len(unlike))
    factor = [F.coalesce(*(F.when(F.col("etype") == k, F.lit(float(v))) for k, v in sorted(c.weights.items())), F.lit(DEFAULT_WEIGHT)) * F.lit(c.gamma) for c in unlike]
    none = F.array().cast("array<string>")
    start = seeds.select(*by, "qualname").distinct()
    hops, most = [start.select(*by, "qualname", *(F.lit(1.0).alias(x) for x in score))], max(c.max_hops for c in unlike)
    for hop in range(1, most + 1):
        known = hops[0].select(*by, F.col("qualname").alias("next"), *score)
        for h in hops[1:]:
            known = known.unionByName(h.select(*by, F.col("qualname").alias("next"), *score))
        known = known.groupBy(*by, "next").agg(*(F.max(x).alias(f"_k{x}") for x in score))
        walk = hops[-1].select(*by, "qualname", *score).join(step, [*by, "qualname"])
        reach = walk.select(*by, "next", F.col("qualname").alias("at"), "etype", *((F.rint(F.col(x) * f * PLACES) / PLACES if c.max_hops >= hop else F.lit(None).cast("double")).alias(x) for x, f, c in zip(score, factor, unlike, strict=True)))
        better = [(F.col(x) >= c.threshold) & (F.col(f"_k{x}").isNull() | (F.col(x) > F.col(f"_k{x}"))) for x, c in zip(score, unlike, strict=True)]
        reach = reach.join(known, [*by, "next"], "left").select(*by, "next", "at", "etype", *(F.when(ok, F.col(x)).alias(x) for x, ok in zip(score, better, strict=True))).where(F.coalesce(*score).isNotNull())
        new = reach.groupBy(*by, F.col("next").alias("qualname")).agg(*(F.min(F.when(F.col(x).isNotNull(), F.struct((-F.col(x)).alias("neg"), "at", "etype"))).alias(m) for x, m in zip(score, best, strict=True)))
        new = new.select(*by, "qualname", *((-F.col(f"{m}.neg")).alias(x) for x, m in zip(score, best, strict=True)), *best)
        hops.append(cut(new) if hop % every == 0 or hop == most else new)
    names = lambda i: F.array(*(F.lit(n) for n, c in configs.items() if c == unlike[i]))
    paths = start.select(*by, F.explode(F.array(*(F.lit(i) for i in every_one))).alias("_i"), "qualname", F.lit(1.0).alias("score"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("source"), F.array("qualname").alias("best_path"), none.alias("edge_types_on_path"))
    found = paths
    for hop, new in enumerate(hops[1:], 1):
        rows = new.select(*by, "qualname", F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), F.col(score[i]).alias("score"), F.col(f"{best[i]}.at").alias("source"), F.col(f"{best[i]}.etype").alias("etype")) for i in every_one))).alias("r"))
        rows = rows.where("r.score is not null").select(*by, "qualname", "r.*")
        before = paths.select(*by, "_i", F.col("qualname").alias("source"), "best_path", "edge_types_on_path")
        paths = rows.join(before, [*by, "_i", "source"]).select(
            *by, "_i", "qualname", "score", F.lit(hop).alias("hop"), "source", F.concat("best_path", F.array("qualname")).alias("best_path"), F.concat("edge_types_on_path", F.array("etype")).alias("edge_types_on_path"),
        )
        found = found.unionByName(paths)
    last = found.groupBy(*by, "_i", "qualname").agg(F.max(F.struct("hop", "score", "source", "best_path", "edge_types_on_path")).alias("m"))
    preset_ = F.explode(F.get(F.array(*map(names, every_one)), F.col("_i"))).alias("preset")
    return last.select(*by, preset_, "qualname", "m.score", "m.hop", "m.source", "m.best_path", "m.edge_types_on_path")


def impact_typed(edges: DataFrame, seeds: DataFrame, config: Config = Config(), every: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(qualname, score, hop, source, best_path, edge_types_on_path): the best product of weight and decay
    over the paths to a seed. Edges may have ``edge_type``; without one they count as CALLED_BY.

    A hop only keeps scores at or above the threshold and better than any known before; every node
    goes on from its best score. Rows of several hops are settled by the last, which is the best."""
    return _typed(edges, seeds, {"one": config}, every, by).drop("preset")


def ablation(edges: DataFrame, seeds: DataFrame, presets=("full", "uniform", "no_decay", "high_decay", "calls_only")) -> DataFrame:
    """The typed result under every preset, walked together."""
    return _typed(edges, seeds, {n: preset(n) for n in presets})


def hop_histogram(impacted: DataFrame) -> DataFrame:
    return impacted.groupBy("hop").agg(F.count(F.lit(1)).alias("n"))


def edge_type_histogram(typed: DataFrame) -> DataFrame:
    """Steps of each type over all best paths, the most frequent first."""
    return typed.select(F.explode("edge_types_on_path").alias("edge_type")).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "edge_type")


def score_distribution(typed: DataFrame) -> DataFrame:
    """One row; with nothing impacted, counts are 0 and the rest null."""
    s = F.round("score", 6)
    return typed.agg(
        F.round(F.min(s), 6).alias("min_score"), F.round(F.max(s), 6).alias("max_score"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.count_if(F.col("score") >= 0.5).alias("above_05"), F.count_if(F.col("score") >= 0.3).alias("above_03"), F.count_if(F.col("score") >= 0.1).alias("above_01"),
    )


def ranked(typed: DataFrame) -> DataFrame:
    """By score, hop and name."""
    return typed.orderBy(F.desc("score"), "hop", "qualname")
