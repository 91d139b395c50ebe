"""Ball k-means in exact integers (operator 12).

A cluster is a ball: its centroid and a bound on the distance of its members. Only neighbours matter: centroids
no farther than twice the radius. A member that is nearer to its centroid than half the way to the nearest
neighbour lies in the stable core and stays without any comparison; the rest lies in annuli between the halves of the
sorted distances to the neighbours, and a member of annulus k is compared with the first k neighbours only. All
comparisons are of squared integer distances, so ties are exact (the smaller number wins).

One pass a round: every task reads vectors with their cluster of the round before, assigns them under the new
centroids, which are broadcast with the balls (k rows), and writes them; the sums, counts, inertia and radii of its
clusters go into the same table as rows of their own, whose columns alone are read for the next centroids. A round's
table is removed when the next one is written. Sums are added by cluster and component.

Edge cases: vectors of another length, null vectors, and those with null or non-finite components are left out; a
null vec_id is kept, and stands last among candidates for a start; rows that repeat a vec_id are vectors of their
own, which as starts follow by their components; fewer vectors than clusters give as many clusters as vectors, none
give no rows; empty clusters keep their centroid. Components beyond 2^18 in size are an error, as squared
distances and sums would leave 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.workspace import release, stored

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
_MOST = 1 << 26  # of an integer component
_SCHEMA = "vec_id long, v binary, cluster int, distance long, of int, n long, inertia long, far long, sums array<long>"
_ARROW = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("cluster", pa.int32()), ("distance", pa.int64()), ("of", pa.int32()), ("n", pa.int64()), ("inertia", pa.int64()), ("far", pa.int64()), ("sums", pa.list_(pa.int64()))])


def integers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that count, as arrays of integers."""
    x = F.col(column)
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kept = vectors.select("vec_id", x.cast("array<double>").alias("x")).where((F.size("x") == dim) & F.forall("x", fine))
    small = F.when(F.forall("x", lambda c: F.abs(c) < _MOST // scale), F.transform("x", lambda c: F.floor(c * scale).cast("int")))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(small, F.raise_error(F.lit(f"components beyond {_MOST // scale} are not supported")).cast("array<int>")).alias("v"))


def starts(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the k least hashes, in their order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


@dataclass
class Balls:
    """Centroids and, for each, its neighbours by distance: those within twice its radius."""

    centroids: np.ndarray
    neighbours: list[np.ndarray]
    distances: list[np.ndarray]  # squared, to these neighbours

    @classmethod
    def of(cls, centroids: np.ndarray, radius: list[int] | None = None) -> Balls:
        """``radius``: bounds on the members' squared distances; without it all others are neighbours."""
        k = len(centroids)
        near, far = [], []
        for i in range(k):
            d = _squared(centroids, centroids[i])
            order = np.lexsort((np.arange(k), d))
            order = order[order != i]
            if radius is not None:
                order = order[d[order] <= min(4 * radius[i], 1 << 62)]
            near.append(order)
            far.append(d[order])
        return cls(centroids, near, far)

    def assign(self, v: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each vector, whose cluster so far is ``old``; the number of comparisons."""
        best, dist, work = old.copy(), np.empty(len(v), np.int64), 0
        order = np.argsort(old, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(old[order])) + 1) if len(v) else []:
            i = int(old[rows[0]])
            own = _squared(v[rows], self.centroids[i])
            annulus = np.searchsorted(self.distances[i], 4 * own, side="right")  # 0: the stable core
            for k in range(int(annulus.max())):
                at = rows[annulus > k]
                j = int(self.neighbours[i][k])
                d = _squared(v[at], self.centroids[j])
                if k == 0:
                    dist[rows] = own
                better = (d < dist[at]) | ((d == dist[at]) & (j < best[at]))
                best[at[better]], dist[at[better]] = j, d[better]
                work += len(at)
            if not annulus.max():
                dist[rows] = own
        return best, dist, work


def _assigned(balls, dim: int):
    def run(batches):
        b: Balls = balls.value
        k = len(b.centroids)
        n, inertia, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            raw = batch.column(1)
            if not batch.num_rows:
                continue
            v = np.frombuffer(b"".join(raw.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)
            cluster, dist, _ = b.assign(v, np.asarray(batch.column(2)).astype(np.int64))
            np.add.at(n, cluster, 1)
            np.add.at(inertia, cluster, dist)
            np.maximum.at(far, cluster, dist)
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            sums[cluster[order][first]] += np.add.reduceat(v[order], first, axis=0)
            none = lambda kind, m=batch.num_rows: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array(cluster.astype(np.int32)), pa.array(dist), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64()))], schema=_ARROW)
        met = np.flatnonzero(n)
        none = lambda kind: pa.nulls(len(met), kind)
        yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.binary()), none(pa.int32()), none(pa.int64()), pa.array(met.astype(np.int32)), pa.array(n[met]), pa.array(inertia[met]), pa.array(far[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], schema=_ARROW)

    return run


def _packed(batches):
    for batch in batches:
        flat = np.concatenate([np.asarray(batch.column(1).flatten()), np.empty(0, np.int32)]).astype("<i4").tobytes()
        step = len(flat) // max(1, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[k * step : (k + 1) * step] for k in range(batch.num_rows)], pa.binary()), pa.array(np.zeros(batch.num_rows, np.int32))], names=["vec_id", "v", "cluster"])


def _totals(table: DataFrame, dim: int) -> dict[int, tuple[int, int, int, list[int]]]:
    """By cluster: count, inertia, greatest squared distance, sums. Added by cluster and component, so that no task
    gets all rows of a cluster."""
    parts = table.where("of is not null").select("of", "far", F.posexplode(F.concat("sums", F.array("n", "inertia"))).alias("i", "x"))
    found: dict[int, list] = {}
    for r in parts.groupBy("of", "i").agg(F.sum("x").alias("x"), F.max("far").alias("far")).collect():  # k x (dim + 2) rows
        found.setdefault(r["of"], [r["far"], [0] * (dim + 2)])[1][r["i"]] = r["x"]
    return {c: (x[dim], x[dim + 1], far, x[:dim]) for c, (far, x) in found.items()}


def _root(x: int) -> int:
    """A bound on the square root from above."""
    r = int(np.sqrt(float(x)))
    while r * r < x:
        r += 1
    return r


def ball_kmeans(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of ``vectors(vec_id, embedding)``."""
    spark = vectors.sparkSession
    whole = stored(integers(vectors, dim, scale), "vectors")
    centroids = starts(whole, k, seed)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], out)
    table, balls = whole, Balls.of(centroids)
    now = whole.mapInArrow(_packed, "vec_id long, v binary, cluster int")
    for turn in range(rounds + 1):
        done = stored(now.mapInArrow(_assigned(spark.sparkContext.broadcast(balls), dim), _SCHEMA), f"round{turn}")
        release(table)
        table, totals = done, _totals(done, dim)
        if turn == rounds:
            break
        new, radius = centroids.copy(), [0] * len(centroids)
        for i, (n, _, far, sums) in totals.items():
            new[i] = [s // n for s in sums]
            radius[i] = (_root(far) + _root(int(_squared(new[i], centroids[i])))) ** 2  # members are no farther from where it moves to
        centroids, balls = new, Balls.of(new, radius)
        now = table.where("of is null").select("vec_id", "v", "cluster")
    whole_inertia = sum(t[1] for t in totals.values())
    told = [(i, t[1], whole_inertia, hashlib.sha256(",".join(map(str, centroids[i].tolist())).encode()).hexdigest()) for i, t in totals.items()]
    facts = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.where("of is null").select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(*(c.split()[0] for c in out.split(", ")))  # k rows


def op12_ball_kmeans(spark, sf_dir: str) -> DataFrame:
    return ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds_sql() -> str:
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""d{r} AS (SELECT v.rid, c.c, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS dist FROM v JOIN c{r} c USING (i) GROUP BY 1, 2),
a{r} AS MATERIALIZED (SELECT rid, arg_min(c, dist * {CLUSTERS} + c) AS c, min(dist) AS dist FROM d{r} GROUP BY 1)""")
        if r < ROUNDS:
            out.append(f"""n{r} AS (SELECT a.c, v.i, floor_div(sum(v.x)::BIGINT, count(*)) AS x FROM a{r} a JOIN v USING (rid) GROUP BY 1, 2),
c{r + 1} AS MATERIALIZED (SELECT c.c, c.i, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN n{r} n ON n.c = c.c AND n.i = c.i)""".replace("floor_div(sum(v.x)::BIGINT, count(*))", "((sum(v.x)::BIGINT - (((sum(v.x)::BIGINT % count(*)) + count(*)) % count(*))) // count(*))"))
    return ",\n".join(out)


OP12_SQL = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
v AS MATERIALIZED (SELECT rid, unnest(range(1, {DIM + 1})) AS i, unnest(e) AS x FROM k),
s AS (SELECT rid, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, e) - 1 AS c FROM k),
c0 AS MATERIALIZED (SELECT s.c, v.i, v.x FROM s JOIN v USING (rid) WHERE s.c < {CLUSTERS}),
{_rounds_sql()},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS} GROUP BY 1)
SELECT k.vec_id, a.c::INT AS cluster, a.dist AS distance, (sum(a.dist) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.dist) OVER ())::BIGINT AS inertia, h.h AS centroid_sha256
FROM a{ROUNDS} a JOIN k USING (rid) JOIN h ON h.c = a.c
"""
