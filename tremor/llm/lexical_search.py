"""Ranked search over dual-sorted wavelet trees (operator 11).

A shard of documents, numbered by doc_id, has one sequence of document numbers: the postings of its terms one term
after another, each term's by falling impact. A wavelet tree over this sequence halves the document numbers level
by level and keeps the order inside a half. So a term is a range of the sequence at every node, its documents can be
navigated by number, and the first posting of the range has the term's greatest impact in the node: the weighted
sum of these, each rounded up to a step, bounds a document below. The search takes the best node of all first, splits it, drops the terms that
have nothing in a half, and has found the next best document when it stands at a leaf, where the bound is the score.
Equal bounds are taken by document number, so ties come out in order, and the search of a shard ends after k documents,
or when the best bound falls below the k-th score that the task has from its earlier shards.

``build`` makes one pass for the corpus sizes (an impact depends on them) and one for the shards, which are stored:
terms, offsets, impacts and the packed bits of the levels. ``search`` sends the queries to all shards in blocks of at most
``BLOCK_TERMS`` terms; it reads the shards' terms once for the document frequencies and the whole index once a block.

Terms are maximal runs of digits, letters and characters above ASCII, A-Z lower-cased, compared by 64-bit hashes.

Edge cases: null and termless texts are no documents of the statistics and are never found; rows that repeat a
doc_id are documents of their own; a null doc_id is kept and stands last among equal scores; rows that repeat an
item_id are one item with the terms of all of them (so are null ids); items without a known term have no rows; an
empty table gives no rows; extra columns are ignored. A text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm import textops as T
from tremor.llm.workspace import documents, stored

TOP, SHARD, BLOCK_TERMS, WIDE = 10, 4_000_000, 500_000, 4
STEP = 16  # impacts are 1,000,000 at most, so their steps have 16 bits
_INDEX = "doc_ids array<long>, terms binary, offsets binary, impacts binary, bits binary"
_INDEX_ARROW = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.binary()), ("offsets", pa.binary()), ("impacts", pa.binary()), ("bits", pa.binary())])
_LAST = np.iinfo(np.int64).max  # where a null doc_id stands


def _terms(batch: pa.RecordBatch):
    for u8 in T.texts(batch):
        yield T.words(T.LOWER[u8], T.ALNUM)


def _sized(batches):
    n = total = 0
    for batch in batches:
        for w in _terms(batch):
            n, total = n + (len(w) > 0), total + len(w)
    yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})


def sizes(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all terms)."""
    r = docs.select("text").mapInArrow(_sized, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return r[0] or 0, r[1] or 0


def _bits_of(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def shard_of(ids: list, docs: list[np.ndarray], n_all: int, total: int) -> pa.RecordBatch:
    """The stored form of one shard."""
    order = sorted(range(len(ids)), key=lambda k: _LAST if ids[k] is None else ids[k])
    found = [np.unique(docs[k], return_counts=True) for k in order]
    per = np.array([len(t) for t, _ in found])
    doc = np.repeat(np.arange(len(order)), per)
    slack = np.repeat([8 * (10 + 90 * len(docs[k]) * n_all // total) for k in order], per)
    term, tf = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found]).astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + slack)
    at = np.lexsort((doc, -impact, term))
    term, doc, impact = term[at], doc[at], impact[at]
    first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    levels, seq = [], doc
    for level in reversed(range(_bits_of(len(order)))):
        one = (seq >> level & 1).astype(bool)
        levels.append(np.packbits(one))
        seq = np.concatenate([seq[~one], seq[one]])
    packed = [[[ids[k] for k in order]], [term[first].tobytes()], [np.append(first, len(term)).astype("<i4").tobytes()], [impact.astype("<i4").tobytes()], [np.concatenate(levels).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(packed, _INDEX_ARROW, strict=True)], schema=_INDEX_ARROW)


def _sharded(n_all: int, total: int, size: int):
    def run(batches):
        ids, docs, held = [], [], 0
        for batch in batches:
            for i, w in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), _terms(batch), strict=True):
                if not len(w):
                    continue
                if docs and held + len(w) > size:
                    yield shard_of(ids, docs, n_all, total)
                    ids, docs, held = [], [], 0
                ids.append(i)
                docs.append(w)
                held += len(w)
        if docs:
            yield shard_of(ids, docs, n_all, total)

    return run


def build(docs: DataFrame, size: int = SHARD) -> tuple[DataFrame, int]:
    """(stored index, number of documents with a term) of ``docs(doc_id, text)``."""
    n, total = sizes(docs)
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(typed.mapInArrow(_sharded(n, max(total, 1), size), _INDEX), "wavelets"), n


class Shard:
    """A shard in memory: the bits of all levels with the ones before each byte, and the impacts in the order of each
    level: in steps of ``STEP`` rounded up, which keeps every bound a bound, and exact at the leaves."""

    def __init__(self, row: dict):
        self.ids = [_LAST if i is None else i for i in row["doc_ids"]]
        self.terms, self.offsets = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["offsets"], "<i4").astype(np.int64)
        n = self.n = int(self.offsets[-1])
        self.height = _bits_of(len(self.ids))
        self.bits = np.frombuffer(row["bits"], np.uint8).reshape(self.height, -1)
        self.before = np.zeros((self.height, self.bits.shape[1] + 1), np.int32)
        self.zeros, self.steps = np.empty(self.height, np.int64), np.empty((self.height, n), np.uint16)
        impact = np.frombuffer(row["impacts"], "<i4")
        for level in range(self.height):
            np.cumsum(np.bitwise_count(self.bits[level]), out=self.before[level, 1:])
            self.zeros[level] = n - self.before[level, -1]
            self.steps[level] = -(-impact // STEP)
            one = np.unpackbits(self.bits[level], count=n).astype(bool)
            impact = np.concatenate([impact[~one], impact[one]])
        self.exact = impact

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` bits of a level are set."""
        byte = at >> 3
        part = self.bits[level, np.minimum(byte, self.bits.shape[1] - 1)].astype(np.uint16) >> (8 - (at & 7)).astype(np.uint16)
        return self.before[level, byte].astype(np.int64) + np.bitwise_count(part)

    def impacts(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """At least the impact at a place of a level's order; at the leaves the impact."""
        return np.where(level == self.height, self.exact[at], self.steps[np.minimum(level, self.height - 1), at].astype(np.int64) * STEP)

    def ranges(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each term's postings; both 0 if it has none."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        return np.where(known, self.offsets[at], 0), np.where(known, self.offsets[at + 1], 0)

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, floors: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
        """For each query (terms, weights) the k best (score, doc_id) of the shard that are above its floor (score,
        doc_id), best first. All queries go on together, a few nodes each a round, so that one step splits them all."""
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        heaps: list[list] = []
        for q, (terms, weights) in enumerate(queries):
            lo, hi = self.ranges(terms)
            keep = (hi > lo) & (weights > 0)
            lo, hi, w = lo[keep], hi[keep], weights[keep]
            bound = int((w * self.impacts(np.zeros(len(lo), np.int64), lo)).sum()) if len(lo) else 0
            heaps.append([(-bound, 0, 0, lo, hi, w)] if bound else [])
        live = [q for q in range(len(queries)) if heaps[q]]
        while live:
            split, going = [], []
            for q in live:
                heap, best, floor = heaps[q], out[q], floors[q]
                mine = 0
                while heap and len(best) < k and mine < WIDE:
                    key = (-heap[0][0], self.ids[heap[0][1]])
                    if key[0] < floor[0] or (key[0] == floor[0] and key[1] >= floor[1]):
                        heap.clear()
                        break
                    leaf = heap[0][2] == self.height
                    if leaf and mine:
                        break  # a better one may come of the nodes that are split now
                    node = heapq.heappop(heap)
                    if leaf:
                        best.append(key)
                    else:
                        split.append((q, node))
                        mine += 1
                if mine:
                    going.append(q)
                elif heap and len(best) < k:
                    going.append(q)
            live = going
            if split:
                self._split(split, heaps, floors)
        return out

    def _split(self, nodes: list, heaps: list[list], floors: list[tuple[int, int]]) -> None:
        sizes_ = np.array([len(n[3]) for _, n in nodes])
        level = np.repeat([n[2] for _, n in nodes], sizes_)
        lo, hi, w = (np.concatenate([n[c] for _, n in nodes]) for c in (3, 4, 5))
        a, b = self.ones(level, lo), self.ones(level, hi)
        ends = np.cumsum(sizes_)
        starts_ = ends - sizes_
        zeros = self.zeros[level]
        for one in (0, 1):
            l2, h2 = (zeros + a, zeros + b) if one else (lo - a, hi - b)
            some = h2 > l2
            l2, h2, w2 = l2[some], h2[some], w[some]
            left = np.add.reduceat(some, starts_, dtype=np.int64)  # terms that a node's half still has
            met = np.flatnonzero(left)
            till = np.cumsum(left[met])
            bound = np.add.reduceat(w2 * self.impacts(level[some] + 1, l2), till - left[met]) if len(met) else []
            for j, s, e, best in zip(met.tolist(), (till - left[met]).tolist(), till.tolist(), np.asarray(bound).tolist(), strict=True):
                q, n = nodes[j]
                if best >= floors[q][0]:
                    heapq.heappush(heaps[q], (-best, n[1] | (one << (self.height - 1 - n[2])), n[2] + 1, l2[s:e], h2[s:e], w2[s:e]))


def item_terms(items: list[tuple]) -> dict:
    """By item id, its distinct terms."""
    out: dict = {}
    for item, text in items:
        w = T.words(T.LOWER[np.frombuffer((text or "").encode(), np.uint8)], T.ALNUM)
        out[item] = np.union1d(out.get(item, w), w)
    return out


def _frequencies(wanted):
    def run(batches):
        terms = wanted.value
        df = np.zeros(len(terms), np.int64)
        for batch in batches:
            for raw, offs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                have, n = np.frombuffer(raw, np.uint64), np.diff(np.frombuffer(offs, "<i4"))
                at = np.minimum(np.searchsorted(have, terms), len(have) - 1)
                df += np.where(have[at] == terms, n[at], 0)
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": met, "df": df[met]})

    return run


def _searched(block, k: int):
    def run(batches):
        queries, numbers = block.value
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        for batch in batches:
            for at in range(batch.num_rows):
                shard = Shard(batch.slice(at, 1).to_pylist()[0])
                floors = [(-b[-1][0], b[-1][1]) if len(b) == k else (0, 0) for b in best]
                for q, found in enumerate(shard.top(queries, k, floors)):
                    best[q] = heapq.nsmallest(k, [*best[q], *((-s, i) for s, i in found)])
        rows = [(n, None if i == _LAST else i, -s) for n, b in zip(numbers, best, strict=True) for s, i in b]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return run


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(index: DataFrame, n: int, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents above 0 of every item of ``queries(item_id, text)``."""
    spark = index.sparkSession
    kind = queries.schema["item_id"].dataType
    rows = queries.groupBy("item_id").agg(F.collect_list("text").alias("texts"))
    items = item_terms([(r.item_id, " ".join(r.texts)) for r in rows.toLocalIterator()])  # the stated query set
    names, sets = list(items), list(items.values())
    blocks, held = [[]], 0
    for q, terms in enumerate(sets):
        if blocks[-1] and held + len(terms) > BLOCK_TERMS:
            blocks.append([])
            held = 0
        blocks[-1].append(q)
        held += len(terms)
    found = None
    for mine in blocks:
        terms = np.unique(np.concatenate([np.empty(0, np.uint64), *(sets[q] for q in mine)]))
        counted = index.select("terms", "offsets").mapInArrow(_frequencies(spark.sparkContext.broadcast(terms)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a row a term of the block
        weights = np.zeros(len(terms), np.int64)
        for r in counted:
            weights[r.term] = weight(n, r.df)
        sent = spark.sparkContext.broadcast(([(sets[q], weights[np.searchsorted(terms, sets[q])]) for q in mine], mine))
        part = index.mapInArrow(_searched(sent, k), "item long, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(names)), "item long, item_id " + kind.simpleString())
    return best.join(F.broadcast(named) if len(names) <= BLOCK_TERMS else named, "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    index, n = build(documents(spark, sf_dir))
    return search(index, n, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
g AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
p AS MATERIALIZED (SELECT rid, t, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
wt AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS wt FROM (SELECT t, count(*) AS df FROM p GROUP BY 1), g),
m AS (SELECT rid, doc_id, 10 + ((90 * len(w)::BIGINT * nn) // ll) AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT q.item_id, m.doc_id, m.rid, sum(wt.wt * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN wt USING (t) JOIN m ON m.rid = p.rid GROUP BY 1, 2, 3)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
