"""MinHash near-dedup by a multi-index Hamming join (operator 2).

A document is the set of its distinct 5-word shingles (the whole sequence if it is
shorter). Its signature has 56 symbols of 16 bits, each the low bits of a minimum hash,
packed as 14 chunks of 4 symbols. Two documents of Jaccard similarity 0.75 differ in 14
symbols on average; the join finds every pair that differs in at most ``MAX_DISTANCE`` =
27 (a pair at exactly 0.75 exceeds that with probability 4e-5, at 0.8 with 3e-7). By the
pigeonhole principle such a pair has a chunk with at most floor(27 / 14) = 1 differing
symbol, so the index holds each chunk under its 4 one-symbol wildcards, and a key stands
for 3 agreeing symbols. Every link is then confirmed on the full texts.

Copies and dense groups are never expanded into pairs: equal sets collapse first; each
set is then tried against the hub (smallest id) of each of its buckets; pairs inside a
bucket come up only between components that are still apart. Members of such buckets of
over ``BUCKET`` sets are not paired at all but meet over their rarest shingles
(``prefix_pairs``), a filter that loses no pair of the wanted similarity.

Edge cases: null and wordless texts have 0 shingles and link with nothing; rows with a
null doc_id link with nothing, have a null component_id and are kept; rows that repeat a
doc_id are one node that has the links of all of them; extra columns are ignored.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm import textops as T
from tremor.llm.workspace import documents, stored

SYMBOLS, CHUNKS, MAX_DISTANCE, BUCKET, SALT, SPREAD, ORDER_BITS = 56, 14, 27, 64, 64, 16, 20
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * T.U64(2) + T.U64(1)
_B = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
SET = ["h1", "h2", "n_shingles"]
ONE_WILD = [~(0xFFFF << 16 * j) for j in range(4)]


def _long(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def signature(s: np.ndarray) -> np.ndarray:
    """14 chunks of 4 symbols of 16 bits."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):  # bounded memory for long texts
        part = s[k : k + 2048]
        np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    sym = (T.mix(low) & T.U64(0xFFFF)).reshape(CHUNKS, 4)
    return sym[:, 0] | sym[:, 1] << T.U64(16) | sym[:, 2] << T.U64(32) | sym[:, 3] << T.U64(48)


SIG_SCHEMA = "doc_id long, n_shingles long, h1 long, h2 long, sig array<long>"
_SIG_ARROW = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("sig", pa.list_(pa.int64()))])


def _signatures(batches):
    zero = np.zeros(CHUNKS, np.uint64)
    for batch in batches:
        n, h1, h2, sigs = [], [], [], []
        for u8 in T.texts(batch):
            s = T.shingles(T.words(T.LOWER[u8], T.SPACED))
            n.append(len(s))
            h1.append(int(T.mix(s).sum().astype(np.int64)) if len(s) else 0)
            h2.append(int(T.mix(s ^ T.U64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)) if len(s) else 0)
            sigs.append(signature(s) if len(s) else zero)
        flat = np.concatenate(sigs).view(np.int64) if sigs else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sigs) + 1, dtype=np.int32) * CHUNKS), pa.array(flat))
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists], schema=_SIG_ARROW)


def distance(a: Column, b: Column) -> Column:
    """Differing symbols of two signatures, inside codegen."""
    out = F.lit(0)
    for i in range(CHUNKS):
        x = a[i].bitwiseXOR(b[i])
        for k in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        out = out + F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))
    return out


def _keys(sig: Column) -> Column:
    return F.explode(F.array(*[F.xxhash64(F.lit(i * 4 + j), sig[i].bitwiseAND(F.lit(_long(m)))) for i in range(CHUNKS) for j, m in enumerate(ONE_WILD)]))


def _close(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """Of ``pairs(a, bs, salts)``, the single pairs (a, b, salts) whose signatures are near enough. Members of a
    hub b are dealt over their salts, each of which gets a copy of the hub's signature."""
    pairs = stored(pairs, "tried")
    salt = F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt")
    owners = pairs.select(F.explode("bs").alias("b"), salt).distinct().join(sig.toDF("b", "sb"), "b")
    both = pairs.join(sig.toDF("a", "sa"), "a").select("a", "sa", "salts", salt, F.explode("bs").alias("b")).join(owners, ["b", "salt"])
    return stored(both.where(distance(F.col("sa"), F.col("sb")) <= MAX_DISTANCE).select("a", "b", "salts"), "close")


def _salts(n: Column) -> Column:
    """Into how many parts a group of about n members is dealt: a power of two, of at most ``SALT`` members each."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n / SALT, F.lit(1.0))))).cast("long")


@contextlib.contextmanager
def _runtime_filter(spark):
    """Let Spark drop texts that no pair needs before they are shuffled: a Bloom filter of bounded
    size that it builds from the ids, where those are few."""
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "16MB")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def _verify(batches):
    """Rows come sorted by (hub, salt, member first as null): exact Jaccard on full sets."""
    at, hubs = None, []
    for batch in batches:
        hub = batch.column(0).to_pylist()
        salt = batch.column(1).to_pylist()
        member = batch.column(2).to_pylist()
        out: list[tuple[int, int]] = []
        for h, s, m, u8 in zip(hub, salt, member, T.texts(batch), strict=True):
            if (h, s) != at:
                at, hubs = (h, s), []
            own = T.shingles(T.words(T.LOWER[u8], T.SPACED))
            if m is None:
                hubs.append(own)
                continue
            for other in hubs:
                if 100 * min(len(own), len(other)) < 75 * max(len(own), len(other)):
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both and 100 * both >= 75 * (len(own) + len(other) - both):
                    out.append((m, h))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of doc_ids whose texts are similar enough, of ``pairs(a, b, salts)``. Members of a hub b
    are dealt over their salts, and every part of a hub has its own copy of the hub's text; nothing is
    dealt by the hub alone."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    members = dealt.select(F.col("a").alias("doc_id"), F.col("b").alias("hub"), "salt", F.col("a").alias("member"))
    owners = dealt.select("b", "salt").distinct().select(F.col("b").alias("doc_id"), F.col("b").alias("hub"), "salt", F.lit(None).cast("long").alias("member"))
    wanted = stored(members.unionByName(owners), "wanted")
    rows = docs.select("doc_id", "text").join(wanted.where("salt >= 0"), "doc_id").select("hub", "salt", "member", "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    with _runtime_filter(docs.sparkSession):
        return stored(dealt.mapInArrow(_verify, "a long, b long"), "links")


def _sets(batches):
    for batch in batches:
        sets = [T.shingles(T.words(T.LOWER[u8], T.SPACED)).view(np.int64) for u8 in T.texts(batch)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["rep", "comp", "s"])


def _common(batches):
    """Counts of the cells that a task meets more than once. They only set an order, and the
    filter is exact under any; what is rare everywhere may count as 0."""
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        h = np.asarray(batch.column(2).flatten()).view(np.uint64)
        counts += np.bincount((h >> T.U64(64 - ORDER_BITS)).astype(np.int64), minlength=len(counts))
    cell = np.flatnonzero(counts > 1)
    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(counts[cell], pa.int64())], names=["cell", "n"])


def _prefixes(order):
    """The rarest shingles of each set: of a set of size n, any partner as large or larger shares
    one of the first n - ceil(6n/7) + 1, any smaller partner one of the first n - ceil(3n/4) + 1."""

    def run(batches):
        freq = order.value
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for rep, comp, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = np.asarray(s.values)
                n = len(h)
                k = n - -(-3 * n // 4) + 1
                rank = np.lexsort((h, freq[(h.view(np.uint64) >> T.U64(64 - ORDER_BITS)).astype(np.int64)]))[:k]
                for c, x in zip(cols, (h[rank], np.full(k, rep), np.full(k, comp), np.full(k, n), np.arange(k)), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in cols], names=["token", "rep", "comp", "n", "pos"])

    return run


def prefix_pairs(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of ``members(rep, comp)`` of different components that can reach the similarity,
    for buckets too large to be paired: an exact prefix and position filter on the shingle
    sets, rarest first. The order is by counts in ``2 ** ORDER_BITS`` cells, whatever the input."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").join(members, F.col("doc_id") == F.col("rep")).select("rep", "comp", "text")
    sets = stored(rows.mapInArrow(_sets, "rep long, comp long, s array<long>"), "sets")
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    for r in sets.mapInArrow(_common, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r[0]] = r[1]
    order = spark.sparkContext.broadcast(counts)
    rare = stored(sets.mapInArrow(_prefixes(order), "token long, rep long, comp long, n long, pos long"), "prefixes")
    x = rare.where(F.expr("pos <= n - ceil(6 * n / 7)"))
    y = rare.toDF("token", "rep2", "comp2", "n2", "pos2")
    return (
        x.join(y, "token").where("comp <> comp2 and (n < n2 or (n = n2 and rep < rep2)) and 100 * n >= 75 * n2 and 175 * least(n - pos, n2 - pos2) >= 75 * (n + n2)")
        .select("rep", "rep2").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, by min-label steps with two pointer jumps each.
    Every step is a stored table; hot nodes meet partial aggregates and skew joins only.
    ``edges(a, b)`` should be stored, as every step reads it."""
    both = edges.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = both.union(both.select("dst", "src"))
    lab = stored(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("comp")).withColumnRenamed("src", "id"), "labels")
    while True:
        near = both.join(lab, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("comp").alias("m"))
        step = lab.join(near, F.col("id") == F.col("src")).select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        one = lab.select(F.col("id").alias("at"), F.col("comp").alias("root"))
        two = lab.select(F.col("id").alias("at2"), F.col("comp").alias("root2"))
        jump = step.join(one, F.col("comp") == F.col("at"), "left").join(two, F.col("root") == F.col("at2"), "left")
        new = stored(jump.select("id", "old", F.least("comp", "root", "root2").alias("comp")), "labels")
        done = new.where("old <> comp").isEmpty()
        lab = new.select("id", "comp")
        if done:
            return lab


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``."""
    sigs = stored(docs.select("doc_id", "text").mapInArrow(_signatures, SIG_SCHEMA), "sigs")
    real = sigs.where("n_shingles > 0 and doc_id is not null")
    reps = stored(real.groupBy(*SET).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "reps")
    # copies of one set, and texts without words, are dealt over salts: each salt that has some gets the set's rep
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).alias("part")
    parts = stored(real.select(*SET, part).distinct().join(reps.select(*SET, "rep"), [*SET]), "parts")
    rows = stored(
        sigs.select("doc_id", *SET, part).join(parts, [*SET, "part"], "left")
        .select("doc_id", "n_shingles", "part", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "rows"
    )
    same_id = rows.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    same_id = same_id.where("lo <> hi or lo <> doc_id").select(F.col("lo").alias("a"), F.col("hi").alias("b"))

    # buckets of the index; every set against the hub of each of its buckets
    keys = reps.select("rep", _keys(F.col("sig")).alias("key"))
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(hubs, "key"), "shared")
    sig = reps.select(F.col("rep").alias("id"), "sig")
    hubs_of = shared.where("rep <> hub").groupBy("rep").agg(F.collect_set("hub").alias("bs"), F.max("n").alias("n"))  # one hub a key at most
    first = verified(docs, _close(hubs_of.select(F.col("rep").alias("a"), "bs", _salts(F.col("n")).alias("salts")), sig))
    comp = components(first.unionByName(stored(same_id, "same")))

    # buckets that still hold several components
    known = shared.drop("n").join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    mixed = stored(known.join(mixed, "key"), "mixed")
    small = mixed.where(F.col("n") <= BUCKET)
    right = small.select("key", F.col("rep").alias("rep2"), F.col("comp").alias("comp2"))
    pairs = small.join(right, "key").where("comp < comp2").select("rep", "rep2")
    large = stored(mixed.where(F.col("n") > BUCKET).select("rep", "comp").distinct(), "large")
    if not large.isEmpty():
        pairs = pairs.union(prefix_pairs(docs, large))
    pairs = pairs.select(F.greatest("rep", "rep2").alias("a"), F.least("rep", "rep2").alias("b"))
    single = stored(pairs.distinct(), "single")
    busy = single.groupBy("b").count().where(F.col("count") > SPREAD * SALT)  # few: each has over a thousand pairs
    salts = F.greatest(F.lit(SPREAD).cast("long"), _salts(F.coalesce("count", F.lit(0))))
    more = verified(docs, _close(single.join(busy, "b", "left").select("a", F.array("b").alias("bs"), salts.alias("salts")), sig))
    named = reps.select("rep").distinct().join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))
    if not more.isEmpty():  # links between components
        named = stored(named, "named")
        ends = more.join(named.toDF("a", "ca"), "a").join(named.toDF("b", "cb"), "b")
        joint = components(stored(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "joint"))
        named = named.join(joint.select(F.col("id").alias("comp"), F.col("comp").alias("least")), "comp", "left").select("rep", F.coalesce("least", "comp").alias("comp"))

    homes = parts.select("rep", "part").distinct().join(named, "rep")  # a repeated id has several sets
    out = rows.join(homes, ["rep", "part"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("comp", "rep")).otherwise(F.col("doc_id")).alias("component_id")
    )
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


_TOKENS = r"""
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)
"""

OP2_SQL = rf"""
WITH RECURSIVE {_TOKENS},
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM words),
groups AS (SELECT z AS s, min(doc_id) AS rep, len(z) AS n FROM (SELECT doc_id, list_sort(s) AS z FROM sets WHERE len(s) > 0) GROUP BY z),
items AS (SELECT rep, n, unnest(s) AS x FROM groups),
inter AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM inter WHERE 100 * k >= 75 * (na + nb - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT rep, rep FROM groups UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.root = e.a),
comp AS (SELECT id, min(root) AS c FROM reach GROUP BY id)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept
FROM sets LEFT JOIN groups g ON list_sort(sets.s) = g.s LEFT JOIN comp ON comp.id = g.rep
"""
