"""Benchmark decontamination over a distributed positional inverted index (operator 1).

``build_index`` stores the postings of every training token, sharded by document: a row is
one shard of at most about ``SHARD`` tokens with its sorted terms, their offsets and their
delta-coded positions. The index does not depend on a benchmark. ``search`` sends windows
of the test items to every shard in blocks of bounded size; there each window starts from
the postings of its rarest term, and the offset-adjusted lists of its next rarest terms are
intersected one by one. ``slop`` = 0 gives exact phrases; with a larger one (proximity) a window stands at
a start if each of its terms has an occurrence of its own at most ``slop`` words off its place. op1 gives the
exact matches and, in ``n_near_items``, the items with a window in proximity ``NEAR``.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters above ASCII. A window
is 10 consecutive item words; a shorter item, but not an empty one, is one window.

Edge cases: null and wordless texts have no words and no hits, as items no windows; rows
that repeat a doc_id are reported row by row; a null doc_id stays null; an item_id that
repeats is one item, a null one marks words but is not listed; an empty benchmark or empty
documents give zero hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm import textops as T
from tremor.llm.workspace import documents, stored

WINDOW, NEAR, SHARD, BLOCK_CHARS, GAP = 10, 1, 1_000_000, 1_000_000, 32  # GAP: free positions between documents
INDEX_SCHEMA = "shard long, doc_ids array<long>, n_words array<long>, terms binary, offsets binary, postings binary"
_INDEX_ARROW = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("terms", pa.binary()), ("offsets", pa.binary()), ("postings", pa.binary())])


def _planes(x: np.ndarray) -> bytes:
    """Byte planes, which the file's compression packs well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _shard(shard: int, ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
    n = np.array([len(x) for x in docs], np.int64)
    base = np.concatenate([[0], np.cumsum(n + GAP)])[:-1]
    tokens = np.concatenate(docs) if docs else np.empty(0, np.uint64)
    order = np.argsort(tokens, kind="stable")
    at = tokens[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
    place = (np.arange(len(tokens)) + GAP * np.repeat(np.arange(len(docs)), n))[order].astype(np.int32)
    assert not len(base) or base[-1] + n[-1] < 1 << 31
    columns = [[shard], [ids], [n.tolist()], [_planes(at[first])], [_planes(np.append(first, len(at)).astype(np.int32))], [_planes(np.diff(place, prepend=np.int32(0)))]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _INDEX_ARROW, strict=True)], schema=_INDEX_ARROW)


def _indexed(batches):
    task = TaskContext.get()
    shard, ids, docs, size = (task.partitionId() if task else 0) << 32, [], [], 0
    for batch in batches:
        for i, u8 in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), T.texts(batch), strict=True):
            w = T.words(T.LOWER[u8], T.ALNUM)
            if docs and size + len(w) > SHARD:
                yield _shard(shard, ids, docs)
                shard, ids, docs, size = shard + 1, [], [], 0
            ids.append(i)
            docs.append(w)
            size += len(w) + 1
    if docs:
        yield _shard(shard, ids, docs)


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index of ``docs(doc_id, text)``."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(typed.mapInArrow(_indexed, INDEX_SCHEMA), "postings")


def item_windows(items: list[tuple[str | None, str | None]], width: int = WINDOW) -> dict[int, tuple[np.ndarray, list[list]]]:
    """By length: the distinct windows and, for each, the items that have it."""
    found: dict[int, dict[bytes, set]] = {}
    for item, text in items:
        w = T.words(T.LOWER[np.frombuffer((text or "").encode(), np.uint8)], T.ALNUM)
        size = min(len(w), width)
        for k in range(len(w) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(w[k : k + size].tobytes(), set()).add(item)
    return {n: (np.frombuffer(b"".join(x), np.uint64).reshape(-1, n), [list(v) for v in x.values()]) for n, x in found.items()}


def _matches(terms, offs, keys, places, m: np.ndarray, slop: int):
    """(window, first position, end) of every place where a window's terms stand; with a slop, of the occurrences
    nearest to the start."""
    at = np.minimum(np.searchsorted(terms, m), max(len(terms) - 1, 0))
    rows = np.flatnonzero((terms[at] == m).all(axis=1)) if len(terms) else np.empty(0, np.int64)
    at = at[rows]
    sizes = offs[at + 1] - offs[at]
    rank = np.argsort(sizes, axis=1, kind="stable")
    lead = sizes[np.arange(len(rows)), rank[:, 0]] if len(rows) else np.empty(0, np.int64)
    cuts = np.searchsorted(np.cumsum(lead), np.arange(0, lead.sum() + 1, 1 << 20)) if len(rows) else []
    for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True) if len(rows) else []:
        win = np.repeat(np.arange(a, b), lead[a:b])
        if not len(win):
            continue
        within = np.arange(len(win)) - np.repeat(np.cumsum(lead[a:b]) - lead[a:b], lead[a:b])
        r0 = rank[win, 0]
        start = places[offs[at[win, r0]] + within] - r0
        if slop:  # the rarest term, too, may stand off its place
            start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            win = np.repeat(win, 2 * slop + 1)
        lo, hi = np.full(len(start), np.iinfo(np.int64).max), np.full(len(start), -1)
        for k in range(m.shape[1]):
            r = rank[win, k]
            term = at[win, r].astype(np.int64) << 32
            j = np.minimum(np.searchsorted(keys, term + np.maximum(start + r - slop, 0)), len(keys) - 1)
            got = keys[j] - term
            ok = (got >= start + r - slop) & (got <= start + r + slop)
            win, start, lo, hi = win[ok], start[ok], np.minimum(lo[ok], got[ok]), np.maximum(hi[ok], got[ok])
        if slop and len(win):
            ok = _apart(at, offs, places, win, start, slop)
            win, lo, hi = win[ok], lo[ok], hi[ok]
        yield rows[win], lo, hi + 1


def _apart(at, offs, places, win, start, slop: int) -> np.ndarray:
    """Whether equal terms of a window have occurrences of their own: the first free one goes to the first of them."""
    sorted_at = np.sort(at, axis=1)
    again = (sorted_at[:, 1:] == sorted_at[:, :-1]).any(axis=1)
    ok = np.ones(len(win), bool)
    for c in np.flatnonzero(again[win]).tolist():
        terms, s = at[win[c]].tolist(), int(start[c])
        for t in {t for t in terms if terms.count(t) > 1}:
            stand, last = places[offs[t] : offs[t + 1]], -1
            for k in (k for k, x in enumerate(terms) if x == t):
                j = int(np.searchsorted(stand, max(s + k - slop, last + 1)))
                if j == len(stand) or stand[j] > s + k + slop:
                    ok[c] = False
                    break
                last = int(stand[j])
    return ok


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("item", pa.string())])
_FOUND = "shard long, doc_ix long, spans array<struct<start:long,stop:long,item:string>>, near array<string>"
_FOUND_ARROW = pa.schema([("shard", pa.int64()), ("doc_ix", pa.int64()), ("spans", pa.list_(_SPAN)), ("near", pa.list_(pa.string()))])


def _searched(block, slop: int, near: int):
    def run(batches):
        windows = block.value
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["n_words"], np.int64)
                base = np.concatenate([[0], np.cumsum(n + GAP)])[:-1]
                terms, offs = _unplanes(row["terms"], np.uint64), _unplanes(row["offsets"], np.int32).astype(np.int64)
                places = np.cumsum(_unplanes(row["postings"], np.int32), dtype=np.int32).astype(np.int64)
                keys = (np.repeat(np.arange(len(terms)), np.diff(offs)) << 32) + places

                def hits(slop):
                    for m, items in windows.values():
                        for win, lo, hi in _matches(terms, offs, keys, places, m, slop):  # noqa: B023
                            doc = np.searchsorted(base, lo, side="right") - 1  # noqa: B023
                            for d, a, b, w in zip(doc.tolist(), (lo - base[doc]).tolist(), (hi - base[doc]).tolist(), win.tolist(), strict=True):  # noqa: B023
                                for item in items[w]:
                                    yield d, item, (a, b)

                spans: dict[int, dict] = {}
                close: dict[int, set] = {}
                for d, item, span in hits(slop):
                    spans.setdefault(d, {}).setdefault(item, set()).add(span)
                for d, item, _ in hits(near) if near else ():
                    close.setdefault(d, set()).add(item)
                out = []
                for d in sorted({*spans, *close}):
                    merged = []
                    for item, pairs in spans.get(d, {}).items():
                        run_a, run_b = None, -1
                        for a, b in sorted(pairs):
                            if a > run_b or slop:
                                if run_a is not None:
                                    merged.append((run_a, run_b, item))
                                run_a, run_b = a, b
                            else:
                                run_b = max(run_b, b)
                        merged.append((run_a, run_b, item))
                    named = sorted(x for x in close.get(d, ()) if x is not None)
                    out.append({"shard": row["shard"], "doc_ix": d, "spans": [{"start": a, "stop": b, "item": i} for a, b, i in merged] or None, "near": named})
                yield pa.RecordBatch.from_pylist(out, schema=_FOUND_ARROW)

    return run


def search(index: DataFrame, benchmark: DataFrame, slop: int = 0, width: int = WINDOW, near: int = 0) -> DataFrame:
    """(shard, doc_ix, doc_id, n_words, spans, near) for every document; spans are the matches
    (start, stop, item) in words, with exact neighbours of one item joined, and null if none; near has the
    items found with the slop ``near``, if that is over 0.

    The items go out in blocks of about ``BLOCK_CHARS`` characters, one broadcast each."""
    if width + 2 * max(slop, near) >= GAP:
        raise ValueError(f"window and slop must stay below {GAP} positions")
    spark = index.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body"))
    chars = items.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0]
    blocks = chars // BLOCK_CHARS + 1
    found = None
    for k in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k)
        block = spark.sparkContext.broadcast(item_windows([tuple(r) for r in mine.collect()], width))
        part = index.mapInArrow(_searched(block, slop, near), _FOUND)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        both = F.flatten(F.collect_list("spans"))
        found = found.groupBy("shard", "doc_ix").agg(F.when(F.size(both) > 0, both).alias("spans"), F.flatten(F.collect_list("near")).alias("near"))
    all_docs = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("doc_ix", "d"))
    all_docs = all_docs.select("shard", F.col("doc_ix").cast("long").alias("doc_ix"), F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    return all_docs.join(found, ["shard", "doc_ix"], "left")


def covered(spans: Column) -> Column:
    """Words inside any span."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("till"))
    return F.aggregate(
        ordered, zero, lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(s["a"], acc["till"]))).alias("n"), F.greatest(acc["till"], s["b"]).alias("till"))
    )["n"]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) for every row."""
    hits = search(build_index(docs), benchmark, near=NEAR)
    near = F.coalesce(F.size(F.array_distinct("near")), F.lit(0)).cast("long")
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("spans", lambda s: s["item"]))))
    items = F.coalesce(items, F.array().cast("array<string>"))
    return hits.select(
        "doc_id", "n_words", F.coalesce(covered(F.col("spans")), F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), F.col("spans").isNotNull().alias("contaminated"), near.alias("n_near_items"),
    )


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, l, g FROM (
  SELECT item_id, least(len(w), 10) AS l, unnest([array_to_string(w[i:i+least(len(w), 10)-1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)]) AS g FROM b WHERE len(w) > 0)),
dp AS (SELECT rid, l, w, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l),
dw AS (SELECT rid, l, i, array_to_string(w[i:i+l-1], ' ') AS g FROM dp),
hits AS (SELECT DISTINCT dw.rid, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
pos AS (SELECT DISTINCT rid, unnest(range(i, i + l)) AS p FROM hits),
nh AS (SELECT rid, count(*) AS n FROM pos GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY rid),
dword AS (SELECT rid, pos, w[pos] AS x FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
win AS (SELECT row_number() OVER () AS wid, l, g, string_split(g, ' ') AS ws FROM (SELECT DISTINCT l, g FROM bw)),
slot AS (SELECT wid, k, ws[k] AS x FROM (SELECT wid, ws, unnest(range(1, l + 1)) AS k FROM win)),
freq AS (SELECT x, count(*) AS n FROM dword GROUP BY x),
lead AS (SELECT wid, arg_min(struct_pack(k := k, x := x), struct_pack(n := n, k := k)) AS r FROM slot JOIN freq USING (x) GROUP BY wid),
cand AS (SELECT DISTINCT rid, wid, pos - lead.r.k + off AS s FROM lead JOIN dword ON dword.x = lead.r.x, (SELECT unnest([-1, 0, 1]) AS off)),
need AS (SELECT a.wid, a.k AS i, b.k AS j, a.x, (SELECT count(*) FROM slot c WHERE c.wid = a.wid AND c.x = a.x AND c.k BETWEEN a.k AND b.k) AS many
  FROM slot a JOIN slot b ON a.wid = b.wid AND a.x = b.x AND a.k <= b.k),
held AS (SELECT cand.rid, cand.wid, cand.s, need.i, need.j FROM cand JOIN need USING (wid) JOIN dword ON dword.rid = cand.rid AND dword.x = need.x AND dword.pos BETWEEN cand.s + need.i - 1 AND cand.s + need.j + 1
  GROUP BY cand.rid, cand.wid, cand.s, need.i, need.j, need.many HAVING count(*) >= need.many),
near AS (SELECT DISTINCT rid, wid FROM (SELECT rid, wid, s, count(*) AS n FROM held GROUP BY rid, wid, s) JOIN (SELECT wid, count(*) AS n FROM need GROUP BY wid) t USING (wid, n)),
ni AS (SELECT rid, count(DISTINCT bw.item_id) AS n FROM near JOIN win USING (wid) JOIN bw ON bw.l = win.l AND bw.g = win.g GROUP BY rid)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(nh.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(it.s, '')) AS items_sha256, coalesce(nh.n, 0) > 0 AS contaminated, coalesce(ni.n, 0)::BIGINT AS n_near_items
FROM d LEFT JOIN nh ON nh.rid = d.rid LEFT JOIN it ON it.rid = d.rid LEFT JOIN ni ON ni.rid = d.rid
"""
