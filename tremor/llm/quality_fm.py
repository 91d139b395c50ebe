"""Quality classifier: a factorisation machine (operator 10).

Features of a text: hashed words and word shapes, each with its share of the words as value;
structure statistics (cut into bins, value 1): length, symbol, digit, upper-case, pipe and
punctuation shares, word length, repeated words and lines; and metadata (bins, value 1): the declared
number of characters ``n_chars`` and whether it is missing, right, too small or too large. The score is
w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2), in linear time.
It is trained with numpy (Adam, log loss) on at most ``TRAIN_ROWS`` labelled rows, those with
the smallest hash of their id, as features that the executors have made; every text is scored whole.

Edge cases: null and empty texts have only structure and metadata features and get a score; a null doc_id
counts as not held out and is never trained on; rows with a null label are not trained on; a label table
without rows gives the score 0.5 to all; if a doc_id repeats in either table, each different label of it is
trained on once, with the least of its texts; without a column n_chars it counts as missing; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType, StructField, StructType

from tremor.llm import textops as T
from tremor.llm.workspace import documents

TRAIN_ROWS, BITS, RANK, BINS, EPOCHS = 6000, 14, 8, 12, 12
N_WORD = 1 << BITS
_SYMBOL, _DIGIT, _UPPER = T._lut(b"#*$%&|<>", True), T._lut(b"0123456789", True), T._lut(bytes(range(65, 91)), True)
_PUNCT, _PIPE, _BANG, _LINE = T._lut(b".,;:?", True), T._lut(b"|", True), T._lut(b"!", True), T._lut(b"\n", False)
_CLASS = np.full(256, 1, np.uint8)  # letters and all above ASCII
_CLASS[:65] = 4
_CLASS[65:91] = 2
_CLASS[91:97] = 4
_CLASS[123:128] = 4
_CLASS[48:58] = 3
N_STAT = 12
N_META = BINS + 4
N_FEATURES = 2 * N_WORD + N_STAT * BINS + N_META


def metadata(u8: np.ndarray, declared: int | None) -> list[int]:
    """Slots of the declared length: its magnitude, and how it compares with the text."""
    if declared is None:
        return [BINS]
    size = int(np.count_nonzero((u8 & 0xC0) != 0x80))
    return [min(max(declared, 0).bit_length() * 2 // 3, BINS - 1), BINS + 1 + (declared > size) + 2 * (declared < size)]


def features(u8: np.ndarray, declared: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids and their values."""
    starts, ends = T.spans(u8, T.SPACED)
    n, size = len(starts), max(len(u8), 1)
    word = T.hashes(T.LOWER[u8], starts, ends)
    shape = T.hashes(_shape(u8), starts, ends)
    uniq, times = np.unique(np.concatenate([(word >> T.U64(64 - BITS)).astype(np.int64), (shape >> T.U64(64 - BITS)).astype(np.int64) + N_WORD]), return_counts=True)
    lines = T.words(u8, _LINE)
    distinct = len(np.unique(word))
    share = lambda lut: np.count_nonzero(lut[u8]) / size
    tri = T.windows(word, 3)
    stats = np.array([
        np.log1p(n) / 10, share(_SYMBOL) * 6, share(_DIGIT) * 6, share(_UPPER), share(_PUNCT) * 8, share(_PIPE) * 6, share(_BANG) * 6,
        (ends - starts).mean() / 16 if n else 0, distinct / n if n else 0, 1 - len(np.unique(lines)) / len(lines) if len(lines) else 0,
        1 - len(np.unique(tri)) / len(tri) if len(tri) else 0, np.log1p(len(lines)) / 6,
    ])
    bins = np.minimum(np.ceil(np.maximum(stats, 0) * (BINS - 1)).astype(np.int64), BINS - 1)
    meta = 2 * N_WORD + N_STAT * BINS + np.array(metadata(u8, declared))
    ids = np.concatenate([uniq, 2 * N_WORD + np.arange(N_STAT) * BINS + bins, meta])
    return ids, np.concatenate([np.sqrt(times / max(n, 1)), np.ones(N_STAT + len(meta))])


def _shape(u8: np.ndarray) -> np.ndarray:
    """Case and kind of each byte; symbols as they are."""
    kind = _CLASS[u8]
    return np.where(kind == 4, u8, kind)


def margins(model, ptr: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The margin of each row, and its sums of v x."""
    w0, w, v = model
    vx = v[ids] * x[:, None]
    s1 = np.add.reduceat(vx, ptr[:-1], axis=0)
    s2 = np.add.reduceat(vx * vx, ptr[:-1], axis=0)
    return w0 + np.add.reduceat(w[ids] * x, ptr[:-1]) + 0.5 * (s1 * s1 - s2).sum(axis=1), s1


def train(ptr: np.ndarray, ids: np.ndarray, x: np.ndarray, labels: list[int], seed: int = 7):
    """(w0, w, v) by Adam on the mean log loss with weight decay; row k has the features from ``ptr[k]`` on."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, RANK))
    if not len(labels):
        return w0, w, np.zeros_like(v)
    y = np.array(labels, float)
    flat = np.concatenate([[w0], w, v.ravel()])
    m, s, step, size = np.zeros_like(flat), np.zeros_like(flat), 0, 256
    for _ in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(len(y)), max(1, len(y) // size)):
            lens = ptr[chosen + 1] - ptr[chosen]
            p = np.cumsum([0, *lens])
            at = np.repeat(ptr[chosen] - p[:-1], lens) + np.arange(p[-1])
            i, xi = ids[at], x[at]
            w0, w, v = flat[0], flat[1 : N_FEATURES + 1], flat[N_FEATURES + 1 :].reshape(N_FEATURES, RANK)
            z, s1 = margins((w0, w, v), p, i, xi)
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) / len(chosen)
            each = np.repeat(d, lens)
            grad = 1e-5 * flat
            grad[0] += d.sum()
            grad[1 : N_FEATURES + 1] += np.bincount(i, each * xi, N_FEATURES)
            gv = each[:, None] * (np.repeat(s1, lens, axis=0) * xi[:, None] - v[i] * (xi * xi)[:, None])
            for f in range(RANK):
                grad[N_FEATURES + 1 + f :: RANK][:N_FEATURES] += np.bincount(i, gv[:, f], N_FEATURES)
            step += 1
            m = 0.9 * m + 0.1 * grad
            s = 0.99 * s + 0.01 * grad * grad
            flat = flat - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return flat[0], flat[1 : N_FEATURES + 1], flat[N_FEATURES + 1 :].reshape(N_FEATURES, RANK)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame):
    """Train on the labelled rows outside the held-out third, at most ``TRAIN_ROWS`` of them."""
    marked = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).where(~held_out(F.col("id")))
    chosen = marked.orderBy(F.xxhash64("id", "y"), "id", "y").limit(TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").alias("id"), "text", _declared(docs)).join(F.broadcast(chosen), "id")  # TRAIN_ROWS short rows
    one = rows.groupBy("id", "y").agg(F.min(F.struct("text", "declared")).alias("r")).select(F.col("id").cast("long").alias("id"), "y", "r.*")
    got = one.mapInArrow(_featured, "id long, y int, ids array<int>, x array<float>").toArrow().sort_by([("id", "ascending"), ("y", "ascending")]).combine_chunks()
    lists = [got[c].combine_chunks() for c in ("ids", "x")]
    ids, x = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
    ptr = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return train(ptr, ids.astype(np.int64), x.astype(float), got["y"].to_pylist())


def _declared(docs: DataFrame) -> Column:
    """The n_chars of ``docs``, where there is such a column of numbers."""
    number = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, NumericType)
    return (F.col("n_chars").cast("long") if number else F.lit(None).cast("long")).alias("declared")


def _featured(batches):
    for batch in batches:
        declared = batch.column(batch.schema.get_field_index("declared")).to_pylist()
        rows = [features(u8, d) for u8, d in zip(T.texts(batch), declared, strict=True)]
        ends = pa.array(np.cumsum([0, *(len(r[0]) for r in rows)]), pa.int32())
        flat = [np.concatenate([r[k] for r in rows]) if rows else np.empty(0) for k in (0, 1)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(f.astype(t))) for f, t in zip(flat, (np.int32, np.float32), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("id", "y")), *lists], names=["id", "y", "ids", "x"])


def _scored(model):
    def run(batches):
        w0, w, v = model.value
        for batch in batches:
            out = []
            declared = batch.column(batch.schema.get_field_index("declared")).to_pylist()
            for u8, d in zip(T.texts(batch), declared, strict=True):
                ids, x = features(u8, d)
                vx = v[ids] * x[:, None]
                s1 = vx.sum(axis=0)
                out.append(w0 + (w[ids] * x).sum() + 0.5 * (s1 @ s1 - (vx * vx).sum()))
            score = 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(score, pa.float64())], names=["row", "score"])

    return run


def scored(docs: DataFrame, model) -> DataFrame:
    """(row, score): every row of ``docs`` and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, "text", _declared(docs))
    return rows.mapInArrow(_scored(shared), StructType([rows.schema["row"], StructField("score", DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    needed = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    out = scored(docs.select(needed), fit(docs, labels)).select("row.doc_id", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
