"""Masked pseudo-likelihood of documents under a bidirectional window network (operator 7).

A network predicts every word from the ``WINDOW`` words on each side: their vectors, weighted by
place, are summed and squashed; a class and then a word of that class follow by two softmaxes. A
document's score is the sum of the logarithms of these conditional probabilities, and its mean.

Vocabulary: the most frequent words, counted over all documents; its size is the square root of the
number of words of all documents, rounded up to a square, and at least ``SIDE`` squared. The other words
share ``OTHER`` buckets by their last two bytes, and each is then spelled from its end: its last two bytes
given the bucket, and every byte before given the two after it, down to the border of the word. So
each word has a probability of its own. The spelling counts come from all words out of the vocabulary.

Training is data-parallel, on all documents: in each round every task runs Adagrad from the shared
weights over its documents, and the weights are averaged by words in two levels, so that the driver
gets few rows. The biases start from the words' frequencies.

Edge cases: null and wordless texts have 0 words, log-probability 0 and a null mean; null doc_ids
and rows that repeat are scored row by row; with no text to train on the start weights are used;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import textops as T
from tremor.llm.workspace import documents, stored

WINDOW, DIM, SIDE, OTHER, ROUNDS, STEP = 2, 12, 24, 128, 1, 8192
V = SIDE * SIDE  # of the least network
BORDER = 0x20


def side_of(n_words: int) -> int:
    """The square root of the number of outputs for a corpus of ``n_words`` words."""
    return max(SIDE, math.ceil(n_words**0.25))


@functools.cache
def layout(side: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the classes begin among the ``side * side`` outputs (buckets first, then words by rank), and the
    class of each output. Classes grow with the rank, as rare words ask for them less often."""
    n = -(-2 * side // 3)
    first = (side * side * np.arange(n + 1) ** 2 / n**2).astype(np.int64)
    return first, np.repeat(np.arange(n), np.diff(first))


def _shapes(side: int) -> dict[str, tuple[int, ...]]:
    """Word vectors, weights of the places, classes and outputs; these two with a bias as the last column."""
    return {"e": (side * side + 1, DIM), "c": (2 * WINDOW, DIM), "u": (len(layout(side)[0]) - 1, DIM + 1), "w": (side * side, DIM + 1)}


def initial(seed: int = 3, side: int = SIDE, mass: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights before training; with the frequencies ``mass`` of all outputs, biases that give just these."""
    rng = np.random.default_rng(seed)
    out = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in _shapes(side).items()}
    out["c"] += 1
    if mass is not None:
        first, cls = layout(side)
        total = np.add.reduceat(mass + 0.1, first[:-1])
        out["w"][:, DIM] = np.log((mass + 0.1) / total[cls])
        out["u"][:, DIM] = np.log(total / total.sum())
    return out


def flat(m: dict) -> np.ndarray:
    return np.concatenate([m[k].ravel() for k in _shapes(1)])


def unflat(x: np.ndarray, side: int = SIDE) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _shapes(side).items():
        n = int(np.prod(s))
        out[k] = x[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def buckets(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (last.astype(np.int64) * 31 + before) % OTHER


SLOTS = 17  # leading bits of a hash by which known words are found


def slots(known: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the words of each slot begin in the sorted ``known``, and the most words in a slot."""
    start = np.searchsorted(known, np.arange((1 << SLOTS) + 1, dtype=np.uint64) << T.U64(64 - SLOTS)) if len(known) else np.zeros((1 << SLOTS) + 1, np.int64)
    start[-1] = len(known)
    return start, int(np.diff(start).max())


def ids_of(u8: np.ndarray, vocabulary: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids: frequent words by rank, the others by a bucket of their last bytes; and the starts and
    ends of the others."""
    known, rank, side, (start, most) = vocabulary[:4]
    a, b = T.spans(u8, T.SPACED)
    if not len(a):
        return np.empty(0, np.int64), a, b
    h = T.hashes(u8, a, b)
    bucket = buckets(u8[b - 1], np.where(b - a > 1, u8[np.maximum(b - 2, 0)], BORDER))
    if not len(known):
        return bucket, a, b
    last = len(known) - 1
    at = np.minimum(start[(h >> T.U64(64 - SLOTS)).astype(np.int64)], last)
    for _ in range(most - 1):
        at = np.minimum(at + (known[at] < h), last)
    other = known[at] != h
    return np.where(other, bucket, OTHER + rank[at]), a[other], b[other]


def spelled(u8: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Codes of the spelling steps of words: (byte, next, next but one), and from 1 << 24 on (last, last but one)."""
    long = b - a > 1
    pairs = (1 << 24) + u8[b - 1].astype(np.int32) * 256 + np.where(long, u8[np.maximum(b - 2, 0)], BORDER)
    a, n = a[long], (b - a)[long] - 1
    t = np.concatenate([[BORDER], u8]).astype(np.int32)
    q = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
    first = np.zeros(len(q), bool)
    first[np.cumsum(n) - n] = True
    return np.concatenate([np.where(first, BORDER, t[q]) << 16 | t[q + 1] << 8 | t[q + 2], pairs]).astype(np.int32)


def spelling(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From counts of codes: symbols of bytes, log P(byte | two after it) by symbols, log P(last two | bucket)."""
    pair = codes >= 1 << 24
    x, y, z = codes[~pair] >> 16, codes[~pair] >> 8 & 255, codes[~pair] & 255
    used = np.unique(np.concatenate([x, y, z, [BORDER]]))
    k = len(used) + 1  # the last for bytes not seen
    symbol = np.full(256, k - 1)
    symbol[used] = np.arange(k - 1)
    three = np.zeros((k, k, k))
    three[symbol[x], symbol[y], symbol[z]] = n[~pair]
    two = three.sum(axis=2)
    back = (two + 1 / k) / (two.sum(axis=0) + 1)
    total = three.sum(axis=0) + 1
    three += back[:, :, None]
    three /= total
    last, before = np.divmod(np.arange(1 << 16), 256)
    share = np.where(T.SPACED[last] & (T.SPACED[before] | (before == BORDER)), 0.01, 0)
    share[codes[pair] - (1 << 24)] += n[pair]
    group = buckets(last, before)
    with np.errstate(divide="ignore"):
        ends = np.log(share / np.bincount(group, share, OTHER)[group])
    return symbol, np.log(three).astype(np.float32).ravel(), ends


def spelling_log_probability(u8: np.ndarray, a: np.ndarray, b: np.ndarray, model) -> float:
    """The sum over words of their log probability given the bucket."""
    if not len(a):
        return 0.0
    symbol, three, ends = model
    k = symbol.max() + 1
    code = spelled(u8, a, b)
    pair = code[len(code) - len(a) :] - (1 << 24)
    code = code[: len(code) - len(a)]
    steps = three[(symbol[code >> 16] * k + symbol[code >> 8 & 255]) * k + symbol[code & 255]]
    return float(steps.sum(dtype=np.float64) + ends[pair].sum())


def contexts(docs: list[np.ndarray], side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Targets and their neighbours; beyond the ends stands the id ``side * side``."""
    pad = np.full(WINDOW, side * side)
    run = np.concatenate([x for d in docs for x in (d, pad)]) if docs else np.empty(0, np.int64)
    run = np.concatenate([pad, run])
    at = np.flatnonzero(run < side * side)
    offsets = [o for o in range(-WINDOW, WINDOW + 1) if o]
    return run[at], np.stack([run[at + o] for o in offsets], 1) if len(at) else np.empty((0, 2 * WINDOW), np.int64)


def _neighbours(m: dict, x: np.ndarray) -> list[np.ndarray]:
    return [m["e"].take(x[:, j], axis=0) for j in range(2 * WINDOW)]


def _hidden(m: dict, vec: list[np.ndarray]) -> np.ndarray:
    """The squashed sums of the neighbours' vectors, with a column of ones for the bias."""
    h = np.ones((len(vec[0]), DIM + 1), np.float32)
    np.tanh(sum(v * m["c"][j] for j, v in enumerate(vec)), out=h[:, :DIM])
    return h


def _by_target(y: np.ndarray, side: int) -> np.ndarray:
    return np.argsort(y.astype(np.uint16) if side < 256 else y, kind="stable")


class _Batch:
    """Examples sorted by target: exp of the logits of the classes (``top``, a row each) and of the words of
    each row's class (``low``, a block a class), kept in the range of exp; and the sums of both by row."""

    def __init__(self, m: dict, h: np.ndarray, y: np.ndarray):
        self.first, of = layout(math.isqrt(len(m["w"])))
        self.cls = of.take(y)
        cuts = np.searchsorted(self.cls, np.arange(len(self.first)))
        sizes = np.diff(self.first)
        ends = np.cumsum(np.diff(cuts) * sizes)
        flat = np.empty(ends[-1], np.float32)
        self.blocks = []
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            a, b, lo, hi = int(cuts[c]), int(cuts[c + 1]), int(self.first[c]), int(self.first[c + 1])
            block = flat[ends[c] - (b - a) * (hi - lo) : ends[c]].reshape(b - a, hi - lo)
            np.matmul(h[a:b], m["w"][lo:hi].T, out=block)
            self.blocks.append((a, b, lo, hi, block))
        self.top = h @ m["u"].T
        for z in (self.top, flat):
            np.clip(z, -80, 80, out=z)
            np.exp(z, out=z)
        one = np.ones(max(sizes.max(), len(sizes)), np.float32)
        self.top_sum, self.low_sum = self.top @ one[: len(sizes)], np.empty(len(h), np.float32)
        for a, b, lo, hi, block in self.blocks:
            np.matmul(block, one[: hi - lo], out=self.low_sum[a:b])
        self.picked = flat[(ends - np.diff(cuts) * sizes)[self.cls] + (np.arange(len(y)) - cuts[self.cls]) * sizes[self.cls] + y - self.first[self.cls]]


def log_probabilities(m: dict, target: np.ndarray, near: np.ndarray) -> np.ndarray:
    side, out = math.isqrt(len(m["w"])), np.empty(len(target))
    for k in range(0, len(target), STEP):
        order = _by_target(target[k : k + STEP], side)
        z = _Batch(m, _hidden(m, _neighbours(m, near[k : k + STEP][order])), target[k : k + STEP][order])
        p = (z.top[np.arange(len(order)), z.cls] / z.top_sum).astype(np.float64) * (z.picked / z.low_sum)
        out[k + order] = np.log(np.maximum(p, 1e-300))
    return out


def _sums(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of the sorted ``of`` and the sum of the rows of each."""
    at = np.flatnonzero(np.diff(of, prepend=-1))
    return of[at], np.add.reduceat(h, at)


def learn(m: dict, seen: dict, target: np.ndarray, near: np.ndarray, rate: float = 0.15, step: int = 1024) -> None:
    """Adagrad over the examples, in place; ``seen`` has the squares so far. Weights without a gradient are left alone."""
    side = math.isqrt(len(m["w"]))
    by_word = np.empty_like(m["w"])

    def update(name, rows, grad):
        grad /= np.float32(n)
        root = grad * grad
        seen[name][rows] += root
        np.sqrt(seen[name][rows], out=root)
        root += np.float32(1e-6)
        grad /= root
        grad *= np.float32(rate)
        m[name][rows] -= grad

    for k in range(0, len(target), step):
        order = _by_target(target[k : k + step], side)
        y, x, n = target[k : k + step][order], near[k : k + step][order], len(order)
        vec = _neighbours(m, x)
        h = _hidden(m, vec)
        z = _Batch(m, h, y)
        top_of, low_of = 1 / z.top_sum[:, None], 1 / z.low_sum[:, None]
        back, of_low, scaled = z.top @ m["u"], np.empty_like(h), h * low_of
        by_class = z.top.T @ (h * top_of)
        by_word[:] = 0
        for a, b, lo, hi, block in z.blocks:
            np.matmul(block, m["w"][lo:hi], out=of_low[a:b])
            np.matmul(block.T, scaled[a:b], out=by_word[lo:hi])
        back *= top_of
        of_low *= low_of
        back += of_low
        back -= m["u"].take(z.cls, axis=0)
        back -= m["w"].take(y, axis=0)
        c, sums = _sums(h, z.cls)
        by_class[c] -= sums
        t, sums = _sums(h, y)
        by_word[t] -= sums
        update("u", slice(None), by_class)
        update("w", slice(None), by_word)
        back = back[:, :DIM] * (1 - h[:, :DIM] ** 2)
        update("c", slice(None), np.stack([np.einsum("nd,nd->d", back, v) for v in vec]))
        flat_x = x.T.ravel()
        by = _by_target(flat_x, side)
        grads = np.concatenate([back * w for w in m["c"]]).take(by, axis=0)
        update("e", *_sums(grads, flat_x.take(by)))


def _counted(batches):
    """Each task's word counts, in runs of bounded size."""
    held, size = [], 0

    def out():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], names=["word", "n"])

    for batch in batches:
        for u8 in T.texts(batch):
            held.append(T.words(T.LOWER[u8], T.SPACED))
            size += len(held[-1])
            if size > 4_000_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def vocabulary(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, tuple, np.ndarray]:
    """The most frequent words of all documents, as sorted hashes and their ranks, the side of the network, the
    slots, and the frequency of every output; the buckets share that of all other words evenly."""
    counts = docs.select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    side = side_of(total)
    top = [tuple(r) for r in counts.orderBy(F.desc("n"), "word").limit(side * side - OTHER).collect()]
    known = np.array([w for w, _ in top], np.int64).view(np.uint64)
    order = np.argsort(known)
    mass = np.zeros(side * side)
    mass[OTHER : OTHER + len(top)] = [n for _, n in top]
    mass[:OTHER] = (total - mass.sum()) / OTHER
    return known[order], order, side, slots(known[order]), mass


def _groups(batches, words, of_others, most: int = 200_000):
    """Documents with their ids and what ``of_others`` makes of the words without one, in groups of bounded size."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        group, keys, others, size = [], [], [], 0
        for name, u8 in zip(names, T.texts(batch), strict=True):
            low = T.LOWER[u8]
            ids, a, b = ids_of(low, words)
            group.append(ids)
            keys.append(name)
            others.append(of_others(low, a, b))
            size += len(ids)
            if size > most:
                yield keys, group, others
                group, keys, others, size = [], [], [], 0
        if keys:
            yield keys, group, others


_TRAINED = "n double, weights binary, codes array<int>, counts array<long>"


def _trained(shared, words):
    def run(batches):
        side = words.value[2]
        m = unflat(shared.value, side)
        seen, n = {k: np.zeros_like(v) for k, v in m.items()}, 0
        codes, counts = np.empty(0, np.int32), np.empty(0, np.int64)
        for _, group, others in _groups(batches, words.value, spelled):
            y, x = contexts(group, side)
            learn(m, seen, y, x, step=4096)
            n += len(y)
            new, times = np.unique(np.concatenate(others), return_counts=True)
            codes, back = np.unique(np.concatenate([codes, new]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, times]), len(codes)).astype(np.int64)
        if n:
            lists = [pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array(v)) for v in (codes, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([flat(m).tobytes()], pa.binary()), *lists], names=["n", "weights", "codes", "counts"])

    return run


def _summed(batches):
    n, total = 0.0, None
    for batch in batches:
        for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, total = n + k, k * np.frombuffer(w, np.float32).astype(np.float64) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])


def train(docs: DataFrame, words) -> tuple[np.ndarray, tuple]:
    """The weights, and the spelling of words out of the vocabulary."""
    spark = docs.sparkSession
    weights, spell = flat(initial(side=words.value[2], mass=words.value[4])), None
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)
        each = docs.select("doc_id", "text").mapInArrow(_trained(shared, words), _TRAINED)
        each = stored(each, "weights")
        few = max(1, int(each.count() ** 0.5))
        sums = sorted((r[0], bytes(r[1])) for r in each.select("n", "weights").repartition(few).mapInArrow(_summed, "n double, weights binary").collect())
        if sums:
            weights = (sum(np.frombuffer(w) for _, w in sums) / sum(n for n, _ in sums)).astype(np.float32)
        if spell is None:  # the same in all rounds
            codes = each.select(F.explode(F.arrays_zip("codes", "counts")).alias("c")).groupBy("c.codes").agg(F.sum("c.counts").alias("n")).toArrow()
            spell = spelling(codes["codes"].to_numpy().astype(np.int64), codes["n"].to_numpy().astype(np.float64))
    return weights, spell


def _scored(shared, words):
    def run(batches):
        weights, spell = shared.value
        side = words.value[2]
        m = unflat(weights, side)
        for keys, group, others in _groups(batches, words.value, lambda u8, a, b: spelling_log_probability(u8, a, b, spell)):
            lp = log_probabilities(m, *contexts(group, side))
            n = np.array([len(g) for g in group])
            total = np.concatenate([[0], np.cumsum(lp)])[np.concatenate([[0], np.cumsum(n)])]
            sums = np.diff(total) + np.array(others)
            mean = [s / k if k else None for s, k in zip(sums.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(sums), pa.array(mean, pa.float64())], names=["doc_id", "n_words", "log_prob", "mean_log_prob"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_prob, mean_log_prob) of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = spark.sparkContext.broadcast(vocabulary(docs))
    shared = spark.sparkContext.broadcast(train(docs, words))
    return docs.mapInArrow(_scored(shared, words), "doc_id long, n_words long, log_prob double, mean_log_prob double")


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    out = score(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", F.round("log_prob", 4).alias("log_prob"), F.round("mean_log_prob", 6).alias("mean_log_prob"))
