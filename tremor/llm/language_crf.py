"""Language of code-switched text by a linear-chain conditional random field (operator 3).

Every word of a text is labelled with a language. Emission features of a word: its identity
(lexicon), prefixes and suffixes of one to four bytes, and the 2- and 3-grams of its bytes with
word borders, hashed into ``2 ** BITS`` weights a label; transitions between neighbours are
learned too. Forward-backward gives each word's marginals; the text's language is the label with
the largest sum, the score its share. Long texts are cut into blocks whose transfer matrices are
multiplied, which is exact and needs few numpy steps.

Training takes at most ``TRAIN_ROWS`` labelled texts (smallest hash of the id); they are strung
together in random order, so that the transitions see switches.

Edge cases: null texts and texts without a letter are ``und`` with score 0; a null lang is not
learned from; with nothing to learn from all are ``und``; a null doc_id is not held out and
never learned from; rows that repeat are labelled one by one, and the least of them is learned from; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import textops as T
from tremor.llm.workspace import documents

TRAIN_ROWS, BITS, BLOCK, STEPS, STRING, GROUP = 600, 16, 64, 25, 4, 300_000
_LETTER = T._lut(bytes([*range(97, 123), *range(0x80, 0x100)]), True)
_ASCII = T._lut(bytes(range(97, 123)), True)


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    return (T.mix(code.astype(np.uint64) + T.U64(kind << 40)) >> T.U64(64 - BITS)).astype(np.int64)


def word_features(u8: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of the words, word after word, and how many each has."""
    n = ends - starts
    at = np.concatenate([[0], np.cumsum(n + 2)])  # each word stands between two border bytes
    b = np.empty(at[-1], np.int64)
    b[at[:-1]], b[at[1:] - 1] = 2, 3
    inner = np.arange(n.sum()) + np.repeat(2 * np.arange(len(n)) + 1, n)
    b[inner] = u8[np.arange(n.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)])[:-1], n)]
    pad = np.concatenate([b, [0, 0, 0, 0]])
    owner = np.repeat(np.arange(len(n)), n + 2)
    place = np.arange(len(b)) - at[owner]
    two, three = place < n[owner] + 1, place < n[owner]
    p = np.arange(len(b))
    parts = [(owner[two], _bucket(pad[p[two]] << 8 | pad[p[two] + 1], 1)), (owner[three], _bucket(pad[p[three]] << 16 | pad[p[three] + 1] << 8 | pad[p[three] + 2], 2))]
    every = np.arange(len(n))
    head, tail = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for k in range(1, 5):
        head = head << 8 | np.where(k <= n, pad[at[:-1] + k], 0)
        tail = tail << 8 | np.where(k <= n, pad[np.maximum(at[1:] - 1 - k, 0)], 0)
        parts += [(every, _bucket(head, 2 + k)), (every, _bucket(tail, 8 + k))]
    parts.append((every, _bucket(hashed >> T.U64(24), 20)))
    own = np.concatenate([x[0] for x in parts])
    order = np.argsort(own, kind="stable")
    return np.concatenate([x[1] for x in parts])[order], 2 * n + 1 + 9


class Lattice:
    """Texts as one run of words, cut into blocks that are worked on side by side."""

    def __init__(self, lengths: np.ndarray):
        lengths = lengths[lengths > 0]
        blocks = -(-lengths // BLOCK)
        self.first = np.repeat(np.cumsum(lengths) - lengths, blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        self.size = np.minimum(BLOCK, np.repeat(np.cumsum(lengths), blocks) - self.first)
        self.order = np.argsort(-self.size, kind="stable")
        self.first, self.len = self.first[self.order], self.size[self.order]
        back = np.empty(len(self.order), np.int64)
        back[self.order] = np.arange(len(self.order))
        self.head = np.cumsum(blocks) - blocks
        self.rank = np.argsort(-blocks, kind="stable")
        self.blocks, self.back, self.head = blocks[self.rank], back, self.head[self.rank]
        self.active = [int(np.searchsorted(-self.len, -j, side="left")) for j in range(BLOCK)]
        self.deep = [int(np.searchsorted(-self.blocks, -j, side="left")) for j in range(int(blocks.max()) if len(blocks) else 0)]

    def marginals(self, psi: np.ndarray, a: np.ndarray):
        """alpha, beta and their normalised product, for positive ``psi`` (words, labels) and ``a``."""
        nb, k = len(self.first), a.shape[0]
        m = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
        for j in range(BLOCK):
            if not (n := self.active[j]):
                break
            x = (m[:n] @ a) * psi[self.first[:n] + j][:, None, :]
            m[:n] = x / x.max(axis=(1, 2), keepdims=True)
        enter, leave = np.empty((nb, k)), np.empty((nb, k))
        v = np.full((len(self.blocks), k), 1 / k)
        for j, n in enumerate(self.deep):
            at = self.back[self.head[:n] + j]
            enter[at] = v[:n]
            x = np.einsum("ni,nij->nj", v[:n], m[at])
            v[:n] = x / x.sum(axis=1, keepdims=True)
        v = np.ones((len(self.blocks), k))
        for j in range(len(self.deep) - 1, -1, -1):
            n = self.deep[j]
            at = self.back[self.head[:n] + j]
            leave[at] = v[:n]
            x = np.einsum("nij,nj->ni", m[at], v[:n])
            v[:n] = x / x.sum(axis=1, keepdims=True)
        alpha, beta = np.empty_like(psi), np.empty_like(psi)
        v = enter
        for j in range(BLOCK):
            if not (n := self.active[j]):
                break
            at = self.first[:n] + j
            x = (v[:n] @ a) * psi[at]
            v[:n] = alpha[at] = x / x.sum(axis=1, keepdims=True)
        v = leave
        for j in range(BLOCK - 1, -1, -1):
            if not (n := self.active[j]):
                continue
            at = self.first[:n] + j
            beta[at] = v[:n]
            x = (v[:n] * psi[at]) @ a.T
            v[:n] = x / x.sum(axis=1, keepdims=True)
        p = alpha * beta
        return alpha, beta, p / p.sum(axis=1, keepdims=True)


def _words(texts):
    """Bytes, word spans, hashes and the number of words of each text."""
    data, spans, hashes = [], [], []
    base = 0
    for u8 in texts:
        a, b = T.spans(u8, _LETTER)
        hashes.append(T.hashes(u8, a, b))
        spans.append((a + base, b + base))
        data.append(u8)
        base += len(u8)
    cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return cat(data, np.uint8), cat([s[0] for s in spans], np.int64), cat([s[1] for s in spans], np.int64), cat(hashes, np.uint64), np.array([len(h) for h in hashes], np.int64)


def _emissions(w: np.ndarray, u8, starts, ends, hashes):
    uniq, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    ids, many = word_features(u8, starts[first], ends[first], uniq)
    score = np.add.reduceat(w[ids], np.cumsum(many) - many, axis=0) if len(ids) else np.empty((0, w.shape[1]))
    return ids, many, back, score


def train(texts: list[str], langs: list[str], seed: int = 5) -> dict:
    """Adam on the log likelihood of the label sequences."""
    labels = sorted(set(langs))
    k = len(labels)
    w, trans = np.zeros((1 << BITS, k)), np.zeros((k, k))
    if not labels:
        return {"labels": [], "w": w, "trans": trans}
    order = np.random.default_rng(seed).permutation(len(texts))
    lower = pc.utf8_lower(pa.array(texts, pa.string())).to_pylist()  # as texts are scored
    u8, starts, ends, hashes, n = _words([np.frombuffer(lower[i].encode(), np.uint8) for i in order])
    y = np.repeat(np.array([labels.index(langs[i]) for i in order]), n)
    lengths = np.array([x.sum() for x in np.array_split(n, max(1, len(n) // STRING))])
    lattice = Lattice(lengths)
    starts_at = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[starts_at[starts_at < len(y)]] = False
    t = np.flatnonzero(inner)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[t - 1], y[t]), 1)
    ids, many, back, _ = _emissions(w, u8, starts, ends, hashes)
    if not len(y):
        return {"labels": labels, "w": w, "trans": trans}
    m, s = [np.zeros_like(w), np.zeros_like(trans)], [np.zeros_like(w), np.zeros_like(trans)]
    for step in range(1, STEPS + 1):
        e = np.add.reduceat(w[ids], np.cumsum(many) - many, axis=0)[back]
        psi, a = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-12, np.exp(trans - trans.max())
        alpha, beta, p = lattice.marginals(psi, a)
        gap = -p
        gap[np.arange(len(y)), y] += 1
        by_word = np.stack([np.bincount(back, gap[:, c], len(many)) for c in range(k)], 1)
        by_feature = np.stack([np.bincount(ids, np.repeat(by_word[:, c], many), len(w)) for c in range(k)], 1)
        pair = alpha[t - 1][:, :, None] * a * (psi[t] * beta[t])[:, None, :]
        expected = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        for i, (param, g) in enumerate(((w, by_feature / len(y) - 1e-6 * w), (trans, (seen - expected) / len(y) - 1e-4 * trans))):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.99 * s[i] + 0.01 * g * g
            param += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-8)
    return {"labels": labels, "w": w.astype(np.float32), "trans": trans}


def label_words(model: dict, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The marginals of every word of the lower-cased texts (UTF-8 bytes), and words a text."""
    u8, starts, ends, hashes, n = _words(texts)
    if not len(starts) or not model["labels"]:
        return np.empty((0, len(model["labels"]))), n
    _, _, back, score = _emissions(model["w"], u8, starts, ends, hashes)
    e = score.astype(np.float64)
    psi = np.exp(e - e.max(axis=1, keepdims=True))[back] + 1e-12
    return Lattice(n).marginals(psi, np.exp(model["trans"] - model["trans"].max()))[2], n


def _has_letter(u8: np.ndarray) -> bool:
    return bool(_ASCII[u8].any()) or any(c.isalpha() for c in u8.tobytes().decode())


def languages(model: dict, texts: list[np.ndarray]) -> list[tuple[str, float]]:
    """(language, score) of lower-cased texts."""
    p, n = label_words(model, texts)
    out, at = [], 0
    for u8, k in zip(texts, n.tolist(), strict=True):
        if not k or not model["labels"] or not _has_letter(u8):
            out.append(("und", 0.0))
        else:
            share = p[at : at + k].mean(axis=0)
            out.append((model["labels"][int(share.argmax())], float(min(1.0, share.max()))))
        at += k if model["labels"] else 0
    return out


def _labelled(model):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            lower = pc.utf8_lower(pc.fill_null(batch.column(at), ""))
            batch = batch.set_column(at, "text", lower)
            found, group, size = [], [], 0
            for u8 in T.texts(batch):
                group.append(u8)
                size += len(u8)
                if size >= GROUP * 6:
                    found += languages(model.value, group)
                    group, size = [], 0
            found += languages(model.value, group)
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def fit(docs: DataFrame) -> dict:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    known = docs.where("text is not null and lang is not null").where(~held)
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # ids first: no task sends its texts
    chosen = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.lang", "r.text").toPandas()
    chosen = chosen.sort_values("doc_id", kind="stable")
    return train(chosen["text"].tolist(), chosen["lang"].tolist())


def detect(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_labelled(shared), "doc_id long, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = detect(docs, fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
