"""Sequence packing as vector bin packing with the dot-product heuristic (operator 6).

An example is placed under three limits at once: tokens, segments and loss-bearing tokens of a
sequence. The ids of its prompt bear no loss, all others do; what the prompt is, the caller says (in op6 it is
the first quarter of a text, and at most ``LOSS`` of the 2048 ids bear loss). Each task packs its own documents: it keeps a pool of at most ``POOL`` examples and
fills one sequence at a time with the example that fits and has the largest dot product
of its demand and the sequence's free room, both as shares of the limits. Room that nothing fits is
filled by cutting the example whose beginning has the largest dot product, and its rest goes back to the pool. A sequence that stays short
(few segments left, or the end of the task) is trimmed to a power of two, so nothing is padded.

Edge cases: a null or empty text is its closing id alone; texts over the limit are cut into
several pieces; rows that repeat and null doc_ids are packed row by row; an empty table gives no
pieces; extra columns are ignored. Sequence ids are unique: partition in the high bits, then a
counter; a task that runs again gives the same pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm import textops as T
from tremor.llm.workspace import documents

TOKENS, SEGMENTS, LOSS, POOL, CACHE, GROUP = 2048, 256, 1664, 256, 1_500_000, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CLASS = np.full(256, 3, np.uint8)
_CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[128:] = 1  # in words that are cut, letters of U+00C0 to U+017F only
_ODD = np.zeros(256, bool)
_ODD[0xC0:] = True
_ODD[0xC3:0xC6] = False
_ODD[0x27] = True


class Encoder:
    """Ids of whole texts, word by word with a cache. The tokenizer drops white space and never
    joins across it, so the ids of a text are those of its parts; words of ASCII and Latin letters
    up to U+017F are cut further where the tokenizer cuts, between letters, digits and signs, unless
    an apostrophe or a special token is near. New parts go to the tokenizer in long strings."""

    def __init__(self, path: str, end: int = 1):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.first, self.many, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def _units(self, u8: np.ndarray):
        starts, ends = T.spans(u8, T.SPACED)
        odd = _ODD[u8]
        odd[:-1] |= (u8[:-1] == 0x3C) & (u8[1:] == 0x7C) | (u8[:-1] == 0xC3) & ((u8[1:] == 0x97) | (u8[1:] == 0xB7)) | (u8[:-1] == 0xC4) & (u8[1:] == 0xB0)
        seen = np.concatenate([[0], np.cumsum(odd)])
        whole = seen[ends] > seen[starts]
        low, size = T.LOWER[u8], ends - starts
        owner = np.repeat(np.arange(len(starts)), size)
        place = np.arange(len(owner)) + np.repeat(starts - np.concatenate([[0], np.cumsum(size)])[:-1], size)
        raw = place[whole[owner]]
        low[raw] = u8[raw]
        kind = _CLASS[low[place]]
        cut = np.ones(len(place), bool)
        cut[1:] = (owner[1:] != owner[:-1]) | ~whole[owner[1:]] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
        at = np.flatnonzero(cut)
        first = place[at]
        last = place[np.append(at[1:], len(place)) - 1] + 1 if len(at) else first
        return low, first, last, whole[owner[at]]

    def _fresh(self, units: list[bytes], whole: np.ndarray):
        """Ids of new units, one after the other, how many each has, and their order."""
        plain = np.flatnonzero(~whole)
        ids, many = [np.empty(0, np.uint32)], np.zeros(len(units), np.int64)
        order = []
        alone = [np.flatnonzero(whole)]
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            got = np.array(self.tokenizer.encode_batch_fast([b" ".join(units[i] for i in part).decode()], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.closes[got]) + 1
            if len(stops) != len(part):  # a unit that is not one word of the tokenizer: one by one
                alone.append(part)
                continue
            ids.append(got)
            many[part] = np.diff(stops, prepend=0)
            order.append(part)
        rest = np.concatenate(alone)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([units[i].decode() for i in rest], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, np.uint32))
            many[i] = len(ids[-1])
        order.append(rest)
        return np.concatenate(ids), many, np.concatenate(order)

    def encode(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each text, with the closing id."""
        return [ids for ids, _ in self.marked(texts, [0] * len(texts))]

    def marked(self, texts: list[np.ndarray], prompts: list[int]) -> list[tuple[np.ndarray, int]]:
        """The ids of each text, with the closing id, and how many of them are of words that begin in its first ``prompt`` bytes."""
        gap = np.array([32], np.uint8)
        u8 = np.concatenate([x for t in texts for x in (t, gap)]) if texts else np.empty(0, np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        heads = np.array([e - len(t) - 1 + min(p, len(t)) for e, t, p in zip(ends.tolist(), texts, prompts, strict=True)], np.int64)
        low, a, b, whole = self._units(u8)
        uniq, first, back = np.unique(T.hashes(low, a, b), return_index=True, return_inverse=True)
        if len(self.known) > CACHE:
            self.clear()
        at = np.minimum(np.searchsorted(self.known, uniq), max(len(self.known) - 1, 0))
        new = self.known[at] != uniq if len(self.known) else np.ones(len(uniq), bool)
        if new.any():
            raw = low.tobytes()
            at = first[new]
            got, many, turn = self._fresh([raw[i:j] for i, j in zip(a[at].tolist(), b[at].tolist(), strict=True)], whole[at])
            base = np.empty(len(many), np.int64)
            base[turn] = len(self.ids) + np.cumsum(many[turn]) - many[turn]
            self.ids = np.concatenate([self.ids, got])
            order = np.argsort(np.concatenate([self.known, uniq[new]]), kind="stable")
            self.known, self.first, self.many = (np.concatenate(x)[order] for x in ((self.known, uniq[new]), (self.first, base), (self.many, many)))
            at = np.searchsorted(self.known, uniq)
        begin, many = self.first[at][back], self.many[at][back]
        total = np.concatenate([[0], np.cumsum(many)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], many)]
        stop, head = total[np.searchsorted(a, ends)], total[np.searchsorted(a, heads)]
        out, k = [], 0
        for s, p in zip(stop.tolist(), head.tolist(), strict=True):
            out.append((np.append(flat[k:s], np.uint32(self.end)), p - k))
            k = s
        return out


class Packer:
    """Places examples; every call yields closed sequences as lists of (key, start, length)."""

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL):
        self.limit = np.array([tokens, segments, loss or tokens], float)
        self.pool, self.size = pool, 0
        self.keys: list = [None] * (2 * pool)
        self.cum: list = [None] * (2 * pool)  # loss-bearing tokens before each position, or None: all are
        self.start, self.stop = np.zeros(2 * pool, np.int64), np.zeros(2 * pool, np.int64)
        self.need = np.zeros((2 * pool, 3))
        self.free = np.zeros(2 * pool)  # leading ids without loss

    def _loss(self, i: int, a: int, b: int) -> int:
        return b - a if self.cum[i] is None else int(self.cum[i][b] - self.cum[i][a])

    def _put(self, key, a: int, b: int, cum) -> None:
        i = self.size
        self.keys[i], self.cum[i], self.start[i], self.stop[i] = key, cum, a, b
        self.need[i] = b - a, 1, self._loss(i, a, b)
        self.free[i] = 0 if cum is None else min(b, int(np.searchsorted(cum, cum[a], side="right")) - 1) - a
        self.size += 1

    def _drop(self, i: int) -> None:
        self.size = k = self.size - 1
        self.keys[i], self.cum[i], self.start[i], self.stop[i] = self.keys[k], self.cum[k], self.start[k], self.stop[k]
        self.need[i], self.free[i] = self.need[k], self.free[k]
        self.keys[k] = self.cum[k] = None

    def _reach(self, i: int, room: np.ndarray) -> int:
        """The end of the longest beginning of example i that fits."""
        a = int(self.start[i])
        b = min(int(self.stop[i]), a + int(room[0]))
        if self.cum[i] is not None:
            b = min(b, int(np.searchsorted(self.cum[i], self.cum[i][a] + int(room[2]), side="right")) - 1)
        elif b - a > room[2]:
            b = a + int(room[2])
        return b

    def _fill(self) -> list[tuple]:
        room, out = self.limit.copy(), []
        while self.size and room[0] >= 1 and room[1] >= 1:
            need = self.need[: self.size]
            fits = (need <= room).all(axis=1)
            if room[1] == 1:  # the last segment should fill the rest
                fits &= need[:, 0] >= room[0]
            if fits.any():
                score = np.where(fits, need @ (room / self.limit**2), -1)
                i = int(score.argmax())
                b = int(self.stop[i])
            else:
                free = self.free[: self.size]
                reach = np.minimum(need[:, 0], np.minimum(room[0], free + room[2]))
                i = int((reach * (room[0] / self.limit[0] ** 2) + np.maximum(reach - free, 0) * (room[2] / self.limit[2] ** 2)).argmax())
                b = self._reach(i, room)
                if b <= self.start[i]:
                    break
            a = int(self.start[i])
            out.append((self.keys[i], a, b - a, self.cum[i], self._loss(i, a, b)))
            room -= (b - a, 1, self._loss(i, a, b))
            key, stop, cum = self.keys[i], int(self.stop[i]), self.cum[i]
            self._drop(i)
            if b < stop:
                self._put(key, b, stop, cum)
        used = int(self.limit[0] - room[0])
        extra = used - (1 << used.bit_length() - 1) if used and used < self.limit[0] else 0
        while extra:  # trim to a power of two; what is cut off waits in the pool
            key, a, n, cum, _ = out.pop()
            cut = min(n, extra)
            extra -= cut
            self._put(key, a + n - cut, a + n, cum)
            if n > cut:
                out.append((key, a, n - cut, cum, 0))
        return [x[:3] for x in out]

    def add(self, key, n: int, cum: np.ndarray | None = None) -> Iterator[list[tuple]]:
        if n:
            self._put(key, 0, n, cum)
        while self.size >= self.pool:
            yield self._fill()

    def finish(self) -> Iterator[list[tuple]]:
        while self.size:
            yield self._fill()


_ENCODERS: dict[str, Encoder] = {}


def _packed(path: str, limits: tuple):
    def run(batches):
        encoder = _ENCODERS.setdefault(path, Encoder(path) if path not in _ENCODERS else None)
        packer, held = Packer(*limits), {}
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 32
        rows: list[tuple] = []
        left: dict[int, int] = {}
        serial = 0

        def note(done):
            nonlocal sequence
            for pieces in done:
                offset = 0
                for key, start, n in pieces:
                    doc, ids = held[key]
                    rows.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), sequence, offset))
                    offset += n
                    left[key] -= n
                    if not left[key]:
                        del held[key], left[key]
                sequence += 1

        def flush():
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

        def place(names, texts, prompts):
            nonlocal serial
            for doc, (ids, head) in zip(names, encoder.marked(texts, prompts), strict=True):
                held[serial], left[serial] = (doc, ids), len(ids)
                note(packer.add(serial, len(ids), np.maximum(np.arange(len(ids) + 1) - head, 0) if head else None))
                serial += 1

        for batch in batches:
            names, group, heads, size = [], [], [], 0
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "prompt"))
            for doc, head, u8 in zip(*columns, T.texts(batch), strict=True):
                names.append(doc)
                group.append(u8)
                heads.append(head or 0)
                size += len(u8) + 1
                if size >= GROUP:
                    place(names, group, heads)
                    names, group, heads, size = [], [], [], 0
            place(names, group, heads)
            yield flush()
        note(packer.finish())
        yield flush()

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def first_quarter(text: Column) -> Column:
    """Bytes of the first quarter of a text: the stand-in for a prompt where documents have no roles."""
    return F.floor(F.octet_length(text) / 4)


def pack(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int | None = None, prompt: Column | None = None) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``, at most ``tokens`` ids, ``segments`` pieces and ``loss`` loss-bearing
    ids a sequence. Words that begin in the first ``prompt`` bytes of a text (a column of ``docs``; null is 0)
    bear no loss; without ``prompt`` all do. One scan, no shuffle."""
    head = F.lit(0) if prompt is None else prompt
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", head.cast("long").alias("prompt"))
    return rows.mapInArrow(_packed(path or default_tokenizer(), (tokens, segments, loss)), SCHEMA)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), loss=LOSS, prompt=first_quarter(F.col("text")))
