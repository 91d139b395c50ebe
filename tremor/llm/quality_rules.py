"""Quality rules as weak supervision (operator 9).

Rules vote good (1) or bad (0) on a text or abstain (-1). Votes of all texts that pass the base rules
are counted by pattern (at most 3 ** len(RULES) rows, whatever the input); expectation-maximisation on
these counts estimates how each rule votes on good and on bad texts, with no labels; a text is kept if
its posterior probability of being good is at least one half and the base rules do not fail it. One bad
vote does not drop a text by itself, nor do good votes alone keep it.

Edge cases: null, empty and blank texts have no words, fail the base rules and are not kept; rows
that repeat and null doc_ids are judged row by row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm import textops as T
from tremor.llm.workspace import documents, stored

_SYMBOL, _UPPER, _LOWERCASE = T._lut(b"#*$%&|<>", True), T._lut(bytes(range(65, 91)), True), T._lut(bytes(range(97, 123)), True)
_STOP, _BANG, _LINE = T._lut(b".?", True), T._lut(b"!", True), T._lut(b"\n", False)
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_stops", "n_bangs"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES)


def statistics(u8: np.ndarray) -> list[int]:
    """The counts of ``NAMES`` for one text."""
    starts, ends = T.spans(u8, T.SPACED)
    n = len(starts)
    if not n:
        return [0, 0, int(np.count_nonzero(_SYMBOL[u8])), *[0] * (len(NAMES) - 3)]
    word = T.hashes(u8, starts, ends)
    lead = (u8 & 0xC0) != 0x80
    chars = np.count_nonzero(lead & T.SPACED[u8])
    a, b = T.spans(u8, _LINE)
    before = np.searchsorted(starts, b) - np.searchsorted(starts, a)
    a, b = a[before > 0], b[before > 0]
    lines = T.hashes(u8, a, b)
    tri = T.windows(word, 3)
    repeated = 0
    if len(tri):
        _, back, times = np.unique(tri, return_inverse=True, return_counts=True)
        hot = np.flatnonzero(times[back] > 1)
        mark = np.zeros(n, bool)
        for k in range(3):
            mark[hot + k] = True
        repeated = int(mark.sum())
    many = lambda lut: int(np.count_nonzero(lut[u8]))
    return [n, int(chars), many(_SYMBOL), len(lines) - len(np.unique(lines)), repeated, len(lines), len(np.unique(word)), many(_UPPER), many(_LOWERCASE), many(_STOP), many(_BANG)]


def _counted(batches):
    for batch in batches:
        rows = np.array([statistics(u8) for u8 in T.texts(batch)], np.int64).reshape(-1, len(NAMES))
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(rows[:, k]) for k in range(len(NAMES)))], names=["doc_id", *NAMES])


def counted(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_counted, STATS_SCHEMA)


#: Rule: (bad if, good if); it abstains between the two. The bounds are loose on purpose: each rule
#: also faults good texts, and how far it is to be believed is for the estimate to say.
RULES = {
    "length": ("n_words < 80", "n_words >= 120"),
    "word_length": ("word_chars < 4 * n_words or word_chars > 7 * n_words", "word_chars >= 4.5 * n_words and word_chars <= 6 * n_words"),
    "symbols": ("n_symbols > 0.01 * n_words", "n_symbols <= 0.002 * n_words"),
    "lines": ("n_dup_lines > 0.1 * n_lines", "n_lines > 1 and n_dup_lines <= 0.02 * n_lines"),
    "repeats": ("n_repeat_words > 0.02 * n_words", "n_repeat_words <= 0.005 * n_words"),
    "variety": ("n_distinct < power(n_words, 0.9)", "n_distinct >= 1.4 * power(n_words, 0.9)"),
    "upper": ("n_upper > 0.03 * (n_upper + n_lower)", "n_upper <= 0.025 * (n_upper + n_lower)"),
    "bangs": ("n_bangs > 0.01 * n_words", "n_bangs <= 0.002 * n_words"),
    "stops": ("n_stops < 0.05 * n_words or n_stops > 0.15 * n_words", "n_stops >= 0.06 * n_words and n_stops <= 0.13 * n_words"),
}
START = ((0.3, 0.1, 0.6), (0.3, 0.4, 0.3))  # chances that a rule abstains, votes bad, votes good: on good texts, on bad ones
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def vote(rule: str) -> Column:
    bad, good = RULES[rule]
    return F.when(F.expr(bad), 0).when(F.expr(good), 1).otherwise(-1)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict]]:
    """EM on (votes, count): the log odds of good, and for each rule the log likelihood ratio of
    each vote, abstention included. Nothing but the data sets them: counts are smoothed by two texts a
    class (so empty input leaves the start values), and of the two classes, good is the one whose texts
    get more good votes and fewer bad ones in sum."""
    k = len(RULES)
    v = np.array([p for p, _ in patterns], int).reshape(-1, k) + 1  # 0 abstains, 1 bad, 2 good
    n = np.array([c for _, c in patterns], float)
    start = np.array(START)
    like, prior = np.array([start] * k), 0.8
    for _ in range(rounds):
        score = math.log(prior / (1 - prior)) + sum(np.log(like[j, 0, v[:, j]] / like[j, 1, v[:, j]]) for j in range(k))
        post = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        for j in range(k):
            for c, w in ((0, post * n), (1, (1 - post) * n)):
                got = np.bincount(v[:, j], w, 3) + 2 * start[c]
                like[j, c] = got / got.sum()
        prior = ((post * n).sum() + 4) / (n.sum() + 5)
    if (like[:, 0, 2] - like[:, 0, 1]).sum() < (like[:, 1, 2] - like[:, 1, 1]).sum():
        like, prior = like[:, ::-1], 1 - prior
    ratio = np.log(like[:, 0] / like[:, 1])
    return math.log(prior / (1 - prior)), [{x - 1: float(ratio[j, x]) for x in range(3)} for j in range(k)]


def judged(stats: DataFrame) -> DataFrame:
    """``stats`` with p_good, base_failed and kept; ``stats`` should be a stored table. Reliabilities are
    estimated on the texts that the base rules leave to the method."""
    failed = F.expr(BASE_FAILED)
    votes = stats.where(~failed).select(*(vote(r).alias(r) for r in RULES)).groupBy(*RULES).count()
    odds, ratios = estimate(sorted((tuple(r)[:-1], r["count"]) for r in votes.collect()))
    total = F.lit(odds)
    for rule, ratio in zip(RULES, ratios, strict=True):
        bad, good = RULES[rule]
        total = total + F.when(F.expr(bad), ratio[0]).when(F.expr(good), ratio[1]).otherwise(ratio[-1])
    p = 1 / (1 + F.exp(-total))
    return stats.withColumns({"p_good": p, "base_failed": failed, "kept": ~failed & (p >= 0.5)})


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(stored(counted(documents(spark, sf_dir)), "stats"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
