"""Lexical search, ball k-means and byte-level BPE against plain versions."""

import base64
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import DATA, same
from pyspark.sql import functions as F

from tremor.llm import ball_kmeans, byte_bpe, lexical_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def ranked(docs, items, k=10):
    """The contract, word for word."""
    words = [(i, WORD.findall(lowered(t))) for i, t in docs]
    held = [w for _, w in words if w]
    n, total = len(held), sum(map(len, held))
    terms = {}
    for item, text in items:
        terms.setdefault(item, set()).update(WORD.findall(lowered(text)))
    out = []
    for item, wanted in terms.items():
        df = {t: sum(t in set(w) for w in held) for t in wanted}
        scores = []
        for i, w in words:
            m = 10 + 90 * len(w) * n // total if w else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in wanted if t in w)
            scores += [(-s, i is None, i)] if s > 0 else []
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [1, 300, 4_000_000])
def test_search_is_the_contract_in_shards_of_any_size(spark, odd, odd_rows, size):
    items = [(1, "house light7 RIVER"), (2, "one two"), (3, None), (4, "nowhere"), (5, "日本語 ñandú license the"), (2, "nine house"), (None, "green sound3 of"), (6, "!!")]
    queries = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    index, n = lexical_search.build(odd, size)
    got = lexical_search.search(index, n, queries).collect()
    assert sorted(map(tuple, got), key=repr) == ranked([r[:2] for r in odd_rows], items)


def test_search_of_nothing(spark, none, odd):
    queries = spark.createDataFrame([("a", "the house")], "item_id string, text string")
    assert lexical_search.search(*lexical_search.build(none), queries).count() == 0
    assert lexical_search.search(*lexical_search.build(odd), queries.where("false")).count() == 0


def test_a_bound_is_never_below_its_documents_and_ties_come_by_number():
    r = random.Random(3)
    docs = [np.array([r.randrange(12) for _ in range(r.randrange(1, 20))], np.uint64) for _ in range(90)] + [np.array([3, 3, 5], np.uint64)] * 40
    ids = r.sample(range(1000), len(docs))
    shard = lexical_search.Shard(lexical_search.shard_of(ids, docs, len(docs), sum(map(len, docs))).to_pylist()[0])
    terms, weights = np.array([3, 5, 99, 7], np.uint64), np.array([900, 700, 5000, 1])
    everything = shard.top([(terms, weights)], 10_000, [(0, 0)])[0]
    assert everything == sorted(everything, key=lambda x: (-x[0], x[1])) and {i for _, i in everything} == {i for i, d in zip(ids, docs, strict=True) if set(d.tolist()) & {3, 5, 7}}
    for k in (1, 10, 35):
        assert shard.top([(terms, weights)] * 2, k, [(0, 0), everything[4]]) == [everything[:k], everything[:4][:k]]


def test_a_shard_in_memory_is_a_third_of_all_ranks_and_impacts():
    r = np.random.default_rng(4)
    docs = [r.integers(0, 400, 60).astype(np.uint64) for _ in range(3000)]
    shard = lexical_search.Shard(lexical_search.shard_of(list(range(len(docs))), docs, len(docs), sum(map(len, docs))).to_pylist()[0])
    held = sum(a.nbytes for a in vars(shard).values() if isinstance(a, np.ndarray))
    assert held < 0.45 * 4 * shard.n * (2 * shard.height + 1)
    one = np.concatenate([[0], np.cumsum(np.unpackbits(shard.bits[3], count=shard.n))])
    at = np.arange(shard.n + 1)
    assert (shard.ones(np.full(len(at), 3), at) == one).all()


def test_search_equals_its_sql(spark, duck):
    same(lexical_search.op11_lexical_search(spark, DATA), duck.sql(lexical_search.OP11_SQL))


def clustered(rows, k, rounds, seed=2):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    first = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in rows]
        groups = [[v for (_, v), a in zip(rows, at, strict=True) if a == j] for j in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in rows]
    inertia = [sum(d for _, c, d in found if c == j) for j in range(len(centroids))]
    return sorted(((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def test_kmeans_is_the_plain_one_with_ties(spark):
    r = random.Random(5)
    rows = [(i, [r.randrange(-3, 4) / 256 for _ in range(3)]) for i in range(300)] + [(7, [0.0, 0.0, 0.0]), (None, [1.5, -0.001, 0.25]), (None, [1.5, -0.001, 0.25])]
    bad = [(900, [0.0]), (901, None), (902, [0.0, None, 0.0]), (903, [0.0, float("nan"), 0.0]), (904, [float("-inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, cluster int, v string").repartition(5)
    for k, rounds in ((1, 1), (9, 4), (400, 2)):
        got = ball_kmeans.ball_kmeans(df, k, rounds, 3).collect()
        assert sorted(map(tuple, got), key=repr) == clustered(rows, k, rounds)
    assert ball_kmeans.ball_kmeans(df.where("vec_id = 901")).count() == 0
    with pytest.raises(Exception, match="not supported"):
        ball_kmeans.ball_kmeans(spark.createDataFrame([(1, [3e9])], "vec_id long, embedding array<double>"), 1, 1, 1).collect()


def test_balls_leave_out_comparisons_and_nothing_else():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (30, 8))
    v = (centres[rng.integers(0, 30, 2000)] + rng.integers(-900, 900, (2000, 8))).astype(np.int64)
    full = ball_kmeans.Balls.of(centres)
    cluster, dist, work = full.assign(v, np.zeros(len(v), np.int64))
    plain = ((v[:, None] - centres[None]) ** 2).sum(-1)
    assert (cluster == plain.argmin(1)).all() and (dist == plain.min(1)).all()
    radius = [int(dist[cluster == j].max(initial=0)) for j in range(30)]
    again, same_dist, less = ball_kmeans.Balls.of(centres, radius).assign(v, cluster)
    assert (again == cluster).all() and (same_dist == dist).all() and less < work / 4


def test_kmeans_equals_its_sql(spark, duck):
    same(ball_kmeans.op12_ball_kmeans(spark, DATA), duck.sql(ball_kmeans.OP12_SQL))


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_of_odd_texts_is_the_library_s(spark, library):
    r = random.Random(9)
    texts = [None, "", " ", "\n\n  x", "a\x00b", "It's we'll they'VE  \t　\xa0x", "aaaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "日本語の長い文章です" * 30, "é́ñandú Ÿ ß", "a  b", "🙂👩‍👩‍👧 !!!???###", "1234567890 ١٢٣", "<|endoftext|>"]
    texts += ["".join(r.choice("abcdeé 日\n'!0") for _ in range(r.randrange(1, 60))) for _ in range(150)]
    texts += ["".join(r.choice("etaoinshr") for _ in range(700)), "".join(chr(r.randrange(32, 0x3000)) for _ in range(300))]
    docs = spark.createDataFrame([(i, t, "t", "i") for i, t in enumerate([*texts, *texts[:20]])], "doc_id long, text string, tokens string, word string")
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    for size in (0, 40):  # all folded; some looked up
        done = byte_bpe.encoded(docs, path, size).select("doc_id", byte_bpe.ids(F.col("tokens")).alias("ids"), byte_bpe.decoded(byte_bpe.ids(F.col("tokens")), byte_bpe.rank_map(path)).alias("raw"))
        for row in done.collect():
            text = docs_text(texts, row.doc_id)
            assert row.ids == library.encode_ordinary(text) and bytes(row.raw) == text.encode()


def docs_text(texts, i):
    return [*texts, *texts[:20]][i] or ""


def test_bpe_of_the_tables_is_the_library_s(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = byte_bpe.op13_byte_bpe(spark, DATA).collect()
    assert len(got) == len(texts) and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == digests(library, texts[r.doc_id]) for r in got)


def test_bpe_folds_words_by_batch(spark, library):
    words = [f"wo{i}rnenß{'ea' * (i % 4)}"[:14].replace(str(i), "x" * (i % 3)) + chr(97 + i) for i in range(2 * byte_bpe.BATCH + 3)] + ["\ue000\ue001", "q"]
    ranks = byte_bpe.rank_map(public_tokenizers.path(byte_bpe.VOCABULARY))
    got = spark.createDataFrame([(words,)], "w array<string>").select(F.transform(byte_bpe.fold(F.col("w"), ranks), byte_bpe.ids).alias("ids")).first().ids
    assert got == [library._encode_single_piece(w) for w in words]


def test_bpe_plans_hold_no_tables(spark):
    done = byte_bpe.encoded(spark.createDataFrame([(1, "to be or not to be")], "doc_id long, text string"), public_tokenizers.path(byte_bpe.VOCABULARY))
    plans = done._jdf.queryExecution()  # Spark keeps their text on the driver for each run
    assert len(plans.toString()) < 100_000 and "AS held" not in plans.executedPlan().toString()  # nor do rows hold a copy of the tables


def test_bpe_words_stand_in_one_of_two_places():
    words = {f"w{i}": str(i) for i in range(3000)}
    table = byte_bpe._places(words)
    code = lambda w: zlib.crc32(w.encode())
    assert sorted(filter(None, table)) == sorted(words) and byte_bpe._places({}) == [""]
    assert all(w in (table[code(w) % len(table)], table[(code(w) >> 12) % len(table)]) for w in words)


def test_bpe_of_nothing_and_of_files_that_are_no_merges(none):
    assert byte_bpe.encoded(none, public_tokenizers.path(byte_bpe.VOCABULARY)).count() == 0
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abcd": 257}
    with pytest.raises(ValueError, match="not made of one pair"):
        byte_bpe.RankMap(ranks)


def test_sql_of_repeated_and_null_rows():
    c = duckdb.connect()
    c.sql("CREATE TABLE documents AS SELECT * FROM (VALUES (1, 'A b'), (1, 'a'), (NULL, 'a a'), (2, NULL)) t(doc_id, text)")
    c.sql("CREATE TABLE benchmark AS SELECT * FROM (VALUES (1, 'a'), (1, 'B'), (2, NULL)) t(item_id, text)")
    assert sorted(c.sql(lexical_search.OP11_SQL).fetchall(), key=repr) == ranked([(1, "A b"), (1, "a"), (None, "a a"), (2, None)], [(1, "a"), (1, "B"), (2, None)])
