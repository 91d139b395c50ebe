"""Decontamination and near-duplicates against brute force."""

import random
import re

import pytest
from helpers import DATA, same

from tremor.llm import decontaminate, near_dedup
from tremor.llm.queries import ORACLE_SQL, QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name]))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(w) >= 5:
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    return frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(None if i is None else find(i) if s else i), i is None or (find(i) if s else i) == i) for i, s in sets)


def dedup(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(df).collect())


def test_near_duplicates_of_odd_rows(odd, odd_rows, none):
    assert dedup(odd) == brute_components([r[:2] for r in odd_rows])
    assert dedup(none) == []


@pytest.mark.parametrize("bucket", [64, 1])
def test_near_duplicates_in_chains_and_dense_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for g in range(4):
        text = [r.choice(vocabulary) for _ in range(120)]
        for k in range(12):
            mine = list(text)
            for _ in range(r.randrange(6)):
                mine[r.randrange(120)] = r.choice(vocabulary)
            rows.append((100 * g + k, " ".join(mine)))
            if k % 3 == 0:
                text = mine  # chains drift away from their start
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dedup(df) == brute_components(rows)


def test_signature_distance_counts_symbols(spark):
    a, b = near_dedup.signature(near_dedup.T.U64(7) * near_dedup.np.arange(1, 400, dtype=near_dedup.np.uint64)), near_dedup.signature(near_dedup.T.U64(7) * near_dedup.np.arange(40, 440, dtype=near_dedup.np.uint64))
    want = sum(x != y for x, y in zip(a.view("uint16"), b.view("uint16"), strict=True))
    df = spark.createDataFrame([(a.view("int64").tolist(), b.view("int64").tolist())], "a array<long>, b array<long>")
    assert df.select(near_dedup.distance(df.a, df.b)).first()[0] == want > 0


def item_windows(text, n=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    size = min(n, len(w))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit, named = set(), set()
    for item, body in items:
        for win in item_windows(body):
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    named.add(item)
    return len(w), len(hit), len({i for i in named if i is not None})


def test_contamination_of_odd_rows(spark, odd, odd_rows, none, monkeypatch):
    words = odd_rows[0][1].split()
    items = [(1, " ".join(words[5:30])), (2, "one TWO"), (3, None), (4, ""), (5, " ".join(words[20:40]).upper()), (None, "日本語"), (2, "one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(odd, bench)
    want = sorted((str(i), *brute_hits(t, items)) for i, t, *_ in odd_rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in got.collect()) == want
    first = plain_rows(got)
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)  # several blocks give the same
    assert plain_rows(decontaminate.contamination(odd, bench)) == first
    monkeypatch.setattr(decontaminate, "SHARD", 50)  # as do many shards
    assert plain_rows(decontaminate.contamination(odd, bench)) == first
    assert decontaminate.contamination(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, bench.where("false")).collect())


def plain_rows(df):
    return sorted(map(str, df.collect()))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, "delta x x x x gamma beta alpha")], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    found = lambda slop: sorted(r.doc_id for r in decontaminate.search(index, bench, slop).where("spans is not null").collect())
    assert found(0) == [2] and found(1) == [1, 2]


def brute_near(w, win, slop):
    """Whether the words of a window have occurrences of their own within ``slop`` of their places from some start."""

    def place(s, k, used):
        if k == len(win):
            return True
        return any(w[p] == win[k] and p not in used and place(s, k + 1, used | {p}) for p in range(max(s + k - slop, 0), min(s + k + slop + 1, len(w))))

    return any(place(s, 0, frozenset()) for s in range(-slop, len(w) + slop))


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_equals_brute_force(spark, monkeypatch, slop):
    r = random.Random(17)
    words = ["red", "blue", "red", "stone", "walk", "sun"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for k in range(120)] + [(500, ""), (501, "alpha"), (None, "red blue"), (503, None)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for k in range(30)] + [(90, "alpha alpha"), (91, "red red red"), (92, " ".join(words * 3))]
    monkeypatch.setattr(decontaminate, "SHARD", 300)
    index = decontaminate.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (set(r.near or []), {s.item for s in r.spans or []}) for r in decontaminate.search(index, bench, slop, near=slop).collect()}
    for i, t in rows:
        w = (t or "").split()
        want = {str(k) for k, body in items if any(brute_near(w, win, slop) for win in item_windows(body))}
        assert got[i] == (want, want), (t, want)


def test_near_items_of_the_query(spark):
    items = [(r.item_id, item_windows(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = {r.doc_id: r for r in QUERIES["op1_decontaminate"](spark, DATA).collect()}
    for i in [i for i, r in out.items() if r.n_near_items or r.n_items][:12]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (texts[i] or "").translate(LOW))
        assert out[i].n_near_items == sum(any(brute_near(w, win, 1) for win in windows if set(win) <= set(w)) for _, windows in items) >= out[i].n_items
