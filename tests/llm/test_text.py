"""Operators on single texts: brute force, exact round trips, held-out accuracy, odd rows."""

import functools
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from helpers import DATA

from tremor.llm import html_text, language_crf, license_scan, lm_score, packing, pii, quality_fm, quality_rules

DOCS = f"{DATA}/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def bytes_of(t):
    return np.frombuffer(t.encode(), np.uint8)


# language


def test_forward_backward_is_exact():
    from itertools import product

    r = np.random.default_rng(1)
    psi, a = r.random((7, 3)) + 0.1, r.random((3, 3)) + 0.1
    want = np.zeros((7, 3))
    for s in product(range(3), repeat=7):
        w = a[:, s[0]].mean() * np.prod([psi[i, s[i]] for i in range(7)]) * np.prod([a[s[i], s[i + 1]] for i in range(6)])
        for i in range(7):
            want[i, s[i]] += w
    assert np.allclose(language_crf.Lattice(np.array([7])).marginals(psi, a)[2], want / want.sum(1, keepdims=True))


def test_blocks_do_not_matter(monkeypatch):
    r = np.random.default_rng(2)
    psi, a, n = r.random((500, 3)) + 0.1, r.random((3, 3)) + 0.1, np.array([130, 0, 3, 200, 167])
    one = language_crf.Lattice(n).marginals(psi, a)[2]
    monkeypatch.setattr(language_crf, "BLOCK", 400)
    assert np.allclose(one, language_crf.Lattice(n).marginals(psi, a)[2])


def test_languages_held_out(spark, docs):
    model = language_crf.fit(docs)
    got = {r.doc_id: r for r in language_crf.detect(docs, model).collect()}
    rows = [r for r in docs.collect() if held(r.doc_id)]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in rows]) > 0.95
    mixed = "the house and of the with this and the was of " * 4, "le la de et que les des est dans pour une " * 4
    p, n = language_crf.label_words(model, [bytes_of(" ".join(mixed))])
    top = p.argmax(axis=1)
    assert len(set(top[: len(mixed[0].split()) - 2])) == 1 and top[0] != top[-1]


def test_languages_of_odd_rows(odd, odd_rows, none):
    out = language_crf.detect(odd, language_crf.fit(odd)).collect()
    assert len(out) == len(odd_rows)
    by = {r.doc_id: r for r in out}
    assert by[4].lang_pred == by[5].lang_pred == by[6].lang_pred == by[13].lang_pred == "und" and by[4].score == 0
    assert by[1].lang_pred == "en" and 0 <= by[1].score <= 1
    assert {r.lang_pred for r in language_crf.detect(odd, language_crf.fit(none)).collect()} == {"und"}
    assert language_crf.detect(none, language_crf.fit(none)).count() == 0


# personal data


def luhn(x):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(x))) % 10 == 0


def base_spans(t):
    t, out = t or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return out


TRICKY = [
    "a@b.co_x@y.zz a@b a@b.c.d, x@@y.z", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0255.4 1.2.3", "4111-1111 1111-1111 4111111111111112 0000000000000000", "+1 555 +12345678 +1(2)3-4.5678 9", "9" * 3000 + " a" * 3, "é+49 (30) 1234567é ü@ü.de x.y@é.de",
    "call 555-123-4567 or bob [at] example [dot] com; ssn 123-45-6789", "", None,
]


def test_base_spans(spark, docs):
    rows = [(-k - 1, t) for k, t in enumerate(TRICKY)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.find(df).select("doc_id", "_pii_spans").collect():
        got = [(s.kind, s.start, s.stop) for s in r._pii_spans if s.base]
        assert got == base_spans(texts[r.doc_id]), r.doc_id
        assert sorted((s.rank, s.start) for s in r._pii_spans) == [(s.rank, s.start) for s in r._pii_spans]


def plain_labels(loose, rounds=40):
    """EM and naive Bayes candidate by candidate: whether each (votes, features) is accepted."""
    k = len(pii.LABELERS)
    chance, prior = [[list(s) for _ in range(k)] for s in pii.START], 0.5
    odds = lambda v: np.log(prior / (1 - prior)) + sum(np.log(chance[0][j][x + 1] / chance[1][j][x + 1]) for j, x in enumerate(v))
    for _ in range(rounds):
        post = [1 / (1 + np.exp(-odds(v))) for v, _ in loose]
        for c in (0, 1):
            w = [p if c == 0 else 1 - p for p in post]
            chance[c] = [[(2 * pii.START[c][x] + sum(wi for wi, (v, _) in zip(w, loose, strict=True) if v[j] + 1 == x)) / (2 + sum(w)) for x in range(3)] for j in range(k)]
        prior = (sum(post) + 1) / (len(post) + 2)
    lean = [sum(x[2] - x[1] for x in chance[c]) for c in (0, 1)]
    if lean[0] < lean[1]:
        chance, prior = chance[::-1], 1 - prior
    post = [1 / (1 + np.exp(-odds(v))) for v, _ in loose]
    yes, no = sum(post), len(post) - sum(post)
    sums = {}
    for p, (_, f) in zip(post, loose, strict=True):
        for key in enumerate(f):
            a, b = sums.get(key, (0, 0))
            sums[key] = a + p, b + 1 - p
    ratio = {key: np.log((a + 0.5) / (yes + 2.5)) - np.log((b + 0.5) / (no + 2.5)) for key, (a, b) in sums.items()}
    return [np.log((yes + 1) / (no + 1)) + sum(ratio[key] for key in enumerate(f)) >= 0 for _, f in loose]


def decoys(r, n=30):
    """Documents with one real or one false candidate each, and whether it is real."""
    run = lambda alphabet, n: "".join(r.choice(list(alphabet), n))
    out = []
    for k in range(n):
        bad = next(x for x in iter(lambda: run("123456789", 16), None) if not luhn(x))
        out += [(f'word token = "{run("0123456789abcdef", 40)}" end', True), (f"an order {bad} of things", False), (f"see {bad} there", False), (f"in commit {run('0123456789abcdef', 40)} of it", False)]
        out += [(f"call 555-{k % 9 + 100}-1234 now", True), (f"bob [at] example{k}.org wrote", True)]
    return out


@pytest.mark.parametrize("which", ["planted", "given"])
def test_labels_equal_plain_em_and_naive_bayes(spark, docs, which):
    cases = decoys(np.random.default_rng(21))
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string") if which == "planted" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    loose = [(r._row.doc_id, c) for r in pii.candidates(df.select("doc_id", "text")).collect() for c in r._pii if not c.base]
    want = {(i, c.kind, c.start, c.stop): ok for (i, c), ok in zip(loose, plain_labels([(c.votes, tuple(c.features)) for _, c in loose]), strict=True)}
    got = {(r.doc_id, s.kind, s.start, s.stop) for r in pii.find(df).collect() for s in r._pii_spans if not s.base}
    assert got == {k for k, ok in want.items() if ok} and 0 < len(got) < len(want)
    if which == "planted":
        assert {k[0] for k in got} == {k for k, (_, real) in enumerate(cases) if real}


def plain_by_kind(loose, rounds=40):
    """EM and naive Bayes inside one kind, candidate by candidate: whether each (votes, features) is accepted."""
    n, known = len(loose), list(pii.KNOWN.values())
    prior, miss, wrong = pii.PRIOR, [x[0] for x in known], [x[1] for x in known]
    odds = lambda v: np.log(prior / (1 - prior)) + sum(np.log((1 - miss[j]) / wrong[j]) if x == 1 else np.log(miss[j] / (1 - wrong[j])) for j, x in enumerate(v) if x >= 0)
    for step in range(rounds + 1):
        post = [1 / (1 + np.exp(-odds(v))) for v, _ in loose]
        if step < rounds:
            tally = lambda j, vote, w: sum(x for x, (v, _) in zip(w, loose, strict=True) if v[j] in vote)
            other = [1 - p for p in post]
            miss = [(n * k[0] + tally(j, (0,), post)) / (n + tally(j, (0, 1), post)) for j, k in enumerate(known)]
            wrong = [(n * k[1] + tally(j, (1,), other)) / (n + tally(j, (0, 1), other)) for j, k in enumerate(known)]
            prior = (n * pii.PRIOR + sum(post)) / (2 * n)
    yes, no, sums = sum(post), n - sum(post), {}
    seen = [[*f[1:3], *map(str, v)] for v, f in loose]
    for p, f in zip(post, seen, strict=True):
        for key in enumerate(f):
            a, b = sums.get(key, (0, 0))
            sums[key] = a + p, b + 1 - p
    ratio = {key: np.log((a + (a + b) / n) / (yes + 1)) - np.log((b + (a + b) / n) / (no + 1)) for key, (a, b) in sums.items()}
    return [np.log((n * pii.PRIOR + yes) / (n * (1 - pii.PRIOR) + no)) + sum(ratio[key] for key in enumerate(f)) >= 0 for f in seen]


@pytest.mark.parametrize("which", ["planted", "given"])
def test_votes_decide_inside_a_kind(spark, which):
    r = np.random.default_rng(22)
    run = lambda first, n: first + "".join(r.choice(list("0123456789"), n - len(first)))
    good = [next(x for x in iter(lambda: run("4", 16), None) if luhn(x)) for _ in range(3)]
    # a group of digits before it keeps a card from being a base match
    cases = [*decoys(r), *((f"box 12 {x} there", True) for x in good), *((f"box 12 {next(y for y in iter(lambda: run('4', 16), None) if not luhn(y))} there", False) for _ in range(30))]
    cases += [("see the long-name-with-words-2024 page", False), ("a digest 0123456789abcdef0123456789abcdef01234567 alone", False)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string") if which == "planted" else spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    loose = [(row._row.doc_id, c) for row in pii.candidates(df.select("doc_id", "text")).collect() for c in row._pii if not c.base]
    want = set()
    for kind in {c.kind for _, c in loose}:
        own = [(i, c) for i, c in loose if c.kind == kind]
        want |= {(i, kind, c.start, c.stop) for (i, c), ok in zip(own, plain_by_kind([([*c.votes, *c.more], c.features) for _, c in own]), strict=True) if ok}
    got = {(row.doc_id, s.kind, s.start, s.stop) for row in pii.find(df, by_kind=True).collect() for s in row._pii_spans if not s.base}
    assert got == want and 0 < len(got) < len(loose)
    if which == "planted":
        assert {k[0] for k in got} == {k for k, (_, real) in enumerate(cases) if real}
    else:
        cards = [(c.votes[0], c.votes[4], (i, c.kind, c.start, c.stop) in got) for i, c in loose if c.kind == "card"]
        assert all(ok for form, check, ok in cards if form == check == 1) and not any(ok for _, check, ok in cards if check == 0)


def test_by_kind_of_odd_rows(spark, odd, odd_rows, none):
    found = pii.find(odd, by_kind=True)
    assert found.columns == [*odd.columns, "_pii_spans"] and found.count() == len(odd_rows) and pii.find(none, by_kind=True).count() == 0
    assert pii.find(odd.where("doc_id = 5"), by_kind=True).first()._pii_spans == []


def test_account_checksum(spark):
    df = spark.createDataFrame([("DE89370400440532013000",), ("GB82WEST12345698765432",), ("DE89370400440532013001",)], "v string")
    assert [r[0] for r in df.select(pii._iban_ok(df.v)).collect()] == [True, True, False]


def test_any_other_column_passes(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'mail a@b.org' AS text, map('k', 1) AS w, 2 AS prior, 3 AS _pii, 4 AS _row, 5 AS base, 6 AS loose, 7 AS votes, 8 AS m_ip, 9 AS `a.b`, null AS c")
    out = pii.find(df)
    assert out.columns == [*df.columns, "_pii_spans"] and out.drop("_pii_spans").collect() == df.collect() and len(out.first()._pii_spans) == 1


def test_redaction_and_odd_rows(spark, odd, odd_rows, none):
    found = pii.find(odd)
    assert found.columns == [*odd.columns, "_pii_spans"] and found.count() == len(odd_rows)
    out = {r.doc_id: r[0] for r in found.select(pii.redacted(found.text, found._pii_spans), "doc_id").collect()}
    assert "a.b@c" not in out[12] and "<email>" in out[12] and "<card>" in out[12] and "999.1.1.1" in out[12] and "abcdef0123" not in out[12]
    assert out[4] is None and out[5] == ""
    assert pii.find(none).count() == 0
    assert pii.find(odd.where("doc_id = 5")).first()._pii_spans == []


def test_candidates_of_any_length(spark):
    r = np.random.default_rng(5)
    token = lambda n: "a1" + "".join(r.choice(list("ABCdef0123456789_-"), n - 2))
    values = [token(40), token(300), token(5000), "b" * 90 + "9 [at] mail.example.org", "z [at] " + "m" * 80 + "1.org"]
    rows = [(k, f"secret = {v} end") for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for row in pii.candidates(df).collect():
        assert [(c.start, c.stop) for c in row._pii] == [(9, 9 + len(values[row._row.doc_id]))]
    found = pii.find(df)
    assert {r[0] for r in found.where("doc_id < 3").select(pii.redacted(found.text, found._pii_spans)).collect()} == {"secret = <secret> end"}


def test_op4_digest(spark):
    from tremor.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(DOCS).collect()}
    for r in QUERIES["op4_pii"](spark, DATA).collect():
        b = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest() and (r.n_email, r.n_card) == (sum(x[0] == "email" for x in b), sum(x[0] == "card" for x in b))


# pages


def test_pages_round_trip(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    import html

    want = {}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        want[p.page_id] = " ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<(/?p|/?h1|br)>", " ", body))).split())
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_generated_pages_held_out():
    import random

    r, model = random.Random(77), html_text.trained()
    tp = fp = fn = 0
    for _ in range(60):
        page = html_text._generated(r)
        words = html_text.main_texts(model, [page])[0].split()
        good = sum(w[0] == "x" for w in words)
        tp, fp, fn = tp + good, fp + sum(w[0] == "b" for w in words), fn + len(re.findall(r"\bx[a-z]+", page)) - good
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97


def test_no_kept_node_below_a_dropped_one():
    f = html_text.Forest()
    html_text.parse(f, "<div><p>a<p>b<div>c</div></div><ul><li>d</ul>")
    shape = html_text.Shape(f)
    keep = html_text.decode(shape, np.random.default_rng(3).random(len(f.group)))
    assert all(keep[p] for k, p in zip(keep, shape.parent, strict=True) if k and p >= 0)


def test_raw_text_is_not_markup():
    page = '<html><head>%s<title>x<y</title></head><body><article><p>Words stay.%s</p><p>So do these.</p></article></body></html>'
    heads = ["<script>if(a<b){x()}</script>", "<SCRIPT>for(i=0;i<n;i++){}</Script >", "<script>var s='<p';\nt=\"</p>\"</script>", "<style>a<b{}</style>", "<noscript>a<b</noscript>", "<iframe>a<b</iframe>", "<textarea>i<n \"</textarea>"]
    for raw in heads:
        for filled in (page % (raw, ""), page % ("", raw)):
            f = html_text.Forest()
            html_text.parse(f, filled)
            assert [t for t in f.text if t] == ["Words stay.", "So do these."]
    f = html_text.Forest()
    html_text.parse(f, "<p>a<svg><title>x<y</title></svg>b<svg>" + "<title>" * 20_000 + "</svg>c")
    assert [t for t in f.text if t] == ["abc"]


def texts_of(page):
    f = html_text.Forest()
    html_text.parse(f, page)
    return [t for t in f.text if t]


def test_unclosed_elements_leave_the_page():
    body = "<article><p>Words stay.</p>%s<p>So do these.</p></article>"
    for odd in ["<svg><path>", "<template>", "<!-- note >", "<script>if (a<b) {", "<style>a{}", "<iframe>", "<noscript>", "<object>", "<canvas>", "<select><option>", "<svg/>", "<svg><svg></svg>", "<script><!-- <script> x </script>"]:
        got = " ".join(texts_of("<body>" + body % odd + "</body>"))
        assert got.startswith("Words stay.") and got.endswith("So do these."), (odd, got)
    assert texts_of("<p>a <math><mi>x</mi></math> b <object>c</object> <canvas>d</canvas></p>") == ["a x b c d"]
    assert texts_of("<p>" + "<!-- x " * 20_000 + "</p>b") and texts_of("<p>a</p>" + "<svg><template>" * 20_000 + "b</template></svg>")
    assert texts_of("a<svg><text>x</text><svg>y</svg>z</svg>b<!-->c<!--->d<!---->e") == ["abcde"]


#: Pages written by hand, with layouts that the generator does not know; what stands in [[ ]] is the article.
LAYOUTS = [
    """<!doctype html><html lang=en><head><meta charset=utf-8><title>T</title><script>for(i=0;i<n;i++){s='x';}</script></head><body class="home"><div id="wrap"><header class="site-header"><a href="/">Daily Tern</a>
    <nav><ul><li><a href="/a">World</a><li><a href="/b">Sport</a><li><a href="/c">Arts</a></ul></nav></header><main><article class="post"><h1>[[Harbour reopens after the storm]]</h1>
    <p>[[The harbour reopened on Monday, three weeks after the storm tore away its outer wall and sank four boats.]]</p><script>if(a<b){t="it's";}</script>
    <p>[[Crews worked through the night, the mayor said, and the ferry will run again from <a href="/f">Friday</a> at noon.]]</p>
    <blockquote>[[We never thought it would hold, said one of the fishermen.]]</blockquote><ul><li>[[Ferry: Friday, noon]]</li><li>[[Fish market: Saturday]]</li></ul></article></main>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">One thing</a></li><li><a href="/2">Another thing</a></li></ul></aside>
    <section id="comments"><h3>Two comments</h3><div class="comment"><b>Ann</b><p>Great news for the town, at last.</p></div><div class="comment"><p>I doubt it will last a winter.</p></div></section>
    <footer>&copy; 2024 Daily Tern. <a href="/p">Privacy</a></footer></div></body></html>""",
    """<html><body><div class="topbar"><a href="#">Home</a> | <a href="#">Shop</a> | <a href="#">About</a></div><div class="cookie-notice"><p>We use cookies to improve the site.</p><button>Accept</button></div>
    <div class="container"><div class="entry-content"><h2>[[How to prune an old apple tree]]</h2><p>[[Start in late winter, when the tree is bare and you can see its whole frame.]]
    <p>[[Take out dead wood first; then crossing branches, then whatever shades the middle of the crown.]]<div class="advert">Buy sharp saws today!</div>
    <h3>[[Tools]]</h3><p>[[A saw, a ladder &amp; patience are enough for most trees.]]<p>[[Do not cut more than a fifth of the crown in a year.]]</div></div>
    <form action="/s"><label>Newsletter</label><input name=e><button>Subscribe</button></form><div class="footer"><p>Garden notes, all rights reserved</p></div></body></html>""",
    """<body><table><tr><td><nav class="menu"><a href=1>Start</a><a href=2>Kontakt</a><a href=3>Impressum</a></nav></td></tr></table><section class="story"><h1>[[Der letzte Zug]]</h1>
    <div>[[Als der letzte Zug den Bahnhof verlie\xdf, blieb nur der W\xe4rter zur\xfcck und l\xf6schte die Lampen.]]</div><div>[[Am Morgen fand man den Schl\xfcssel auf der Bank, daneben einen Brief ohne Absender.]]</div>
    <pre>[[Gleis 1: gesperrt]]</pre></section><div class="related"><h4>Mehr</h4><ul><li><a href=4>Ein anderer Text</a></li><li><a href=5>Noch ein Text</a></li></ul></div></body>""",
]


def test_layouts_that_the_generator_does_not_know():
    import html

    model = html_text.trained()
    for page in LAYOUTS:
        want = " ".join(html.unescape(re.sub("<[^>]+>", "", x)) for x in re.findall(r"\[\[(.*?)\]\]", page, re.S))
        got = html_text.main_texts(model, [page.replace("[[", "").replace("]]", "")])[0]
        assert got.split() == want.split()


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "plain & text &lt;"), (3, "u", "<article><p>" + "word " * 50_000), (4, "u", "<" * 200 + "<a href='" + "x" * 100), (5, "u", "<div>" * 3000 + "deep")]
    out = html_text.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    assert len(out) == len(rows) and {r.text for r in out if r.page_id in (1, 2)} == {""}
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# packing


def check_pieces(rows, want):
    """want: ids by doc in order; every id in exactly one piece, sequences gapless."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[doc])
            assert r.ids_crc32 == zlib.crc32(np.array(want[doc][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want[doc])
    padded = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.TOKENS and len(seq) <= packing.SEGMENTS
        padded += 0 if at & (at - 1) == 0 else packing.TOKENS - at
    return padded


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_round_trip(docs):
    want = {r.doc_id: plain_ids(r.text) for r in docs.collect()}
    assert check_pieces(packing.pack(docs).collect(), want) == 0


def test_packing_odd_rows(odd, odd_rows, none):
    single = odd.where("doc_id is not null and doc_id not in (7, 8)")
    want = {r[0]: plain_ids(r[1]) for r in odd_rows if r[0] not in (None, 7, 8)}
    assert check_pieces(packing.pack(single).collect(), want) == 0
    assert sum(r.length for r in packing.pack(odd).collect()) == sum(len(plain_ids(r[1])) for r in odd_rows)
    assert packing.pack(none).count() == 0


def test_ids_of_odd_words():
    odd = ["a\x1cb", "a\x85b", "a\xa0b", "a　b", "don't 's x's DON'T", "<|endoftext|> a<|startoftext|>b <|x", "İx ́y", "ﬁ Ⅷ 12a3 é", "", "\x00", "A-B_c9%%%x", "é É×÷Ünö,Ŀ.ſ…a ñ.b İstanbul straße!", "a= ̸b"]
    got = packing.Encoder(packing.default_tokenizer()).encode([bytes_of(x) for x in odd])
    assert [g.tolist() for g in got] == [plain_ids(x) for x in odd]


def test_three_limits_hold():
    r = np.random.default_rng(5)
    packer = packing.Packer(100, 4, 30, pool=16)
    sizes, cums, seqs = {}, {}, []
    for k in range(300):
        n = int(r.integers(1, 90))
        loss = (r.random(n) < 0.3).astype(int)
        sizes[k], cums[k] = n, np.concatenate([[0], np.cumsum(loss)])
        seqs += list(packer.add(k, n, cums[k]))
    seqs += list(packer.finish())
    seen = {}
    for s in seqs:
        assert len(s) <= 4 and sum(n for *_, n in s) <= 100 and sum(cums[k][a + n] - cums[k][a] for k, a, n in s) <= 30
        for k, a, n in s:
            seen.setdefault(k, []).append((a, n))
    for k, n in sizes.items():
        assert sum(x for _, x in seen[k]) == n and sorted(seen[k])[0][0] == 0


def test_loss_limit_binds(spark, docs):
    r = np.random.default_rng(14)
    texts = [" ".join(r.choice(["red", "stone", "walk", "quiet"], int(n))) for n in r.integers(1, 3000, 60)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(df, loss=1200, prompt=packing.first_quarter(df.text)).collect()
    check_pieces(rows, {i: plain_ids(t) for i, t in enumerate(texts)})
    heads = {i: len(plain_ids(" ".join(w for w, at in zip(t.split(), np.cumsum([0, *(len(w) + 1 for w in t.split())]), strict=False) if at < len(t) // 4))) - 1 if t else 0 for i, t in enumerate(texts)}
    loss = {}
    for x in rows:
        loss[x.sequence_id] = loss.get(x.sequence_id, 0) + max(0, x.start + x.length - heads[x.doc_id]) - max(0, x.start - heads[x.doc_id])
    assert max(loss.values()) == 1200  # with one limit for all ids it would not be met
    free = packing.pack(df).groupBy("sequence_id").sum("length").collect()
    assert len({x.sequence_id for x in rows}) > len(free)
    want = {r.doc_id: plain_ids(r.text) for r in docs.collect()}
    assert check_pieces(packing.pack(docs, loss=packing.LOSS, prompt=packing.first_quarter(docs.text)).collect(), want) == 0


# language-model scores


def test_probabilities_sum_to_one_and_learning_helps():
    m = {k: v.copy() for k, v in lm_score.unflat(lm_score.flat(lm_score.initial())).items()}
    near = np.zeros((lm_score.V, 2 * lm_score.WINDOW), int)
    assert np.exp(lm_score.log_probabilities(m, np.arange(lm_score.V), near)).sum() == pytest.approx(1, abs=1e-5)
    doc = np.tile([3, 8, 30, 77, 200], 400)
    y, x = lm_score.contexts([doc])
    before = lm_score.log_probabilities(m, y, x).mean()
    seen = {k: np.zeros_like(v) for k, v in m.items()}
    for _ in range(10):
        lm_score.learn(m, seen, y, x)
    assert lm_score.log_probabilities(m, y, x).mean() > before + 3


def test_scores_tell_prose_from_noise(spark, docs, odd, odd_rows, none):
    out = {r.doc_id: r for r in lm_score.score(docs).collect()}
    assert len(out) == docs.count() and all(r.log_prob <= 0 for r in out.values())
    r, rows = np.random.default_rng(12), {x.doc_id: x.text for x in docs.collect() if x.text and len(x.text) < 20_000}
    noise = [(i, re.sub(r"\S", lambda _, it=iter(r.permutation(list(re.sub(r"\s", "", t)))): next(it), t)) for i, t in rows.items()]  # noqa: B023
    both = spark.createDataFrame([(i, t) for i, t in rows.items()] + [(-i - 1, t) for i, t in noise], "doc_id long, text string")
    got = {x.doc_id: x.mean_log_prob for x in lm_score.score(both).collect()}
    assert np.mean([got[i] > got[-i - 1] + 1 for i in rows]) > 0.95
    odd_out = lm_score.score(odd).collect()
    by = {r.doc_id: r for r in odd_out}
    assert len(odd_out) == len(odd_rows) and by[4].n_words == 0 and by[4].mean_log_prob is None and by[10].n_words == 30_000
    assert lm_score.score(none).count() == 0


@pytest.mark.xfail(strict=True, reason="a bound from a model that scored rare words as one of 128 buckets; not met since each word is scored itself")
def test_mean_over_words_beats_the_least_network(spark, docs):
    out = lm_score.score(docs).collect()
    assert np.mean([r.mean_log_prob for r in out]) > -np.log(lm_score.V)


def network(spark, df):
    words = spark.sparkContext.broadcast(lm_score.vocabulary(df))
    weights, spell = lm_score.train(df, words)
    return words.value, lm_score.unflat(weights, words.value[2]), spell


def test_network_beats_a_uniform_guess_over_its_outputs(spark, docs):
    """The bound is on the outputs of the network (words and buckets); whole words have a lower score, as
    there are more of them: the exact word frequencies of this table give a mean of -8.6."""
    words, m, _ = network(spark, docs)
    means = []
    for x in docs.collect():
        y, near = lm_score.contexts([lm_score.ids_of(lm_score.T.LOWER[bytes_of(x.text or "")], words)[0]], words[2])
        if len(y):
            means.append(lm_score.log_probabilities(m, y, near).mean())
    assert np.mean(means) > -np.log(lm_score.V)


def test_scores_equal_a_plain_sum(spark):
    """Word by word, with plain sums and no batches, from the same weights."""
    texts = ["red blue green red blue", "Blue red\tzebra", "yak", "", "red  red red green blue zebra yak yak"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words, m, spell = network(spark, df)
    m = {k: v.astype(float) for k, v in m.items()}
    side = words[2]
    got = {r.doc_id: r for r in lm_score.score(df).collect()}
    for i, t in enumerate(texts):
        tokens = [x.encode() for x in re.findall(r"[^ \t-\r]+", t.lower())]
        parts = [lm_score.ids_of(bytes_of(x.decode()), words) for x in tokens]
        ids = [int(p[0][0]) for p in parts]
        total = sum(lm_score.spelling_log_probability(bytes_of(x.decode()), a, b, spell) for x, (_, a, b) in zip(tokens, parts, strict=True))
        for k, y in enumerate(ids):
            places = [o for o in range(-lm_score.WINDOW, lm_score.WINDOW + 1) if o]
            z = sum(m["c"][j] * m["e"][ids[k + o] if 0 <= k + o < len(ids) else side * side] for j, o in enumerate(places))
            h = [*map(float, np.tanh(z)), 1.0]
            first, of = lm_score.layout(side)
            c = int(of[y])
            for table, at in ((m["u"], c), (m["w"][first[c] : first[c + 1]], y - first[c])):
                odds = [np.exp(sum(a * b for a, b in zip(row, h, strict=True))) for row in table]
                total += np.log(odds[at] / sum(odds))
        assert got[i].n_words == len(ids) and got[i].log_prob == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_every_word_has_a_probability_of_its_own(spark):
    rows = [(k, " ".join(["the of and"] * 30 + [f"w{chr(97 + k % 26)}{chr(97 + j % 26)}nation" for j in range(60)])) for k in range(60)]
    rows += [(100, "wabnation wacnation"), (101, "xqzjkvnation qqxzpwnation")]  # the same endings
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert lm_score.side_of(10**8) == 100 and lm_score.side_of(16 * 10**8) == 200
    out = {r.doc_id: r.mean_log_prob for r in lm_score.score(df).collect()}
    assert out[100] > out[101] + 3
    codes = lm_score.spelled(bytes_of("ab b  bab"), np.array([0, 3, 6]), np.array([2, 4, 9]))
    symbol, three, ends = lm_score.spelling(*np.unique(codes.astype(int), return_counts=True))
    k = symbol.max() + 1
    assert np.allclose(np.exp(three.reshape(k, k, k)).sum(axis=0), 1, atol=1e-5)
    last, before = np.divmod(np.arange(1 << 16), 256)
    assert np.allclose(np.bincount(lm_score.buckets(last, before), np.exp(ends)), 1)


def test_all_documents_train(spark):
    df = spark.createDataFrame([(k, "left right " * 40) for k in range(16)], "doc_id long, text string")
    words = spark.sparkContext.broadcast(lm_score.vocabulary(df))
    start = lm_score.flat(lm_score.initial(mass=words.value[4]))
    for k in range(16):  # whichever it is
        weights, _ = lm_score.train(df.where(f"doc_id = {k}"), words)
        assert not np.allclose(weights, start)


# licences


def brute_base(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    places = [(k, lab) for lab, p, _ in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licences(spark, odd_rows, none):
    from tremor.llm.queries import QUERIES

    extra = ["Under the MIT license, under the mit License", "cc-by-nc CC BY NC cc by", "license version 2 apache license version 2", "This work is licensed under the GNU General Public License, version 3.", "THE mit bsd gnu general public", "İ Kelvin Kit under the mit licenSe"]
    import tempfile

    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + k, t) for k, t in enumerate(extra)]
    with tempfile.TemporaryDirectory() as d:
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
        got = QUERIES["op8_license_scan"](spark, d).collect()
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got])) == sorted(map(str, [(i, *brute_base(t)) for i, t in rows]))
    by = {r.doc_id: r for r in got}
    assert by[103].labels == "gpl-3" and by[103].base_labels == "" and 0.5 <= by[103].score <= 1 and by[104].labels == "" and by[14].labels == "apache-2"
    assert license_scan.scan(none).count() == 0


def plain_labels_of(t, idf):
    """The labels of a text: every template at every place, without an index."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    slack, out = license_scan.SLACK, {}
    order = sorted(idf, key=lambda x: (-idf[x], x))
    for label, notice, keys in license_scan.TEMPLATES:
        ws = notice.split()
        own = [x for x in order if x in ws and x in w][: license_scan.RARE]
        starts = sorted((i - p, order.index(x)) for i, x in enumerate(w) if x in own for p, y in enumerate(ws) if x == y)
        for s in {b for (a, x), (b, y) in zip(starts, starts[1:]) if x != y and b - a <= slack}:  # noqa: B905
            region = " " + " ".join(w[max(s - slack, 0) : max(s - slack, 0) + len(ws) + 2 * slack]) + " "
            near = [x in w[max(s + p - slack, 0) : max(s + p + slack + 1, 0)] for p, x in enumerate(ws)]
            cover = sum(idf[x] for x, ok in zip(ws, near, strict=True) if ok) / sum(idf[x] for x in ws)
            if cover >= license_scan.COVER and all(f" {k} " in region for k in keys):
                out[label] = max(out.get(label, 0), min(cover, 1))
    return out


def test_labels_equal_plain_search_and_survive_an_inserted_word(spark, docs):
    r = np.random.default_rng(31)
    filler = [f"w{k}" for k in range(400)]
    rows, wanted = [], {}
    for k, (label, notice, keys) in enumerate(license_scan.TEMPLATES):
        ws = notice.split()
        for j in range(len(ws)):
            text = " ".join(ws[:j] + ["inserted"] + ws[j:])
            if j and not all(x in text for x in keys):
                continue  # a broken key phrase
            i = 1000 * k + j
            rows.append((i, " ".join([*r.choice(filler, 30), text if j else notice.upper(), *r.choice(filler, 20)])))
            wanted[i] = label
    words = [w for _, n, _ in license_scan.TEMPLATES for w in n.split()]
    rows += [(-k, " ".join(r.choice(words, 60))) for k in range(1, 60)]  # licence words without order
    rows += [(10**6 + x.doc_id, x.text) for x in docs.collect() if x.text and len(x.text) < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    total, freq = license_scan.frequencies(df, license_scan.VOCABULARY)
    idf = {w: np.log((total + 1) / (freq.get(w, 0) + 1)) + 1e-9 for w in license_scan.VOCABULARY}
    texts = dict(rows)
    for x in license_scan.scan(df).select("doc_id", "found").collect():
        got = {}
        for f in x.found:
            got[f.label] = max(got.get(f.label, 0), f.cover)
        assert got == pytest.approx(plain_labels_of(texts[x.doc_id], idf)), texts[x.doc_id]
        if x.doc_id in wanted:
            assert wanted[x.doc_id] in got, texts[x.doc_id]


def test_short_and_partial_notices_are_found(spark):
    warranty = "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
    liable = " In no event shall the authors or copyright holders be liable for any claim, damages or other liability"
    texts = {
        "# SPDX-License-Identifier: MIT": "mit", "// SPDX-License-Identifier: Apache-2.0": "apache-2", "distributed under GPL v3 by us": "gpl-3", "it has a BSD style license": "bsd", warranty + liable: "mit",
        warranty: "", "license identifier of a car": "", "gpl and v3 of it": "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: ",".join(sorted({f.label for f in r.found})) for r in license_scan.scan(df).collect()}
    assert got == texts


def test_licences_keep_other_columns(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'released under the MIT license' AS text, map('k', 1) AS w, 2 AS hits, 3 AS own, 4 AS raw, 5 AS `a.b`")
    out = license_scan.scan(df)
    assert out.columns == [*df.columns, "n_words", "base", "found"] and out.first().n_words == 5 and {f.label for f in out.first().found} <= {"mit"}


# quality


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    hot = {k + j for k, x in enumerate(tri) if tri.count(x) > 1 for j in range(3)} if len(tri) < 3000 else None
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), hot and len(hot) or 0


def test_statistics(docs, odd_rows):
    for t in [r.text for r in docs.collect()] + [r[1] for r in odd_rows] + ["a b c a b c\n\n a b c\n a b c", "x\r\nx\n x\nx", "é é é é é"]:
        if len(t or "") < 20_000:
            assert tuple(quality_rules.statistics(bytes_of(t or ""))[:5]) == brute_stats(t)


def test_rules_follow_the_labels_they_never_saw(spark):
    from tremor.llm.queries import QUERIES

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.01").collect()]
    clean = [r.kept for r in out if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r.kept for r in out if labels.get(r.doc_id) == 0]
    assert np.mean(clean) > 0.97 and np.mean(junk) < 0.1 and not any(r.kept for r in out if r.base_failed)


def test_rules_of_odd_rows(odd, odd_rows, none):
    out = quality_rules.judged(quality_rules.counted(odd)).collect()
    assert len(out) == len(odd_rows) and not any(r.kept for r in out if r.n_words < 50)
    assert quality_rules.judged(quality_rules.counted(none)).count() == 0


def plain_em(rows, rounds=60):
    """EM text by text: the log odds of good of each row of votes (-1, 0, 1)."""
    k, start = len(rows[0]), [{-1: a, 0: b, 1: g} for a, b, g in quality_rules.START]
    like, prior = [[dict(start[0]), dict(start[1])] for _ in range(k)], 0.8

    def odds(r):
        return np.log(prior / (1 - prior)) + sum(np.log(like[j][0][x] / like[j][1][x]) for j, x in enumerate(r))

    for _ in range(rounds):
        post = [1 / (1 + np.exp(-odds(r))) for r in rows]
        for j in range(k):
            for c in (0, 1):
                sums = {x: 2 * start[c][x] for x in (-1, 0, 1)}
                for r, p in zip(rows, post, strict=True):
                    sums[r[j]] += p if c == 0 else 1 - p
                like[j][c] = {x: n / sum(sums.values()) for x, n in sums.items()}
        prior = (sum(post) + 4) / (len(rows) + 5)
    return [odds(r) for r in rows]


def test_estimate_equals_plain_em_and_decides(spark):
    stats = quality_rules.counted(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    rows = stats.where("not (" + quality_rules.BASE_FAILED + ")").select("doc_id", *(quality_rules.vote(r).alias(r) for r in quality_rules.RULES)).collect()
    want = dict(zip((r[0] for r in rows), plain_em([tuple(r)[1:] for r in rows]), strict=True))
    out = {r.doc_id: r for r in quality_rules.judged(stats).collect()}
    assert all(not r.kept for i, r in out.items() if i not in want)
    for i, z in want.items():
        assert out[i].kept == (z >= 0) and out[i].p_good == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    bad = {r[0]: sum(x == 0 for x in tuple(r)[1:]) for r in rows}
    assert sum(out[i].kept for i in want if bad[i]) > 100  # a rule's fault is not the verdict
    assert any(not out[i].kept for i in want)
    stats.unpersist()


def test_classes_are_told_apart_by_their_votes():
    k = len(quality_rules.RULES)
    odds, ratios = quality_rules.estimate([((0,) * k, 900), ((1,) * k, 100)])
    assert odds < 0 and all(r[1] > 0 > r[0] for r in ratios)
    assert quality_rules.estimate([])[0] > 0


def test_factorisation_identity():
    r = np.random.default_rng(8)
    model = 0.3, r.normal(size=quality_fm.N_FEATURES), r.normal(size=(quality_fm.N_FEATURES, quality_fm.RANK))
    ids, x = quality_fm.features(bytes_of("Some words, some MORE words!"), 28)
    assert ids[-2:].tolist() == [quality_fm.N_FEATURES - quality_fm.N_META + k for k in (3, quality_fm.BINS + 1)]
    assert quality_fm.metadata(bytes_of("é"), 1)[1] < quality_fm.metadata(bytes_of("é"), 2)[1] < quality_fm.metadata(bytes_of("é"), 0)[1]
    pairs = sum(model[2][ids[i]] @ model[2][ids[j]] * x[i] * x[j] for i in range(len(ids)) for j in range(i))
    got = quality_fm.margins(model, np.array([0, len(ids)]), ids, x)[0][0]
    assert got == pytest.approx(0.3 + model[1][ids] @ x + pairs)


def test_quality_held_out(spark):
    from tremor.llm.queries import QUERIES

    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    out = pd.DataFrame([r.asDict() for r in QUERIES["op10_quality_classifier"](spark, d).collect()]).merge(labels, on="doc_id")
    test = out[out.held_out]
    good, bad = test[test.quality == 1].score, test[test.quality == 0].score
    assert (good.values[:, None] > bad.values[None, :]).mean() > 0.97 and set(out.doc_id[out.held_out]) == {i for i in out.doc_id if held(i)}


def test_quality_of_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(1, 1, 0), (10, 1, 0), (13, 0, None), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    out = quality_fm.quality(odd, labels).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.score for r in quality_fm.quality(odd, labels.where("false")).collect()} == {0.5} and quality_fm.quality(none, labels).count() == 0


def test_variety_at_every_length(spark):
    r = np.random.default_rng(6)
    texts = {n: " ".join(f"w{k}" for k in r.permutation(np.arange(n) % 150)) for n in (1000, 1999, 2000, 5000, 50_000)}
    texts[-1] = " ".join(f"w{k}" for k in np.arange(5000) % 2500)
    df = quality_rules.counted(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    got = {x.doc_id: x.v for x in df.select("doc_id", quality_rules.vote("variety").alias("v")).collect()}
    assert got == {n: -1 if n < 0 else 0 for n in texts}
