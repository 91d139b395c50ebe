"""License scans over a positional rare-token index (operator 8), in SQL functions only.

Notices are templates of some words; the index holds, for every template, its words with their positions, rarest
first by their document frequency over all documents. A file's licence words are looked up there: of a template
all of whose key words the file has, and of the
words that it shares with a template, the ``RARE`` of highest inverse document frequency are taken, their
postings in file and template give implied starts, and a place comes up only where two different
words imply nearly the same start (at most ``SLACK`` apart, so words may be inserted or lost between
them). At each such place all mandatory key phrases must stand, word by word, and the template words
found within ``SLACK`` of their positions must carry at least ``COVER`` of the template's weight. The score
is the best such share. Base phrases are looked up by position in the same way, but exactly, and always give
their labels (score 1).

Edge cases: null, empty and wordless texts have 0 words, no labels, empty strings and score 0; first_word
and last_word are null without a base place; rows that repeat and null doc_ids are scanned row by
row; an empty table gives no rows; extra columns of any name but ``_lic`` and the new ones (n_words, base, found)
pass through; long texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.workspace import documents

RARE, SLACK, COVER = 5, 4, 0.5
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Fixed base phrases: label, words, the word to look up.
BASE = [("mit", "under the mit license", "license"), ("apache-2", "apache license version 2", "apache"), ("cc-by-nc", "cc by nc", "nc")]
#: Label, notice, mandatory key phrases. The wording is that of the public licence texts.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "this project is licensed under the terms of the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["free of charge", "any person obtaining a copy"],
    ),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    (
        "apache-2",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ["apache org licenses"],
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    (
        "gpl-3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu general public license", "version 3"],
    ),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    (
        "gpl-2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ["gnu general public license", "version 2"],
    ),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ["gnu lesser general public license", "version 3"]),
    ("lgpl-2", "licensed under the gnu lesser general public license version 2 1", ["gnu lesser general public license", "version 2"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license", "v 2"]),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ["mozilla public license", "version 2"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license version 2 0", ["eclipse public license"]),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ["source and binary forms", "with or without modification"],
    ),
    ("bsd", "released under the bsd license", ["bsd license"]),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee"],
    ),
    (
        "zlib",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ["including commercial applications", "redistribute it freely"],
    ),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc0", "dedicated to the public domain under creative commons cc0 1 0 universal", ["cc0 1 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("gpl-3", "under gpl v3", ["gpl v3"]),
    ("gpl-2", "under gpl v2", ["gpl v2"]),
    ("bsd", "a bsd style license", ["bsd style license"]),
    (
        "mit",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        ["warranty of any kind express or implied", "authors or copyright holders be liable"],
    ),
]
#: Short names that a file may declare in a line of its own.
DECLARED = {"mit": "mit", "apache-2": "apache 2", "gpl-2": "gpl 2", "gpl-3": "gpl 3", "lgpl-2": "lgpl 2", "lgpl-3": "lgpl 3", "agpl-3": "agpl 3", "mpl-2": "mpl 2", "epl-2": "epl 2", "bsd": "bsd", "isc": "isc", "zlib": "zlib", "boost": "bsl 1", "unlicense": "unlicense", "cc0": "cc0 1"}
TEMPLATES += [(label, f"spdx license identifier {name}", [f"license identifier {name}"]) for label, name in DECLARED.items()]
VOCABULARY = sorted({w for _, t, _ in TEMPLATES for w in t.split()} | {w for _, p, _ in BASE for w in p.split()})


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def lowered(w: Column) -> Column:
    """A-Z only, word by word."""
    return F.transform(w, lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many have each word; few rows come back."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.array_intersect(lowered(words(text)), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("w")).groupBy("w").count()
    got = {r[0]: r[1] for r in counts.collect()}
    return got.pop("", 0), got


def _at(w: Column, start: Column, k: int) -> Column:
    """Word k after ``start``; null outside."""
    return F.try_element_at(w, F.when(start + k >= 0, start + k + 1))


def _quoted(x: str) -> str:
    return "'" + x + "'"


def index_of(idf: dict[str, float]) -> str:
    """The templates as a SQL array: label, size, distinct words by rank, postings (rank, place, weight), key phrases."""
    rank = {w: k for k, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
    rows = []
    for label, notice, keys in TEMPLATES:
        ws = notice.split()
        whole = sum(idf[w] for w in ws)
        postings = ", ".join(f"named_struct('r', {rank[w]}, 'p', {p}, 'idf', {idf[w] / whole!r}D, 'w', {_quoted(w)})" for p, w in enumerate(ws))
        own = ", ".join(str(r) for r in sorted({rank[w] for w in ws}))
        need = ", ".join(str(r) for r in sorted({rank[w] for k in keys for w in k.split()}))
        rows.append(f"named_struct('label', {_quoted(label)}, 'size', {len(ws)}, 'ranks', array({own}), 'need', array({need}), 'postings', array({postings}), 'keys', array({', '.join(_quoted(f' {k} ') for k in keys)}))")
    return f"array({', '.join(rows)})"


#: Of the words w, the hits (r, i) and a template t: places where two of the file's rarest words of t agree.
_IMPLIED = """array_sort(flatten(transform(filter(hits, h -> array_contains(slice(array_intersect(t.ranks, own), 1, {rare}), h.r)),
  h -> transform(filter(t.postings, x -> x.r = h.r), x -> named_struct('start', h.i - x.p, 'r', h.r)))))"""
_PLACES = """array_distinct(filter(transform(a, (x, k) -> IF(k > 0 AND a[k - 1].r <> x.r AND x.start - a[k - 1].start <= {slack}, x.start, NULL)), x -> x IS NOT NULL))"""
#: At a place s: the share of the template's weight that stands near its position, or 0 without the key phrases.
_COVER = """IF(forall(t.keys, k -> contains(concat(' ', array_join(slice(w, greatest(s - {slack}, 0) + 1, t.size + 2 * {slack}), ' '), ' '), k)),
  least(aggregate(t.postings, 0D, (z, x) -> z + IF(s + x.p + {slack} >= 0 AND array_contains(slice(w, greatest(s + x.p - {slack}, 0) + 1, {slack} + 1 + least({slack}, s + x.p)), x.w), x.idf, 0D)), 1D), 0D)"""


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, base (label, start), found (label, cover)."""
    total, df = frequencies(docs.select("text"), VOCABULARY)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in VOCABULARY}
    by_rank = sorted(idf, key=lambda w: (-idf[w], w))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("_lic"), lowered(words(F.col("text"))).alias("w"))
    rows = rows.select("_lic", F.size("w").cast("long").alias("n_words"), "w")
    w = F.col("w")
    hit = F.filter(F.transform(w, lambda x, i: F.when(x.isin(by_rank), F.struct((F.array_position(F.array(*map(F.lit, by_rank)), x) - 1).cast("int").alias("r"), i.alias("i")))), lambda x: x.isNotNull())
    rows = rows.withColumn("hits", hit).withColumn("own", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["r"]))))

    def base_places(label: str, phrase: str, anchor: str) -> Column:
        ws = phrase.split()
        shift = ws.index(anchor)
        starts = F.transform(F.filter("hits", lambda h: h["r"] == by_rank.index(anchor)), lambda h: h["i"] - shift)

        def stands(s: Column) -> Column:
            ok = F.lit(True)
            for k, x in enumerate(ws):
                ok = ok & F.coalesce(_at(w, s, k) == x, F.lit(False))
            return ok

        return F.transform(F.filter(starts, stands), lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))

    rows = rows.withColumn("base", F.concat(*(base_places(*b) for b in BASE)))
    places = f"transform(array({_IMPLIED.format(rare=RARE)}), a -> {_PLACES.format(slack=SLACK)})[0]"
    judged = f"transform({places}, s -> named_struct('label', t.label, 'cover', {_COVER.format(slack=SLACK)}))"
    each = f"transform(filter({index_of(idf)}, t -> size(array_except(t.need, own)) = 0 AND size(array_intersect(t.ranks, own)) > 1), t -> {judged})"
    found = F.expr(f"IF(size(own) > 1, filter(flatten({each}), x -> x.cover >= {COVER}), CAST(array() AS array<struct<label:string,cover:double>>))")
    return rows.select("_lic.*", "n_words", "base", found.alias("found"))


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    s = scan(documents(spark, sf_dir).select("doc_id", "text"))
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    base = F.array_distinct(F.transform("base", lambda b: b["label"]))
    both = F.array_distinct(F.concat(base, F.transform("found", lambda f: f["label"])))
    best = F.array_max(F.transform("found", lambda f: f["cover"]))
    return s.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(both), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.round(best, 6), F.lit(0.0))).alias("score"),
    )
