import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rep long, hub string, key string, comp long, item string, word string, votes string"


def prose(r, n):
    w = "the of and house river stone walk green light open river quiet sound under small".split()
    return " ".join(r.choice(w) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and blank texts, repeated rows and ids, ties, a long text."""
    r = random.Random(4)
    base = prose(r, 80)
    words = base.split()
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \t\n"), (None, base), (None, None), (7, prose(r, 60)), (7, prose(r, 60)), (8, "one two"), (8, "one two"), (9, "One  two"), (10, prose(r, 30_000)),
        (11, "Ünïcödé ñandú 日本語 ​ — …"), (12, "mail a.b@c.example.org or +1 (555) 010-9999, card 4111 1111 1111 1111, ip 10.0.0.1 and 999.1.1.1 token = abcdef0123456789abcdef0123456789abcdef01"),
        (13, "12345 !!! ### 67"), (14, "Licensed under the Apache License, Version 2.0."), (15, "A\x00B <|endoftext|> don't"),
    ]
    return [(i, t, "en" if i and i % 2 else None, None, None, "x", None, "h", "k", 1, None, "w", "v") for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
