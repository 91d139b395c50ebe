DATA = "/root/testdata/sf0.001"


def plain(rows):
    """Rows as sorted tuples of text, for comparison."""
    return sorted(tuple("None" if v is None or v != v else str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)


def same(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert plain(df.select(*cols).collect()) == plain(rel.select(*(f'"{c}"' for c in cols)).fetchall())
