"""Interval tables against the plain operations at every ordinal, and a repository's graph against each commit's."""

import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tremor.functions.checkpoints import cut
from tremor.operators import graph, parse, propagate, temporal
from tremor.sources import git, parsed

LAST = 12


def held(df, *columns):
    """Rows with their columns at every ordinal where they hold."""
    return {(o, *(r[c] for c in columns)) for r in df.collect() for o in range(r.since, r.until + 1)}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)

    def one(n):
        rows = []
        for _ in range(n):
            a = r.randrange(LAST + 1)
            rows.append((r.choice("klm"), r.choice("xyz"), a, min(LAST, a + r.randrange(6))))
        return rows

    return [spark.createDataFrame(one(n), "k string, v string, since int, until int") for n in (40, 6)]


def test_operations_equal_the_plain_ones_everywhere(tables):
    a, b = tables
    c = temporal.coalesce(a, ["k", "v"])
    assert held(c, "k", "v") == held(a, "k", "v") and c.count() <= a.count()
    runs = sorted((r.k, r.v, r.since, r.until) for r in c.collect())
    assert all(x[:2] != y[:2] or x[3] + 1 < y[2] for x, y in zip(runs, runs[1:]))
    w = b.withColumnRenamed("v", "w")
    assert held(temporal.join(a, w, ["k"]), "k", "v", "w") == {(o, k, v, x) for o, k, v in held(a, "k", "v") for p, j, x in held(b, "k", "v") if (o, k) == (p, j)}
    assert held(temporal.subtract(a, b, ["k"]), "k", "v") == {(o, k, v) for o, k, v in held(a, "k", "v") if (o, k) not in held(b, "k")}
    for greatest, pick in ((False, min), (True, max)):
        rows = held(a, "k", "v")
        assert held(temporal.best(a, ["k"], ["v"], greatest), "k", "v") == {(o, k, pick(v for p, j, v in rows if (p, j) == (o, k))) for o, k, _ in rows}


def sh(repo, *args):
    return subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, text=True).stdout.strip()


def history(repo, n, files, r):
    """Commits that each rewrite, remove or add one file."""
    sh(repo, "init", "-q", "-b", "main")
    (repo / "lib").mkdir()

    def text():
        base = r.choice(["", "(Base)", "(lib.m0.K)", "(K)", "(Sub)"])
        body = "".join(f"    def {r.choice('abc')}{k}(self):\n        return {r.choice(['self.a0()', 'self.b0()', 'self.c0()', 'f0()', 'queue.put()', 'g()'])}\n" for k in range(r.randrange(1, 3)))
        return f"from lib.m{r.randrange(files)} import f0 as g\n\n\nclass {r.choice(['K', 'Base', 'Sub'])}{base}:\n{body}\n\ndef f{r.randrange(2)}():\n    return g(), K.a0()\n"

    for k in range(files):
        (repo / f"lib/m{k}.py").write_text(text())
    (repo / "late.py").write_text("def go():\n    return queue.put()\n")  # the repository's own from the middle on
    ids = []
    for k in range(n):
        path = repo / f"lib/m{r.randrange(files)}.py"
        if k and r.random() < 0.25 and path.exists():
            path.unlink()
        else:
            path.write_text(text())
        if k == n // 2:
            (repo / "queue.py").write_text("def put():\n    pass\n")
        sh(repo, "add", "-A")
        sh(repo, "commit", "-q", "--allow-empty", "-m", str(k))
        ids.append(sh(repo, "rev-parse", "HEAD"))
    return ids


def test_a_repository_s_graph_is_each_commit_s(spark, tmp_path):
    ids = history(tmp_path, 9, 5, random.Random(5))
    wanted = ",".join(ids)
    changes = cut(git.read(spark, str(tmp_path), "changes", commits=wanted))
    files = cut(temporal.intervals(changes, len(ids) - 1))
    trees = cut(git.read(spark, str(tmp_path), "trees", commits=wanted).withColumnRenamed("ord", "n"))
    assert held(files, "path", "blob") == {(r.n, r.path, r.blob) for r in trees.collect()}
    assert files.count() <= 6 + 9 + 1 < trees.count()
    store = parsed.ParseStore(spark, str(tmp_path))
    assert store.refresh(files) == files.select("path", "blob").distinct().count()
    defs, calls, bases = (cut(store.table(files, kind)) for kind in ("defs", "calls", "bases"))
    top = lambda d, *c: d.select(F.regexp_replace(F.element_at(F.split("path", "/"), 1), r"\.py$", "").alias("top"), *c)
    nodes, edges = temporal.build(defs, calls, bases, top(files, "since", "until"))
    nodes, edges = cut(nodes), cut(edges)
    d, c, b = (cut(store.table(trees, kind)) for kind in ("defs", "calls", "bases"))
    plain_nodes, plain_edges = graph.build(d, c, b, top(trees, "n"), ("n",))
    assert held(nodes, "qualname") == {(r.n, r.qualname) for r in plain_nodes.collect()}
    assert held(edges, "caller", "callee", "edge_type") == {(r.n, r.caller, r.callee, r.edge_type) for r in plain_edges.collect()}
    assert {r.edge_type for r in edges.collect()} == {"CALLS", "OVERRIDES"} and [(r.since, r.until) for r in edges.collect() if (r.caller, r.callee) == ("late.go", "queue.put")] == [(4, 8)]
    defined = temporal.nodes_of(defs.select("qualname", "since", "until"))
    more = temporal.inheritance_edges(defined, edges.where("edge_type = 'CALLS'"), bases)  # with definitions alone as nodes
    plain_more = graph.inheritance_edges(d.select("n", "qualname").distinct(), plain_edges.where("edge_type = 'CALLS'"), b, ("n",))
    assert held(more, "caller", "callee", "edge_type") == {(r.n, r.caller, r.callee, r.edge_type) for r in plain_more.collect()}
    assert "INHERITS" in {r.edge_type for r in more.collect()}
    seeds = cut(edges.where("callee like 'lib.%f0'").withColumnRenamed("callee", "qualname").groupBy().agg(F.min("qualname").alias("qualname")).crossJoin(spark.range(len(ids)).select(F.col("id").cast("int").alias("ord"))))
    for direction in ("callers", "both"):
        walked = {tuple(r) for r in propagate.impact(edges, seeds, 3, direction, at="ord").select("ord", "qualname", "hop", "source", "reason").collect()}
        plain = {tuple(r) for r in propagate.impact(plain_edges, seeds.withColumnRenamed("ord", "n"), 3, direction, by=("n",)).select("n", "qualname", "hop", "source", "reason").collect()}
        assert walked == plain and len(walked) > len(ids)


def test_store_reads_what_it_has_not(spark, tmp_path):
    (tmp_path / "r").mkdir()
    ids = history(tmp_path / "r", 4, 6, random.Random(1))
    tree = lambda c: cut(git.read(spark, str(tmp_path / "r"), "trees", commits=c).drop("ord"))
    store = lambda: parsed.ParseStore(spark, str(tmp_path / "r"), 2, str(tmp_path / "store"))
    first = store().refresh(tree(ids[1]))
    assert first == tree(ids[1]).count()
    changed = git.read(spark, str(tmp_path / "r"), "changes", commits=f"{ids[1]},{ids[2]}").where("ord = 1 and blob is not null").count()
    assert store().refresh(tree(ids[2])) == changed <= 2  # of all files of the next commit
    assert store().refresh(tree(",".join(ids[1:3]))) == 0
    (tmp_path / "store" / "level2" / "broken").mkdir()  # a run that died: no _SUCCESS
    (tmp_path / "store" / "level2" / "broken" / "part-0.parquet").write_text("x")
    files = git.read(spark, str(tmp_path / "r"), "files", commits=ids[2])
    got = lambda kind: sorted(map(repr, store().table(tree(ids[2]), kind).select(*[x for x in WANT[kind]]).collect()))
    for kind, parser in (("defs", parse.parse_defs), ("calls", lambda f: parse.parse_calls(f, 2)), ("bases", parse.parse_bases)):
        assert got(kind) == sorted(map(repr, parser(files).select(*WANT[kind]).collect()))
    store().compact()
    assert len(store().generations()) == 1 and store().refresh(tree(ids[2])) == 0 and got("defs")


WANT = {"defs": ["commit", "path", "qualname", "lineno", "params", "docstring"], "calls": ["commit", "path", "caller", "callee", "line"], "bases": ["commit", "path", "child", "ord", "base"]}


def test_contents_are_read_once_a_blob(spark, tmp_path):
    ids = history(tmp_path, 3, 3, random.Random(2))
    trees = git.read(spark, str(tmp_path), "trees", commits=",".join(ids))
    got = {(r.commit, r.path): r.source for r in git.contents(trees, str(tmp_path)).collect()}
    assert got == {(r.commit, r.path): r.source for r in git.read(spark, str(tmp_path), "files", commits=",".join(ids)).collect()}
    assert git.contents(trees.select("commit", "path", F.lit("0" * 40).alias("blob")), str(tmp_path)).where("source is not null").count() == 0


def test_windows_of_intervals_are_dealt_over_all_partitions_and_by_narrow_keys(spark):
    from helpers import DATA

    from tremor.plans import catalogue

    plan = catalogue.temporal_edges(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
    assert "concat" not in plan[plan.index("Window") :]  # names are made after the window, not carried through it
