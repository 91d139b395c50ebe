import subprocess

import pytest
from pyspark.sql import functions as F

from tremor.functions.checkpoints import cut
from tremor.operators import graph, match, parse, patch, propagate, seeds
from tremor.sources import documents, git, sinks


def sh(repo, *args):
    return subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, text=True).stdout.strip()


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("repo")
    sh(r, "init", "-q", "-b", "main")
    pkg = r / "pkg"
    pkg.mkdir()
    (pkg / "__init__.py").write_text("def boot():\n    return 1\n")
    (pkg / "a.py").write_text("from pkg import b\n\n\ndef top():\n    return b.low()\n\n\ndef gone():\n    pass\n")
    (pkg / "b.py").write_text("def low():\n    x = 1\n    return x\n")
    (pkg / "bad.py").write_text("def (\n")
    (r / "tests").mkdir()
    (r / "tests" / "test_b.py").write_text("from pkg.b import low\n\n\ndef test_low():\n    assert low()\n")
    sh(r, "add", "-A")
    sh(r, "commit", "-qm", "one")
    (pkg / "b.py").write_text("def low():\n    x = 2\n    return x\n")
    (pkg / "a.py").write_text("from pkg import b\n\n\ndef top():\n    return b.low()\n")
    (pkg / "é.py").write_text("def neu():\n    pass\n")
    sh(r, "add", "-A")
    sh(r, "commit", "-qm", "two")
    return str(r)


def test_git_source(spark, repo):
    commits = git.read(spark, repo, "commits").orderBy("ord").collect()
    assert len(commits) == 2 and commits[0].parent == commits[1].commit and commits[1].parent is None
    files = {f.path: f.source for f in git.read(spark, repo, "files", commits=commits[0].commit).collect()}
    assert {"pkg/__init__.py", "pkg/é.py", "tests/test_b.py", "pkg/bad.py"} <= set(files) and "x = 2" in files["pkg/b.py"]
    blobs = {b.path: b.source for b in git.read(spark, repo, "blobs", commits=commits[0].commit, paths="pkg/b.py,nope.py").collect()}
    assert blobs["nope.py"] is None and blobs["pkg/b.py"] == files["pkg/b.py"]
    work = git.read(spark, repo, "files", commits=commits[0].commit, snapshot="worktree").count()
    assert work == len(files)


def test_seeds_to_impact(spark, repo):
    head = sh(repo, "rev-parse", "HEAD")
    diffs = cut(git.read(spark, repo, "diffs", commits=head).select("commit", "diff"))
    new = cut(git.read(spark, repo, "files", commits=head))
    old = cut(git.read(spark, repo, "files", commits=f"{head}^").withColumn("commit", F.lit(head)))
    found = cut(seeds.extract_seeds(diffs, new, old))
    rows = {(s.qualname, s.version): s for s in found.collect()}
    assert rows[("pkg.b.low", "new")].old_code.endswith("x = 1\n    return x") and rows[("pkg.b.low", "new")].new_code.endswith("x = 2\n    return x")
    assert ("pkg.a.gone", "old") in rows and ("pkg.é.neu", "new") in rows
    nodes, edges = graph.build(cut(parse.parse_defs(new)), cut(parse.parse_calls(new)), cut(parse.parse_bases(new)), ["pkg"])
    resolved = match.resolve_callers(cut(edges), cut(nodes)).selectExpr("caller", "qualname as callee")
    hit = {x.qualname: x.hop for x in propagate.impact(resolved, seeds.in_scope(found)).collect()}
    assert hit["pkg.b.low"] == 0 and hit["pkg.a.top"] == 1 and hit["tests.test_b.test_low"] == 1
    doc = seeds.seeds_document(found, diffs, git.read(spark, repo, "commits", commits=head), "r").first()
    assert doc.num_seeds == found.count() and doc.num_py_files_in_diff == 3


def test_patch_applies(spark, repo, tmp_path):
    head = sh(repo, "rev-parse", "HEAD")
    files = git.read(spark, repo, "files", commits=head).select("commit", "path", "source")
    edits = spark.createDataFrame([(head, "pkg/b.py", "pkg.b.low", ['"""Low."""']), (head, "pkg/bad.py", "pkg.bad.x", ['"""x"""'])], "commit string, path string, qualname string, docstring_lines array<string>")
    done = patch.apply_patches(files, edits)
    assert {r.qualname: r.status for r in done.collect()} == {"pkg.b.low": "inserted", "pkg.bad.x": "syntax_error"}
    (tmp_path / "p.diff").write_text(patch.patch_text(done).first().patch)
    subprocess.run(["git", "-C", repo, "apply", "--check", str(tmp_path / "p.diff")], check=True)


def test_stream_of_commits(spark, repo):
    git.register(spark)
    stream = spark.readStream.format("git").option("repo", repo).option("kind", "commits").load()
    q = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("seen").count() == 2


def test_documents(spark, tmp_path):
    (tmp_path / "commits.txt").write_text("# list\nabc first\n\n  def\n")
    assert [r.commit for r in documents.commit_list(spark, str(tmp_path / "commits.txt")).orderBy("ord").collect()] == ["abc", "def"]
    (tmp_path / "log.jsonl").write_text('{"commit":"a","mode":"template","ok":true}\n{bad\n\n{"commit":"b"}\n')
    assert [r.commit for r in documents.resume_rows(spark, str(tmp_path / "log.jsonl")).collect()] == ["a"]
    rows = spark.createDataFrame([("a", 1)], "commit string, n int")
    sinks.append_log(rows, str(tmp_path / "out"))
    sinks.append_log(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    sinks.csv_summary([rows, spark.createDataFrame([("b", 2.0)], "commit string, z double")], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["commit", "n", "z"]
    sinks.json_documents(rows, str(tmp_path / "json"))
    sinks.text(rows, "commit", str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).first().value == "a"
    assert documents.settings().get("api_key") is None


def test_stream_reads_what_the_branch_gained(spark, tmp_path):
    import os

    r = tmp_path / "r"
    r.mkdir()
    sh(r, "init", "-q", "-b", "main")

    def step(name, date):
        (r / f"{name}.py").write_text(f"def {name}():\n    pass\n")
        sh(r, "add", "-A")
        os.environ["GIT_COMMITTER_DATE"] = date
        try:
            sh(r, "commit", "-qm", name, "--date", date)
        finally:
            del os.environ["GIT_COMMITTER_DATE"]
        return sh(r, "rev-parse", "HEAD")

    def read_new():
        git.register(spark)
        q = spark.readStream.format("git").option("repo", str(r)).option("kind", "commits").option("branch", "main").load().writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return [x.commit for x in spark.read.schema("ord int, commit string, parent string").json(str(tmp_path / "out")).collect()]

    one = step("one", "2020-01-01T00:00:00")
    sh(r, "checkout", "-q", "-b", "side")
    old = step("old", "2020-01-02T00:00:00")  # made before what the first trigger reads
    sh(r, "checkout", "-q", "main")
    two = step("two", "2020-02-01T00:00:00")
    assert sorted(read_new()) == sorted([one, two])
    sh(r, "merge", "-q", "--no-ff", "-m", "merge", "side")
    merge = sh(r, "rev-parse", "HEAD")
    assert sorted(read_new()) == sorted([one, two, old, merge])  # each once
    assert sorted(read_new()) == sorted([one, two, old, merge])


def test_a_batch_that_runs_again_replaces_its_rows(spark, repo, tmp_path):
    from tremor.plans import workflow
    from tremor.streaming import commits

    ids = sh(repo, "rev-list", "--reverse", "HEAD").split()
    out = str(tmp_path / "out")
    for number, part in ((0, ids[:1]), (1, ids[1:]), (1, ids[1:]), (2, ids)):  # the second again; the branch set back
        commits.write_batch(spark, repo, part, number, out, workflow.Options())
    assert sorted(r.commit for r in sinks.read_log(spark, f"{out}/batch").collect()) == sorted(ids)
    impacted = spark.read.parquet(f"{out}/impacted")
    assert impacted.count() == impacted.select("commit", "qualname").distinct().count() > 0


def test_a_job_keeps_its_spacing_over_all_tasks(spark):
    import time

    from tremor.operators import generate

    paced = generate.Paced(lambda p: str(time.time()), 0.15, 4)
    prompts = spark.range(12).select(F.col("id").cast("string").alias("prompt"))
    times = sorted(float(r.answer) for r in generate.call_generator(prompts, paced).collect())
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert len(times) == 12 and min(gaps) > 0.1


def test_patches_are_made_by_batch_and_in_more_than_one_task(spark):
    n = 300
    files = spark.createDataFrame([("c", f"m{k}.py", "def f(a):\n    return a\n\n\ndef g():\n    pass\n") for k in range(n)], "commit string, path string, source string")
    edits = spark.createDataFrame([("c", f"m{k}.py", f"m{k}.{f}", ['"""Of a."""']) for k in range(n) for f in "fg"], "commit string, path string, qualname string, docstring_lines array<string>")
    done = patch.apply_patches(files, edits)
    checked = patch.verify(done)
    for df, rows in ((done, 2 * n), (checked, 2 * n)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
        assert df.count() == rows and df.select(F.spark_partition_id()).distinct().count() > 1
    assert {r[0] for r in done.select("status").distinct().collect()} == {"inserted"} and checked.where("ok").count() == 2 * n
