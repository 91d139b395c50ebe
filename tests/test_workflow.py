import subprocess

import pytest

from tremor.__main__ import main
from tremor.plans import workflow


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    r = tmp_path_factory.mktemp("flow")
    git = lambda *a: subprocess.run(["git", "-C", str(r), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "main")
    (r / "pkg").mkdir()
    (r / "pkg" / "__init__.py").write_text("")
    (r / "pkg" / "b.py").write_text("def low(a, *b):\n    return a\n")
    (r / "pkg" / "a.py").write_text("from pkg.b import low\n\n\ndef top(x):\n    return low(x)\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    (r / "pkg" / "b.py").write_text("def low(a, *b):\n    return a + 1\n")
    git("commit", "-qam", "two")
    return str(r)


def test_run_end_to_end(spark, repo, tmp_path):
    out = workflow.run(spark, repo, n=1)
    assert {(r.qualname, r.hop) for r in out["impacted"].collect()} == {("pkg.b.low", 0), ("pkg.a.top", 1)}
    assert {r.qualname for r in out["targets"].collect()} == {"pkg.b.low", "pkg.a.top"}
    row = out["batch"].first()
    assert row.verifier_ok and row.num_targets == row.num_changed_targets == 2 and row.num_files_changed == 2 and row.impacted_internal == 2
    (tmp_path / "p.diff").write_text(out["patches"].first().patch)
    subprocess.run(["git", "-C", repo, "apply", "--check", str(tmp_path / "p.diff")], check=True)


def test_command_line(spark, repo, tmp_path):
    main(["propagate", "--repo", repo, "--out", str(tmp_path / "p"), "--n", "1", "--mode", "typed"], spark)
    got = spark.read.option("multiLine", True).json(str(tmp_path / "p")).count()
    assert got >= 1
    main(["extract-seeds", "--repo", repo, "--out", str(tmp_path / "s"), "--n", "1"], spark)
    assert "pkg.b.low" in "".join(r.value for r in spark.read.text(str(tmp_path / "s")).collect())


def test_follow_new_commits(spark, repo, tmp_path):
    from tremor.streaming import commits

    for _ in range(2):  # the second start finds nothing new
        commits.follow(spark, repo, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    rows = spark.read.json(str(tmp_path / "out" / "batch"))
    assert rows.count() == 2 and spark.read.parquet(str(tmp_path / "out" / "impacted")).select("commit").distinct().count() == 2


def test_module_changes_and_pages(spark, repo):
    diffs = spark.createDataFrame([("c1", "@@ LIMIT = 2"), ("c2", "x")], "commit string, diff string")
    seeds = spark.createDataFrame([("c1", "module", "code_change"), ("c2", "module", "code_change")], "commit string, kind string, seed_type string")
    nodes = spark.createDataFrame([("c1", "m.f", "function"), ("c1", "m.C", "class"), ("c2", "m.f", "function")], "commit string, qualname string, kind string")
    chosen = spark.createDataFrame([("c2",)], "commit string")
    answer = '[AFFECTED_FUNCTIONS][{"qualname":"m.f","path":"m.py","reason":"uses LIMIT"},{"qualname":"m.nope"}][/AFFECTED_FUNCTIONS]'
    got = workflow.module_changes(diffs, seeds, chosen, nodes, lambda p: answer if "LIMIT" in p and "m.f" in p else "").collect()
    assert [(r.commit, r.qualname, r.reason) for r in got] == [("c1", "m.f", "uses LIMIT")]
    speak = lambda p: "[DOCSTRING]Spoken. a b x[/DOCSTRING][ANALYSIS]calls[/ANALYSIS]"
    out = workflow.run(spark, repo, n=1, options=workflow.Options(mode="llm"), generator=speak)
    assert out["report"].first().ok and "Spoken." in out["patches"].first().patch and out["readmes"].count() == 1


def test_module_changes_see_everything(spark):
    names = [f"a.f{k:03}" for k in range(250)] + ["z.late"]
    diff = "+x = 1\n" * 3000 + "+LIMIT = 2\n"
    source = "pad = 0\n" * 3000 + "def late(): return LIMIT\n"
    diffs = spark.createDataFrame([("c1", diff)], "commit string, diff string")
    seeds = spark.createDataFrame([("c1", "z.py", "module", "code_change")], "commit string, path string, kind string, seed_type string")
    nodes = spark.createDataFrame([("c1", n[0] + ".py", n, "function") for n in names], "commit string, path string, qualname string, kind string")
    files = spark.createDataFrame([("c1", "z.py", source), ("c1", "a.py", "")], "commit string, path string, source string")
    chosen = spark.createDataFrame([], "commit string")
    answer = '[AFFECTED_FUNCTIONS][{"qualname":"z.late"},{"qualname":"a.f001"}][/AFFECTED_FUNCTIONS]'
    sees = lambda p: answer if "LIMIT = 2" in p and "return LIMIT" in p and "z.late" in p else ""
    for size in (100_000, 9000):  # one prompt, several
        got = workflow.module_changes(diffs, seeds, chosen, nodes, lambda p, size=size: sees(p) if len(p) < size + 500 else "", files, size).collect()
        assert [(r.commit, r.qualname) for r in got] == [("c1", "z.late")]
    text = spark.range(1).select(workflow._pieces(workflow.F.lit(diff + "y" * 50), 20).alias("p")).first().p
    assert "".join(text) == diff + "y" * 50 and max(map(len, text)) <= 20


def speak(prompt):
    """A generator that tells which prompt it was given."""
    kind = "diff" if "Before:" in prompt and "return a + 1" in prompt and "return a\n" in prompt else "impact"
    return f"[DOCSTRING]Spoken {kind}. a b x[/DOCSTRING][ANALYSIS]calls[/ANALYSIS]"


def test_generator_from_the_command_line(spark, repo, tmp_path):
    main(["run", "--repo", repo, "--out", str(tmp_path), "--n", "1", "--mode", "llm", "--generator", "test_workflow:speak"], spark)
    patch = "\n".join(r.value for r in spark.read.text(str(tmp_path / "patch")).collect())
    assert "Spoken diff." in patch and "Spoken impact." in patch  # the changed function is shown before and after
    with pytest.raises(SystemExit):
        main(["run", "--repo", repo, "--out", str(tmp_path), "--n", "1", "--mode", "llm"], spark)


def test_zero_hops_and_a_batch_that_starts_anew(spark, repo, tmp_path):
    main(["propagate", "--repo", repo, "--out", str(tmp_path / "p"), "--n", "1", "--max-hops", "0"], spark)
    assert [r.qualname for r in spark.read.option("multiLine", True).json(str(tmp_path / "p")).collect()] == ["pkg.b.low"]
    batch = ["batch", "--repo", repo, "--out", str(tmp_path / "b"), "--n", "1"]
    main([*batch, "--resume"], spark)  # nothing to resume from
    main([*batch, "--resume"], spark)  # nothing left to do
    assert spark.read.json(str(tmp_path / "b" / "summary.jsonl")).count() == 1
    main(batch, spark)
    assert spark.read.json(str(tmp_path / "b" / "summary.jsonl")).count() == 1


def test_style_is_sampled_in_each_commit(spark):
    from tremor.operators import style

    files = spark.range(60).selectExpr("concat('c', id) AS commit").crossJoin(spark.range(80).selectExpr("concat('f', id, '.py') AS path"))
    defs = files.selectExpr("commit", "path", "'Do it.\\n\\nArgs:\\n    a: x' AS docstring")
    got = style.docstring_corpus(files, defs).groupBy("commit").count().collect()
    assert len(got) == 60 and {r["count"] for r in got} == {50}


def test_commits_together_are_as_each_alone(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "main")
    low = "def low(a):\n    return {}\n"
    steps = [
        {"lib/b.py": low.format("a"), "lib/a.py": "from lib.b import low\n\n\ndef top(x):\n    return low(x)\n"},
        {"lib/b.py": low.format("a + 1"), "queue/q.py": "from lib.b import low\n\n\ndef put(x):\n    return low(x)\n\n\ndef twice(x):\n    return put(put(x))\n"},
        {"lib/a.py": "def top(x):\n    return x\n", "queue/q.py": "def put(x):\n    return x + 1\n\n\ndef twice(x):\n    import queue.q\n\n    return queue.q.put(x)\n"},
        {"lib/b.py": low.format("a + 2")},
    ]
    ids = []
    for files in steps:
        for path, text in files.items():
            (tmp_path / path).parent.mkdir(exist_ok=True)
            (tmp_path / path).write_text(text)
        git("add", "-A")
        git("commit", "-qm", "step")
        ids.append(git("rev-parse", "HEAD"))
    rows = lambda out: {t: sorted(map(repr, out[t].drop("ast_parse_calls").collect())) for t in ("impacted", "targets", "patches", "batch")}  # noqa: E731 (a content that commits share is parsed once)
    options = workflow.Options(limit_targets=2)
    together = rows(workflow.run(spark, str(tmp_path), ids[1:], options=options))
    alone = [rows(workflow.run(spark, str(tmp_path), [c], options=options)) for c in ids[1:]]
    assert together == {t: sorted(r for one in alone for r in one[t]) for t in together}
    assert len(together["batch"]) == 3 and len({len(one["impacted"]) for one in alone}) > 1


def echo(prompt):
    """Tells the code it was shown, and passes on what it was told of the caller's source."""
    import re

    told = re.findall(r"seen<(.*?)>", prompt, re.S)
    number = re.findall(r"return a \+ (\d)", prompt)
    return f"[DOCSTRING]Doc {told} {number}. a x[/DOCSTRING][ANALYSIS]seen<{number or told}>[/ANALYSIS]"


def test_commits_together_are_as_each_alone_in_llm_mode(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q", "-b", "main")
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.py").write_text("from lib.b import low\n\n\ndef top(x):\n    return low(x)\n")
    ids = []
    for n in range(3):
        (tmp_path / "lib/b.py").write_text(f"def low(a):\n    return a + {n}\n")
        git("add", "-A")
        git("commit", "-qm", "step")
        ids.append(git("rev-parse", "HEAD"))
    options = workflow.Options(mode="llm")
    rows = lambda ids: sorted((r.commit, r.patch) for r in workflow.run(spark, str(tmp_path), ids, options=options, generator=echo)["patches"].collect())
    together = rows(ids[1:])
    assert together == sorted(sum((rows([c]) for c in ids[1:]), []))
    for n, c in enumerate(ids[1:]):  # the caller heard of its own commit's change
        assert f"'{n}', '{n + 1}'" in dict(together)[c] and f"'{1 - n}', '{2 - n}'" not in dict(together)[c]


def test_a_killed_batch_goes_on_with_its_open_chunk(spark, tmp_path, monkeypatch):
    from tremor.sources import documents, sinks

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    (tmp_path / "r").mkdir()
    git("init", "-q", "-b", "main")
    ids = []
    for n in range(5):
        (tmp_path / "r" / "b.py").write_text(f"def low(a):\n    return a + {n}\n")
        git("add", "-A")
        git("commit", "-qm", "step")
        ids.append(git("rev-parse", "HEAD"))
    listed, log, real, seen = workflow.commits_of(spark, str(tmp_path / "r"), ids), str(tmp_path / "log"), workflow.run, []

    def dies(spark, repo, commits, **more):
        seen.append(commits)
        if commits == ids[2:4]:
            raise KeyboardInterrupt  # as a kill: no handler may take it
        return real(spark, repo, commits, **more)

    monkeypatch.setattr(workflow, "run", dies)
    with pytest.raises(KeyboardInterrupt):
        workflow.run_batch(spark, str(tmp_path / "r"), listed, ["template"], log, chunk=2)
    assert sinks.read_log(spark, log).count() == 2
    (tmp_path / "log" / "chunk=half").mkdir()  # written in part when it was killed
    (tmp_path / "log" / "chunk=half" / "part-0.json").write_text(f'{{"commit":"{ids[3]}","mode":"template","ok":true}}\n')

    def fails(spark, repo, commits, **more):
        seen.append(commits)
        if ids[3] in commits:
            raise ValueError("a broken commit")
        return real(spark, repo, commits, **more)

    monkeypatch.setattr(workflow, "run", fails)
    del seen[:]
    rolled = workflow.run_batch(spark, str(tmp_path / "r"), listed, ["template"], log, chunk=2, done=documents.resume_rows(spark, log)).first()
    assert seen == [ids[2:4], ids[2:3], ids[3:4], ids[4:]] and rolled.num_runs == 5 and rolled.ok_rate == 0.8
    rows = {r.commit: r for r in sinks.read_log(spark, log).collect()}
    assert len(rows) == 5 and rows[ids[3]].exit_code == 1 and "a broken commit" in rows[ids[3]].error and rows[ids[4]].ok and rows[ids[4]].error is None
    assert rows[ids[4]].git_show_calls == 3 and rows[ids[4]].subprocess_calls == 4  # both sides of b.py, and b.py as a target
    del seen[:]
    workflow.run_batch(spark, str(tmp_path / "r"), listed, ["template"], log, chunk=2, done=documents.resume_rows(spark, log))
    assert seen == []


def test_a_chunk_that_takes_too_long_is_stopped(spark, repo):
    import time

    late = workflow._within(spark, 0.5, lambda: spark.range(1).selectExpr("java_method('java.lang.Thread', 'sleep', 20000L)").collect())
    assert late == (None, True)
    assert workflow._within(spark, 60, lambda: spark.range(3).count()) == (3, False)
    began = time.monotonic()
    with pytest.raises(ZeroDivisionError):
        workflow._within(spark, 60, lambda: 1 / 0)
    assert time.monotonic() - began < 5


def test_propagate_from_a_seeds_document(spark, repo, tmp_path):
    main(["extract-seeds", "--repo", repo, "--out", str(tmp_path / "s"), "--n", "1"], spark)
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "new.json").write_text("".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*"))))
    for seeds in (str(tmp_path / "s"), str(tmp_path / "docs" / "*.json")):
        out = str(tmp_path / f"p{len(seeds)}")
        main(["propagate", "--repo", repo, "--out", out, "--seeds", seeds], spark)
        told = "".join(r.value for r in spark.read.text(out).collect())
        assert "pkg.b.low" in told and "pkg.a.top" in told
    with pytest.raises(FileNotFoundError):
        main(["propagate", "--repo", repo, "--out", out, "--seeds", str(tmp_path / "none")], spark)


def test_the_newest_file(spark, tmp_path):
    import os

    from tremor.sources import documents

    for name, age in (("a.json", 30), ("_hidden.json", 10), (".dot.json", 20)):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (1_700_000_000 - age, 1_700_000_000 - age))
    (tmp_path / "folder").mkdir()
    assert documents.newest_path(spark, str(tmp_path)).endswith("/_hidden.json")
    assert documents.newest_path(spark, f"{tmp_path}/a*").endswith("/a.json") and documents.newest_path(spark, f"{tmp_path}/a.json").endswith("/a.json")
    assert documents.newest_path(spark, f"{tmp_path}/nothing*") is None


def test_pages_are_files(spark, tmp_path):
    from tremor.sources import sinks

    pages = spark.createDataFrame([("README_1.md", "# One\né"), ("README_2.md", ""), (None, "x")], "name string, readme string")
    assert sinks.named_files(pages, "name", "readme", str(tmp_path / "pages")) == 2
    assert (tmp_path / "pages" / "README_1.md").read_text() == "# One\né" and len(list((tmp_path / "pages").iterdir())) == 2


def test_styles_are_kept_until_the_head_changes(spark, tmp_path, monkeypatch):
    from tremor.operators import style
    from tremor.sources import git as source
    from tremor.sources.parsed import ParseStore

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    (tmp_path / "r").mkdir()
    git("init", "-q", "-b", "main")
    for k in range(6):  # the styles stand in docstrings of modules only
        (tmp_path / "r" / f"m{k}.py").write_text(f'"""Module {k}.\n\nParameters\n----------\nx : int\n"""\n\n\ndef f():\n    pass\n')
    git("add", "-A")
    git("commit", "-qm", "one")
    options, real, asked = workflow.Options(cache=str(tmp_path / "cache")), style.winner, []
    monkeypatch.setattr(style, "winner", lambda *a: asked.append(1) or real(*a))

    def styles():
        listed = workflow.commits_of(spark, str(tmp_path / "r"), None, 1)
        trees = source.read(spark, str(tmp_path / "r"), "trees", n="1").select("commit", "path", "blob")
        store = ParseStore(spark, str(tmp_path / "r"))
        store.refresh(trees)
        new = workflow.Files(trees, str(tmp_path / "r"), store)
        return workflow.styles_of(spark, str(tmp_path / "r"), listed, new, new.parsed("defs", 2), options).first()

    first = styles()
    assert (first.style, first.numpy, first.confidence) == ("numpy", 6, 1.0) and styles() == first and len(asked) == 1
    (tmp_path / "r" / "m0.py").write_text("x = 1\n")
    git("commit", "-qam", "two")
    assert styles().numpy == 5 and len(asked) == 2 and styles().numpy == 5 and len(asked) == 2
