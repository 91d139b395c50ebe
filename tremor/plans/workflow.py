"""The whole analysis: seeds, graph, impact, style, targets, patches, report, batch rows.

Everything runs on all commits together: a commit is read as the names of its blobs, each distinct blob is parsed
once (and never again with a lasting ``store``), texts are read of changed files and targets only, and ``commit`` is a
key of every join and aggregate, as names of different commits must not meet. The number of jobs does not grow with the commits."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions import names as N
from tremor.functions.checkpoints import cut
from tremor.operators import batch, classify, generate, graph, match, parse, patch, propagate, spans, style, targets
from tremor.operators import seeds as seed_ops
from tremor.operators.diff import parse_hunks, patch_stats
from tremor.sources import git, sinks
from tremor.sources.cache import KeyValue
from tremor.sources.parsed import ParseStore, modules

BY = ("commit",)


@dataclass(frozen=True)
class Options:
    mode: str = "template"  # template or llm
    max_hops: int = 2
    level: int = 2  # of the parser
    seed_scope: str = "code_only"
    limit_targets: int = 50
    style: str = "auto"
    overwrite_existing: bool = False
    direction: str = "callers"
    fuzzy: bool = True
    typed: propagate.Config | None = None
    snapshot: str = "commit"
    store: str | None = None  # folder of parsed sources that outlasts the run
    cache: str | None = None  # folder of detected styles


@dataclass(frozen=True)
class Files:
    """Files of commits, with texts and parsed rows on demand. ``entries`` has (commit, path, blob), or with no
    ``store`` (commit, path, source)."""

    entries: DataFrame
    repo: str
    store: ParseStore | None = None

    def texts(self, of: DataFrame | None = None) -> DataFrame:
        """(commit, path, source) of all files, or of those that ``of(commit, path)`` names."""
        mine = self.entries if of is None else self.entries.join(of.select("commit", "path").distinct(), ["commit", "path"], "left_semi")
        return (git.contents(mine, self.repo) if self.store else mine).select("commit", "path", "source")

    def parsed(self, kind: str, level: int) -> DataFrame:
        """The defs, calls, bases or docs (of modules)."""
        if self.store:
            return self.store.table(self.entries, kind)
        return {"defs": parse.parse_defs, "calls": lambda f: parse.parse_calls(f, level), "bases": parse.parse_bases, "docs": parse.parse_docs}[kind](self.entries)


def commits_of(spark: SparkSession, repo: str, commits: list[str] | None = None, n: int | None = None) -> DataFrame:
    picked = {"commits": ",".join(commits)} if commits else {"n": str(n)} if n else {}
    return cut(git.read(spark, repo, "commits", **picked))


def read_all(spark: SparkSession, repo: str, commits: DataFrame, options: Options = Options()) -> tuple[DataFrame, Files, Files]:
    """Diffs, files at each commit, and the files at its parent that it changes, under the commit's name."""
    rows = commits.select("commit", "parent").collect()  # a list the caller asked for
    wanted = ",".join(r.commit for r in rows)
    parents = {r.commit: r.parent for r in rows if r.parent}
    diffs = cut(git.read(spark, repo, "diffs", commits=wanted).select("commit", "diff"))
    store = ParseStore(spark, repo, options.level, options.store)
    changed = parse_hunks(diffs, ["commit"]).select("commit", "path").distinct()
    if parents:
        at_parent = git.read(spark, repo, "trees", commits=",".join(sorted(set(parents.values())))).withColumnRenamed("commit", "parent")
        named = commits.where("parent is not null").select("commit", "parent")
        old = at_parent.join(F.broadcast(named), "parent").select("commit", "path", "blob").join(changed, ["commit", "path"], "left_semi")  # one short row a commit
    if options.snapshot != "commit":
        new = Files(cut(git.read(spark, repo, "files", commits=wanted, snapshot=options.snapshot)), repo)
        old = cut(old if parents else new.entries.select("commit", "path", "blob").where("false"))
        store.refresh(old)
        return diffs, new, Files(old, repo, store)
    new = cut(git.read(spark, repo, "trees", commits=wanted).select("commit", "path", "blob"))
    old = cut(old) if parents else new.where("false")
    store.refresh(new.unionByName(old))
    return diffs, Files(new, repo, store), Files(old, repo, store)


def seeds_of(diffs: DataFrame, new: Files, old: Files, level: int) -> DataFrame:
    """The seeds, from the texts and definitions of changed files."""
    changed = parse_hunks(diffs, ["commit"]).select("commit", "path").distinct()
    parsed = {side: cut(f.parsed("defs", level).join(changed, ["commit", "path"], "left_semi")) for side, f in (("new", new), ("old", old))}
    return cut(seed_ops.extract_seeds(diffs, cut(new.texts(changed)), cut(old.texts(changed)), parsed=parsed))


def prompt_diffs(spark: SparkSession, repo: str, commits: DataFrame, context: int = 3) -> DataFrame:
    """Diffs with some lines of context, as generators get them; ``read_all`` has those without, for the line numbers."""
    wanted = ",".join(r.commit for r in commits.select("commit").collect())  # a list the caller asked for
    return cut(git.read(spark, repo, "diffs", commits=wanted, context=str(context)).select("commit", "diff"))


def changed_code(seeds: DataFrame) -> DataFrame:
    """(commit, qualname, old_code, new_code) of the changed definitions."""
    return seeds.where("kind <> 'module'").groupBy("commit", "qualname").agg(F.max("old_code").alias("old_code"), F.max("new_code").alias("new_code"))


def extract_seeds(spark: SparkSession, repo: str, commits: list[str]) -> DataFrame:
    """The seeds documents of commits."""
    listed = commits_of(spark, repo, commits)
    diffs, new, old = read_all(spark, repo, listed)
    return seed_ops.seeds_document(seeds_of(diffs, new, old, Options.level), diffs, listed, repo.rstrip("/").rpartition("/")[2])


def impacted_by(spark: SparkSession, repo: str, seeds: DataFrame, options: Options) -> DataFrame:
    """Impacted names of the commits of given ``seeds``; nothing of the diffs is computed again."""
    seeds = cut(seeds)
    wanted = ",".join(r.commit for r in seeds.select("commit").distinct().orderBy("commit").collect())  # a row a commit
    trees = cut(git.read(spark, repo, "trees", commits=wanted).select("commit", "path", "blob") if wanted else spark.createDataFrame([], "commit string, path string, blob string"))
    store = ParseStore(spark, repo, options.level, options.store)
    store.refresh(trees)
    defs, calls, bases = (cut(store.table(trees, kind)) for kind in ("defs", "calls", "bases"))
    return impacted_of(seeds, defs, calls, bases, trees, options)


def impacted_of(seeds: DataFrame, defs: DataFrame, calls: DataFrame, bases: DataFrame, files: DataFrame, options: Options) -> DataFrame:
    """Impacted names of every commit, with their classes."""
    own = files.select("commit", F.regexp_replace(F.element_at(F.split("path", "/"), 1), r"\.py$", "").alias("top"))
    nodes, edges = graph.build(defs, calls, bases if options.level > 1 else None, own, BY)
    nodes, edges = cut(nodes), cut(edges)
    start = seed_ops.in_scope(seeds, options.seed_scope).select("commit", "qualname").distinct()
    if options.fuzzy:
        start = match.match_seeds(start, nodes, BY).where("matched_qualname is not null").select("commit", F.col("matched_qualname").alias("qualname"))
        edges = match.resolve_callers(edges, nodes, BY).select("commit", "caller", F.col("qualname").alias("callee"))
    edges = edges.select("commit", "caller", "callee")
    if options.typed:
        found = propagate.impact_typed(edges, start, options.typed, by=BY)
    else:
        found = propagate.impact(edges, start, options.max_hops, options.direction, by=BY)
    return classify.classify(found, files, BY)


def _pieces(text: Column, size: int) -> Column:
    """``text`` in pieces of at most ``size`` characters, cut at line ends where there are any."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{0,{size - 1}}}\n|.{{1,{size}}}"), F.lit(0))


def module_changes(diffs: DataFrame, seeds: DataFrame, chosen: DataFrame, nodes: DataFrame, generator: generate.Generator, files: DataFrame | None = None, size: int = 100_000, calls: list | None = None) -> DataFrame:
    """(commit, qualname, path, reason) that the generator names for commits with module-level seeds and no
    target. It sees the whole diff, and the sources and all functions of the files with module-level seeds; where
    these have more than ``size`` characters, in several prompts (every piece of the one with every piece of
    the others), whose answers are united. Names that are no function of these files are dropped."""
    seeds, nodes = (d if "path" in d.columns else d.withColumn("path", F.lit("")) for d in (seeds, nodes))
    open_commits = seeds.where("kind = 'module' and seed_type = 'code_change'").select("commit").distinct().join(chosen.select("commit").distinct(), "commit", "left_anti")
    paths = seeds.where("kind = 'module'").join(open_commits, "commit", "left_semi").select("commit", "path").distinct()
    known = nodes.where("kind in ('function', 'async_function')").join(paths, ["commit", "path"], "left_semi").select("commit", "path", "qualname")
    each = paths.join(known.groupBy("commit", "path").agg(F.array_join(F.array_sort(F.collect_list("qualname")), "\n").alias("names")), ["commit", "path"], "left")
    each = each.join(files.select("commit", "path", "source"), ["commit", "path"], "left") if files is not None else each.withColumn("source", F.lit(None).cast("string"))
    titled = lambda c, none: F.concat(F.lit("### "), F.col("path"), F.lit("\n"), F.coalesce(F.col(c), F.lit(none)))
    listed = F.array_sort(F.collect_list(F.struct("path", titled("source", "(no source)").alias("files"), titled("names", "(no functions found)").alias("functions"))))
    sections = each.groupBy("commit").agg(listed.alias("s"), F.count("names").alias("n")).where("n > 0")
    text = lambda c: F.array_join(F.transform("s", lambda x: x[c]), "\n\n").alias(c)
    asked = diffs.join(sections, "commit").select("commit", F.coalesce("diff", F.lit("")).alias("diff"), text("files"), text("functions"))
    asked = asked.withColumn("long", F.length("diff") + F.length("files") + F.length("functions") > size)
    for c in ("diff", "files", "functions"):
        asked = asked.withColumn(c, F.explode(F.when(F.col("long") & (F.length(c) > 0), _pieces(F.col(c), max(1, size // 3))).otherwise(F.array(c))))
    asked = asked.select("commit", N.render(generate.prompt("module_analysis"), diff=F.col("diff"), files=F.col("files"), functions=F.col("functions")).alias("prompt"))
    answers = cut(generate.call_generator(asked, generator))  # no call runs twice
    if calls is not None:
        calls.append(answers)
    found = answers.select("commit", F.explode(generate.affected_functions(F.coalesce("answer", F.lit("")))).alias("f")).select("commit", "f.*")
    return found.dropDuplicates(["commit", "qualname"]).join(known, ["commit", "qualname"], "left_semi")


def readmes(repo: str, diffs: DataFrame, targets_: DataFrame, generator: generate.Generator, calls: list | None = None) -> DataFrame:
    """(commit, name, readme): a page a commit, under a name that its content fixes."""
    listed = targets_.groupBy("commit").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", "qualname"))), lambda x: F.concat(F.lit("- "), x["qualname"])), "\n").alias("analyses"))
    rows = diffs.join(listed, "commit", "left")
    asked = rows.select("commit", N.render(generate.prompt("readme"), commit=F.col("commit"), repo=F.lit(repo), analyses=F.col("analyses"), diff=F.substring("diff", 1, 8000)).alias("prompt"))
    answers = cut(generate.call_generator(asked, generator))
    if calls is not None:
        calls.append(answers)
    done = answers.where("ok")
    text = generate.clean_answer(F.col("answer"))
    return done.select("commit", F.concat(F.lit("README_"), F.substring("commit", 1, 8), F.lit("_"), F.substring(F.sha2(text, 256), 1, 6), F.lit(".md")).alias("name"), text.alias("readme"))


STYLES = "commit string, google bigint, numpy bigint, sphinx bigint, unknown bigint, style string, confidence double"


def styles_of(spark: SparkSession, repo: str, commits: DataFrame, new: Files, defs: DataFrame, options: Options) -> DataFrame:
    """(commit, votes, style, confidence). With a ``cache`` the styles of a repository are kept for the commits they
    were found at: the same commits read them, any other head replaces them."""
    cache = KeyValue(spark, options.cache) if options.cache and options.snapshot == "commit" else None
    key, version = os.path.abspath(repo), ""
    if cache:
        version = hashlib.sha256("\n".join(r.commit for r in commits.select("ord", "commit").orderBy("ord").collect()).encode()).hexdigest()  # a list the caller asked for
        if (found := cache.get(key, version)) is not None:
            return spark.createDataFrame([(r,) for r in json.loads(found)], "row string").select(F.from_json("row", STYLES).alias("r")).select("r.*")
    votes = cut(style.winner(style.votes(style.docstring_corpus(new.entries, defs, modules=new.parsed("docs", options.level)), ["commit"])))
    if cache:
        cache.put(key, version, json.dumps([r[0] for r in votes.select(F.to_json(F.struct("*"))).collect()]))  # a row a commit
    return votes


def run(spark: SparkSession, repo: str, commits: list[str] | None = None, n: int | None = None, options: Options = Options(), generator: generate.Generator | None = None) -> dict[str, DataFrame]:
    """All tables of the analysis, keyed by commit."""
    listed = commits_of(spark, repo, commits, n)
    diffs, new, old = read_all(spark, repo, listed, options)
    calls_made: list[DataFrame] = []
    seeds = seeds_of(diffs, new, old, options.level)
    defs, calls, bases = (cut(new.parsed(kind, options.level)) for kind in ("defs", "calls", "bases"))
    nodes = spans.last_by(defs.select("commit", "qualname", "ordinal", "kind", "path", "params", "lineno", "end_lineno", "docstring"), ["commit", "qualname"], "ordinal")
    shown = prompt_diffs(spark, repo, listed) if generator is not None else diffs
    impacted = cut(impacted_of(seeds, defs, calls, bases, new.entries, options))
    s = seed_ops.in_scope(seeds, options.seed_scope)
    near = targets.candidates(impacted.drop("path"), nodes.drop("ordinal"), 1 if options.mode == "template" else options.max_hops, by=BY)
    chosen = cut(targets.select_template(near, s, options.limit_targets, BY) if options.mode == "template" else targets.select_lineage(near, s, options.max_hops, options.limit_targets, BY))
    if generator is not None and options.mode == "llm":
        named = module_changes(shown, seeds, chosen, nodes, generator, cut(new.texts(seeds.where("kind = 'module'"))), calls=calls_made).withColumnsRenamed({"path": "given_path"}).drop("given_path")
        more = named.select("commit", "qualname", F.lit(0).alias("hop"), F.col("reason"), F.lit(True).alias("is_internal"))
        near = targets.candidates(more, nodes.drop("ordinal"), 0, by=BY)
        chosen = cut(chosen.unionByName(near.select("commit", *[c for c in chosen.columns if c in near.columns and c != "commit"]), allowMissingColumns=True))
    if options.style == "auto":
        votes = styles_of(spark, repo, listed, new, defs, options)
    else:
        votes = listed.select("commit").withColumns({"style": F.lit(options.style), "confidence": F.lit(1.0)})
    lines = N.placeholder_docstring(F.col("params"))
    work = chosen.withColumnRenamed("rel_path", "path")
    texts = cut(new.texts(work))
    if generator is not None and options.mode == "llm":
        code = work.join(texts.withColumnRenamed("source", "file_text"), ["commit", "path"]).withColumn("code", N.snippet(F.col("file_text"), F.col("lineno"), F.col("end_lineno"))).drop("file_text")
        code = code.join(votes.select("commit", "style"), "commit", "left")
        code = code.join(changed_code(seeds), ["commit", "qualname"], "left")

        def ask(d: DataFrame) -> Column:
            shown = {c: d[c] for c in ("qualname", "parent_analysis", "code", "old_code", "new_code")} | {"style": N.style_description(d["style"])}
            return F.when(F.coalesce(d["new_code"], d["old_code"]).isNotNull() & (d["hop"] == 0), N.render(generate.prompt("docstring_diff"), **shown)).otherwise(N.render(generate.prompt("docstring_impact"), **shown))

        work = generate.layered(code, generator, options.max_hops, ask, BY)
        calls_made.append(work)
        lines = generate.with_fallback(F.coalesce("answer", F.lit("")), lines)
    edits = work.select("commit", "path", "qualname", lines.alias("docstring_lines"))
    patched = cut(patch.apply_patches(texts, edits, options.overwrite_existing))
    checked = cut(patch.verify(patched.where("status in ('inserted', 'updated')")))
    report = listed.select("commit").join(patch.report(checked), "commit", "left").select("commit", F.coalesce("ok", F.lit(True)).alias("ok"), F.coalesce("num_targets_checked", F.lit(0)).alias("num_targets_checked"))
    patches = patch.patch_text(patched)
    stats = patched.where("diff <> ''").select("commit", "path", "diff").distinct()
    lines_of = patch_stats(stats, ["commit", "path"]).groupBy("commit").agg(
        F.count(F.lit(1)).alias("num_files_changed"), F.sum("added_lines").alias("patch_added_lines"), F.sum("removed_lines").alias("patch_removed_lines"), F.sum("total_lines").alias("patch_total_lines"))
    labels = classify.label_counts(impacted, ["commit"])
    counts = chosen.groupBy("commit").agg(F.count(F.lit(1)).alias("num_targets"))
    changed = patched.where("status in ('inserted', 'updated')").groupBy("commit").agg(F.count(F.lit(1)).alias("num_changed_targets"))
    rows = listed.select("commit", F.lit(options.mode).alias("mode"), F.lit(True).alias("ok"))
    for part in (counts, changed, lines_of, labels, report.select("commit", F.col("ok").alias("verifier_ok"), F.col("num_targets_checked").alias("verifier_checked")), votes.select("commit", "style")):
        rows = rows.join(part, "commit", "left")
    pages = {"readmes": cut(readmes(repo, shown, chosen, generator, calls_made))} if generator is not None else {}
    parts = [process_counts(listed, diffs, new, old, texts, generator is not None)]
    if calls_made:
        parts.append(call_counts(calls_made))
    if generator is not None and options.mode == "llm":
        unanswered = F.nullif(generate.tagged_answer(F.coalesce("answer", F.lit("")))["docstring"], F.lit("")).isNull()
        parts.append(work.groupBy("commit").agg(F.count_if(unanswered).alias("llm_fallbacks")))
    for part in parts:
        rows = rows.join(part, "commit", "left")
    if pages:
        rows = rows.join(pages["readmes"].select("commit", F.col("name").alias("readme_path")), "commit", "left").withColumn("readme_generated", F.col("readme_path").isNotNull())
    return pages | {"commits": listed, "seeds": seeds, "impacted": impacted, "style": votes, "targets": chosen, "patched": patched, "patches": patches, "verified": checked, "report": report, "batch": cut(rows)}


def process_counts(commits: DataFrame, diffs: DataFrame, new: Files, old: Files, texts: DataFrame, prompts: bool) -> DataFrame:
    """(commit, subprocess_calls, git_show_calls, ast_parse_calls): git calls of a commit of its own (its parent,
    diff, tree, the parent's tree, the diff for prompts); texts read for it (both sides of changed files, targets);
    contents parsed in this run, each counted for the first commit of the list that has it."""
    asked = commits.select("commit", "ord", (F.lit(3 + prompts) + F.col("parent").isNotNull().cast("int")).cast("long").alias("subprocess_calls"))
    changed = parse_hunks(diffs, ["commit"]).select("commit", "path").distinct()
    read_ = new.entries.join(changed, ["commit", "path"], "left_semi").select("commit").unionByName(old.entries.select("commit")).unionByName(texts.select("commit"))
    counts = [read_.groupBy("commit").agg(F.count(F.lit(1)).alias("git_show_calls"))]
    store = new.store or old.store
    have = (new.entries if new.store else old.entries).select("commit", "path", "blob").unionByName(old.entries.select("commit", "path", "blob"))
    first = modules(have).join(store.fresh(), ["blob", "module"]).join(asked, "commit").groupBy("blob", "module").agg(F.min_by("commit", "ord").alias("commit"))
    counts.append(first.groupBy("commit").agg(F.count(F.lit(1)).alias("ast_parse_calls")))
    out = asked.drop("ord")
    for c in counts:
        out = out.join(c, "commit", "left")
    return out.fillna(0, ["git_show_calls", "ast_parse_calls"])


def call_counts(calls: list[DataFrame]) -> DataFrame:
    """Generator calls of all kinds a commit: llm_total_calls, llm_success_calls, tokens, latency, success rate."""
    log = None
    for c in calls:
        part = c.select("commit", "ok", "error", "latency_ms", "prompt_tokens", "completion_tokens")
        log = part if log is None else log.unionByName(part)
    kept = ["total_calls", "success_calls", "total_prompt_tokens", "total_completion_tokens", "total_latency_ms", "success_rate"]
    return generate.call_stats(log, ["commit"]).select("commit", *(F.col(c).alias(f"llm_{c}") for c in kept))


CHUNK, TIMEOUT_S = 25, 600


def _within(spark: SparkSession, seconds: float, f):
    """``f()``, whose Spark jobs are cancelled after ``seconds``; says whether that happened."""
    group, late = uuid.uuid4().hex, threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "a chunk of commits", interruptOnCancel=True)
    timer.start()
    try:
        return f(), False
    except Exception:
        if late.is_set():
            return None, True
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def run_chunk(spark: SparkSession, repo: str, commits: list[str], options: Options, generator: generate.Generator | None, timeout_s: float) -> list[DataFrame]:
    """Batch rows of some commits. Where they fail or take over ``timeout_s`` a commit, each half is run alone, and
    what fails alone is a row: exit_code 1 with the error, -1 for time."""
    began = time.monotonic()
    try:
        rows, late = _within(spark, timeout_s * len(commits), lambda: run(spark, repo, commits, options=options, generator=generator)["batch"])
        error = "stopped after its time" if late else None
    except Exception as e:
        rows, late, error = None, False, f"{type(e).__name__}: {e}"[-2000:]
    took = int(1000 * (time.monotonic() - began))
    if rows is not None:
        return [rows.withColumns({"exit_code": F.lit(0), "error": F.lit(None).cast("string"), "runner_ms": F.lit(took).cast("long"), "duration_ms": F.lit(took // len(commits)).cast("long")})]
    if len(commits) == 1:
        return [spark.createDataFrame([(commits[0], options.mode, False, -1 if late else 1, error, took, took)], "commit string, mode string, ok boolean, exit_code int, error string, runner_ms long, duration_ms long")]
    half = len(commits) // 2
    return [d for part in (commits[:half], commits[half:]) for d in run_chunk(spark, repo, part, options, generator, timeout_s)]


def run_batch(
    spark: SparkSession, repo: str, commits: DataFrame, modes: list[str], log: str, options: Options = Options(), generator: generate.Generator | None = None, done: DataFrame | None = None,
    chunk: int = CHUNK, timeout_s: float = TIMEOUT_S, counts: dict | None = None,
) -> DataFrame:
    """Runs what ``done`` does not have yet, ``chunk`` commits of a mode at a time, and returns the roll-up a mode.

    A chunk's rows are written as soon as it is done, to a folder of ``log`` that its mode and commits name; a chunk
    that is run again replaces its folder, so no row comes twice. What a dead run leaves without ``_SUCCESS`` is no
    result. ``counts`` gets the numbers of chunks run."""
    todo = batch.remaining(batch.work_list(commits, modes), done) if done is not None else batch.work_list(commits, modes)
    order = {r.commit: r.ord for r in commits.select("commit", "ord").collect()}  # a list the caller asked for
    mine = {m: sorted((r.commit for r in todo.collect() if r.mode == m), key=order.get) for m in modes}
    for mode in modes:
        for k in range(0, len(mine[mode]), chunk):
            part = mine[mode][k : k + chunk]
            rows = batch.sparse_union(run_chunk(spark, repo, part, replace(options, mode=mode), generator, timeout_s))
            sinks.keyed_log(rows, log, hashlib.sha256("\n".join([mode, *part]).encode()).hexdigest()[:16])
            if counts is not None:
                counts["chunks"] = counts.get("chunks", 0) + 1
    return batch.rollup(sinks.read_log(spark, log), ["mode"])
