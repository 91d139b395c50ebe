"""python -m tremor run | extract-seeds | propagate | batch | mutations"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tremor.operators import batch as batch_ops
from tremor.operators import experiment, generate, propagate
from tremor.plans import workflow
from tremor.sources import documents, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tremor", description="Change-impact analytics on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "extract-seeds", "propagate", "batch", "mutations"):
        c = sub.add_parser(name)
        c.add_argument("--repo", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--commit")
        c.add_argument("--commits-file")
        c.add_argument("--n", type=int)
        c.add_argument("--mode", default="simple" if name == "propagate" else "template", choices=["template", "llm", "both", "simple", "typed"])
        c.add_argument("--max-hops", type=int)
        c.add_argument("--parser-level", type=int, default=2, choices=[1, 2])
        c.add_argument("--seed-scope", default="code_only", choices=["code_only", "all"])
        c.add_argument("--limit-targets", type=int, default=50)
        c.add_argument("--style", default="auto", choices=["auto", "google", "numpy", "sphinx"])
        c.add_argument("--ablation", default="full", choices=["full", "uniform", "no_decay", "high_decay", "calls_only"])
        c.add_argument("--gamma", type=float)
        c.add_argument("--threshold", type=float)
        c.add_argument("--direction", default="callers", choices=["callers", "both"])
        c.add_argument("--exact", action="store_true", help="match names exactly")
        c.add_argument("--snapshot", default="commit", choices=["commit", "worktree"])
        c.add_argument("--resume", action="store_true")
        c.add_argument("--store", help="folder of parsed sources that later runs use again")
        c.add_argument("--cache", help="folder that keeps the style found for a repository")
        c.add_argument("--chunk", type=int, default=workflow.CHUNK, help="commits of a batch that are written together")
        c.add_argument("--timeout", type=float, default=workflow.TIMEOUT_S, help="seconds a commit of a batch")
        c.add_argument("--seeds", help="for propagate: a seeds document, a glob or a folder, of which the newest counts")
        c.add_argument("--spacing", type=float, default=0.5, help="least seconds between two calls of the generator, over all tasks")
        c.add_argument("--generator", help="module:function from a prompt to an answer, for --mode llm")
    return p


def options_of(a: argparse.Namespace) -> workflow.Options:
    typed = None
    if a.mode == "typed":
        base = propagate.preset(a.ablation)
        typed = propagate.Config(base.weights, base.gamma if a.gamma is None else a.gamma, base.threshold if a.threshold is None else a.threshold, base.max_hops if a.max_hops is None else a.max_hops)
    mode = "llm" if a.mode == "llm" else "template"
    return workflow.Options(mode, 2 if a.max_hops is None else a.max_hops, a.parser_level, a.seed_scope, a.limit_targets, a.style, direction=a.direction, fuzzy=not a.exact, typed=typed, snapshot=a.snapshot, store=a.store, cache=a.cache)


def generator_of(a: argparse.Namespace):
    """The callable that ``--generator`` names; modes that need one fail without it."""
    if a.generator:
        module, _, name = a.generator.partition(":")
        found = getattr(importlib.import_module(module), name)
        return generate.Paced(found, a.spacing) if a.spacing > 0 else found
    if a.mode in ("llm", "both"):
        raise SystemExit(f"--mode {a.mode} needs --generator module:function")
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    generator = generator_of(a)
    spark = spark or SparkSession.builder.appName("tremor").getOrCreate()
    commits = [a.commit] if a.commit else [r.commit for r in documents.commit_list(spark, a.commits_file).orderBy("ord").collect()][: a.n] if a.commits_file else None
    n = None if commits else a.n or (1 if a.command == "run" else 200)
    if a.command == "extract-seeds":
        listed = commits or [r.commit for r in workflow.commits_of(spark, a.repo, None, n).orderBy("ord").collect()]
        sinks.json_documents(workflow.extract_seeds(spark, a.repo, listed), a.out)
    elif a.command == "propagate":
        found = workflow.impacted_by(spark, a.repo, documents.seeds_document(spark, a.seeds), options_of(a)) if a.seeds else workflow.run(spark, a.repo, commits, n, options_of(a))["impacted"]
        sinks.json_documents(found, a.out)
    elif a.command == "run":
        tables = workflow.run(spark, a.repo, commits, n, options_of(a), generator)
        for name, df in tables.items():
            sinks.table(df, f"{a.out}/{name}")
        sinks.text(tables["patches"], "patch", f"{a.out}/patch")
        sinks.json_documents(tables["report"], f"{a.out}/verifier_report")
        if "readmes" in tables:
            sinks.named_files(tables["readmes"], "name", "readme", f"{a.out}/pages")
        sinks.json_documents(tables["batch"].withColumn("options", F.lit(str(options_of(a)))), f"{a.out}/history")
    elif a.command == "batch":
        listed = workflow.commits_of(spark, a.repo, commits, n)
        log = f"{a.out}/summary.jsonl"
        done = documents.resume_rows(spark, log) if a.resume and sinks.exists(spark, log) else None
        if done is None:
            sinks.remove(spark, log)
        sinks.json_documents(spark.createDataFrame([{k: str(v) for k, v in vars(a).items()}]).withColumn("started", F.current_timestamp()), f"{a.out}/config")
        modes = ["template", "llm"] if a.mode == "both" else [a.mode]
        rolled = workflow.run_batch(spark, a.repo, listed, modes, log, options_of(a), generator, done, a.chunk, a.timeout)
        sinks.json_documents(batch_ops.prefixed(rolled, modes), f"{a.out}/aggregate")
        if sinks.exists(spark, log):
            sinks.csv_summary([sinks.read_log(spark, log)], f"{a.out}/summary.csv")
    else:
        tables = workflow.run(spark, a.repo, commits, n, options_of(a))
        docs = tables["targets"].where("not has_docstring").select("commit", "qualname", F.concat(F.lit("TODO: docstring\n\nArgs:\n"), F.array_join(F.transform("params", lambda p: F.concat(F.lit("    "), p, F.lit(":"))), "\n")).alias("docstring"), "params")
        per_commit = experiment.commit_results(experiment.mutation_results(docs))
        sinks.json_documents(per_commit, f"{a.out}/commits")
        sinks.json_documents(experiment.pass_rates(per_commit), f"{a.out}/rates")


if __name__ == "__main__":
    main()
