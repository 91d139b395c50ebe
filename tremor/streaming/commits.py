"""New commits as a stream: each micro-batch is analysed and written under its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tremor.plans import workflow
from tremor.sources import git, sinks


def new_commits(spark: SparkSession, repo: str, branch: str = "HEAD") -> DataFrame:
    """(ord, commit, parent), parents first, each commit that the branch gains once; no state is kept."""
    git.register(spark)
    return spark.readStream.format("git").option("repo", repo).option("kind", "commits").option("branch", branch).load()


def write_batch(spark: SparkSession, repo: str, commits: list[str], number: int, out: str, options: workflow.Options) -> None:
    """Batch rows and impacted names of some commits in the place of what ``out`` has of this batch number. Commits that
    another batch has (a branch that was set back and forth) are left out."""
    known = sinks.read_log(spark, f"{out}/batch", "commit string, chunk string", but=f"{number:08d}").select("commit")
    open_ = spark.createDataFrame([(c,) for c in commits], "commit string").join(known, "commit", "left_anti")
    todo = {r.commit for r in open_.collect()}  # of one micro-batch
    if todo:
        tables = workflow.run(spark, repo, [c for c in commits if c in todo], options=options)
        sinks.table(tables["impacted"], f"{out}/impacted/batch={number:08d}")
        sinks.keyed_log(tables["batch"], f"{out}/batch", f"{number:08d}")


def follow(spark: SparkSession, repo: str, out: str, checkpoint: str, options: workflow.Options = workflow.Options(), branch: str = "HEAD", **trigger):
    """Start a query that writes batch rows and impacted names of every new commit under ``out``; a batch that runs
    again after a failure replaces what it wrote."""

    def one(batch: DataFrame, number: int) -> None:
        commits = [r.commit for r in batch.select("commit", "ord").orderBy("ord").collect()]  # of one micro-batch
        if commits:
            write_batch(spark, repo, commits, number, out, options)

    writer = new_commits(spark, repo, branch).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
