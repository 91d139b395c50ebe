"""A Spark data source over git repositories: ``spark.read.format("git")``.

Options: ``repo``; ``kind`` commits, diffs, trees, changes, files or blobs; ``commits`` a comma-separated list, or ``n`` for the
latest n; ``context`` lines of a diff; ``ext`` (default .py); ``snapshot`` commit or worktree for files;
``paths`` for blobs. Trees are the entries of a commit without contents; changes are those between each commit of
the list and the one before it (all entries for the first), a null blob for a path that goes; ``contents`` reads
blobs that a table names. Commits are split over partitions; each task runs its own git processes, blobs through
one ``cat-file --batch``. What git cannot give comes as null, not as an exception, unless ``strict``."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMAS = {
    "commits": "ord int, commit string, parent string",
    "diffs": "commit string, context int, diff string",
    "trees": "ord int, commit string, path string, blob string",
    "changes": "ord int, commit string, path string, blob string",
    "files": "commit string, path string, blob string, source string",
    "blobs": "commit string, path string, source string",
}
SKIPPED_DIRS = {"__pycache__", "node_modules"}


def git(repo: str, *args: str, timeout: float = 600) -> tuple[int, bytes]:
    """Exit code and output; -1 for a timeout, -2 if git cannot run."""
    try:
        done = subprocess.run(["git", "-C", repo, "-c", "core.quotePath=false", *args], capture_output=True, timeout=timeout)
        return done.returncode, done.stdout if done.returncode == 0 else done.stderr
    except subprocess.TimeoutExpired:
        return -1, b""
    except OSError as e:
        return -2, str(e).encode()


def decoded(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def blobs(repo: str, names: list[str]) -> Iterator[bytes | None]:
    """The contents of objects, through one process."""
    with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        for name in names:
            p.stdin.write(f"{name}\n".encode())
            p.stdin.flush()
            head = p.stdout.readline().split()
            if len(head) == 3 and head[1] == b"blob":
                yield p.stdout.read(int(head[2]))
                p.stdout.read(1)
            else:
                if len(head) == 3:
                    p.stdout.read(int(head[2]) + 1)
                yield None
        p.stdin.close()


class _Part(InputPartition):
    def __init__(self, rows: list[tuple[int, str]], before: str | None = None):
        super().__init__(rows)
        self.rows, self.before = rows, before


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = {k.lower(): v for k, v in options.items()}
        self.repo, self.kind = self.o["repo"], self.o.get("kind", "commits")
        self.ext, self.strict = self.o.get("ext", ".py"), self.o.get("strict", "false").lower() == "true"

    def commits(self) -> list[str]:
        if self.o.get("commits"):
            return [c.strip() for c in self.o["commits"].split(",") if c.strip()]
        code, out = git(self.repo, "log", "--format=%H", *(["-n", self.o["n"]] if "n" in self.o else []))
        if code:
            raise RuntimeError(f"git log failed: {out.decode(errors='replace')[:500]}")
        return out.decode().split()

    def partitions(self) -> list[_Part]:
        rows = list(enumerate(self.commits()))
        size = max(1, min(50, -(-len(rows) // 64)))
        return [_Part(rows[k : k + size], rows[k - 1][1] if k else None) for k in range(0, len(rows), size)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[tuple]:
        before = part.before
        for ord_, commit in part.rows:
            yield from self.read_changes(ord_, commit, before) if self.kind == "changes" else getattr(self, f"read_{self.kind}")(ord_, commit)
            before = commit

    def read_commits(self, ord_: int, commit: str):
        code, out = git(self.repo, "rev-parse", f"{commit}^")
        if code and self.strict:
            raise RuntimeError(f"{commit} has no parent")
        yield ord_, commit, None if code else out.decode().strip()

    def read_diffs(self, ord_: int, commit: str):
        context = int(self.o.get("context", "0"))
        code, out = git(self.repo, "show", "--format=", f"--unified={context}", commit)
        yield commit, context, None if code else out.decode("utf-8", "replace")

    def read_files(self, ord_: int, commit: str):
        if self.o.get("snapshot", "commit") == "worktree":
            for folder, dirs, names in os.walk(self.repo):
                dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in SKIPPED_DIRS)
                for name in sorted(names):
                    if name.endswith(self.ext):
                        full = os.path.join(folder, name)
                        with open(full, "rb") as f:
                            text = decoded(f.read())
                        if text is not None:
                            yield commit, os.path.relpath(full, self.repo).replace(os.sep, "/"), None, text
            return
        keep = list(self.entries(commit))
        for (path, blob), raw in zip(keep, blobs(self.repo, [b for _, b in keep]), strict=True):
            yield commit, path, blob, decoded(raw)

    def wanted(self, path: str) -> bool:
        return path.endswith(self.ext) and not any(d.startswith(".") or d in SKIPPED_DIRS for d in path.split("/")[:-1])

    def entries(self, commit: str) -> Iterator[tuple[str, str]]:
        """(path, blob) of a commit's files."""
        code, out = git(self.repo, "ls-tree", "-r", "-z", commit)
        if code and self.strict:
            raise RuntimeError(f"no tree of {commit}: {out.decode(errors='replace')[:500]}")
        for entry in out.decode("utf-8", "replace").split("\0") if not code else []:
            meta, _, path = entry.partition("\t")
            if path and meta.split()[1] == "blob" and self.wanted(path):
                yield path, meta.split()[2]

    def read_trees(self, ord_: int, commit: str):
        for path, blob in self.entries(commit):
            yield ord_, commit, path, blob

    def read_changes(self, ord_: int, commit: str, before: str | None):
        if before is None:
            yield from self.read_trees(ord_, commit)
            return
        code, out = git(self.repo, "diff-tree", "-r", "-z", "--no-renames", "--raw", before, commit)
        if code:
            raise RuntimeError(f"no changes up to {commit}: {out.decode(errors='replace')[:500]}")
        parts = out.decode("utf-8", "replace").split("\0")
        for meta, path in zip(parts[::2], parts[1::2]):
            mode, blob, status = meta.split()[1], meta.split()[3], meta.split()[4]
            if self.wanted(path):
                yield ord_, commit, path, None if status[0] == "D" or mode == "160000" else blob

    def read_blobs(self, ord_: int, commit: str):
        paths = [p for p in self.o.get("paths", "").split(",") if p]
        for path, raw in zip(paths, blobs(self.repo, [f"{commit}:{p}" for p in paths]), strict=True):
            if raw is None and self.strict:
                raise RuntimeError(f"{path} is not in {commit}")
            yield commit, path, decoded(raw)


class GitStreamReader(GitReader, DataSourceStreamReader):
    """New commits of a branch, parents first. The offset is the branch's tip, and a batch has what its end reaches and
    its start does not: whatever is merged or pushed between two triggers is read once, in whatever order it was made."""

    def initialOffset(self) -> dict:
        return {"tip": ""}

    def latestOffset(self) -> dict:
        code, out = git(self.repo, "rev-parse", "--verify", "--quiet", f"{self.o.get('branch', 'HEAD')}^{{commit}}")
        return {"tip": "" if code else out.decode().strip()}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        if not end["tip"]:
            return []
        known = start.get("tip") and not git(self.repo, "cat-file", "-e", start["tip"])[0]  # a tip that was pushed away may be gone
        code, out = git(self.repo, "rev-list", "--topo-order", "--reverse", end["tip"], *(["--not", start["tip"]] if known else []))
        if code:
            raise RuntimeError(f"git rev-list failed: {out.decode(errors='replace')[:500]}")
        rows = list(enumerate(out.decode().split()))
        return [_Part(rows[k : k + 50], rows[k - 1][1] if k else None) for k in range(0, len(rows), 50)]

    def commit(self, end: dict) -> None:
        pass


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))

    def streamReader(self, schema) -> GitStreamReader:
        return GitStreamReader(dict(self.options))


def contents(entries, repo: str):
    """``entries`` with the ``source`` of their ``blob``. Each distinct blob is read once; only names are shuffled
    for that, and each task reads its blobs through one git process."""

    def run(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decoded(x) for x in blobs(repo, names)], pa.string())], names=["blob", "source"])

    read_ = entries.where("blob is not null").select("blob").distinct().mapInArrow(run, "blob string, source string")
    return entries.join(read_, "blob", "left").select(*entries.columns, "source")


def register(spark) -> None:
    spark.dataSource.register(GitSource)


def read(spark, repo: str, kind: str = "commits", **options):
    register(spark)
    reader = spark.read.format("git").option("repo", repo).option("kind", kind)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
