"""Docstrings into sources, diffs out of them, and their verification. One group is one file of a commit."""

from __future__ import annotations

import ast
import difflib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions.checkpoints import spread
from tremor.operators.parse import params_of, tree_of

_LINE = re.compile(r"\r\n|\r|\n")
FILES = 64  # files that are turned into rows at once


def named_functions(tree: ast.Module, module: str) -> dict[str, ast.AST]:
    """Qualname to node; the last definition wins."""
    out, todo = {}, [(tree, module)]
    while todo:
        node, scope = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            scope = f"{scope}.{node.name}" if scope else node.name
            out[scope] = node
        todo.extend((c, scope) for c in reversed(list(ast.iter_child_nodes(node))))
    return out


def first_line(stmt: ast.stmt) -> int:
    """Where a statement begins, its decorators included."""
    return min([stmt.lineno, *(d.lineno for d in getattr(stmt, "decorator_list", []))])


def put_docstring(source: str, qualname: str, module: str, doc: list[str], overwrite: bool = True) -> tuple[str, str]:
    """(new source, status). A one-line function is opened up; text never lands between a decorator and its def."""
    tree = tree_of(source)
    if tree is None:
        return source, "syntax_error"
    node = named_functions(tree, module).get(qualname)
    if node is None:
        return source, "node_not_found"
    if isinstance(node, ast.ClassDef):
        return source, "not_a_function"
    lines = _LINE.split(source)
    stmt = node.body[0]
    if ast.get_docstring(node, clean=False) is not None:
        if not overwrite:
            return source, "kept"
        first, last, status = stmt.lineno, stmt.end_lineno, "updated"
        before, after = lines[first - 1].encode()[: stmt.col_offset].decode(), lines[last - 1].encode()[stmt.end_col_offset :].decode()
    else:
        first, last, status = first_line(stmt), first_line(stmt) - 1, "inserted"
        before, after = "", ""
        if stmt.lineno == node.lineno or lines[first - 1][: len(lines[first - 1]) - len(lines[first - 1].lstrip())] != lines[first - 1].encode()[: stmt.col_offset].decode() and not getattr(stmt, "decorator_list", []):
            line = lines[first - 1].encode()
            before, after, last = line[: stmt.col_offset].decode(), line[stmt.col_offset :].decode(), first
    own = re.match(r"[ \t]*", lines[node.lineno - 1])[0]
    if before.strip():  # the body stands on the line of its def
        indent = own + "    "
        rest = after.lstrip("; \t")
        block = [before.rstrip(), *(indent + d if d else "" for d in doc), *([indent + rest] if rest else [])]
    else:
        indent = re.match(r"[ \t]*", lines[first - 1])[0]
        rest = after.lstrip("; \t")
        block = [*(indent + d if d else "" for d in doc), *([indent + rest] if rest and not rest.startswith("#") else [])]
    return "\n".join([*lines[: first - 1], *block, *lines[last:]]), status


def as_lines(text: str) -> list[str]:
    """Generated text as docstring lines, the closing quotes on a line of their own."""
    body = text.rstrip()
    body = body.removesuffix('"""').rstrip()
    first, *rest = body.removeprefix('"""').split("\n")
    return ['"""' + first, *rest, '"""']


def file_diff(old: str, new: str, path: str) -> str:
    """A unified diff that git applies; a last line without its end is marked."""
    a, b = (re.findall(r"[^\n]*\n|[^\n]+", "\n".join(_LINE.split(t))) for t in (old, new))
    out = [x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in difflib.unified_diff(a, b, f"a/{path}", f"b/{path}")]
    return "".join(out).rstrip("\n")


PATCH_SCHEMA = "commit string, path string, qualname string, status string, new_source string, diff string"


def apply_patches(files: DataFrame, edits: DataFrame, overwrite: bool = False) -> DataFrame:
    """``edits(commit, path, qualname, docstring_lines)`` applied to ``files(commit, path, source)``: a row an
    edit, with the file's final source and unified diff. Edits of a file go from the bottom up."""

    def one(commit: str, path: str, source: str, edits_: list[dict]) -> list[tuple]:
        module = _module(path)
        tree = tree_of(source)
        nodes = named_functions(tree, module) if tree is not None else {}
        at = lambda q: -getattr(nodes.get(q), "lineno", 0)
        text, done = source, {}
        for e in sorted(edits_, key=lambda e: (at(e["qualname"]), e["qualname"])):
            text, done[e["qualname"]] = put_docstring(text, e["qualname"], module, list(e["docstring_lines"]), overwrite)
        diff = file_diff(source, text, path)
        return [(commit, path, e["qualname"], done[e["qualname"]], text, diff) for e in edits_]

    once = spread(edits, "commit", "path").groupBy("commit", "path").agg(F.collect_list(F.struct("qualname", "docstring_lines")).alias("edits"))  # bounded by one file
    joined = once.join(files.where("source is not null"), ["commit", "path"])
    return joined.select("commit", "path", "source", "edits").mapInArrow(_by_file(one, PATCH_SCHEMA), PATCH_SCHEMA)


def _module(path: str) -> str:
    return re.sub(r"\.py$", "", path.replace("\\", "/")).replace("/", ".")


def _by_file(one, schema: str):
    """Rows of ``one`` for a few files at a time: no group has a call or a frame of its own."""
    arrow = pa.schema([(n, pa.list_(pa.string()) if t.startswith("array") else pa.bool_() if t == "boolean" else pa.string()) for n, t in (f.split() for f in schema.split(", "))])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, FILES):
                part = batch.slice(start, FILES)
                rows = [r for args in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in one(*args)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return run


def patch_text(patched: DataFrame) -> DataFrame:
    """One patch a commit: its files' diffs in path order, blank lines between, one newline at the end."""
    files = patched.where("diff <> ''").select("commit", "path", "diff").distinct()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", "diff"))), lambda x: x["diff"])
    return files.groupBy("commit").agg(F.concat(F.rtrim(F.array_join(ordered, "\n\n")), F.lit("\n")).alias("patch"))


def missing_params(doc: Column, params: Column, keep_stars: bool = False) -> Column:
    """Parameters that the docstring does not mention."""
    return F.filter(params, lambda p: ~F.contains(doc, p if keep_stars else F.regexp_replace(p, r"^\*+", "")))


VERIFY_SCHEMA = "commit string, path string, qualname string, ok boolean, errors array<string>, missing array<string>, detail string"


def verify(patched: DataFrame, keep_stars: bool = False) -> DataFrame:
    """A row a patched function: the file parses, the function is there, has a docstring and names its parameters."""

    def one(commit: str, path: str, source: str, qualnames: list[str]) -> list[tuple]:
        module = _module(path)
        tree = tree_of(source)
        nodes = named_functions(tree, module) if tree is not None else {}
        out = []
        for q in qualnames:
            node, errors, missing = nodes.get(q), [], []
            if tree is None:
                errors = ["syntax_error"]
            elif node is None or isinstance(node, ast.ClassDef):
                errors = ["node_not_found"]
            elif not (doc := ast.get_docstring(node)):
                errors = ["missing_docstring"]
            else:
                missing = [p for p in params_of(node) if (p if keep_stars else p.lstrip("*")) not in doc]
                errors = ["missing_params"] if missing else []
            out.append((commit, path, q, not errors, errors, missing, None))
        return out

    once = spread(patched.select("commit", "path", "qualname", "new_source"), "commit", "path").groupBy("commit", "path").agg(F.first("new_source").alias("new_source"), F.collect_list("qualname").alias("qualnames"))  # bounded by one file
    return once.mapInArrow(_by_file(one, VERIFY_SCHEMA), VERIFY_SCHEMA)


def report(results: DataFrame) -> DataFrame:
    """A row a commit: all ok, and how many were checked."""
    return results.groupBy("commit").agg(F.bool_and("ok").alias("ok"), F.count(F.lit(1)).alias("num_targets_checked"))
