"""Python sources as rows: definitions, calls, imports and bases, by Arrow-batched table functions.

``level`` 1 resolves names as the plain syntax tree allows; 2 also follows bases, ``super()`` and the types
of local variables. A source that does not parse gives no rows."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.names import BUILTINS, EXTERNAL_MODULES

DEFS_SCHEMA = "ordinal int, kind string, qualname string, lineno int, end_lineno int, body_line int, params array<string>, docstring string"
CALLS_SCHEMA = "caller string, callee string, line int"
BASES_SCHEMA = "child string, ord int, base string"
DOCS_SCHEMA = "docstring string"
FILES = 64  # files whose rows a worker holds at once
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_OUTSIDE = frozenset(BUILTINS) | frozenset(EXTERNAL_MODULES)


def tree_of(source: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def params_of(node) -> list[str]:
    """Names in call order with their stars, without self and cls."""
    a = node.args
    names = [x.arg for x in (*a.posonlyargs, *a.args)]
    names += [f"*{a.vararg.arg}"] if a.vararg else []
    names += [x.arg for x in a.kwonlyargs]
    names += [f"**{a.kwarg.arg}"] if a.kwarg else []
    return [n for n in names if n not in ("self", "cls")]


def definitions(source: str | None, module: str) -> Iterator[tuple]:
    """Functions and classes in pre-order; decorators stand outside the span."""
    tree = tree_of(source)
    if tree is None:
        return
    todo, ordinal = [(tree, module)], 0
    while todo:
        node, scope = todo.pop()
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            scope = f"{scope}.{node.name}" if scope else node.name
            kind = "class" if isinstance(node, ast.ClassDef) else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
            params = [] if kind == "class" else params_of(node)
            yield ordinal, kind, scope, node.lineno, node.end_lineno, node.body[0].lineno, params, ast.get_docstring(node)
            ordinal += 1
        todo.extend((child, scope) for child in reversed(list(ast.iter_child_nodes(node))))


def import_base(module: str, name: str | None, level: int) -> str | None:
    """What ``from <dots><name> import`` refers to, seen from ``module``."""
    if not level:
        return name
    package = [p for p in module.split(".") if p][:-1]
    package = package[: max(len(package) - (level - 1), 0)]
    return ".".join([*package, *([name] if name else [])]) or None


def aliases_of(tree: ast.AST, module: str) -> dict[str, str]:
    """Names bound by imports anywhere in the module. Plain ``import x`` and stars bind nothing here."""
    out: dict[str, str] = {}
    todo = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, ast.Import):
            out.update({a.asname: a.name for a in node.names if a.asname})
        elif isinstance(node, ast.ImportFrom):
            base = import_base(module, node.module, node.level)
            out.update({a.asname or a.name: f"{base}.{a.name}" if base else a.name for a in node.names if a.name != "*"})
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return out


def dotted(node: ast.AST) -> list[str] | None:
    """The parts of a pure ``a.b.c`` chain."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return [node.id, *reversed(parts)] if isinstance(node, ast.Name) else None


class _Resolver:
    """Walks one module and yields its calls."""

    def __init__(self, tree: ast.Module, module: str, level: int):
        self.module, self.level, self.aliases = module, level, aliases_of(tree, module)
        self.defined = {module} | {d[2] for d in _defs_of(tree, module)}
        self.bases = {child: base for child, ord_, base in _bases(tree, module, self) if ord_ == 0} if level > 1 else {}

    def name(self, parts: list[str]) -> str:
        """A chain with its first part replaced by what it stands for; a bare name may be the module's own."""
        head, rest = parts[0], parts[1:]
        if head in self.aliases:
            return ".".join([self.aliases[head], *rest])
        if not rest and self.module and f"{self.module}.{head}" in self.defined:
            return f"{self.module}.{head}"
        return ".".join(parts)

    def calls(self, node: ast.AST, scope: str, cls: str | None, types: dict[str, str]) -> Iterator[tuple[str, str, int]]:
        if isinstance(node, ast.ClassDef):
            scope = cls = f"{scope}.{node.name}" if scope else node.name
            types = {}
        elif isinstance(node, _FUNCTIONS):
            scope = f"{scope}.{node.name}" if scope else node.name
            types = self.annotated(node) if self.level > 1 else {}
        elif self.level > 1 and isinstance(node, (ast.Assign, ast.AnnAssign)):
            self.assigned(node, types)
        if isinstance(node, ast.Call) and scope and (callee := self.callee(node.func, scope, cls, types)):
            yield scope, callee, node.lineno
        for child in ast.iter_child_nodes(node):
            yield from self.calls(child, scope, cls, types)

    def callee(self, func: ast.AST, scope: str, cls: str | None, types: dict[str, str]) -> str | None:
        parts = dotted(func)
        if parts is None:
            if self.level < 2 or not isinstance(func, ast.Attribute):
                return None
            inner = func.value
            if isinstance(inner, ast.Call) and isinstance(inner.func, ast.Name) and inner.func.id == "super":
                base = self.bases.get(cls or "")
                return f"{base}.{func.attr}" if base else None
            return func.attr
        if parts[0] in ("self", "cls") and len(parts) > 1:
            owner = cls or scope.rpartition(".")[0]
            return ".".join([owner, *parts[1:]]) if owner else ".".join(parts)
        if len(parts) > 1 and parts[0] in types:
            return ".".join([types[parts[0]], *parts[1:]])
        return self.name(parts)

    def type_name(self, node: ast.AST | None) -> str | None:
        parts = dotted(node) if node is not None else None
        if parts is None and isinstance(node, ast.Constant) and isinstance(node.value, str) and all(p.isidentifier() for p in node.value.split(".")):
            parts = node.value.split(".")
        return self.name(parts) if parts and parts[0] not in _OUTSIDE else None

    def annotated(self, node) -> dict[str, str]:
        a = node.args
        args = [x for x in (*a.posonlyargs, *a.args, *a.kwonlyargs) if x.arg not in ("self", "cls")]
        return {x.arg: t for x in args if (t := self.type_name(x.annotation))}

    def assigned(self, node, types: dict[str, str]) -> None:
        if isinstance(node, ast.AnnAssign):
            targets, found = [node.target], self.type_name(node.annotation)
        else:
            parts = dotted(node.value.func) if isinstance(node.value, ast.Call) else None
            targets, found = node.targets, self.name(parts) if parts and parts[-1][:1].isupper() and parts[0] not in _OUTSIDE else None
        for t in targets:
            if isinstance(t, ast.Name) and found:
                types[t.id] = found


def _defs_of(tree: ast.Module, module: str) -> Iterator[tuple]:
    todo = [(tree, module)]
    while todo:
        node, scope = todo.pop()
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            scope = f"{scope}.{node.name}" if scope else node.name
            yield node, node.name, scope
        todo.extend((c, scope) for c in ast.iter_child_nodes(node))


def _bases(tree: ast.Module, module: str, names: _Resolver) -> Iterator[tuple[str, int, str]]:
    for node, _, qual in _defs_of(tree, module):
        if isinstance(node, ast.ClassDef):
            chains = [p for b in node.bases if (p := dotted(b))]
            for k, parts in enumerate(chains):
                yield qual, k, names.name(parts)


def calls(source: str | None, module: str, level: int = 1) -> list[tuple[str, str, int]]:
    tree = tree_of(source)
    return list(_Resolver(tree, module, level).calls(tree, module, None, {})) if tree is not None else []


def bases(source: str | None, module: str) -> list[tuple[str, int, str]]:
    tree = tree_of(source)
    return sorted(_bases(tree, module, _Resolver(tree, module, 1))) if tree is not None else []


def docs(source: str | None, module: str) -> list[tuple[str]]:
    """The module's own docstring, if it has one."""
    tree = tree_of(source)
    doc = ast.get_docstring(tree) if tree is not None else None
    return [(doc,)] if doc else []


def _rows(parser, schema: str):
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, FILES):
                keys, sources, modules = (c.to_pylist() for c in batch.slice(start, FILES).columns[:3])
                found = [(k, *r) for k, source, module in zip(keys, sources, modules, strict=True) for r in parser(source, module or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], f.type) for n, f in enumerate(ARROW[schema])], schema=ARROW[schema])

    return run


_S, _I = pa.string(), pa.int32()
ARROW = {
    DEFS_SCHEMA: pa.schema([("blob", _S), ("ordinal", _I), ("kind", _S), ("qualname", _S), ("lineno", _I), ("end_lineno", _I), ("body_line", _I), ("params", pa.list_(_S)), ("docstring", _S)]),
    CALLS_SCHEMA: pa.schema([("blob", _S), ("caller", _S), ("callee", _S), ("line", _I)]),
    BASES_SCHEMA: pa.schema([("blob", _S), ("child", _S), ("ord", _I), ("base", _S)]),
    DOCS_SCHEMA: pa.schema([("blob", _S), ("docstring", _S)]),
}


def _parsed(files: DataFrame, parser, schema: str) -> DataFrame:
    """Parse each distinct (blob, module) once, then join its rows back to (commit, path). For files that are at
    hand as texts; files of a repository go through ``sources.parsed``, which moves names only."""
    from tremor.functions.names import module_qual

    keyed = files.where("source is not null").withColumn("module", module_qual(F.col("path"))).withColumn("key", F.sha2(F.concat_ws("\0", "module", "source"), 256))
    once = keyed.groupBy("key").agg(F.first("source").alias("source"), F.first("module").alias("module")).select("key", "source", "module")
    rows = once.mapInArrow(_rows(parser, schema), f"blob string, {schema}")
    places = keyed.select("commit", "path", F.col("key").alias("blob"))
    return places.join(rows, "blob").drop("blob")


def parse_defs(files: DataFrame) -> DataFrame:
    """(commit, path, ordinal, kind, qualname, lineno, ...) of ``files(commit, path, source)``."""
    return _parsed(files, definitions, DEFS_SCHEMA)


def parse_calls(files: DataFrame, level: int = 1) -> DataFrame:
    return _parsed(files, lambda s, m: calls(s, m, level), CALLS_SCHEMA)


def parse_bases(files: DataFrame) -> DataFrame:
    return _parsed(files, bases, BASES_SCHEMA)


def parse_docs(files: DataFrame) -> DataFrame:
    """(commit, path, docstring) of modules that have one."""
    return _parsed(files, docs, DOCS_SCHEMA)


def register_udtfs(spark) -> None:
    """``py_defs(source, module)`` and ``py_calls(source, module)`` for SQL."""
    from pyspark.sql.functions import udtf

    class Defs:
        def eval(self, source: str, module: str):
            yield from definitions(source, module or "")

    class Calls:
        def eval(self, source: str, module: str):
            yield from calls(source, module or "")

    spark.udtf.register("py_defs", udtf(Defs, returnType=DEFS_SCHEMA))
    spark.udtf.register("py_calls", udtf(Calls, returnType=CALLS_SCHEMA))
