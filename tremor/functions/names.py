"""Column functions over dotted names and paths. Everything stays inside Catalyst."""

from __future__ import annotations

import builtins
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bare names that are never repository code.
BUILTINS = sorted(n for n, v in vars(builtins).items() if callable(v) and not n.startswith("_"))
#: Third-party and alias top-level modules treated as external besides the standard library.
THIRD_PARTY = [
    "typing_extensions", "pytest", "numpy", "np", "pandas", "pd", "scipy", "sklearn", "requests", "flask", "django", "fastapi",
    "click", "rich", "tqdm", "yaml", "toml",
]
EXTERNAL_MODULES = sorted({*sys.stdlib_module_names, *THIRD_PARTY})


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashed(path), "/"), -1)


def repo_name(path: Column) -> Column:
    """Last part of a path; ``repo`` if there is none."""
    return F.coalesce(F.nullif(F.element_at(F.split(F.rtrim(slashed(path), F.lit("/")), "/"), -1), F.lit("")), F.lit("repo"))


def module_qual(path: Column, strip_init: bool = False) -> Column:
    """``pkg/mod.py`` as ``pkg.mod``; ``__init__`` is kept unless ``strip_init``."""
    name = F.translate(F.regexp_replace(slashed(path), r"\.py$", ""), "/", ".")
    return F.regexp_replace(name, r"(^|\.)__init__$", "") if strip_init else name


def suffixes(name: Column) -> Column:
    """All dotted suffixes, the longest first."""
    p = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "."))


def prefixes(name: Column) -> Column:
    """All dotted prefixes, the longest first."""
    p = F.split(name, r"\.")
    return F.transform(F.sequence(F.size(p), F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(p, 1, i), "."))


def parent_qual(name: Column) -> Column:
    """Everything before the last dot; null if there is none."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", ""))


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def depth(name: Column) -> Column:
    return F.size(F.split(name, r"\.")) - 1


def is_python(path: Column) -> Column:
    return F.endswith(path, F.lit(".py"))


def is_test_path(path: Column) -> Column:
    p = F.lower(slashed(path))
    return F.contains(p, F.lit("/tests/")) | F.startswith(p, F.lit("tests/")) | F.startswith(basename(p), F.lit("test_"))


def is_external(callee: Column, own_packages: list[str] | None = None) -> Column:
    """A builtin bare name, or a dotted name of an external module. The repository's own
    top-level packages are never external (``own_packages=[]`` keeps the raw list)."""
    modules = [m for m in EXTERNAL_MODULES if m not in set(own_packages or [])]
    first = F.element_at(F.split(callee, r"\."), 1)
    return F.when(F.contains(callee, F.lit(".")), first.isin(modules)).otherwise(callee.isin(BUILTINS))


def indent_of(line: Column) -> Column:
    return F.regexp_extract(line, r"^([ \t]*)", 1)


def source_lines(source: Column) -> Column:
    """Lines split at CRLF, CR or LF, the line ends that the parser counts."""
    return F.split(source, r"\r\n|\r|\n")


def snippet(source: Column, first: Column, last: Column) -> Column:
    """Lines first..last, counted from 1, inclusive, clamped."""
    lines = source_lines(source)
    a = F.greatest(first, F.lit(1)).cast("int")
    n = F.greatest(F.least(last, F.size(lines)) - a + 1, F.lit(0)).cast("int")
    return F.array_join(F.slice(lines, a, n), "\n")


def style_description(style: Column) -> Column:
    return F.when(style == "numpy", "NumPy style with underlined sections").when(style == "sphinx", "Sphinx style with field lists").otherwise("Google style with indented sections")


def placeholder_docstring(params: Column) -> Column:
    """A docstring that names every parameter, as lines with the quotes."""
    quotes = '"""'
    named = F.concat(F.array(F.lit(quotes + "TODO: docstring"), F.lit(""), F.lit("Args:")), F.transform(params, lambda p: F.concat(F.lit("    "), p, F.lit(":"))), F.array(F.lit(quotes)))
    return F.when(F.coalesce(F.size(params), F.lit(0)) > 0, named).otherwise(F.array(F.lit(f"{quotes}TODO: docstring{quotes}")))


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` holes; braces inside values are not filled again, ``{{`` and ``}}`` are braces."""
    parts, rest = [], template
    while rest:
        at = min((rest.find(b) for b in "{}" if b in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        if rest[at : at + 2] in ("{{", "}}"):
            parts.append(F.lit(rest[at]))
            rest = rest[at + 2 :]
            continue
        end = rest.index("}", at)
        name = rest[at + 1 : end]
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[end + 1 :]
    return F.concat(*parts) if parts else F.lit("")
