"""Parsing, patching, verification, experiments and generation on short sources."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremor.functions import names as N
from tremor.operators import experiment, generate, graph, parse, patch, style

CODE = """
from . import sib
from .sib import thing as t
import numpy as np


class A(sib.Base):
    def m(self, x: "Other", *a, k, **w):
        y = Other()
        y.go()
        x.run()
        super().m()
        f().g()
        return self.n(t(), np.abs(x))


def f():
    return later()


async def later():
    pass
"""


def test_calls_by_level():
    one = {c[:2] for c in parse.calls(CODE, "pkg.mod")}
    assert ("pkg.mod.A.m", "pkg.mod.A.n") in one and ("pkg.mod.f", "pkg.mod.later") in one and ("pkg.mod.A.m", "pkg.sib.thing") in one
    assert ("pkg.mod.A.m", "y.go") in one and not any(c == "g" for _, c in one)
    two = {c[:2] for c in parse.calls(CODE, "pkg.mod", 2)}
    assert ("pkg.mod.A.m", "Other.go") in two and ("pkg.mod.A.m", "Other.run") in two and ("pkg.mod.A.m", "pkg.sib.Base.m") in two and ("pkg.mod.A.m", "g") in two
    assert parse.bases(CODE, "pkg.mod") == [("pkg.mod.A", 0, "pkg.sib.Base")]
    assert parse.calls("def (", "m") == [] and list(parse.definitions("def (", "m")) == []


def test_inheritance(spark):
    nodes = spark.createDataFrame([("a.P",), ("a.P.run",), ("a.P.only",), ("a.C",), ("a.C.run",)], "qualname string")
    edges = spark.createDataFrame([("x", "a.C.only")], "caller string, callee string")
    inherits = spark.createDataFrame([("a.C", 0, "P")], "child string, ord int, base string")
    got = {(r.caller, r.callee, r.edge_type) for r in graph.inheritance_edges(nodes, edges, inherits).collect()}
    assert got == {("a.C.run", "a.P.run", "OVERRIDES"), ("a.C.only", "a.P.only", "INHERITS")}


SOURCES = [
    ("def f(a): return a\n", "m.f"),
    ("class C:\n    @staticmethod\n    def f(a):\n        @wrap\n        def g():\n            return 1\n        return g\n", "m.C.f"),
    ("def f(a, *b):\n    '''Old\n    text.'''\n    return a\n", "m.f"),
    ("def f(a):\n    if a:\n        return 1\n    return 2", "m.f"),
    ("async def f():\n\treturn 1\n", "m.f"),
    ("def f(a): 'old'; return a\n", "m.f"),
]


@pytest.mark.parametrize("source,name", SOURCES)
def test_patched_sources_parse_and_keep_their_code(source, name):
    new, status = patch.put_docstring(source, name, "m", ['"""New.', "", "Args:", "    a:", '"""'])
    assert status in ("inserted", "updated")
    node = patch.named_functions(ast.parse(new), "m")[name]
    assert ast.get_docstring(node).startswith("New.")

    def bare(text):
        n = patch.named_functions(ast.parse(text), "m")[name]
        return [ast.dump(s) for s in (n.body[1:] if ast.get_docstring(n) is not None else n.body)]

    assert bare(new) == bare(source)


def test_statuses():
    assert patch.put_docstring("class C:\n    pass\n", "m.C", "m", ['"""x"""'])[1] == "not_a_function"
    assert patch.put_docstring("x = 1\n", "m.f", "m", ['"""x"""'])[1] == "node_not_found"
    assert patch.put_docstring("def f():\n    'doc'\n", "m.f", "m", ['"""x"""'], overwrite=False)[1] == "kept"
    assert patch.as_lines('One.\n\nTwo."""') == ['"""One.', "", "Two.", '"""']


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), unique=True, max_size=4))
def test_strict_rules_in_python(params):
    source = f"def f({', '.join(params)}):\n    return 1\n"
    doc = ['"""TODO: docstring', "", "Args:", *(f"    {p}:" for p in params), '"""'] if params else ['"""TODO: docstring"""']
    new, _ = patch.put_docstring(source, "m.f", "m", doc)
    got = ast.get_docstring(patch.named_functions(ast.parse(new), "m")["m.f"])
    assert all(p in got for p in params)


def test_mutations_fail_the_strict_check(spark):
    doc = "Do.\n\nArgs:\n    a:\n    *b:\n\nReturns:\n    x"
    docs = spark.createDataFrame([("c", "f", doc, ["a", "*b"]), ("c", "g", "Do.", [])], "commit string, qualname string, docstring string, params array<string>")
    got = {(r.qualname, r.setting): r.ok for r in experiment.mutation_results(docs).collect()}
    assert got[("f", "original")] and not any(got[("f", s)] for s in experiment.SETTINGS[1:]) and all(got[("g", s)] for s in experiment.SETTINGS)
    rates = {r.setting: r.pass_rate for r in experiment.pass_rates(experiment.commit_results(experiment.mutation_results(docs))).collect()}
    assert rates == {"original": 1.0, "drop_param": 0.0, "add_fake_param": 0.0, "rename_param": 0.0}


def test_answers(spark):
    fence = "```python\n\"\"\"Doc.\"\"\"\n```"
    df = spark.createDataFrame([(fence,), ("'''Doc.'''",), ("<think>x</think>Doc.",), ("",)], "t string")
    assert [r[0] for r in df.select(generate.clean_answer(F.col("t"))).collect()] == ["Doc.", "Doc.", "Doc.", ""]
    prompts = spark.createDataFrame([("a",), ("boom",)], "prompt string")

    def speak(p):
        if p == "boom":
            raise ValueError("no")
        return "[DOCSTRING]ok[/DOCSTRING]"

    rows = {r.prompt: r for r in generate.call_generator(prompts, speak, backoff_s=0.01).collect()}
    assert rows["a"].ok and rows["a"].answer and not rows["boom"].ok and "ValueError" in rows["boom"].error
    assert generate.prompt_names() == ["docstring", "docstring_diff", "docstring_impact", "module_analysis", "readme"]
    filled = spark.range(1).select(N.render("{{x}} {a} {b}", a=F.lit("{b}"), b=F.lit("2"))).first()[0]
    assert filled == "{x} {b} 2"


def test_styles(spark):
    docs = ["Args:\n    a: x\nReturns:\n    y", "Parameters\n----------\na", "Parameters\na", ":param a: b", "plain text", ""]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in docs], "t string").select(style.style_of(F.col("t"))).collect()]
    assert got == ["google", "numpy", "unknown", "sphinx", "unknown", "unknown"]


def test_layers_see_the_layer_before(spark):
    t = spark.createDataFrame([("a", 0, None), ("b", 1, "a")], "qualname string, hop int, source string")
    out = generate.layered(t, lambda p: f"[DOCSTRING]{p}[/DOCSTRING][ANALYSIS]of {p}[/ANALYSIS]", 1, lambda d: F.concat_ws("|", d["qualname"], d["parent_analysis"]))
    assert {r.qualname: r.parsed.docstring for r in out.collect()} == {"a": "a", "b": "b|of a"}


def test_a_worker_holds_the_rows_of_a_few_files_only():
    import pyarrow as pa

    from tremor.operators import parse

    n = 1000
    batch = pa.RecordBatch.from_pydict({"key": [str(k) for k in range(n)], "source": ["def f():\n    g()\n    h()\n" if k % 7 else None for k in range(n)], "module": ["m"] * n})
    out = list(parse._rows(lambda s, m: parse.calls(s, m, 2), parse.CALLS_SCHEMA)([batch]))
    assert max(b.num_rows for b in out) <= 2 * parse.FILES and sum(b.num_rows for b in out) == 2 * sum(k % 7 > 0 for k in range(n))
    assert pa.Table.from_batches(out).slice(2, 2).to_pylist() == [{"blob": "2", "caller": "m.f", "callee": c, "line": i} for i, c in ((2, "g"), (3, "h"))]
