"""Docstring generation behind a plain callable, and the parsing of its answers. No network here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Generator = Callable[[str], str]
CALL_SCHEMA = "answer string, ok boolean, error string, latency_ms long, prompt_tokens long, completion_tokens long"


@dataclass(frozen=True)
class Paced:
    """A generator that a whole job calls at most once in ``spacing_s`` seconds: time is cut into slots of that
    length, which are dealt in turn to the job's ``tasks``, and a task calls at the start of its own slots only."""

    generate: Generator
    spacing_s: float = 0.5
    tasks: int = 4

    def __call__(self, prompt: str) -> str:
        return self.generate(prompt)

    def wait(self, part: int, last: float) -> float:
        """Sleep to the next slot of task ``part`` after ``last``; when it begins."""
        period = self.spacing_s * self.tasks
        now = max(time.time(), last + period / 2)
        slot = (now // period) * period + part * self.spacing_s
        slot += period if slot < now else 0.0
        time.sleep(max(0.0, slot - time.time()))
        return slot


def call_generator(prompts: DataFrame, generate: Generator, attempts: int = 3, backoff_s: float = 1.0) -> DataFrame:
    """``prompts(..., prompt)`` with the answers. A failure becomes a row, never an exception. A ``Paced``
    generator is called by as many tasks as it has slots for, each attempt in a slot of its own."""
    names = prompts.columns
    paced = generate if isinstance(generate, Paced) else None
    if paced:
        prompts = prompts.repartition(paced.tasks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, part = 0.0, TaskContext.get().partitionId() if paced else 0
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                answer, error, began = None, None, time.monotonic()
                for k in range(attempts):
                    last = paced.wait(part, last) if paced else last
                    try:
                        answer, error = generate(prompt), None
                        break
                    except Exception as e:  # the generator is foreign code
                        error = f"{type(e).__name__}: {e}"
                        if k + 1 < attempts:
                            time.sleep(backoff_s * (k + 1))
                rows.append((answer, error is None, error, int(1000 * (time.monotonic() - began)), len((prompt or "").split()), len((answer or "").split())))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=[f.split()[0] for f in CALL_SCHEMA.split(", ")])], axis=1)[[*names, "answer", "ok", "error", "latency_ms", "prompt_tokens", "completion_tokens"]]

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema] + [CALL_SCHEMA])
    return prompts.mapInPandas(run, schema)


def _ws(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def without_quotes(text: Column) -> Column:
    """A code fence first, then triple quotes at either end."""
    fenced = F.startswith(text, F.lit("```"))
    inner = F.regexp_extract(text, r"(?s)\A```[^\n]*\n?(.*?)(?:\n[ \t]*```.*|\z)", 1)
    t = F.when(fenced, _ws(inner)).otherwise(text)
    for q in ('"""', "'''"):
        t = _ws(F.regexp_replace(t, rf"\A{q}", ""))
    for q in ('"""', "'''"):
        t = _ws(F.regexp_replace(t, rf"{q}\z", ""))
    return t


def clean_answer(text: Column) -> Column:
    """Fence, quotes, then thoughts, in this order."""
    return _ws(F.regexp_replace(without_quotes(_ws(text)), r"(?s)<think>.*?</think>", ""))


def section(text: Column, tag: str) -> Column:
    return F.regexp_extract(text, rf"(?s)\[{tag}\]\s*(.*?)\s*\[/{tag}\]", 1)


def tagged_answer(text: Column) -> Column:
    """struct(docstring, analysis); without a docstring section the whole text is the docstring."""
    t = _ws(F.regexp_replace(_ws(text), r"(?s)<think>.*?</think>", ""))
    doc = F.coalesce(F.nullif(section(t, "DOCSTRING"), F.lit("")), clean_answer(t))
    return F.struct(without_quotes(doc).alias("docstring"), section(t, "ANALYSIS").alias("analysis"))


def affected_functions(text: Column) -> Column:
    """The JSON list of the tagged section; empty on any failure; items without a qualname go."""
    kind = "array<struct<qualname:string,path:string,reason:string>>"
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    items = F.coalesce(F.from_json(section(t, "AFFECTED_FUNCTIONS"), kind), F.array().cast(kind))
    kept = F.filter(items, lambda x: x["qualname"].isNotNull())
    return F.transform(kept, lambda x: F.struct(x["qualname"].alias("qualname"), F.coalesce(x["path"], F.lit("")).alias("path"), F.coalesce(x["reason"], F.lit("")).alias("reason")))


def with_fallback(answer: Column, template_lines: Column) -> Column:
    """Generated lines, or the template's where there is no answer."""
    doc = F.nullif(tagged_answer(answer)["docstring"], F.lit(""))
    lines = F.split(F.concat(F.lit('"""'), doc), "\n")
    return F.coalesce(F.concat(lines, F.array(F.lit('"""'))), template_lines)


def call_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums, integer mean latency of the successes, success rate, first ten errors."""
    ok, n = F.col("ok"), F.count(F.lit(1))
    good = F.count_if(ok)
    errors = F.slice(F.array_sort(F.collect_set(F.when(~ok, F.substring("error", 1, 500)))), 1, 10)
    return log.groupBy(*(by or [])).agg(
        n.alias("total_calls"), good.alias("success_calls"), F.count_if(~ok).alias("failed_calls"), F.coalesce(F.sum(F.when(ok, F.col("prompt_tokens"))), F.lit(0)).alias("total_prompt_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("completion_tokens"))), F.lit(0)).alias("total_completion_tokens"), F.coalesce(F.sum(F.when(ok, F.col("latency_ms"))), F.lit(0)).alias("total_latency_ms"),
        F.coalesce(F.floor(F.try_divide(F.sum(F.when(ok, F.col("latency_ms"))), good)), F.lit(0)).alias("avg_latency_ms"),
        F.coalesce(F.try_divide(good, n), F.lit(0.0)).alias("success_rate"), errors.alias("errors"),
    )


PROMPTS = Path(__file__).parent.parent / "plans" / "prompts"


@cache
def prompt(name: str) -> str:
    return (PROMPTS / f"{name}.txt").read_text().strip()


def prompt_names() -> list[str]:
    return sorted(p.stem for p in PROMPTS.glob("*.txt"))


def layered(targets: DataFrame, generate: Generator, max_hops: int, render, by: tuple[str, ...] = ()) -> DataFrame:
    """Hop by hop: ``render(target columns, parent_analysis)`` gives the prompt; each layer sees the
    analyses of the layer before, of its own group of ``by``; of several answers for a name, the least analysis.
    The answers are stored after each hop, so no call runs twice."""
    from tremor.functions.checkpoints import cut

    out, parent = None, None
    for hop in range(max_hops + 1):
        layer = targets.where(F.col("hop") == hop)
        if parent is None:
            layer = layer.withColumn("parent_analysis", F.lit(None).cast("string"))
        else:
            layer = layer.join(parent, [*by, "source"], "left")
        done = cut(call_generator(layer.withColumn("prompt", render(layer)), generate).withColumn("parsed", tagged_answer(F.coalesce("answer", F.lit("")))))
        parent = done.groupBy(*by, F.col("qualname").alias("source")).agg(F.min("parsed.analysis").alias("parent_analysis"))
        out = done if out is None else out.unionByName(done)
    return out
