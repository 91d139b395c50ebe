"""Parsed sources by content: every (blob, module) of a repository is read and parsed once, ever.

A store is a folder of generations, each a Parquet table with one row a (blob, module): whether it parsed, and its
definitions, calls, bases and module docstring as arrays. A generation counts when its ``_SUCCESS`` file is there, so a run that dies
leaves nothing half done; where two runs parsed the same content, the least generation has it. Blobs are read and
parsed in one step by the tasks that hold their names, so no source text is ever shuffled or stored.

``blob`` is git's content hash. The module is part of the key, as names are resolved from it. A blob that is no
text or no Python has a row without arrays and is not tried again."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions.checkpoints import folder
from tremor.functions.names import module_qual
from tremor.operators import parse
from tremor.sources import git, sinks

_FIELDS = {"defs": parse.DEFS_SCHEMA, "calls": parse.CALLS_SCHEMA, "bases": parse.BASES_SCHEMA, "docs": parse.DOCS_SCHEMA}


def _struct(schema: str) -> str:
    return ", ".join(f.replace(" ", ":", 1) for f in schema.split(", "))


SCHEMA = "blob string, module string, gen string, ok boolean, " + ", ".join(f"{k} array<struct<{_struct(v)}>>" for k, v in _FIELDS.items())


def _arrow() -> pa.Schema:
    rows = {k: pa.list_(pa.struct([f for f in parse.ARROW[v] if f.name != "blob"])) for k, v in _FIELDS.items()}
    return pa.schema([("blob", pa.string()), ("module", pa.string()), ("gen", pa.string()), ("ok", pa.bool_()), *rows.items()])


def _parser(repo: str, level: int, gen: str):
    names = {k: [f.split()[0] for f in v.split(", ")] for k, v in _FIELDS.items()}

    def run(batches):
        schema = _arrow()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            out = []
            for (blob, module), raw in zip(keys, git.blobs(repo, [b for b, _ in keys]), strict=True):
                source = git.decoded(raw)
                ok = source is not None and parse.tree_of(source) is not None
                found = {"defs": parse.definitions(source, module), "calls": parse.calls(source, module, level), "bases": parse.bases(source, module), "docs": parse.docs(source, module)} if ok else {}
                out.append({"blob": blob, "module": module, "gen": gen, "ok": ok} | {k: [dict(zip(names[k], r, strict=True)) for r in rows] for k, rows in found.items()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def modules(entries: DataFrame) -> DataFrame:
    return entries.withColumn("module", module_qual(F.col("path")))


class ParseStore:
    """The store of one repository and parser level; without a path it lasts as long as the session's scratch tables."""

    def __init__(self, spark: SparkSession, repo: str, level: int = 2, path: str | None = None):
        self.spark, self.repo, self.level, self.last = spark, repo, level, None
        self.path = f"{(path or f'{folder(spark)}/parsed-{uuid.uuid4().hex}').rstrip('/')}/level{level}"

    def generations(self) -> list[str]:
        return [p for p in sinks.children(self.spark, self.path) if sinks.exists(self.spark, f"{p}/_SUCCESS")]

    def rows(self) -> DataFrame:
        have = self.generations()
        return self.spark.read.schema(SCHEMA).parquet(*have) if have else self.spark.createDataFrame([], SCHEMA)

    def owners(self) -> DataFrame:
        """(blob, module, gen): which generation has a content."""
        return self.rows().groupBy("blob", "module").agg(F.min("gen").alias("gen"))

    def refresh(self, entries: DataFrame) -> int:
        """Parse what ``entries(path, blob)`` have and the store has not; how many that were."""
        wanted = modules(entries.where("blob is not null")).select("blob", "module").distinct()
        new = wanted.join(self.rows().select("blob", "module"), ["blob", "module"], "left_anti") if self.generations() else wanted
        gen = uuid.uuid4().hex
        new.mapInArrow(_parser(self.repo, self.level, gen), SCHEMA).write.parquet(f"{self.path}/{gen}")
        self.last = gen
        return self.fresh().count()

    def fresh(self) -> DataFrame:
        """(blob, module) that the last ``refresh`` parsed."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{self.last}").select("blob", "module")

    def table(self, entries: DataFrame, kind: str) -> DataFrame:
        """The defs, calls, bases or docs of ``entries(..., path, blob)``, with the columns of these."""
        rows = self.rows().select("blob", "module", "gen", F.explode(kind).alias("_r"))
        key = ["blob", "module"]
        places = modules(entries)
        if len(self.generations()) > 1:  # within one, a content has one row
            places, key = places.join(self.owners(), key), [*key, "gen"]
        return places.join(rows, key).select(*entries.columns, "_r.*").drop("blob")

    def compact(self) -> None:
        """All generations as one, which is written before they go."""
        old, gen = self.generations(), uuid.uuid4().hex
        if len(old) > 1:
            self.rows().join(self.owners(), ["blob", "module", "gen"], "left_semi").withColumn("gen", F.lit(gen)).write.parquet(f"{self.path}/{gen}")
            for path in old:
                sinks.remove(self.spark, path)
