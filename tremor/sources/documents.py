"""Readers of the documents an analysis leaves behind."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources import sinks

BATCH_KEYS = "commit string, mode string, ok boolean, exit_code int, runner_ms bigint"
SEEDS = (
    "commit string, parent string, repo string, num_files_in_diff bigint, num_py_files_in_diff bigint, num_seeds bigint, "
    "seeds array<struct<path:string,version:string,line:int,kind:string,qualname:string,span:array<int>,reason:string,is_test:boolean,seed_type:string,new_code:string,old_code:string>>, generated_at string"
)


def commit_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, commit): first token of each line; blanks and # lines are skipped; the order of the file is kept."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("ord", "line"))
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    kept = lines.where((line != "") & ~F.startswith(line, F.lit("#")))
    return kept.select("ord", F.element_at(F.split(line, " "), 1).alias("commit"))


def json_document(spark: SparkSession, path: str, schema: str = SEEDS) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def resume_rows(spark: SparkSession, path: str, schema: str = BATCH_KEYS) -> DataFrame:
    """Rows of a JSON-lines log, of its finished chunks if it is keyed; malformed lines and rows without commit or
    mode are dropped."""
    keyed = any("/chunk=" in p for p in sinks.children(spark, path)) if sinks.exists(spark, path) else False
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    have = sinks.finished(spark, path) if keyed else [path]
    rows = reader.json(have) if have else spark.createDataFrame([], schema)
    return rows.where("commit is not null and mode is not null")


def newest_path(spark: SparkSession, pattern: str) -> str | None:
    """A file as it is; of a glob or a folder, the file changed last, then the greatest by name. From the file
    system's listing, so names that begin with ``_`` or ``.`` count (but for Hadoop's own marks), and no content is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = at.getFileSystem(conf)
    found = list(fs.globStatus(at) or [])
    if len(found) == 1 and found[0].isDirectory():
        found = list(fs.listStatus(found[0].getPath()))
    own = lambda name: name == "_SUCCESS" or name.endswith(".crc")
    files = [(f.getModificationTime(), f.getPath().toString()) for f in found if f.isFile() and not own(f.getPath().getName())]
    return max(files)[1] if files else None


def seeds_document(spark: SparkSession, pattern: str) -> DataFrame:
    """(commit, path, kind, qualname, seed_type, ...) of the newest seeds document that ``pattern`` names: a file of
    one or more documents, a glob of such files, a folder of them, or a folder that one job wrote, which is read whole."""
    path = f"{pattern}/part-*" if sinks.exists(spark, f"{pattern}/_SUCCESS") else newest_path(spark, pattern)
    if path is None:
        raise FileNotFoundError(f"no seeds document at {pattern}")
    documents_ = spark.read.text(path, lineSep="\n}\n").select(F.from_json(F.concat("value", F.lit("\n}")), SEEDS).alias("d"))
    return documents_.where("d.commit is not null").select("d.commit", F.explode("d.seeds").alias("s")).select("commit", "s.*")


def newest_run(names: DataFrame) -> DataFrame:
    """The greatest run name; names begin with their time."""
    return names.agg(F.max("name").alias("name"))


def settings(path: str | None = None) -> dict:
    """A TOML or YAML settings file, if any; secrets come from the environment only."""
    path = path or os.environ.get("TREMOR_CONFIG", "")
    out: dict = {}
    if path and os.path.isfile(path):
        with open(path, "rb") as f:
            if path.endswith(".toml"):
                out = tomllib.load(f)
            else:
                try:
                    import yaml
                except ImportError as e:
                    raise RuntimeError("YAML settings need PyYAML") from e
                out = yaml.safe_load(f) or {}
    out["api_key"] = os.environ.get("TREMOR_API_KEY")
    return out
