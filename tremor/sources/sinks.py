"""Writers: tables for the engine, JSON, CSV and text for people."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators.batch import sparse_union


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return bool(fs.globStatus(p)) if "*" in path else fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Files and folders right under a folder, by name; none if it is not there."""
    fs, p = _at(spark, path)
    return sorted(f.getPath().toString() for f in fs.listStatus(p)) if fs.exists(p) else []


def table(df: DataFrame, path: str, by: str = "commit", mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(by).parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """JSON lines, appended; a resumed batch reads them back."""
    rows.write.mode("append").json(path)


def keyed_log(rows: DataFrame, path: str, key: str) -> None:
    """The rows of ``key`` as JSON lines, in place of those that the log had of it."""
    rows.write.mode("overwrite").json(f"{path}/chunk={key}")


def finished(spark: SparkSession, path: str) -> list[str]:
    """The folders of a keyed log that were written to their end; those of a dead run lack the mark."""
    return [p for p in children(spark, path) if "/chunk=" in p and exists(spark, f"{p}/_SUCCESS")]


def read_log(spark: SparkSession, path: str, schema: str | None = None, but: str | None = None) -> DataFrame:
    """All finished rows of a keyed log, but for those of one key; without any, none of ``BATCH_KEYS``."""
    from tremor.sources.documents import BATCH_KEYS

    have = [p for p in finished(spark, path) if not but or not p.endswith(f"/chunk={but}")]
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(have) if have else spark.createDataFrame([], schema or BATCH_KEYS)


def named_files(df: DataFrame, name: str, content: str, folder: str) -> int:
    """A text file a row under ``folder``, by the tasks that hold the rows; how many were written. A name that
    comes again is written again."""
    target = _at(df.sparkSession, folder)[0].makeQualified(_at(df.sparkSession, folder)[1]).toString()

    def run(batches):
        for batch in batches:
            fs, base = pafs.FileSystem.from_uri(target)
            fs.create_dir(base)
            for file, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{base}/{file}") as f:
                    f.write(text_.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = df.select(F.col(name).alias("name"), F.col(content).alias("text")).where("name is not null and text is not null")
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def json_documents(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a row, nulls kept."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "true"}).alias("value")).write.mode(mode).text(path, lineSep="\n\n")


def csv_summary(parts: list[DataFrame], path: str) -> None:
    """A header with the sorted union of all columns."""
    sparse_union(parts).write.mode("overwrite").option("header", True).csv(path)


def text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).where("value is not null").write.mode("overwrite").text(path)
