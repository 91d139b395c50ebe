"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which is
written as Parquet and read again for the next one. All but the last return the columns of ``docs``.

1. quality: rows whose score under the factorisation machine is below one half go (trained on the
   labelled rows of ``sf_dir``, whatever ``docs`` is).
2. near_dedup: one document of each near-duplicate group stays, that with the smallest doc_id; different
   texts of one doc_id are documents of their own, and of those that are near-duplicates the one with the
   least hash stays; of rows with the same doc_id and text the least stays; a row without words goes if its
   doc_id has another row; rows with a null doc_id stay.
3. decontaminate: rows that hold a window of a benchmark item go; a null doc_id is told apart by its text.
4. pii: spans of personal data are replaced by their kind in angle brackets, and n_chars follows.
5. packing: the pieces of sequences of at most 2048 tokens.

Null and empty texts: scored by the first stage, kept by 2 to 4, packed as their closing id. Empty
tables give empty tables. Extra columns of any name and type pass through stages 1 to 4, but for one
named ``_pii_spans``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tremor.llm import decontaminate, near_dedup, packing, pii, quality_fm
from tremor.llm.workspace import documents, stored


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_fm.fit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_fm.scored(docs, model).where("score >= 0.5").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    repeated = stored(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        gone = near_dedup.near_duplicates(docs).where("not kept").select("doc_id")
        return docs.join(stored(gone, "gone"), "doc_id", "left_anti").select(_columns(docs))

    # different texts of one id are documents of their own, under a key of id and text
    key = F.when(F.col("again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("key")
    marked = docs.select("doc_id", "text", F.struct(*_columns(docs)).alias("row")).join(repeated.select("doc_id", F.lit(True).alias("again")), "doc_id", "left")
    keyed = stored(marked.select(key, "doc_id", F.col("again").isNotNull().alias("again"), F.to_json("row").alias("least"), "row"), "keyed")
    found = near_dedup.near_duplicates(keyed.select(F.col("key").alias("doc_id"), "row.text")).where("doc_id is not null").withColumnRenamed("doc_id", "key")
    nodes = found.distinct().join(keyed.select("key", "doc_id").distinct(), "key")
    nodes = stored(nodes.select("key", F.struct("doc_id", "key").alias("first"), F.coalesce("component_id", "key").alias("group"), (F.col("n_shingles") == 0).alias("blank")), "nodes")
    leaders = nodes.groupBy("group").agg(F.min("first").alias("first"), F.first("blank").alias("blank"))
    # of the rows of an id without words one stays, and only if no row of that id has words
    blank = leaders.where("blank").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.min("first.key").alias("key"))
    blank = blank.join(nodes.where("not blank").select("first.doc_id").distinct(), "doc_id", "left_anti").select("key")
    kept = stored(leaders.where("not blank").select("first.key").union(blank), "kept")
    staying = keyed.join(kept, "key", "left_semi")
    folded = staying.where("again").groupBy("key").agg(F.min_by("row", "least").alias("row")).select("row.*")
    return keyed.where("key is null").select("row.*").unionByName(staying.where("not again").select("row.*")).unionByName(folded)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("key")
    found = decontaminate.contamination(docs.select(key.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = stored(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    return docs.select(key, F.struct(*_columns(docs)).alias("row")).join(bad, "key", "left_anti").select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.find(docs, by_kind=True).withColumn("text", pii.redacted(F.col("text"), F.col("_pii_spans"))).drop("_pii_spans")
    if "n_chars" in docs.columns and isinstance(kind := docs.schema["n_chars"].dataType, NumericType):
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, loss=packing.LOSS, prompt=packing.first_quarter(F.col("text")))


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: Trained models and iterated graph steps have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
