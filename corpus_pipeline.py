"""Training-corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

Each stage takes the documents its predecessor kept and returns documents with the same columns; the last
returns packed token pieces. Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoframe.llm import decontaminate, neardup, packing, quality, secrets
from phenoframe.llm.session import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the rows of labels that aren't held out."""
    labels = _table(spark, sf_dir, "labels").where(~quality.held_out("doc_id"))
    return quality.accept(docs, quality.fit_model(docs, labels, "doc_id", "text", "quality"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group; of rows that repeat id and text, one."""
    found = neardup.near_duplicates(docs, percent=80)
    gone = found.where("not kept").select(F.col("doc").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def _key(docs: DataFrame) -> DataFrame:
    """Identity of a row for a join back: its id, if any, and its text."""
    body = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.withColumn("_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), body))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    keyed = _key(docs)
    found = decontaminate.find_windows(keyed, _table(spark, sf_dir, "benchmark"), doc_id="_key")
    bad = found.where("contaminated").select(F.col("doc").alias("_key")).distinct()
    return keyed.join(bad, "_key", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text."""
    forest = secrets.fit_forest(secrets.labelled_findings(spark))
    seen = secrets.accepted(secrets.findings(F.col("text"), secrets.path_of(docs, "source"), forest))
    clean = docs.withColumn("_found", seen)
    columns = {"text": secrets.redacted(F.col("text"), F.col("_found"))}
    if "n_chars" in docs.columns:
        count = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.size("_found") > 0, count).otherwise(F.col("n_chars"))
    return clean.withColumns(columns).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack_documents(docs).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontamination", drop_contaminated),
    ("secrets", redact_secrets), ("packing", pack)]

# Training, connected components and tokenisation have no SQL form; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
