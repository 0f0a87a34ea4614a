"""The corpus pipeline: quality, boilerplate lines, near copies, benchmark leaks, packing.

Each stage works on all rows that the stage before it kept; run() writes each stage's rows to
the shared folder and reads them again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import classify, decontaminate, linededup, packing, setjoin
from lodestone.llm.store import materialize, new_path, scratch
from lodestone.work import delete

#: Documents with a lower probability of good quality go.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from labelled documents that aren't held out."""
    model = classify.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return classify.score(docs, model, name="__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of all texts; n_chars follows."""
    out = linededup.remove_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return setjoin.keep_one(docs, k=5, percent=80).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with ten words of a benchmark item in a row, or all words of a shorter item; an item needs no id."""
    hits = decontaminate.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), prefix="__", unnamed=True)
    return hits.where(F.size("__hit_starts") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("line dedup", lines), ("near copies", near_copies), ("benchmark leaks", benchmark_leaks), ("packing", packed)]

#: Neither the classifier nor the tokenizer can be written in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work tables of a stage, and the rows of the stage before it, are deleted when its rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
