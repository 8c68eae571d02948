"""Corpus pipeline: documents to a deduplicated, decontaminated training mix, stage by stage.

Each stage is a function (spark, docs, sf_dir) whose result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gainsieve.llm import decontaminate, lines, mixing, quality, simhash
from gainsieve.llm.common import read
from gainsieve.sources.workspace import Workspace


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from docs and the labels, does not reject."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without boilerplate lines; n_chars is that of the text left."""
    return lines.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id."""
    return simhash.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass of a document, with its text as far as the mix takes it; n_chars is that of this text.

    A document that the mix takes nothing of has a row with taken 0 and no text, which run() drops.
    """
    mix = mixing.served(docs, into="mix")
    into = mix.columns[-1]
    taken, size = F.col(f"{into}.taken"), F.col(f"{into}.size")
    n_chars = F.when((taken < size) | (taken == 0), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    # what the mix tells stands beside the columns of docs, as far as they leave its names free
    free = [c for c in mixing.SERVED if c.lower() not in {x.lower() for x in docs.columns}]
    return mix.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{into}.{c}").alias(c) for c in free], F.col(into))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
]

#: The first stage learns a model, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; what each stage returns is written as a table and read again. Returns the mix."""
    ws = Workspace(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs.where(F.col(docs.columns[-1])["taken"] > 0).drop(docs.columns[-1])
