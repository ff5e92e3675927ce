"""The corpus pipeline over `documents`: STAGES, run() and ORACLE_SQL.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of `documents`.  run() writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartospark.llm.decontaminate import decontaminate
from cartospark.llm.jaccard_join import drop_near_copies
from cartospark.llm.quality_classifier import GOOD, GOOD_PROB, GRADE_FIELDS, LEVELS, grade, label_grades, train
from cartospark.llm.quality_rules import FIELDS, quality_rules
from cartospark.llm.queries import segmentation_digest
from cartospark.llm.store import Scratch, free_names
from cartospark.plans.ship import shipped


def _kept(docs: DataFrame, judge, fields: list) -> DataFrame:
    """The rows that judge(docs, prefix=...) keeps, its columns under a prefix that no column of docs has."""
    names = free_names(docs.columns, *[f.name for f in fields])
    prefix = names[0][: -len(fields[0].name)]
    return judge(docs, prefix=prefix).where(f"`{prefix}kept`").select(*[f"`{c}`" for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably good, by a model fitted on the rated ones among them."""
    weights, thresholds = train(docs, label_grades(spark.read.parquet(f"{sf_dir}/labels.parquet")), LEVELS)
    return _kept(docs, lambda d, prefix: grade(d, weights, thresholds, GOOD, GOOD_PROB, prefix=prefix), GRADE_FIELDS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and lie within the compression bands."""
    return _kept(docs, quality_rules, FIELDS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_copies(docs, size=5, percent=80)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document left. Workers still hold memory of earlier stages, so tasks remember less."""
    return segmentation_digest(docs, lattice_nodes=300_000)


STAGES = [
    ("quality classifier", shipped(quality_classifier)), ("quality rules", shipped(rules)), ("n-gram Jaccard join", shipped(near_copies)),
    ("benchmark decontamination", shipped(benchmark_overlaps)), ("SentencePiece encoding and decoding", shipped(segmentations)),
]

#: Trained weights, compression and sampled segmentations have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
        scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
