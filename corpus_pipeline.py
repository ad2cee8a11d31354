"""A corpus pipeline: quality, near-duplicates, benchmark decontamination, personal data, source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import Workspace, scratch
from cairn.llm.decontaminate import decontaminate
from cairn.llm.mixing import mix_sources
from cairn.llm.pii import redact
from cairn.llm.quality import score_quality
from cairn.llm.simhash import near_duplicates


#: What the last stage adds.
PLACES = ("n_tokens", "epoch", "block", "position")


def _fresh(docs: DataFrame) -> str:
    """A name that no column of ``docs`` has."""
    name = "__row"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _known(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column ``name``: the doc_id and a hash of all columns, so rows that share an id stay apart."""
    return docs.withColumn(name, F.struct("doc_id", F.xxhash64(*docs.columns).alias("hash")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents vote for; the others go. Empty texts have an even vote and stay."""
    own = {c: f"{_fresh(docs)}{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # the operator adds columns
    scored = score_quality(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 1").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of every group of near-duplicates (of several, that of the smallest hash).

    Documents link by their SimHash fingerprints, at 3 bits of 64, and, as most near copies differ in more, also by the
    exact Jaccard similarity of their sets of five-word shingles.
    """
    row = _fresh(docs)
    near = near_duplicates(_known(docs, row).select(row, "text"), id_col=row, radius=3, fp_width=3, similarity=0.8)
    first = near.where(F.col("component_id") == F.col("doc_id")).select(F.col("doc_id").alias(row)).distinct()
    return _known(docs, row).join(first, row, "left_semi").dropDuplicates([row]).select(*docs.columns)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    row = _fresh(docs)
    found = decontaminate(_known(docs, row).select(row, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    bad = found.where("contaminated").select(F.col("doc_id").alias(row)).distinct()
    return _known(docs, row).join(bad, row, "left_anti").select(*docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture with the places (PLACES) at which each occurrence is to be read.

    Columns of documents that have such a name make way for them.
    """
    row = _fresh(docs)
    placed = mix_sources(_known(docs, row).select(row, "text", "source"), id_col=row).select(F.col("doc_id").alias(row), *PLACES)
    # equal rows have equal places to fill, so one of them stands for all
    return _known(docs, row).dropDuplicates([row]).drop(*PLACES).join(placed, row).drop(row)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", unseen), ("pii", without_pii), ("mixing", mixture)]

#: Votes of nearest neighbours and SimHash components have no SQL form; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what each stage returns is written to the shared folder, read again, and then freed."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with scratch():  # what the operator wrote for itself goes once the stage's result is written
            docs = work.save(stage(spark, docs, sf_dir), name)
        if k:
            work.drop(STAGES[k - 1][0])
    return docs
