"""A corpus pipeline of five stages, each one of the operators of polyfold.llm.

Quality classifier, near-duplicates, decontamination and mixing return rows in the columns of documents; the
last stage writes the mix as range-coded token ids and returns what the files hold of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyfold.llm import common as C
from polyfold.llm import decontam, mixing, near_dedup, quality_classifier, token_output


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of its own for each row, written once so that it stays the same, and that column's name.

    Ids may be null or repeated, so stages decide on rows.
    """
    (row,) = C.fresh(docs.columns, "_row")
    return C.written(docs.withColumn(row, F.monotonically_increasing_id()), docs.sparkSession), row


def _without(rows: DataFrame, row: str, out: DataFrame) -> DataFrame:
    """The documents of rows whose numbers are not in out (one column)."""
    (gone,) = C.fresh(rows.columns, "_gone")
    out = out.toDF(gone).distinct()
    return rows.join(out, F.col(row) == F.col(gone), "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the quality classifier rejects; it learns from the labels of the documents given.

    Rows of null ids, null or empty texts and repeated rows are scored like any other, each for itself.
    """
    rows, row = _keyed(docs)
    scores = quality_classifier.classify(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), row_col=row)
    return _without(rows, row, scores.where("predicted = 0").select(row))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id (five words, similarity 0.8).

    Null ids come last, and of rows that repeat an id the first one stays. Rows without words are in no group.
    """
    rows, row = _keyed(docs)
    found = near_dedup.near_duplicates(rows, k=5, percent=80, id_col=row).select(F.col("doc_id").alias("r"), F.col("component_id").alias("g"))
    ids = rows.select(F.col(row).alias("r"), F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(row).alias("c")).alias("rank"))
    ranked = C.written(found.join(ids, "r"), spark)
    kept = ranked.groupBy("g").agg(F.min("rank").alias("m")).select(F.col("m.c").alias("r"))
    return _without(rows, row, ranked.join(kept, "r", "left_anti").select("r"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows in which a benchmark item is found within its error budget."""
    rows, row = _keyed(docs)
    return _without(rows, row, decontam.contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row).select("doc_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, read back from the written segments."""
    return token_output.token_files(docs)


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("token output", tokens),
]
#: Fourier features, signatures and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, C.finished(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), spark)
        C.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
