"""The corpus pipeline: quality, line and near-duplicate filters, privacy, packing.

``STAGES`` are applied in order; each takes (spark, docs, sf_dir), is written as Parquet and read again
as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import line_dedup, packing, pii, quality, queries, shared, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null text counts as empty; repeated rows and rows without an id are judged like others; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    scored = quality.scored(docs, shared.read_table(spark, sf_dir, "labels"))
    return scored.filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a fifth of their source's documents have go; no document goes.

    Rows without a source form one source; null and empty texts and very long ones stay documents; repeated rows all count.
    """
    return line_dedup.document_lines(docs.select(*COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that with the smallest (id, text digest).

    Different texts with one id are different documents. Of rows with equal id and text the least (by the other columns) stays.
    Null text counts as empty, rows without an id all stay, an empty table gives no rows, very long texts are read whole.
    """
    docs = docs.select(*COLUMNS)
    named = docs.filter("doc_id is not null").withColumn("_digest", simhash.text_digest())
    groups = simhash.similar_groups(named.select("doc_id", "text")).filter("keep").select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_least"))
    kept = named.hint("merge").join(groups, "_digest").filter("doc_id = _least")
    # Rows of one text that even share their id are rare; only those are compared column by column.
    rows = named.groupBy("_digest", "doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_digest", "doc_id")
    rows = shared.written(rows, "repeated-rows")
    unnamed = docs.filter("doc_id is null")
    if rows.isEmpty():
        return kept.select(*COLUMNS).unionByName(unnamed)
    single = kept.join(rows, ["_digest", "doc_id"], "left_anti").select(*COLUMNS)
    least = kept.join(rows, ["_digest", "doc_id"], "left_semi").groupBy("_digest").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return single.unionByName(least).unionByName(unnamed)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in angle brackets; no row goes, null text stays null."""
    return pii.masked(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its ids, its sequence and its place there; null text is one piece with the end id alone."""
    return packing.pack_documents(docs, queries.vocabulary(queries.WORD_VOCABULARY), with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_boilerplate_lines),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is a written table."""
    docs = shared.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


ORACLE_SQL = None  # the classifier, the near-duplicate search and the packing are beyond SQL: see tests/llm

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
