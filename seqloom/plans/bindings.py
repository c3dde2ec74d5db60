"""Sequences, features, windows and scores read off the driver's tables, in Spark and as DuckDB SQL.

Each function has its SQL twin under the same name in ``SQL``; the queries in ``catalog`` build on both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.5
DIMS = 64  # prediction features: the dimensions of the vectors
SEED = 1337


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seq(spark, sf_dir) -> DataFrame:
    """name, seq: every document as a sequence; letters outside the alphabet are unknown."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("name"), F.upper(F.regexp_replace("text", "[^ACGTacgt]", "N")).alias("seq"))


def dense(spark, sf_dir) -> DataFrame:
    """name, seq: only the alphabet's letters of every document, in their own case; can be empty."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("name"), F.regexp_replace("text", "[^ACGTacgt]", "").alias("seq"))


def feat(spark, sf_dir) -> DataFrame:
    r = read(spark, sf_dir, "lineitem")
    start = F.floor("l_extendedprice").cast("long")
    return r.select(
        F.col("l_suppkey").alias("chrom"), start.alias("fs"), (start + (F.col("l_quantity") * 20).cast("long")).alias("fe"),
        F.concat("l_returnflag", "l_linestatus").alias("feature"), F.col("l_partkey").alias("part"),
        F.when(F.col("l_linenumber") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def win(spark, sf_dir) -> DataFrame:
    n = read(spark, sf_dir, "supplier").count()
    r = read(spark, sf_dir, "orders")
    centre = F.pmod(F.floor("o_totalprice").cast("long"), F.lit(105000))
    return r.select(F.col("o_orderkey").alias("id"), F.pmod("o_custkey", F.lit(n)).alias("chrom"), (centre - 100).alias("qs"), (centre + 100).alias("qe"))


def names(spark, sf_dir) -> DataFrame:
    return feat(spark, sf_dir).select("feature").distinct().withColumn("threshold", F.lit(THRESHOLD).cast("float"))


def scores(spark, sf_dir) -> DataFrame:
    """feature, id, target, score: a logistic score of each vector's dimensions; the target is its label's parity."""
    e = read(spark, sf_dir, "embeddings")
    long = e.select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("ix", "x"))
    score = F.round(1 / (1 + F.exp(-8 * F.col("x").cast("double"))), 5)
    return long.select(F.concat(F.lit("f"), F.col("ix")).alias("feature"), "id", (F.col("label") % 2).alias("target"), score.alias("score"), "ix")


def ref_alt(spark, sf_dir) -> DataFrame:
    """id, feature, ref, alt: the scores of a vector and of the next one."""
    s = scores(spark, sf_dir)
    ref = s.select("id", "feature", F.col("score").alias("ref"))
    alt = s.select((F.col("id") - 1).alias("id"), "feature", F.col("score").alias("alt"))
    return ref.join(alt, ["id", "feature"])


def letters(spark, sf_dir) -> DataFrame:
    """name, seq: the letters A, C, G, T and N of every document in upper case; can be empty."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("name"), F.upper(F.regexp_replace("text", "[^ACGTNacgtn]", "")).alias("seq"))


def places(spark, sf_dir) -> DataFrame:
    """mode, place, name, start, end: a range of a document's letters for every order; some documents validate, some test."""
    n = read(spark, sf_dir, "documents").count()
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.pmod("o_custkey", F.lit(n)).alias("name"), F.pmod(F.floor("o_totalprice").cast("long"), F.lit(300)).alias("start"))
    return o.select(mode(F.col("name")).alias("mode"), "place", "name", "start", (F.col("start") + 50 + F.col("place") % 150).alias("end"))


def mode(name):
    return F.when(name % 10 == 7, "validate").when(name % 10 == 8, "test").otherwise("train")


def marks(spark, sf_dir) -> DataFrame:
    """chrom, fs, fe, feature: labelled ranges of the documents' letters."""
    n = read(spark, sf_dir, "documents").count()
    r = read(spark, sf_dir, "lineitem")
    start = F.pmod(F.floor("l_extendedprice").cast("long"), F.lit(500))
    return r.select(F.pmod("l_partkey", F.lit(n)).alias("chrom"), start.alias("fs"), (start + F.col("l_quantity").cast("long")).alias("fe"), F.concat("l_returnflag", "l_linestatus").alias("feature"))


SQL = {
    "letters": "SELECT doc_id AS name, upper(regexp_replace(text, '[^ACGTNacgtn]', '', 'g')) AS seq FROM documents",
    "places": """SELECT CASE name % 10 WHEN 7 THEN 'validate' WHEN 8 THEN 'test' ELSE 'train' END AS mode, place, name, start, start + 50 + place % 150 AS "end"
        FROM (SELECT o_orderkey AS place, o_custkey % (SELECT count(*) FROM documents) AS name, floor(o_totalprice)::BIGINT % 300 AS start FROM orders)""",
    "marks": """SELECT l_partkey % (SELECT count(*) FROM documents) AS chrom, floor(l_extendedprice)::BIGINT % 500 AS fs, floor(l_extendedprice)::BIGINT % 500 + l_quantity::BIGINT AS fe,
        l_returnflag || l_linestatus AS feature FROM lineitem""",
    "seq": "SELECT doc_id AS name, upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')) AS seq FROM documents",
    "dense": "SELECT doc_id AS name, regexp_replace(text, '[^ACGTacgt]', '', 'g') AS seq FROM documents",
    "feat": """SELECT l_suppkey AS chrom, floor(l_extendedprice)::BIGINT AS fs, floor(l_extendedprice)::BIGINT + (l_quantity * 20)::BIGINT AS fe,
        l_returnflag || l_linestatus AS feature, l_partkey AS part, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand FROM lineitem""",
    "win": """SELECT o_orderkey AS id, o_custkey % (SELECT count(*) FROM supplier) AS chrom,
        floor(o_totalprice)::BIGINT % 105000 - 100 AS qs, floor(o_totalprice)::BIGINT % 105000 + 100 AS qe FROM orders""",
    "names": "SELECT DISTINCT l_returnflag || l_linestatus AS feature, 0.5::FLOAT AS threshold FROM lineitem",
    "scores": """SELECT 'f' || ix AS feature, vec_id AS id, label % 2 AS target, round(1 / (1 + exp(-8 * embedding[ix + 1]::DOUBLE)), 5) AS score, ix
        FROM embeddings, (SELECT unnest(range(64)) AS ix)""",
    "ref_alt": """SELECT a.id, a.feature, a.score AS ref, b.score AS alt FROM scores a JOIN scores b ON b.id = a.id + 1 AND a.feature = b.feature""",
}
NEEDS = {"ref_alt": ("scores",)}


def with_views(*views: str) -> str:
    """A WITH clause of the named views and of those they need."""
    wanted: list[str] = []
    for v in views:
        wanted += [*NEEDS.get(v, ()), v]
    return "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in dict.fromkeys(wanted))
