"""The registered query of each training-data operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, licences, line_dedup, merkle, packing, periodic, pieces, pii, quality, repeats, simhash, toxicity
from .shared import read_table, whole_text

WORD_VOCABULARY = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary(PIECE_MODEL)
    out = pieces.encode(read_table(spark, sf_dir, "documents"), model, decoded=True)
    return out.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.scored(docs, read_table(spark, sf_dir, "labels"))
    return out.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (~quality.in_training(F.col("row.doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs)).withColumn("doc_id", F.col("doc_id").cast("long"))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP5_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read_table(spark, sf_dir, "documents"))


def _op8_sql() -> str:
    known = ", ".join(f"('{s}', {n})" for n, s in licences.KNOWN)
    longer = [licences.longer_runs(name, run) for name, run in licences.RULES]
    assert max(map(len, longer)) == 1  # the SQL cuts out one longer run
    rules = ", ".join(f"('{name}', '{licences.written_run(run)}', '{''.join(cut)}', {licences.LICENCES.index(name)})" for (name, run), cut in zip(licences.RULES, longer, strict=True))
    return rf"""
WITH known(s, n) AS (VALUES {known}), rules(name, run, cut, place) AS (VALUES {rules}),
k AS (SELECT map_from_entries(list((s, n))) AS m FROM known),
cut AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.!?]+[ 	
]+|[.!?]+$|
', chr(1), 'g'), '[^a-z0-9]+', ' ', 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l
  FROM documents
), numbered AS (
  SELECT doc_id, len(l) AS n_sentences, list_transform(l, lambda x: coalesce(m[x], 0)) AS n FROM cut, k
), sequences AS (SELECT *, ',' || array_to_string(n, ',') || ',' AS q FROM numbered)
SELECT doc_id, n_sentences::INT AS n_sentences, array_to_string(list_filter(n, lambda x: x <> 0), ',') AS known,
  coalesce((SELECT string_agg(name, ',' ORDER BY place) FROM (SELECT DISTINCT name, place FROM rules WHERE contains(CASE WHEN cut = '' THEN q ELSE replace(q, cut, ',') END, run))), '') AS licences
FROM sequences
"""


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.page_lines(read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH cleaned AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
           '(?i)</?(p|div|li|ul|ol|h[1-6]|br|article|section|nav|header|footer|tr|td|table|title|head|body)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g') AS t
  FROM pages
), lines AS (
  SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM cleaned
), often AS (
  SELECT host, line FROM (SELECT page_id, host, unnest(list_distinct(l)) AS line FROM lines)
  JOIN (SELECT host, count(*) AS total FROM lines GROUP BY host) USING (host)
  GROUP BY host, line, total HAVING count(*) >= 2 AND count(*) > total * 0.2
), dropped AS (SELECT host, list(line) AS o FROM often GROUP BY host),
kept AS (
  SELECT page_id, host, len(l) AS n, list_filter(l, lambda x: NOT list_contains(coalesce(o, []), x)) AS k
  FROM lines LEFT JOIN dropped USING (host)
)
SELECT page_id, host, n::INT AS n_lines, (n - len(k))::INT AS n_dropped, sha256(array_to_string(k, chr(10))) AS kept_sha256 FROM kept
"""


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, read_table(spark, sf_dir, "labels"))
    return out.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        (~toxicity.in_training(F.col("row.doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), false) AS again
  FROM documents
), masks AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * again::INT AS mask
  FROM d
), known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask
), f(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT o, step, f.bit, coalesce((SELECT sum(bit) FROM f g WHERE strpos(o, g.l) < step), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step), f WHERE substr(o, step, 1) = f.l
), done AS (
  SELECT part, o, step, bit, sum(CASE WHEN mask & before = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, o, step, bit
)
SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM done
"""


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = periodic.runs(docs.select("doc_id", periodic.repeated_tail(F.col("text"), F.col("doc_id")).alias("text")))
    # The longest run; of equal ones that with the least start, then period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    written = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("_best", longest).select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(F.col("_best.length") * 1000 / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(written.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_quality": op2_quality,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_merkle": op6_merkle,
    "op7_simhash": op7_simhash,
    "op8_licences": op8_licences,
    "op9_repeats": op9_repeats,
    "op10_line_dedup": op10_line_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic": op13_periodic,
}
ORACLES = {"op5_exact_dedup": OP5_SQL, "op8_licences": _op8_sql(), "op10_line_dedup": OP10_SQL, "op12_filter_audit": OP12_SQL}
