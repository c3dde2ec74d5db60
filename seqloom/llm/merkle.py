"""Document fingerprints as Merkle trees (native: DataFrame functions only).

A text is cut without loss into sections (at empty lines), paragraphs (at line ends) and segments
of at most ``SEGMENT`` code points. Leaves are digests of segments; a paragraph, a section and the root
hash the digests below them. Roots are equal exactly when texts are (up to SHA-256); leaves in
common measure likeness, and the branches that differ show where an edit lies.

A fingerprint is written ``root:section/section``, a section ``paragraph,paragraph``, a paragraph
``leaf-leaf``; the upper nodes follow from the leaves.

Defined cases: null text counts as empty; the empty text has a root and no leaf; two texts
without leaves are alike 1.0 if equal, else 0.0; rows of equal id stand in order of their text's hash; a table of one
row is its own successor; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import whole_text

SEGMENT = 64
LEAF_DIGITS = 12
ROOT_DIGITS = 32
BUCKET_BYTES = 128 << 20  # of text in one range bucket, on average


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _digest(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, digits)


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text column without nulls."""

    def paragraph(p):
        segments = F.regexp_extract_all(p, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))
        return F.array_join(F.transform(segments, lambda s: _digest(s, LEAF_DIGITS)), "-")

    def node(children, sep):
        # What a level above hashes: its children's digests, in order.
        return let(children, lambda c: F.struct(F.array_join(c, sep).alias("text"), F.array_join(F.transform(c, lambda x: _digest(x, ROOT_DIGITS)), sep).alias("below")))

    def section(s):
        return node(F.transform(F.split(s, "\n"), paragraph), ",")

    def whole(sections):
        root = _digest(F.array_join(F.transform(sections, lambda s: _digest(s["below"], ROOT_DIGITS)), "/"), ROOT_DIGITS)
        return F.concat(root, F.lit(":"), F.array_join(F.transform(sections, lambda s: s["text"]), "/"))

    return let(F.transform(F.split(text, "\n\n"), section), whole)


def leaves(fp: Column) -> Column:
    return F.filter(F.split(F.substring_index(fp, ":", -1), "[-,/]"), lambda x: x != "")


def likeness(a: Column, b: Column) -> Column:
    """1.0 for equal roots, else twice the distinct leaves in common over the leaves of both."""
    def shared(s):
        both = F.size(s["a"]) + F.size(s["b"])
        return F.when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(both, F.lit(1)))

    dice = let(F.struct(F.array_distinct(leaves(a)).alias("a"), F.array_distinct(leaves(b)).alias("b")), shared)
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.lit(1.0)).otherwise(dice)


def differing(a: Column, b: Column) -> Column:
    """Numbers (section, paragraph, from 0) of the branches of ``a`` whose counterpart in ``b`` differs or is missing."""
    def sections(fp):
        return F.transform(F.split(F.substring_index(fp, ":", -1), "/"), lambda s: F.split(s, ","))

    def walk(x):
        per_section = F.transform(
            x["a"], lambda s, i: F.filter(F.transform(s, lambda p, j: F.when(F.coalesce(F.get(F.get(x["b"], i), j) == p, F.lit(False)), None).otherwise(F.struct(i.alias("section"), j.alias("paragraph")))), lambda r: r.isNotNull())
        )
        return F.flatten(per_section)

    return let(F.struct(sections(a).alias("a"), sections(b).alias("b")), walk)


def bucket_count(docs: DataFrame) -> int:
    """How many range buckets the texts need at ``BUCKET_BYTES`` each; not fewer than the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET_BYTES))


def _buckets(docs: DataFrame, number: int) -> Column:
    """A range bucket of doc_id, by about equal counts; found in two steps of sqrt(number) comparisons."""
    shares = [i / number for i in range(1, number)]
    accuracy = max(10_000, 20 * number)
    bounds = docs.agg(F.percentile_approx("doc_id", shares, accuracy).alias("b")).first()["b"] if shares else None
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0)
    width = max(1, math.isqrt(len(bounds)))

    def constant(values):
        # Written as one string, which Catalyst folds to an array, however many there are.
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")

    heads, every = constant(bounds[::width]), constant(bounds)

    def below(array):
        return F.size(F.filter(array, lambda x: x <= key))

    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    return let(below(heads), lambda n: F.when(n == 0, 0).otherwise((n - 1) * width + below(F.slice(every, F.greatest((n - 1) * width + 1, F.lit(1)), F.lit(width)))))


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, fp and the next document's next_text and next_fp, by descending doc_id, the last one's being the first.

    The text is shuffled once, by range buckets of the id; the last row of a bucket takes the first of the next one,
    which a second scan fetches: one row per bucket.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    number = buckets or bucket_count(base)
    bucket = _buckets(base.select("doc_id"), number)
    keyed = base.withColumn("tie", F.xxhash64("text")).withColumn("bucket", bucket.cast("int"))
    dealt = keyed.repartition(number, "bucket")  # the number of tasks follows the bytes as well, not the session's setting
    heads = keyed.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), "doc_id", "tie")).alias("head"))
    order = Window.orderBy(F.desc("bucket"))  # one row per bucket
    after = F.coalesce(F.lead("head").over(order), F.first("head").over(order))
    heads = heads.select("bucket", after.alias("after")).select("bucket", F.col("after.doc_id").alias("at_id"), F.col("after.tie").alias("at_tie"))
    found = keyed.select(F.col("doc_id").alias("at_id"), F.col("tie").alias("at_tie"), F.col("text").alias("head_text"))
    texts = found.join(F.broadcast(heads), found["at_id"].eqNullSafe(heads["at_id"]) & (found["at_tie"] == heads["at_tie"]))
    texts = texts.select("bucket", "head_text").groupBy("bucket").agg(F.first("head_text").alias("head_text"))
    texts = texts.withColumn("head_fp", fingerprint(F.col("head_text")))
    trees = dealt.withColumn("fp", fingerprint(F.col("text")))
    within = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("doc_id"), F.desc("tie"))
    led = trees.withColumn("next", F.lead(F.struct("text", "fp")).over(within))
    led = led.join(texts, "bucket")  # led is dealt by bucket already: only the few head texts move
    return led.select(
        "doc_id", "text", "fp", F.coalesce("next.text", "head_text").alias("next_text"), F.coalesce("next.fp", "head_fp").alias("next_fp")
    )


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Each document's fingerprint, and that of its text with the second half replaced from the next document."""
    rows = with_next(docs, buckets).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.expr("concat(left(text, int(n_chars - n_chars div 2)), left(next_text, int(n_chars div 2)))"))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
