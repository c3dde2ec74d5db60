"""Site-relative line deduplication.

Lines are counted per host: the pages of a host that contain a line, divided by all pages of that
host. Lines above the boilerplate ratio go, wherever they stand; the order of the rest stays.

Scale: a page counts once per line before anything is shuffled, only 16-byte line digests travel,
and counts are combined map-side, so a host with a third of all pages costs no more than others.
A host keeps fewer than (its lines per page / ratio) boilerplate lines; that bounded list is joined
to the pages under a salt, so no host's pages meet in one task.

Defined cases: null text counts as empty and stays null if nothing goes; null hosts form one host; a line repeated within
one page counts once but is dropped everywhere; blank lines are never boilerplate; a line on one page alone says nothing about its
host and stays (``min_pages``), so hosts of one page lose nothing; from two pages on the ratio decides; repeated rows count as often as they
stand; an empty table gives no rows; very long texts are cut into lines like others; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

SALTS = 16


def html_lines(html: Column) -> Column:
    """The visible lines of a page: scripts, styles and comments go, block tags end a line."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|article|section|nav|header|footer|tr|td|table|title|head|body)\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def drop_boilerplate(
    pages: DataFrame, host: Column, lines: Column, salt: Column, max_ratio: float = 0.2, min_pages: int = 2
) -> DataFrame:
    """``_row`` (all columns of ``pages``), ``_host``, ``_lines`` and ``_kept``, the lines that stay.

    ``lines`` is an array of strings, ``salt`` any column that spreads the pages of a host.
    """
    keyed = pages.select(
        F.struct(*pages.columns).alias("_row"),
        F.coalesce(host.cast("string"), F.lit("")).alias("_host"),
        lines.alias("_lines"),
        F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    digests = F.array_distinct(F.transform(F.filter("_lines", lambda x: F.trim(x) != ""), lambda x: F.md5(x.cast("binary"))))
    seen = keyed.select("_host", F.explode(digests).alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    totals = keyed.groupBy("_host").agg(F.count(F.lit(1)).alias("_total"))
    often = seen.filter(F.col("_n") >= min_pages).join(totals, "_host").filter(F.col("_n") > F.col("_total") * F.lit(max_ratio))
    often = written(often.groupBy("_host").agg(F.collect_list("_line").alias("_often")), "boilerplate")
    often = often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = keyed.join(often, ["_host", "_salt"], "left")
    kept = F.when(F.col("_often").isNull(), F.col("_lines")).otherwise(
        F.filter("_lines", lambda x: ~F.array_contains("_often", F.md5(x.cast("binary"))))
    )
    return joined.select("_row", "_host", "_lines", kept.alias("_kept"))


def page_lines(pages: DataFrame, **options) -> DataFrame:
    """Raw web pages: page_id, host, n_lines, n_dropped, text."""
    out = drop_boilerplate(pages.select("page_id", "url", "html"), url_host(F.col("url")), html_lines(F.col("html")), F.col("page_id"), **options)
    return out.select(
        F.col("_row.page_id").alias("page_id"),
        F.col("_host").alias("host"),
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).alias("n_dropped"),
        F.array_join("_kept", "\n").alias("text"),
    )


def document_lines(docs: DataFrame, **options) -> DataFrame:
    """Documents by source, without boilerplate lines; the columns and rows stay, n_chars follows the text."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    out = drop_boilerplate(docs, F.col("source"), lines, F.xxhash64("doc_id", F.length("text")), **options)
    text = F.when(F.size("_kept") == F.size("_lines"), F.col("_row.text")).otherwise(F.array_join("_kept", "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(dict(docs.dtypes)["n_chars"])
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
