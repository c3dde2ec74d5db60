"""The pipeline's stages on a small table, each against what it must do to its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from seqloom.llm import pii, shared

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = shared.read_table(spark, SF, "documents")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(shared.written(stage(spark, tables[-1], SF), f"test-{name}"))
    start, good, lines, single, masked, packed = tables
    labels = shared.read_table(spark, SF, "labels")
    kept = good.join(labels, "doc_id").groupBy("quality").count().collect()
    there = {r["quality"]: r["count"] for r in start.join(labels, "doc_id").groupBy("quality").count().collect()}
    got = {r["quality"]: r["count"] for r in kept}
    assert got.get(1, 0) >= 0.98 * there[1] and got.get(0, 0) <= 0.1 * there.get(0, 0) + 1
    assert lines.count() == good.count()
    texts = [r["text"].lower() for r in single.collect()]
    assert len(texts) == len(set(texts)) and single.select("doc_id").distinct().count() == len(texts)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    similar = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not similar
    assert pii.find(masked).filter(F.exists("spans", lambda s: s["base"])).isEmpty()
    assert packed.select("doc_id").distinct().count() == masked.count() == single.count()
    assert all(t.columns == docs.columns for t in tables[:-1])


def test_registered():
    import __spark_entry__

    assert set(corpus_pipeline.QUERIES) <= set(__spark_entry__.queries())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_near_duplicates_keep_rows_without_an_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (4, text), (2, text.upper()), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(None, text), (None, text), (2, text.upper()), (3, None), (None, None)], key=str)


def test_near_duplicates_with_repeated_ids_and_rows(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a, "en"), (1, b, "en"), (2, a, "de"), (1, b, "de"), (3, b.upper(), "en"), (1, b, "de"), (0, b + " more", "en")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, `_digest` string, sketch string"
    docs = spark.createDataFrame([(i, t, lang, None, 0, "x", "y") for i, t, lang in rows], kind)
    got = [tuple(r)[:3] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(got) == [(0, b + " more", "en"), (1, a, "en")]
    got = corpus_pipeline.drop_near_duplicates(spark, docs.filter("doc_id = 1"), SF).collect()
    assert sorted(tuple(r)[:3] for r in got) == [(1, a, "en"), (1, b, "de")]


def test_stages_on_an_empty_table(spark):
    docs = shared.read_table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, SF), f"empty-{name}")
        assert docs.count() == 0
