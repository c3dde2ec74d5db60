from itertools import islice

import pytest
from pyspark.sql import functions as F

from seqloom.operators import interpret, metrics, mutagenesis, prep, sampling
from seqloom.plans import training


def test_shuffle_and_sample(spark):
    df = spark.range(500).repartition(7)
    order = [r["id"] for r in sampling.shuffled(df, F.col("id"), 5).orderBy("place").collect()]
    assert sorted(order) == list(range(500)) and order != list(range(500))
    # No trend: of neighbours in the order about half go up, and a third of the places holds a third of each third of the ids.
    assert 200 < sum(a < b for a, b in zip(order, order[1:])) < 300
    assert all(35 < sum(i // 167 == part for i in order[:167]) < 80 for part in range(3))
    strands = [r["x"] for r in df.orderBy("id").select((sampling.draw(F.col("id"), 5, 2) % 2).alias("x")).collect()]
    assert 200 < sum(a == b for a, b in zip(strands, strands[1:])) < 300
    picked = [r["id"] for r in sampling.sample_rows(df, F.col("id"), 20, 5).orderBy("place").collect()]
    assert picked == order[:20]
    assert sampling.sample_rows(df, F.col("id"), 900, 5).count() == 500
    assert sampling.shuffled(df.limit(0), F.col("id"), 5).count() == 0


def test_draws_go_on_until_enough_are_accepted(spark):
    parts = spark.createDataFrame([(1, 10), (2, 30), (3, 0)], "part int, size int")
    draws = lambda n, first=0: sampling.weighted_draws(parts, "part", F.col("size"), n, 3, first=first)
    rare = lambda c: c.filter("offset = 7 and strand = '-'")
    got = [r["draw_id"] for r in sampling.accepted_draws(draws, rare, 25).orderBy("draw_id").collect()]
    every = sorted(r["draw_id"] for r in rare(draws(6000)).collect())
    assert len(got) == 25 and got == every[:25]
    with pytest.raises(ValueError, match="0 draws"):
        sampling.accepted_draws(draws, lambda c: c.filter("offset > 40"), 2, rounds=2)
    batches = list(islice(sampling.endless(lambda first, n: draws(n, first), 8, first=16), 2))
    assert [sorted(r["draw_id"] for r in b.collect()) for b in batches] == [list(range(16, 24)), list(range(24, 32))]
    whole = {r["draw_id"]: tuple(r) for r in draws(32).collect()}
    assert all(whole[r["draw_id"]] == tuple(r) for b in batches for r in b.collect())


def test_loaded_batches(spark):
    df = spark.range(100).withColumnRenamed("id", "row")
    plain = sampling.loaded(df, "row", 8, subset=(20, 50)).orderBy("place").collect()
    assert [r["row"] for r in plain] == list(range(20, 50)) and plain[-1]["batch_id"] == 3
    mixed = sampling.loaded(df, "row", 8, subset=(20, 50), shuffle_seed=1).orderBy("place").collect()
    assert sorted(r["row"] for r in mixed) == list(range(20, 50)) and [r["place"] for r in mixed] == list(range(30))


def test_modes_and_filters(spark):
    a, b = spark.range(3), spark.range(3, 5)
    modes = sampling.by_mode({"train": a, "test": b})
    assert {(r["id"], r["mode"]) for r in modes.collect()} == {(0, "train"), (1, "train"), (2, "train"), (3, "test"), (4, "test")}
    for wrong in ({"other": a}, {}):
        with pytest.raises(ValueError):
            sampling.by_mode(wrong)
    assert sampling.defaults() == {"validate": 32000, "test": 640000} and sampling.defaults(test=5)["test"] == 5
    rows = spark.createDataFrame([("ACGT", [0, 1], "c", 0), ("ACGN", [0, 0], "c", -1), ("", [], "d", 3), (None, [0], None, 4)], "seq string, labels array<int>, chrom string, start int")
    seq = F.col("seq")
    checks = [
        (sampling.has_positive(F.col("labels")), [True, False, False, False]), (sampling.has_positive(F.col("labels"), True), [True] * 4),
        (sampling.retrieved(seq), [True, True, False, False]), (sampling.long_enough(seq, 4), [True, True, False, False]),
        (sampling.complete(seq, 4), [True, False, False, False]), (sampling.complete(seq, 3), [False] * 4),
        (sampling.held_out(F.col("chrom"), F.col("start"), ["c"]), [True, False, False, False]),
    ]
    for column, expected in checks:
        assert [r["x"] for r in rows.select(column.alias("x")).collect()] == expected


def test_small_tables(spark):
    files = spark.createDataFrame([("x",), ("y",)], "file string")
    meta = spark.createDataFrame([("x", "K562")], "file string, cell string")
    assert {tuple(r) for r in prep.with_metadata(files, meta).collect()} == {("x", "K562"), ("y", None)}
    q = spark.createDataFrame([("a", None), ("c", 0.1), ("b", 0.1), ("d", 0.0)], "feature string, q double")
    assert [r["feature"] for r in prep.by_q(q).collect()] == ["d", "b", "c", "a"]
    scores = spark.createDataFrame([("a", float("nan")), ("b", 0.5), ("c", None)], "feature string, auc double")
    assert {tuple(r) for r in metrics.scores_by_feature(scores, "auc").collect()} == {("a", None), ("b", 0.5), ("c", None)}
    mutants = spark.createDataFrame([("s", 3.0), ("s", 1.0), ("t", 2.0)], "name string, score double")
    base = spark.createDataFrame([("s", 2.0), ("t", 2.0)], "name string, score double")
    assert sorted((r["name"], r["effect"]) for r in mutagenesis.effects(mutants, base, "name").collect()) == [("s", -1.0), ("s", 1.0), ("t", 0.0)]
    steps = spark.createDataFrame([(i, float(i), 0.5) for i in range(5)], "step int, loss double, seconds double")
    assert sorted((r["report"], r["loss"], r["steps_per_second"]) for r in training.report(steps, 3).collect()) == [(0, 1.0, 2.0), (1, 3.5, 2.0)]


def test_variant_places_follow_the_sorted_order(spark):
    rows = [(i, c, p, "A", "C") for i, (c, p) in enumerate([("chr10", 70000), ("chr2", 5), ("chrX", 1), ("chr2", 200000), ("chrUn", 3), (None, 2), ("chr2", 5), ("chrM", None)])]
    v = spark.createDataFrame(rows, "id int, chrom string, pos int, ref string, alt string")
    placed = interpret.variant_places(v, "id")
    got = [r["id"] for r in placed.orderBy("place").collect()]
    expected = [r["id"] for r in v.orderBy(interpret.chromosome_key(F.col("chrom")), "chrom", "pos", "id").collect()]
    assert got == expected and sorted(r["place"] for r in placed.collect()) == list(range(1, 9))


def test_weights_below_the_floor_go_and_the_rest_is_renormalised(spark):
    rows = [(1, 10**6), (2, 3 * 10**6), (3, 1), (4, 10**17), (5, 0), (6, 10**8)]
    got = {r["k"]: r["weight"] for r in sampling.weights(spark.createDataFrame(rows, "k int, n long"), F.col("n")).collect()}
    assert set(got) == {4, 6} and abs(sum(got.values()) - 1) < 1e-12 and got[6] == pytest.approx(1e8 / (1e17 + 1e8))
    assert sampling.weights(spark.createDataFrame([], "k int, n long"), F.col("n")).count() == 0


def test_mutations_check_their_arguments(spark):
    df = spark.createDataFrame([("ACGT",), ("AC",)], "seq string")
    for wrong in ({"n": 0}, {"n": 3, "start": 1, "end": 3}, {"start": 3, "end": 3}, {"start": -1}):
        with pytest.raises(ValueError):
            mutagenesis.mutations(df, **wrong)
    assert mutagenesis.mutations(df, n=3).count() == 4 * 27
