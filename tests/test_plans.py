import pytest
from pyspark.sql import functions as F

from seqloom.plans import jobs, training
from seqloom.streaming import live


def test_job_specification(tmp_path):
    r = jobs.Registry()
    r.register("add", lambda a, b, extra=0: a + b + extra)
    spec = jobs.load("ops: [evaluate, analyze]\nevaluate: !obj:add {a: 1, b: !float ${N}}\nanalyze: {prediction: !obj:add {a: 5, b: 6}, variant_effect_prediction: !obj:add {a: 0, b: 0}}\n", r, {"N": "2"})
    assert jobs.execute(spec, extra=10) == [("evaluate", 13.0), ("variant_effect_prediction", 10), ("prediction", 21)]
    with pytest.raises(ValueError):
        jobs.load("ops: [other]", r)
    with pytest.raises(KeyError):
        jobs.load("ops: [train]\ntrain: !obj:os.system {}", r)


def test_state_machines(tmp_path):
    rate = training.PlateauRate(1.0, factor=0.5, patience=1)
    assert [rate.step(x) for x in (0.5, 0.5, 0.5, 0.4)] == [1.0, 1.0, 0.5, 0.5]
    stop = training.EarlyStop(1)
    assert [stop.stop(x) for x in (0.1, 0.3, 0.2, float("nan"))] == [False, False, False, True]
    c = training.Checkpoints(str(tmp_path), every=2)
    for step, loss in enumerate([3.0, 2.0, 2.5]):
        c.offer(step, loss, {"w": [loss]})
    assert c.written == ["best", "best", "checkpoint-2"]
    assert training.Checkpoints.resume(f"{tmp_path}/checkpoint-2.json", 1)[3] == 3


def test_training_lowers_the_loss(spark):
    rows = spark.range(200).select(F.array((F.col("id") % 10 - 4.5).cast("double")).alias("features"), (F.col("id") % 10 > 4).cast("int").alias("target"))
    losses = training.train(rows, training.Logistic([0.0]), 8, training.PlateauRate(0.5))
    assert losses[-1] < losses[0] / 2


def test_score_stream(spark, tmp_path):
    spark.createDataFrame([("ACGT",), ("GG",)], "seq string").write.parquet(str(tmp_path / "in"))
    query = live.score_stream(spark, str(tmp_path / "in"), "seq string", lambda s: s.map(lambda x: [float(len(x))]), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["seq"], r["prediction"][0]) for r in got) == [("ACGT", 4.0), ("GG", 2.0)]
