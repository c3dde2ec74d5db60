"""Layered scorers by hand, gradients by finite differences, and runs that are resumed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import layers
from seqloom.operators.layers import Network

SMALL = Network((("convolution", {"name": "c"}), ("relu", {}), ("pool", {"width": 2}), ("dropout", {}), ("convolution", {"name": "e"}), ("flatten", {}), ("dense", {"name": "d"}), ("sigmoid", {})))


def weights(seed=0, length=9):
    rng = np.random.default_rng(seed)
    shapes = {"c.weight": (3, 4, 2), "c.bias": (3,), "e.weight": (2, 3, 2), "e.bias": (2,), "d.weight": (2, 2 * ((length - 1) // 2 - 1)), "d.bias": (2,)}
    return {n: rng.normal(0, 0.7, s) for n, s in shapes.items()}


def by_hand(w, seq):
    """The small network with plain loops."""
    x = [[1.0 if s == c else 0.25 if c not in "ACGT" else 0.0 for s in "ACGT"] for c in seq]

    def convolved(rows, weight, bias):
        width = weight.shape[2]
        return [[sum(weight[o, i, k] * rows[p + k][i] for i in range(weight.shape[1]) for k in range(width)) + bias[o] for o in range(len(bias))] for p in range(len(rows) - width + 1)]

    h = [[max(0.0, v) for v in row] for row in convolved(x, w["c.weight"], w["c.bias"])]
    h = [[max(h[p][o], h[p + 1][o]) for o in range(3)] for p in range(0, len(h) - 1, 2)]
    h = convolved(h, w["e.weight"], w["e.bias"])
    flat = [h[p][o] for o in range(2) for p in range(len(h))]
    return [1 / (1 + np.exp(-(sum(a * b for a, b in zip(row, flat, strict=True)) + bias))) for row, bias in zip(w["d.weight"], w["d.bias"], strict=True)]


def test_scores_by_hand(spark):
    w = weights()
    seqs = ["ACGTNACGT", "TTTTTTTTT", "ACGTNACGT", "acgtgcatg"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*seqs, None])], "id int, seq string")
    got = {r["id"]: r["prediction"] for r in layers.predict(df, SMALL, w).collect()}
    for i, s in enumerate(seqs):
        assert np.allclose(got[i], by_hand(w, s.upper()))
    assert got[4] is None
    both = {r["id"]: r["prediction"] for r in layers.predict(df, SMALL, w, strands="mean").collect()}
    assert np.allclose(both[0], (np.array(by_hand(w, seqs[0])) + by_hand(w, layers.turned(seqs[0]))) / 2)
    other = Network(SMALL.layers, "AGCT")  # another order of the rows
    swapped = {n: a[:, [0, 2, 1, 3]] if n == "c.weight" else a for n, a in w.items()}
    assert np.allclose(layers.scores_of(other, swapped, seqs[:2]), [by_hand(w, s) for s in seqs[:2]])


def test_recurrent_layer_by_hand():
    net = Network((("lstm", {"name": "r", "both": True}), ("flatten", {}), ("sigmoid", {})))
    rng = np.random.default_rng(3)
    w = {n: rng.normal(0, 1, {"input": (8, 4), "state": (8, 2), "bias": (8,)}[n.rsplit(".", 1)[1]]) for n in net.names()}
    x = net.encoded(["ACGT"])

    def way(name, rows):
        h, c, out = np.zeros(2), np.zeros(2), []
        for row in rows:
            g = w[f"{name}input"] @ row + w[f"{name}state"] @ h + w[f"{name}bias"]
            s = lambda v: 1 / (1 + np.exp(-v))
            c = s(g[2:4]) * c + s(g[:2]) * np.tanh(g[4:6])
            h = s(g[6:]) * np.tanh(c)
            out.append(h)
        return out

    there, back = way("r.", x[0]), way("r.back.", x[0][::-1])[::-1]
    flat = np.array([np.concatenate(p) for p in zip(there, back, strict=True)]).T.ravel()
    assert np.allclose(net.forward(w, x)[0], 1 / (1 + np.exp(-flat)))
    with pytest.raises(ValueError, match="cannot be trained"):
        net.gradient(w, x, np.zeros((1, 16)))


def test_weights_by_name_or_by_place():
    w = weights()
    plain = SMALL.loaded(list(w.items()))
    moved = SMALL.loaded([(f"module.{i}", a) for i, a in enumerate(w.values())])
    assert all((plain[n] == moved[n]).all() for n in w) and list(plain) == SMALL.names()
    shuffled = SMALL.loaded(list(w.items())[::-1])
    assert all((shuffled[n] == w[n]).all() for n in w)
    with pytest.raises(ValueError, match="arrays"):
        SMALL.loaded(list(w.items())[:-1])
    with pytest.raises(ValueError, match="shape"):
        SMALL.loaded(list(w.items()), {"c.bias": (4,)})


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(5)
    w = weights(1)
    for net, own in ((SMALL, w), (Network((("convolution", {"name": "c"}), ("pool_all", {}), ("dense", {"name": "d"}), ("sigmoid", {}))), {**w, "d.weight": rng.normal(0, 1, (2, 3))})):
        x = net.encoded(["".join(rng.choice(list("ACGT"), 9)) for _ in range(5)])
        y = rng.integers(0, 2, (5, 2)).astype(float)
        _, grads = net.gradient(own, x, y)
        for n in net.names():
            for at in list(np.ndindex(own[n].shape))[:6]:
                moved = []
                for step in (1e-5, -1e-5):
                    changed = own[n].copy()
                    changed[at] += step
                    moved.append(net.gradient({**own, n: changed}, x, y)[0])
                assert grads[n][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_a_resumed_run_equals_one_that_went_through(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(120):
        seq = "".join(rng.choice(list("ACGT"), 9))
        rows.append((seq, [float("CG" in seq), float(seq[0] in "AC")], i % 3))
    samples = spark.createDataFrame(rows, "seq string, targets array<double>, batch long").repartition(5)
    made = lambda: layers.Descent(SMALL, weights(2), rate=0.3, decay=1e-3)
    whole = made()
    losses = layers.train(samples, whole, 12)
    assert losses[-1] < losses[0]
    first = made()
    early = layers.train(samples, first, 5, str(tmp_path / "state"), every=5)
    again = layers.Descent.resumed(spark, str(tmp_path / "state"), SMALL)
    assert again.step == 5
    assert early + layers.train(samples, again, 12) == losses
    assert all((again.weights[n] == whole.weights[n]).all() for n in SMALL.names())
    n, loss, grads = layers.summed_gradient(samples, SMALL, whole.weights, groups=2)
    direct_loss, direct = SMALL.gradient(whole.weights, SMALL.encoded([r[0] for r in rows]), np.array([r[1] for r in rows]))
    assert n == 120 and loss == pytest.approx(direct_loss) and all(np.allclose(grads[k], direct[k]) for k in grads)
    assert layers.summed_gradient(samples.filter(F.lit(False)), SMALL, whole.weights)[0] == 0
