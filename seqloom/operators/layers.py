"""Layered scorers on Arrow batches, and their training by gradients that are summed in the tasks.

A network is a list of layers as plain data; its weights are named arrays. Forward and backward passes are numpy over a batch of sequences of one
length; Spark deals the sequences, the weights are broadcast. A training step sums gradients within each task, then in groups of tasks, always in the
order of the tasks, so a run that is resumed from its state gives the same weights as one that was never stopped.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.sources import tables

BATCH = 256  # sequences of one pass
Weights = Mapping[str, np.ndarray]

_OF_LAYER = {"convolution": ("weight", "bias"), "dense": ("weight", "bias"), "lstm": ("input", "state", "bias")}
_COMPLEMENT = dict(zip("ACGTN", "TGCAN", strict=True))


@dataclass(frozen=True)
class Network:
    """``layers``: (kind, settings). Kinds are convolution, dense and lstm (with a name), relu, pool (width; stride: the width), pool_all,
    flatten, dropout (nothing happens when scoring) and sigmoid. ``symbols`` is the order of the rows of the encoding."""

    layers: tuple[tuple[str, dict], ...]
    symbols: str = "ACGT"

    def names(self) -> list[str]:
        """The weights' names in order; an lstm that reads both ways has those of the way back after those of the way there."""
        out = []
        for kind, settings in self.layers:
            ways = ("", "back.") if settings.get("both") else ("",)
            out += [f"{settings['name']}.{way}{part}" for way in ways for part in _OF_LAYER.get(kind, ())]
        return out

    def loaded(self, found: Sequence[tuple[str, np.ndarray]], shapes: Mapping[str, tuple] | None = None) -> dict[str, np.ndarray]:
        """Weights by their names or, where names differ, by their places in the list; ``shapes`` are checked where given."""
        names = self.names()
        if len(found) != len(names):
            raise ValueError(f"{len(found)} arrays for {len(names)} weights")
        known = dict(found)
        out = {n: known[n] for n in names} if set(known) == set(names) else dict(zip(names, (a for _, a in found), strict=True))
        for n, shape in (shapes or {}).items():
            if out[n].shape != tuple(shape):
                raise ValueError(f"{n} has shape {out[n].shape}, not {tuple(shape)}")
        return out

    def encoded(self, seqs: Sequence[str]) -> np.ndarray:
        """(sequences, length, symbols) for sequences of one length; unknown symbols are spread evenly."""
        table = np.full((256, len(self.symbols)), 1 / len(self.symbols))
        for i, s in enumerate(self.symbols):
            table[[ord(s), ord(s.lower())]] = np.eye(len(self.symbols))[i]
        raw = np.frombuffer("".join(seqs).encode("ascii", "replace"), dtype=np.uint8)
        return table[raw.reshape(len(seqs), -1)]

    def forward(self, w: Weights, x: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The last layer's output; ``kept`` gets what the way back needs."""
        for kind, settings in self.layers:
            x, back = _LAYERS[kind](w, settings, x)
            if kept is not None:
                kept.append(back)
        return x

    def gradient(self, w: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The sum of the cross-entropies over sequences and features, and its gradient; the last layer has to be a sigmoid."""
        if self.layers[-1][0] != "sigmoid":
            raise ValueError("the last layer must be a sigmoid")
        kept: list = []
        p = self.forward(w, x, kept)
        safe = np.clip(p, 1e-12, 1 - 1e-12)
        loss = float(-(y * np.log(safe) + (1 - y) * np.log(1 - safe)).sum())
        grads = {n: np.zeros_like(w[n], dtype=np.float64) for n in self.names()}
        d = p - y  # through sigmoid and cross-entropy at once
        for back in kept[-2::-1]:
            d = back(d, grads)
        return loss, grads


def _convolution(w, s, x):
    weight, bias = w[f"{s['name']}.weight"], w[f"{s['name']}.bias"]  # (out, in, width)
    views = np.lib.stride_tricks.sliding_window_view(x, weight.shape[2], axis=1)  # n, place, in, width

    def back(d, grads):
        grads[f"{s['name']}.weight"] += np.tensordot(d, views, axes=([0, 1], [0, 1]))
        grads[f"{s['name']}.bias"] += d.sum(axis=(0, 1))
        dx = np.zeros(x.shape)
        for k in range(weight.shape[2]):
            dx[:, k : k + d.shape[1]] += d @ weight[:, :, k]
        return dx

    return np.tensordot(views, weight, axes=([2, 3], [1, 2])) + bias, back


def _dense(w, s, x):
    weight = w[f"{s['name']}.weight"]  # (out, in)

    def back(d, grads):
        grads[f"{s['name']}.weight"] += d.T @ x
        grads[f"{s['name']}.bias"] += d.sum(axis=0)
        return d @ weight

    return x @ weight.T + w[f"{s['name']}.bias"], back


def _relu(w, s, x):
    over = x > s.get("threshold", 0.0)
    return np.where(over, x, 0.0), lambda d, grads: d * over


def _pool(w, s, x):
    width, stride = s["width"], s.get("stride", s["width"])
    views = np.lib.stride_tricks.sliding_window_view(x, width, axis=1)[:, ::stride]  # n, place, channel, width
    best = views.argmax(axis=3)

    def back(d, grads):
        dx = np.zeros(x.shape)
        n, place, channel = np.indices(best.shape)
        np.add.at(dx, (n, place * stride + best, channel), d)
        return dx

    return views.max(axis=3), back


def _pool_all(w, s, x):
    best = x.argmax(axis=1)

    def back(d, grads):
        dx = np.zeros(x.shape)
        n, channel = np.indices(best.shape)
        dx[n, best, channel] = d
        return dx

    return x.max(axis=1), back


def _flatten(w, s, x):
    """Channel by channel."""
    return x.transpose(0, 2, 1).reshape(len(x), -1), lambda d, grads: d.reshape(len(x), x.shape[2], x.shape[1]).transpose(0, 2, 1)


def _sigmoid(w, s, x):
    p = 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    return p, lambda d, grads: d * p * (1 - p)


def _lstm_way(w, name, x):
    """Hidden states of one direction; the rows of the weights are the input, forget, cell and output gates."""
    size = w[f"{name}state"].shape[1]
    hidden, cell, out = np.zeros((len(x), size)), np.zeros((len(x), size)), []
    gates_in = x @ w[f"{name}input"].T + w[f"{name}bias"]
    for at in range(x.shape[1]):
        gates = gates_in[:, at] + hidden @ w[f"{name}state"].T
        i, f, o = (1 / (1 + np.exp(-gates[:, k * size : (k + 1) * size])) for k in (0, 1, 3))
        cell = f * cell + i * np.tanh(gates[:, 2 * size : 3 * size])
        hidden = o * np.tanh(cell)
        out.append(hidden)
    return np.stack(out, axis=1)


def _lstm(w, s, x):
    there = _lstm_way(w, f"{s['name']}.", x)

    def back(d, grads):
        raise ValueError("a recurrent layer can score and cannot be trained here")

    return np.concatenate([there, _lstm_way(w, f"{s['name']}.back.", x[:, ::-1])[:, ::-1]], axis=2) if s.get("both") else there, back


_LAYERS = {
    "convolution": _convolution, "dense": _dense, "relu": _relu, "pool": _pool, "pool_all": _pool_all, "flatten": _flatten, "sigmoid": _sigmoid, "lstm": _lstm,
    "dropout": lambda w, s, x: (x, lambda d, grads: d),
}


def turned(seq: str) -> str:
    """The reverse complement; other symbols stay what they are."""
    return "".join(_COMPLEMENT.get(c, c) for c in reversed(seq.upper()))


def scores_of(network: Network, w: Weights, seqs: Sequence[str], strands: str | None = None) -> np.ndarray:
    """A row of scores per sequence, in passes over sequences of equal length; ``strands``: mean or max over both strands."""
    if strands:
        there, back = scores_of(network, w, seqs), scores_of(network, w, [turned(s) for s in seqs])
        return np.maximum(there, back) if strands == "max" else (there + back) / 2
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
    out: list = [None] * len(seqs)
    at = 0
    while at < len(order):
        stop = at
        while stop < len(order) and stop - at < BATCH and len(seqs[order[stop]]) == len(seqs[order[at]]):
            stop += 1
        for i, row in zip(order[at:stop], network.forward(w, network.encoded([seqs[i] for i in order[at:stop]])), strict=True):
            out[i] = row
        at = stop
    return np.stack(out) if out else np.zeros((0, 0))


def predict(df: DataFrame, network: Network, weights: Weights, seq: str = "seq", out: str = "prediction", strands: str | None = None) -> DataFrame:
    """An array of scores per row (null for a null sequence); each distinct sequence of a batch is scored once, the weights are broadcast."""
    if strands not in (None, "mean", "max"):
        raise ValueError(f"strands must be mean or max: {strands}")
    sent = df.sparkSession.sparkContext.broadcast({k: np.asarray(v, dtype=np.float64) for k, v in weights.items()})

    @F.arrow_udf("array<double>")
    def score(seqs: pa.Array) -> pa.Array:
        coded = seqs.dictionary_encode()
        rows = scores_of(network, sent.value, coded.dictionary.to_pylist(), strands)
        width = rows.shape[1] if len(rows) else 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(rows.ravel()))
        return lists.take(coded.indices)

    return df.withColumn(out, score(F.col(seq)))


# --- training --------------------------------------------------------------------------------


@dataclass
class Descent:
    """Weights with momentum and decay; what a step needs is in here, and ``save`` keeps it in a folder all machines share."""

    network: Network
    weights: dict[str, np.ndarray]
    rate: float = 0.1
    momentum: float = 0.9
    decay: float = 0.0
    step: int = 0
    velocity: dict[str, np.ndarray] = field(default_factory=dict)

    def update(self, grads: Mapping[str, np.ndarray]) -> None:
        for n in self.network.names():
            g = grads[n] + self.decay * self.weights[n]
            self.velocity[n] = self.momentum * self.velocity.get(n, np.zeros_like(g)) + g
            self.weights[n] = self.weights[n] - self.rate * self.velocity[n]
        self.step += 1

    def save(self, spark: SparkSession, path: str, loss: float) -> None:
        held = io.BytesIO()
        np.savez(held, **{f"w:{n}": a for n, a in self.weights.items()}, **{f"v:{n}": a for n, a in self.velocity.items()})
        row = [(loss, self.rate, self.momentum, self.decay, held.getvalue())]
        spark.createDataFrame(row, "loss double, rate double, momentum double, decay double, arrays binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/step={self.step}")

    @classmethod
    def resumed(cls, spark: SparkSession, path: str, network: Network) -> Descent:
        """The state of the last step that was kept."""
        table = spark.read.parquet(path)
        last = table.agg(F.max("step")).first()[0]
        row = table.filter(F.col("step") == last).first()
        arrays = np.load(io.BytesIO(bytes(row["arrays"])))
        of = lambda kind: {n: arrays[f"{kind}:{n}"] for n in network.names() if f"{kind}:{n}" in arrays}
        return cls(network, of("w"), row["rate"], row["momentum"], row["decay"], last, of("v"))


def summed_gradient(samples: DataFrame, network: Network, weights: Weights, groups: int = 16) -> tuple[int, float, dict[str, np.ndarray]]:
    """Sequences, loss and gradient over ``samples`` (seq, targets): summed in each task, then in groups of tasks; one row per group comes back."""
    sent = samples.sparkSession.sparkContext.broadcast(dict(weights))
    names = network.names()
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("loss", pa.float64()), ("flat", pa.binary())])
    kind = "part long, n long, loss double, flat binary"

    def row(part, n, loss, flat):
        return pa.RecordBatch.from_pylist([{"part": part, "n": n, "loss": loss, "flat": flat.tobytes()}], schema)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, flat = 0, 0.0, None
        for batch in batches:
            seqs, targets = batch.column("seq").to_pylist(), np.array(batch.column("targets").to_pylist(), dtype=np.float64)
            for length in sorted(set(map(len, seqs))):
                own = [i for i, s in enumerate(seqs) if len(s) == length]
                for at in range(0, len(own), BATCH):
                    part = own[at : at + BATCH]
                    add, grads = network.gradient(sent.value, network.encoded([seqs[i] for i in part]), targets[part])
                    vector = np.concatenate([grads[k].ravel() for k in names])
                    n, loss, flat = n + len(part), loss + add, vector if flat is None else flat + vector
        if n:
            yield row(TaskContext.get().partitionId(), n, loss, flat)

    def of_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["part"])
        if rows:
            yield row(rows[0]["part"], sum(r["n"] for r in rows), sum(r["loss"] for r in rows), sum(np.frombuffer(r["flat"]) for r in rows))

    tasks = samples.select("seq", "targets").mapInArrow(of_task, kind)
    rows = sorted(tasks.repartition(groups, F.col("part") % groups).mapInArrow(of_group, kind).collect(), key=lambda r: r["part"])
    if not rows:
        return 0, 0.0, {}
    flat = sum(np.frombuffer(r["flat"]) for r in rows)
    ends = np.cumsum([weights[n].size for n in names])
    return sum(r["n"] for r in rows), sum(r["loss"] for r in rows), {n: part.reshape(weights[n].shape) for n, part in zip(names, np.split(flat, ends[:-1]), strict=True)}


def train(samples: DataFrame, state: Descent, steps: int, path: str | None = None, every: int = 1) -> list[float]:
    """Steps ``state.step`` to below ``steps``; step k learns from the rows with ``batch`` = k modulo the number of batches. Returns mean losses.

    ``samples`` (seq, targets, batch) is written once in the order of its batches, so that a step reads its own files alone.
    """
    spark = samples.sparkSession
    if not len(state.weights) == len(state.network.names()):
        raise ValueError("a weight is missing")
    where = tables.folder(spark, "training")
    samples.select("seq", "targets", "batch").repartition("batch").sortWithinPartitions("batch", "seq").write.partitionBy("batch").parquet(where)
    kept = spark.read.schema("seq string, targets array<double>, batch long").parquet(where)
    batches = (kept.agg(F.max("batch")).first()[0] or 0) + 1
    losses = []
    while state.step < steps:
        n, loss, grads = summed_gradient(kept.filter(F.col("batch") == state.step % batches), state.network, state.weights)
        if n:
            state.update({k: g / n for k, g in grads.items()})
        else:
            state.step += 1
        losses.append(loss / n if n else float("nan"))
        if path and state.step % every == 0:
            state.save(spark, path, losses[-1])
    return losses
