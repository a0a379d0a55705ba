"""Gradient boosting over all classes at once, from distributed histograms (ML-2).

Features are cut into bins at quantiles, one byte each, once. Every round fits one tree per class to the softmax gradients; a level of all
those trees is one aggregation: tasks sum gradients by (class, node, feature, bin), the sums meet by class and node, and only the best split of each
node comes to the driver, a handful of numbers. Byte features are mostly at one value, so the commonest bin of a feature is not summed: it is what the
other bins leave of the node. Scores are brought up to date in the rows every ``KEEP`` rounds and written; between, tasks add the few trees that are
newer. The rows lie in one partition per core, for every partition sends sums. A model is small: classes, bin edges and trees as arrays.

Defined results: a feature that never varies is never split; a class seen once is a class; repeated rows count each; an empty table is refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.session import cut_lineage

BINS = 32
KEEP = 5
#: share by which gains may differ and still are equal
SAME_GAIN = 1e-10
#: partitions in which the sums of tasks meet, at most
MEETS = 8
#: added to the curvature of every leaf; least gain and least curvature of a split
SHRINK, LEAST_GAIN, LEAST_WEIGHT = 1.0, 1e-6, 1e-3


@dataclass
class Boosted:
    """``feature``, ``bin`` and ``value``: (rounds, classes, nodes) arrays of complete trees; feature -1 is a leaf. ``gain``: per feature."""

    classes: list[str]
    edges: np.ndarray
    prior: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores (rows, classes) of feature rows."""
        return self.prior + scores(binned(x, self.edges), self.feature, self.bin, self.value)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The number of edges below each value: one byte per feature."""
    return np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1).astype(np.uint8)


def leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of one tree where each row ends."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while True:
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            return node
        node = np.where(inner, 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > cut[node]), node)


def scores(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bins), feature.shape[1] if feature.ndim == 3 else 0))
    for r in range(len(feature)):
        for k in range(feature.shape[1]):
            out[:, k] += value[r, k][leaves(bins, feature[r, k], cut[r, k])]
    return out


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _rows(batch, n_features: int, n_classes: int):
    """Class numbers, bins, sampling numbers and scores of a batch."""
    m = batch.num_rows

    def flat(k: int, kind) -> np.ndarray:
        """The bytes of a column's rows, which lie side by side."""
        values = batch.column(k)
        _, ends, data = values.buffers()
        ends = np.frombuffer(ends, np.int32)[values.offset:values.offset + m + 1]
        return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind)
    return (np.asarray(batch.column(0)), flat(1, np.uint8).reshape(m, n_features), np.asarray(batch.column(2)).astype(np.uint64),
            flat(3, np.float64).reshape(m, n_classes))


_ROW = "y int, bins binary, mark long, scores binary"


def _prepare(edges: np.ndarray, prior: np.ndarray):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            bins = binned(x, edges)
            data = [b.tobytes() for b in bins]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), batch.column(2), pa.array([prior.tobytes()] * len(data), pa.binary())],
                                             names=["y", "bins", "mark", "scores"])
    return run


def _update(trees: tuple, n_features: int, n_classes: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, bins, _, now = _rows(batch, n_features, n_classes)
                now = now + scores(bins, *trees)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in now], pa.binary())], names=batch.schema.names)
    return run


def _sample(mark: np.ndarray, turn: int, share: float) -> np.ndarray:
    """Rows of a round, by a hash of the row and the round."""
    x = (mark ^ np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) < share * float(1 << 53)


def _histograms(newer: tuple, grown: tuple, level: int, turn: int, share: float, common: np.ndarray, n_classes: int):
    """A task's sums of gradient and curvature per class and node of the level, whole and by feature and bin, without the ``common`` bin of a feature."""
    first, nodes, n_features, common = 2**level - 1, 2**level, len(common), common.astype(np.uint8)

    def run(batches):
        whole, parts = np.zeros((2, n_classes, nodes)), np.zeros((2, n_classes, nodes * n_features * BINS))
        for batch in batches:
            if not batch.num_rows:
                continue
            y, bins, mark, now = _rows(batch, n_features, n_classes)
            chosen = _sample(mark, turn, share)
            y, bins, now = y[chosen], bins[chosen], now[chosen]
            p = softmax(now + scores(bins, *newer))
            off = bins != common
            at, row = np.flatnonzero(off), np.repeat(np.arange(len(bins)), np.count_nonzero(off, axis=1))
            place = np.tile(np.arange(n_features) * BINS, len(bins))[at] + bins.ravel()[at]
            for k in range(n_classes):
                node = leaves(bins, grown[0][k], grown[1][k]) - first
                here, node, q = node >= 0, np.maximum(node, 0), p[:, k]
                if not here.any():
                    continue
                here_at = place + (node * (n_features * BINS))[row]
                for j, weight in enumerate((q - (y == k), np.maximum(q * (1 - q), 1e-6))):
                    weight = np.where(here, weight, 0.0)
                    whole[j, k] += np.bincount(node, weight, nodes)
                    parts[j, k] += np.bincount(here_at, weight[row], nodes * n_features * BINS)
        k, node = np.nonzero(whole[1])
        parts = parts.reshape(2, n_classes, nodes, -1)
        columns = [pa.array(c.astype(np.int32)) for c in (k, node + first)] + [pa.array(whole[j, k, node]) for j in range(2)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([parts[:, a, b].tobytes() for a, b in zip(k, node)], pa.binary())], names=["k", "node", "g", "h", "parts"])
    return run


_HISTOGRAM = "k int, node int, g double, h double, parts binary"
_SPLIT = "k int, node int, gain double, feature int, bin int, gl double, hl double, g double, h double"


def _best(common: np.ndarray):
    """The best cut of every (class, node), all of whose sums are in one partition; they are added as they come."""
    def run(batches):
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for k, node, g, h, parts in zip(*(c.to_pylist() for c in batch.columns)):
                sums = found.setdefault((k, node), [np.zeros(2), np.zeros((2, len(common), BINS))])
                sums[0] += (g, h)
                sums[1] += np.frombuffer(parts).reshape(2, -1, BINS)
        out = []
        for (k, node), ((g, h), sums) in sorted(found.items()):
            sums[:, np.arange(len(common)), common] = np.array([[g], [h]]) - sums.sum(axis=2)
            left_g, left_h = np.cumsum(sums, axis=2)
            worth = lambda a, b: a * a / (b + SHRINK)
            gain = worth(left_g, left_h) + worth(g - left_g, h - left_h) - worth(g, h)
            gain[(left_h < LEAST_WEIGHT) | (h - left_h < LEAST_WEIGHT)] = 0.0
            # sums differ in their last digits by the order in which they came: of equal gains the first counts
            f, b = np.unravel_index(np.argmax(gain >= gain.max() * (1 - SAME_GAIN)), gain.shape)
            out.append((k, node, gain[f, b], f, b, left_g[f, b], left_h[f, b], g, h))
        if out:
            kinds = [{"int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in _SPLIT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c), kind) for c, kind in zip(zip(*out), kinds)], names=[c.split()[0] for c in _SPLIT.split(", ")])
    return run


def edges_of(data: DataFrame, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner bin edges (features, BINS - 1) at quantiles, and per feature the bin that most quantiles fall in."""
    parts = F.array(*[F.lit(k / BINS) for k in range(1, BINS)])
    found = data.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", parts, F.lit(1000)).alias("e")).collect()  # one row per feature
    out, common = np.full((n_features, BINS - 1), np.inf), np.zeros(n_features, np.int64)
    for r in found:
        cuts, times = np.unique(r["e"], return_counts=True)
        out[r["f"], :len(cuts)] = cuts
        common[r["f"]] = times.argmax()
    return out, common


def fit(train: DataFrame, label: str = "label", features: str = "features", rounds: int = 60, depth: int = 4, rate: float = 0.1, subsample: float = 0.85,
        seed: int = 42) -> Boosted:
    """Trees of all classes over the vectors in ``features``."""
    data = cut_lineage(train.select(F.col(label).alias("label"), vector_to_array(features).alias("x")))
    counts = data.groupBy("label").agg(F.count("*").alias("n"), F.first(F.size("x")).alias("size")).orderBy("label").collect()  # one row per class
    if not counts:
        raise ValueError("no rows to learn from")
    classes, n_features, n_classes = [r["label"] for r in counts], counts[0]["size"], len(counts)
    weight = np.array([r["n"] for r in counts], float)
    prior = np.log(weight / weight.sum())
    edges, common = edges_of(data, n_features)
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")).cast("int") - 1
    numbered = data.select(number.alias("y"), "x", F.xxhash64("x", "label", F.lit(seed)).alias("mark"))
    rows = cut_lineage(numbered.coalesce(train.sparkSession.sparkContext.defaultParallelism).mapInArrow(_prepare(edges, prior), _ROW))
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.full((rounds, n_classes, nodes), -1), np.zeros((rounds, n_classes, nodes), np.int64), np.zeros((rounds, n_classes, nodes))
    gains, written = np.zeros(n_features), 0
    for turn in range(rounds):
        newer = (feature[written:turn], cut[written:turn], value[written:turn])
        for level in range(depth):
            grown = (feature[turn].copy(), cut[turn].copy())
            sums = rows.mapInArrow(_histograms(newer, grown, level, turn, subsample, common, n_classes), _HISTOGRAM)
            met = sums.repartition(min(n_classes * 2**level, MEETS), "k", "node")
            for r in met.mapInArrow(_best(common), _SPLIT).collect():  # a row per class and node
                k, n = r["k"], r["node"]
                step = lambda g, h: -rate * g / (h + SHRINK)
                value[turn, k, n] = step(r["g"], r["h"])
                if r["gain"] > LEAST_GAIN:
                    feature[turn, k, n], cut[turn, k, n] = r["feature"], r["bin"]
                    value[turn, k, 2 * n + 1], value[turn, k, 2 * n + 2] = step(r["gl"], r["hl"]), step(r["g"] - r["gl"], r["h"] - r["hl"])
                    gains[r["feature"]] += r["gain"]
            if (feature[turn, :, 2**level - 1:2 ** (level + 1) - 1] < 0).all():
                break
        if turn + 1 - written == KEEP and turn + 1 < rounds:
            trees = (feature[written:turn + 1], cut[written:turn + 1], value[written:turn + 1])
            rows, written = cut_lineage(rows.mapInArrow(_update(trees, n_features, n_classes), _ROW)), turn + 1
    return Boosted(classes, edges, prior, feature, cut, value, gains / max(gains.sum(), 1e-300))


def probabilities(model: Boosted, features: str = "features") -> Column:
    """The distribution over the classes as an array column."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(softmax(model.raw(np.stack(x.to_list()))))) if len(x) else pd.Series([], dtype=object)
    return run(vector_to_array(features))


def save(model: Boosted, path: str) -> None:
    """One line of text in a shared folder."""
    parts = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(model).items()}
    SparkSession.active().createDataFrame([(json.dumps(parts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(path: str) -> Boosted:
    parts = json.loads(SparkSession.active().read.text(path).first()["value"])
    return Boosted(parts.pop("classes"), **{k: np.array(v) for k, v in parts.items()})
