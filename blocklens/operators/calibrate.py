"""Calibration and benchmark metrics (CAL-1..4, SNK-3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.functions.scoring import SIGNALS, WEIGHTS, composite

# fixed values: decision threshold and search grid
THRESHOLD = 0.70
GRID_STEPS = [0.10, 0.15, 0.20, 0.25, 0.30]
GRID_ENTROPY = [0.05, 0.10, 0.15]
GRID_FRAGMENTATION = 0.15
GRID_OVERWRITE = 0.05


def weight_grid() -> np.ndarray:
    """Row 0 is the default profile, then 375 combinations normalised to sum 1."""
    rows = [[WEIGHTS[s] for s in SIGNALS]]
    for hf in GRID_STEPS:
        for st in GRID_STEPS:
            for me in GRID_STEPS:
                for en in GRID_ENTROPY:
                    w = [hf, st, me, en, GRID_FRAGMENTATION, GRID_OVERWRITE]
                    total = ((((hf + st) + me) + en) + GRID_FRAGMENTATION) + GRID_OVERWRITE
                    rows.append([x / total for x in w])
    return np.array(rows)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = (counts.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn)))
    pr = F.col("precision") + F.col("recall")
    return (out.withColumn("f1", F.when(pr > 0, 2.0 * (F.col("precision") * F.col("recall")) / pr).otherwise(0.0))
            .withColumn("brier", _ratio(F.col("sse"), F.col("n"))))


def evaluate_profile(samples: DataFrame, weights=WEIGHTS, threshold: float = THRESHOLD) -> DataFrame:
    """CAL-1: one row of counts and rates; ``samples`` has ``truth`` and the six signals."""
    scored = samples.select("truth", composite(weights=weights).alias("score"))
    hit, ok = F.col("score") >= threshold, F.col("truth")
    err = F.col("score") - ok.cast("double")
    return _with_rates(scored.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit & ok).alias("tp"), F.count_if(hit & ~ok).alias("fp"),
        F.count_if(~hit & ~ok).alias("tn"), F.count_if(~hit & ok).alias("fn"),
        F.coalesce(F.sum(err * err), F.lit(0.0)).alias("sse")))


def grid_metrics(samples: DataFrame, grid: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Counts and rates of every weight profile in one pass over the samples.

    Each task scores its samples against all profiles and emits one partial row per
    profile, so the shuffle carries ``tasks x profiles`` rows and samples are not multiplied.
    """
    weights = weight_grid() if grid is None else grid

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((len(weights), 5))
        n = 0
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo:lo + 4096]
                truth = part["truth"].to_numpy(dtype=bool)[:, None]
                score = np.zeros((len(part), len(weights)))
                for j, s in enumerate(SIGNALS):
                    score += part[s].to_numpy(dtype=float)[:, None] * weights[:, j]
                score = np.clip(score, 0.0, 1.0)
                hit = score >= threshold
                acc[:, 0] += (hit & truth).sum(axis=0)
                acc[:, 1] += (hit & ~truth).sum(axis=0)
                acc[:, 2] += (~hit & ~truth).sum(axis=0)
                acc[:, 3] += (~hit & truth).sum(axis=0)
                acc[:, 4] += ((score - truth) ** 2).sum(axis=0)
                n += len(part)
        if n:
            yield pd.DataFrame({"profile": np.arange(len(weights)), "n": n, "tp": acc[:, 0].astype(int),
                                "fp": acc[:, 1].astype(int), "tn": acc[:, 2].astype(int),
                                "fn": acc[:, 3].astype(int), "sse": acc[:, 4]})

    parts = samples.select("truth", *SIGNALS).mapInPandas(
        run, "profile int, n bigint, tp bigint, fp bigint, tn bigint, fn bigint, sse double")
    return _with_rates(parts.groupBy("profile").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "tn", "fn", "sse")]))


def grid_search(samples: DataFrame) -> DataFrame:
    """CAL-2: best F1, then lowest Brier, then the earlier profile; weights attached."""
    weights = weight_grid()
    table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    order = F.struct(-F.col("f1"), F.round("brier", 9), F.col("profile"))
    best = grid_metrics(samples, weights).agg(F.min_by(F.struct("*"), order).alias("b")).select("b.*")
    return best.select("*", *[table[F.col("profile")][j].alias(f"w_{s}") for j, s in enumerate(SIGNALS)])


def calibration_curve(scored: DataFrame, buckets: int = 10) -> DataFrame:
    """CAL-3: mean predicted and observed correctness per confidence bucket."""
    b = F.least(F.floor(F.col("score") * buckets), F.lit(buckets - 1)).cast("int")
    return scored.groupBy(b.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_predicted"),
        F.avg(F.col("truth").cast("double")).alias("observed"))


def equal_bytes(pairs: DataFrame, ids, left: str, right: str) -> DataFrame:
    """``ids`` plus the number of positions at which two payloads agree."""
    ids = list(ids)
    kept = pairs.select(*ids, left, right)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-2]) + ", equal bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            same = []
            for x, y in zip(pdf[left], pdf[right]):
                n = min(len(x), len(y))
                same.append(int((np.frombuffer(x, np.uint8, n) == np.frombuffer(y, np.uint8, n)).sum()) if n else 0)
            yield pdf[ids].assign(equal=same)

    return kept.mapInPandas(run, schema)


def benchmark_metrics(artifacts: DataFrame, truth: DataFrame, keys=("image_id", "start_lba")) -> DataFrame:
    """CAL-4: found vs expected objects by position; both sides carry ``payload``.

    A reported object at an expected position counts as recovered, whole or partial. Byte
    accuracy is the mean share of expected bytes reproduced by those objects. Rows of one
    side with the same key are first reduced to the longest, so pairs cannot multiply.
    """
    keys = list(keys)

    def one(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max_by("payload", F.struct(F.octet_length("payload"), F.sha2("payload", 256))).alias(name))

    j = one(artifacts, "got").join(one(truth, "want"), keys, "full_outer")
    both = j.where("got IS NOT NULL AND want IS NOT NULL").withColumn("n", F.octet_length("want"))
    acc = equal_bytes(both, [*keys, "n"], "got", "want").agg(
        F.avg(F.when(F.col("n") > 0, F.col("equal") / F.col("n")).otherwise(1.0)).alias("byte_accuracy"),
        F.count_if(F.col("equal") == F.col("n")).alias("exact"))
    got, want = F.col("got").isNotNull(), F.col("want").isNotNull()
    counts = j.agg(F.count_if(got & want).alias("tp"), F.count_if(got & ~want).alias("fp"),
                   F.count_if(want & ~got).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    # both sides are one-row aggregates
    return (counts.withColumn("one", F.lit(1)).join(acc.withColumn("one", F.lit(1)), "one").drop("one")
            .withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0))
            .withColumn("false_positive_rate", _ratio(fp, tp + fp))
            .withColumn("completeness", r).withColumn("byte_accuracy", F.coalesce("byte_accuracy", F.lit(0.0))))


def export_profile(best: DataFrame, path: str) -> None:
    """SNK-3: the winning row (one row by construction) as JSON."""
    best.coalesce(1).write.mode("overwrite").json(path)
