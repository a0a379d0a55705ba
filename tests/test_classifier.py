import random

import golden
import pytest
from pyspark.sql import functions as F

from blocklens.functions.payload import FEATURE_NAMES
from blocklens.operators import carve, classifier
from blocklens.sources import signatures

KEYS = ["image_id"]


@pytest.fixture(scope="module")
def data(spark):
    """Three kinds of payload with their own byte habits; a third is held out."""
    rng = random.Random(8)
    make = {"pdf": lambda: golden.PDF + bytes(rng.choice(b"abcdef /<>\n") for _ in range(rng.randint(200, 900))), "sqlite": lambda: golden.sqlite() + bytes(rng.randint(0, 400)),
            "png": lambda: golden.PNG + rng.randbytes(rng.randint(300, 900))}
    rows = [(i, k, make[k]()) for i, k in enumerate(sorted(make) * 40)]
    f = classifier.features_of(spark.createDataFrame(rows, "id bigint, label string, payload binary"), ["id", "label"])
    return f.withColumn("is_train", F.col("id") % 9 > 2)


@pytest.fixture(scope="module", params=[True, False], ids=["boosted", "forest"])
def model(data, request):
    return classifier.train_file_type(data.where("is_train"), rounds=4, boosted=request.param)


def test_held_out_quality(data, model):
    got = {r["class"]: r for r in classifier.evaluate_classifier(classifier.classify(data.where("NOT is_train"), model)).collect()}
    assert got["macro"]["f1"] >= 0.95 and got["macro"]["support"] == data.where("NOT is_train").count()


def test_distribution_and_text(data, model):
    got = classifier.explain(classifier.classify(data, model), model)
    for r in got.select("probs", "predicted", "probability", "basis").collect():
        assert sum(r["probs"]) == pytest.approx(1) and r["probability"] == max(r["probs"])
        assert r["predicted"] == classifier.classes_of(model)[r["probs"].index(max(r["probs"]))]
        assert r["basis"].startswith(f"ML Model: {r['predicted']} (") and r["basis"].count(": ") == 5


def test_importances(spark, model):
    rows = classifier.rank_importances(spark, model, 5).orderBy("rank").collect()
    weights = [r["importance"] for r in rows]
    assert weights == sorted(weights, reverse=True) and weights[0] > 0 and all(FEATURE_NAMES[r["feature_index"]] == r["feature"] for r in rows)
    assert sum(classifier.importances_of(model)) == pytest.approx(1, abs=1e-6)


def test_saved_model_answers_alike(data, model, tmp_path):
    classifier.save_model(model, str(tmp_path / "m"))
    again = classifier.load_model(str(tmp_path / "m"))
    probs = lambda m: {r["id"]: [round(p, 9) for p in r["probs"]] for r in classifier.classify(data, m).select("id", "probs").collect()}
    assert classifier.classes_of(again) == classifier.classes_of(model) and probs(again) == probs(model)


def test_classifier_scores_carved_files(spark, model):
    """The classifier as entropy signal moves scores, not finds."""
    chunks = carve.to_chunks(golden.sectors(spark, golden.place(80, {4: golden.PDF, 30: golden.sqlite()})), KEYS)
    sigs = signatures.signature_rows(spark)
    plain = {r["start_lba"]: r for r in carve.recover_image(chunks, sigs, KEYS, tiers=(2,)).collect()}
    scored = {r["start_lba"]: r for r in carve.recover_image(chunks, sigs, KEYS, tiers=(2,), entropy_score=classifier.entropy_scorer(model)).collect()}
    assert plain.keys() == scored.keys() == {4, 30}
    assert all(scored[k]["content_hash"] == plain[k]["content_hash"] and 0.1 <= scored[k]["entropy"] <= 1 for k in scored)
    assert scored[30]["entropy"] >= 0.6


def test_boosting_equals_one_machine(spark):
    """The distributed trees next to the same rule over one table in numpy."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    from blocklens.operators import boosting
    rng = np.random.default_rng(5)
    x = np.round(rng.random((240, 6)), 2)
    x[:, 5] = 1.0  # never varies
    y = (x[:, 0] > 0.5).astype(int) + (x[:, 1] * x[:, 2] > 0.3)
    df = spark.createDataFrame([(f"c{k}", v.tolist()) for k, v in zip(y, x)], "label string, v array<double>").repartition(5).withColumn("features", array_to_vector("v"))
    model = boosting.fit(df, rounds=3, depth=2, subsample=1.0)
    bins, prior = boosting.binned(x, model.edges), np.log(np.bincount(y) / len(y))
    raw = np.tile(prior, (len(y), 1))
    for turn in range(3):
        p = boosting.softmax(raw)
        for k in range(3):
            g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            node = np.zeros(len(y), int)
            for level in range(2):
                for n in range(2**level - 1, 2 ** (level + 1) - 1):
                    here = node == n
                    if not here.any():
                        continue
                    worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
                    gain = max((worth(here & (bins[:, f] <= b)) + worth(here & (bins[:, f] > b)) - worth(here), -f, -b) for f in range(6) for b in range(31)
                               if h[here & (bins[:, f] <= b)].sum() >= 1e-3 and h[here & (bins[:, f] > b)].sum() >= 1e-3)
                    f, b = model.feature[turn, k, n], model.bin[turn, k, n]
                    if f < 0:  # a leaf: nothing to gain
                        assert gain[0] <= 1e-6
                        continue
                    got = worth(here & (bins[:, f] <= b)) + worth(here & (bins[:, f] > b)) - worth(here)
                    assert got == pytest.approx(gain[0], rel=1e-9)
                    node = np.where(here, 2 * n + 1 + (bins[:, f] > b), node)
            raw[:, k] += [-0.1 * g[node == n].sum() / (h[node == n].sum() + 1.0) for n in node]
    assert np.allclose(raw, model.raw(x)) and model.gain[5] == 0


def test_boosting_leaves_out_commonest_bins(spark):
    """Tasks send the sums of rare bins only, of one partition per core at most; of cuts that divide alike the first feature counts."""
    import numpy as np
    import pyarrow as pa

    from blocklens.operators import boosting
    bins = np.zeros((600, 3), np.uint8)
    bins[::3, 1] = bins[::3, 2] = 4
    y, prior = (bins[:, 1] > 0).astype(np.int32), np.log([2 / 3, 1 / 3])
    batch = pa.RecordBatch.from_arrays([pa.array(y), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(range(600), pa.int64()), pa.array([prior.tobytes()] * 600, pa.binary())],
                                       names=["y", "bins", "mark", "scores"])
    common, none = np.zeros(3, np.int64), np.full((2, 7), -1)
    no_trees = tuple(np.zeros((0, 2, 7)) for _ in range(3))
    # a slice of a batch starts inside its buffers
    sums = list(boosting._histograms(no_trees, (none, none), 0, 0, 1.0, common, 2)([batch.slice(0, 250), batch.slice(250)]))
    rows = sums[0].to_pylist()
    assert [(r["k"], r["node"]) for r in rows] == [(0, 0), (1, 0)]
    parts = np.frombuffer(rows[0]["parts"]).reshape(2, 3, boosting.BINS)
    assert not parts[:, 0].any() and not parts[:, :, 0].any() and parts[0, 1, 4] == pytest.approx(200 * 2 / 3)
    best = list(boosting._best(common)(sums))[0].to_pylist()
    assert [(r["feature"], r["bin"]) for r in best] == [(1, 0), (1, 0)] and best[0]["gl"] == pytest.approx(400 * (2 / 3 - 1))
    df = spark.range(400).selectExpr("if(id % 4 = 0, 'a', 'b') AS label", "array(double(id % 4), double(id % 7)) AS v").repartition(40)
    from pyspark.ml.functions import array_to_vector
    cut, seen = boosting.cut_lineage, []
    boosting.cut_lineage = lambda d: seen.append(cut(d)) or seen[-1]
    try:
        boosting.fit(df.withColumn("features", array_to_vector("v")), rounds=1, depth=1)
    finally:
        boosting.cut_lineage = cut
    assert seen[1].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
