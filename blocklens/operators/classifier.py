"""File-type classifier on byte features with MLlib (ML-1..7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blocklens.functions import scoring
from blocklens.functions.payload import FEATURE_NAMES
from blocklens.operators import boosting, byte_stats, slices
from blocklens.operators.boosting import Boosted
from blocklens.session import cut_lineage

# fixed values: claimed type -> class of the model
CANONICAL = {"jpg": "jpeg", "docx": "zip", "xlsx": "zip", "pptx": "zip", "db": "sqlite"}


def stratified_split(df: DataFrame, label: str, row_id: str, test_tenths: int = 3, seed: int = 42) -> DataFrame:
    """ML-1: exact share per class in column ``is_train``.

    Order inside a class is the MD5 of seed and id; its leading digits cut a class in 4096
    even slices, so a class holding most rows is still spread.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))
    hashed = df.withColumn("_h", h)
    cut = F.conv(F.substring("_h", 1, 3), 16, 10).cast("bigint")
    ranked = slices.row_numbers(hashed, [label], ["_h", row_id], cut, "_pos")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return (ranked.join(sizes, label).withColumn("is_train", F.col("_pos") * 10 <= F.col("_n") * (10 - test_tenths))
            .drop("_h", "_pos", "_n"))


def features_of(objects: DataFrame, ids: Sequence[str], payload: str = "payload") -> DataFrame:
    """BYT-7 as an MLlib vector column ``features``."""
    return byte_stats.feature_vector(objects, ids, payload).withColumn("features", array_to_vector("features"))


def train_file_type(train: DataFrame, label: str = "label", rounds: int = 60, depth: int = 4, rate: float = 0.1, subsample: float = 0.85,
                    seed: int = 42, boosted: bool = True) -> Boosted | PipelineModel:
    """ML-2: trees boosted over all classes at once (``boosting``), or a random forest as MLlib's native multi-class form."""
    if boosted:
        return boosting.fit(train, label, "features", rounds, depth, rate, subsample, seed)
    train = cut_lineage(train)  # fitting reads the features many times
    index = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc")
    learner = RandomForestClassifier(labelCol="label_index", featuresCol="features", rawPredictionCol="raw", numTrees=rounds,
                                     maxDepth=depth, subsamplingRate=subsample, seed=seed)
    return Pipeline(stages=[index, learner]).fit(train)


def save_model(model: Boosted | PipelineModel, path: str) -> None:
    """Stores a fitted classifier with its classes; ``path`` is a shared folder."""
    if isinstance(model, Boosted):
        boosting.save(model, path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> Boosted | PipelineModel:
    # a stored pipeline is a folder of folders, a boosted model one of text files
    try:
        return boosting.load(path)
    except (ValueError, TypeError, AnalysisException):
        return PipelineModel.load(path)


def classes_of(model: Boosted | PipelineModel) -> list[str]:
    return list(model.classes if isinstance(model, Boosted) else model.stages[0].labels)


def importances_of(model: Boosted | PipelineModel) -> list[float]:
    """One weight per feature, adding up to one: its share of the gain of all splits, or the forest's."""
    if isinstance(model, Boosted):
        return model.gain.tolist()
    return [float(model.stages[-1].featureImportances[i]) for i in range(len(FEATURE_NAMES))]


def rank_importances(spark: SparkSession, model: PipelineModel, k: int = 15) -> DataFrame:
    """ML-4: the k strongest features (a list of 280 numbers, ties by position)."""
    ranked = sorted(enumerate(importances_of(model)), key=lambda x: (-x[1], x[0]))[:k]
    rows = [(r + 1, i, FEATURE_NAMES[i], w) for r, (i, w) in enumerate(ranked)]
    return spark.createDataFrame(rows, "rank int, feature_index int, feature string, importance double")


def winner(df: DataFrame, classes: Sequence[str], probs: str = "probs") -> DataFrame:
    """Largest probability, the first class on a tie; unknown when nothing is above 0."""
    names = F.array(*[F.lit(c) for c in classes])
    best = F.array_max(probs)
    at = F.array_position(F.col(probs), best).cast("int")
    return (df.withColumn("probability", F.coalesce(F.greatest(best, F.lit(0.0)), F.lit(0.0)))
            .withColumn("predicted", F.when(best > 0, F.element_at(names, at)).otherwise("unknown")))


def classify(features: DataFrame, model: Boosted | PipelineModel) -> DataFrame:
    """ML-5: distribution per class, winner and its probability."""
    if isinstance(model, Boosted):
        out = features.withColumn("probs", boosting.probabilities(model))
    else:
        out = model.stages[-1].transform(features).withColumn("probs", vector_to_array("probability")).drop("probability", "raw", "prediction")
    return winner(out, classes_of(model))


def distribution(classified: DataFrame, ids: Sequence[str], classes: Sequence[str], probs: str = "probs") -> DataFrame:
    """One row per object and class."""
    names = F.array(*[F.lit(c) for c in classes])
    return classified.select(*ids, F.posexplode(probs).alias("_i", "prob")).select(
        *ids, F.element_at(names, F.col("_i") + 1).alias("class"), "prob")


def canonical_type(file_type: Column) -> Column:
    t = F.lower(file_type)
    out = None
    for alias, name in CANONICAL.items():
        out = F.when(t == alias, name) if out is None else out.when(t == alias, name)
    return out.otherwise(t)


def ml_consistency(file_type: Column, predicted: Column, target_prob: Column, heuristic: Column) -> Column:
    """ML-6: ``target_prob`` is the probability of the canonical class, 0 if the model lacks it."""
    p = target_prob
    score = (F.when(p >= 0.60, 0.80 + (p - 0.60) * 0.50).when(predicted == canonical_type(file_type), 0.60 + p * 0.40)
             .when(predicted == "unknown", 0.50 * heuristic + 0.50 * p)
             .otherwise(F.least(0.30 * heuristic + 0.20 * p, F.lit(0.40))))
    return F.least(F.greatest(score, F.lit(0.1)), F.lit(1.0))


def target_probability(classes: Sequence[str], file_type: Column, probs: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), canonical_type(file_type)).cast("int")
    return F.when(at > 0, F.element_at(probs, F.greatest(at, F.lit(1)))).otherwise(0.0)


def entropy_scorer(model: PipelineModel):
    """The classifier as the entropy signal of ``carve.recover_image(entropy_score=...)``: ML-6 over the carved payloads."""
    from blocklens.operators.carve import payload_entropy

    def score(rows: DataFrame) -> DataFrame:
        keep = rows.columns
        found = classify(features_of(rows, keep), model)
        heuristic = scoring.entropy_consistency(payload_entropy("payload"), F.col("file_type"), F.octet_length("payload") == 0)
        p = target_probability(classes_of(model), F.col("file_type"), F.col("probs"))
        return found.select(*keep, ml_consistency(F.col("file_type"), F.col("predicted"), p, heuristic).alias("entropy"))
    return score


def explain(classified: DataFrame, model: PipelineModel, k: int = 3) -> DataFrame:
    """ML-7: text of the model's k strongest features with the object's values."""
    ranked = sorted(enumerate(importances_of(model)), key=lambda x: (-x[1], x[0]))[:k]
    values = vector_to_array("features")
    parts = [F.format_string(f"{FEATURE_NAMES[i]}: %.4f", values[i]) for i, _ in ranked]
    return classified.withColumn("basis", F.concat(
        F.lit("ML Model: "), "predicted", F.format_string(" (%.1f%% prob) | Top Features: [", F.col("probability") * 100),
        F.concat_ws(", ", *parts), F.lit("]")))


def confusion(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return predictions.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, classes: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    return confusion(predictions, label, predicted).groupBy("label").pivot("predicted", list(classes)).agg(F.sum("n")).na.fill(0)


def evaluate_classifier(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """ML-3: precision, recall and F1 per class, macro means in the row ``macro``.

    Predictions shrink to (label, predicted) counts first; what follows is tiny.
    """
    c = confusion(predictions, label, predicted)
    by_label = c.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("actual"))
    by_pred = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("claimed"))
    hit = c.where("label = predicted").select(F.col("label").alias("class"), F.col("n").alias("tp"))
    j = by_label.join(by_pred, "class", "left").join(hit, "class", "left").na.fill(0)
    p = F.when(F.col("claimed") > 0, F.col("tp") / F.col("claimed")).otherwise(0.0)
    r = F.col("tp") / F.col("actual")
    per = j.select("class", F.col("actual").alias("support"), p.alias("precision"), r.alias("recall"),
                   F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0).alias("f1"))
    macro = per.agg(F.sum("support").alias("support"), *[F.avg(x).alias(x) for x in ("precision", "recall", "f1")]).select(
        F.lit("macro").alias("class"), "support", "precision", "recall", "f1")
    return per.unionByName(macro)
