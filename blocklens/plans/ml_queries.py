"""Classifier queries: documents by language on byte features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from blocklens.operators import classifier as ml
from blocklens.plans import containers as ct
from blocklens.plans.catalog import query, r6, rounded, table
from blocklens.session import checkpoint_root, cut_lineage


def featured(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"), F.encode("text", "UTF-8").alias("payload"))
    return ml.features_of(docs, ["doc_id", "label"])


def labelled(spark, sf, features):
    """``features`` with their split, which runs on ids and labels alone."""
    ids = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    return features.join(ml.stratified_split(ids, "label", "doc_id").drop("label"), "doc_id")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark, sf, what, fit):
    """A model is fitted once per session and input, stored in the shared folder and loaded by every query that asks for it."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _STORED:
        at = f"{checkpoint_root(spark)}/models/{uuid.uuid4().hex}"
        ml.save_model(fit(), at)
        _STORED[key] = at
    return ml.load_model(_STORED[key])


def language_model(spark, sf, features, boosted=False):
    """Fitted on the training share of ``features``; who reads these again should materialise them, for profiling reads every payload."""
    return stored(spark, sf, f"language {boosted}", lambda: ml.train_file_type(labelled(spark, sf, features).where("is_train"), boosted=boosted))


def files(spark, sf):
    """Every page wrapped in the file format of its id, whole."""
    b = ct.bodies(spark, sf)
    out = None
    for i, f in enumerate(ct.FORMATS):
        part = ct.WRAP[f](F.col("body"), F.lit(0))
        out = F.when(F.col("page_id") % 7 == i, part) if out is None else out.when(F.col("page_id") % 7 == i, part)
    label = F.element_at(F.array(*[F.lit(f) for f in ct.FORMATS]), (F.col("page_id") % 7 + 1).cast("int"))
    return b.select("page_id", label.alias("label"), out.alias("payload"))


def file_features(spark, sf):
    f = files(spark, sf)
    ids = ml.stratified_split(f.select("page_id", "label"), "label", "page_id").drop("label")
    return cut_lineage(ml.features_of(f, ["page_id", "label"]).join(ids, "page_id"))


def file_model(spark, sf, boosted=False):
    """The features and the model fitted on their training share."""
    data = file_features(spark, sf)
    return data, stored(spark, sf, f"files {boosted}", lambda: ml.train_file_type(data.where("is_train"), boosted=boosted))


FILES = f"""fl AS (SELECT page_id, {list(ct.FORMATS)!r}[page_id % 7 + 1] AS label FROM pages),
 sp AS (SELECT page_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || page_id), page_id) * 10 > count(*) OVER (PARTITION BY label) * 7 AS is_test FROM fl)"""


@query("ml2_file_types", f"""WITH {FILES}, t AS (SELECT label AS class, count(*) AS support FROM sp WHERE is_test GROUP BY 1)
SELECT class, support, true AS reliable FROM t UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), true FROM t""")
def file_types(spark, sf):
    """Held-out quality of the seven formats: macro F1 of 0.95 or more, and of every class."""
    data, model = file_model(spark, sf)
    got = ml.evaluate_classifier(ml.classify(data.where("NOT is_train"), model))
    return got.select("class", "support", (F.col("f1") >= 0.95).alias("reliable"))


@query("ml2_file_quality")
def file_quality(spark, sf):
    """Precision, recall and F1 of every format and their means, on the held-out files, by the boosted model."""
    data, model = file_model(spark, sf, boosted=True)
    got = ml.evaluate_classifier(ml.classify(data.where("NOT is_train"), model))
    return got.select("class", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("ml5_file_classes", f"""WITH {FILES} SELECT page_id, label, 7 AS classes, 1.0::DOUBLE AS total, true AS named FROM sp""")
def file_classes(spark, sf):
    """Distributions over the classes add up to one and the winner is one of them."""
    data, model = file_model(spark, sf)
    got = ml.classify(data, model)
    total = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    return got.select("page_id", "label", F.size("probs").alias("classes"), F.round(total, 6).alias("total"), F.col("predicted").isin(*ml.classes_of(model)).alias("named"))


@query("ml7_file_basis", f"WITH {FILES} SELECT page_id, true AS told FROM sp")
def file_basis(spark, sf):
    """The text names the winner, its share and three features with their values."""
    data, model = file_model(spark, sf)
    got = ml.explain(ml.classify(data, model), model)
    shape = r"^ML Model: \w+ \(\d+\.\d% prob\) \| Top Features: \[\S+: -?\d+\.\d{4}, \S+: -?\d+\.\d{4}, \S+: -?\d+\.\d{4}\]$"
    return got.select("page_id", (F.col("basis").rlike(shape) & F.col("basis").contains(F.concat(F.lit("Model: "), "predicted", F.lit(" ")))).alias("told"))


@query("ml1_stratified_split", """WITH h AS (SELECT doc_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, label, pos * 10 <= n * 7 AS is_train FROM h""")
def split(spark, sf):
    return ml.stratified_split(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label")), "label", "doc_id")


@query("ml2_train_file_type")
def train(spark, sf):
    """Held-out quality per language of the boosted model."""
    data = cut_lineage(featured(spark, sf))
    got = ml.classify(labelled(spark, sf, data).where("NOT is_train"), language_model(spark, sf, data, boosted=True))
    return ml.evaluate_classifier(got).select("class", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


def fixed_predictions(spark, sf):
    flip = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("n_chars") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select(F.col("lang").alias("label"), F.when(F.col("doc_id") % 7 == 0, flip).otherwise(F.col("lang")).alias("predicted"))


FIXED = "p AS (SELECT lang AS label, CASE WHEN doc_id % 7 = 0 THEN ['en','de','fr','es'][n_chars % 4 + 1] ELSE lang END AS predicted FROM documents)"


@query("ml3_evaluate_classifier", f"""WITH {FIXED}, c AS (SELECT l.label AS class, count(*) AS support, count(*) FILTER (predicted = label) AS tp FROM p l GROUP BY 1), k AS (SELECT predicted AS class, count(*) AS claimed FROM p GROUP BY 1),
 m AS (SELECT class, support, coalesce(tp::DOUBLE/claimed, 0) AS pr, tp::DOUBLE/support AS rc FROM c LEFT JOIN k USING (class)), f AS (SELECT *, CASE WHEN pr+rc > 0 THEN 2*pr*rc/(pr+rc) ELSE 0 END AS f1 FROM m)
SELECT class, support, round(pr,6) AS "precision", round(rc,6) AS recall, round(f1,6) AS f1 FROM f UNION ALL SELECT 'macro', CAST(sum(support) AS BIGINT), round(avg(pr),6), round(avg(rc),6), round(avg(f1),6) FROM f""")
def evaluate(spark, sf):
    return ml.evaluate_classifier(fixed_predictions(spark, sf)).select("class", "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("ml3_confusion_matrix", f"WITH {FIXED} SELECT label, " + ", ".join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in ("de", "en", "es", "fr")) + " FROM p GROUP BY label")
def matrix(spark, sf):
    return ml.confusion_matrix(fixed_predictions(spark, sf), ["de", "en", "es", "fr"])


@query("ml4_rank_importances")
def importances(spark, sf):
    return ml.rank_importances(spark, language_model(spark, sf, featured(spark, sf)), 15).withColumn("importance", r6("importance"))


@query("ml5_classify")
def classify(spark, sf):
    data = cut_lineage(featured(spark, sf))
    return ml.classify(data, language_model(spark, sf, data)).select("doc_id", "label", "predicted", r6("probability").alias("probability"))


PROB = """pb AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, [l_discount * 5, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_tax * 6 END, l_discount * 5] AS probs,
 CASE l_partkey % 4 WHEN 0 THEN 'JPG' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'ole2' END AS file_type FROM lineitem)"""
CLASSES = ["jpeg", "pdf", "zip"]


def probabilities(spark, sf):
    p = table(spark, sf, "lineitem")
    kinds = F.element_at(F.array(F.lit("JPG"), F.lit("pdf"), F.lit("docx"), F.lit("ole2")), (F.col("l_partkey") % 4 + 1).cast("int"))
    d5 = F.col("l_discount") * 5
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.array(d5, F.when(F.col("l_linenumber") == 1, 0.0).otherwise(F.col("l_tax") * 6), d5).alias("probs"), kinds.alias("file_type"))


@query("ml5_winner", f"""WITH {PROB} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN list_max(probs) > 0 THEN ['jpeg','pdf','zip'][list_position(probs, list_max(probs))] ELSE 'unknown' END AS predicted,
 round(list_max(probs), 6) AS probability FROM pb""")
def winner(spark, sf):
    return ml.winner(probabilities(spark, sf), CLASSES).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "predicted", r6("probability").alias("probability"))


@query("ml6_ml_consistency", f"""WITH {PROB}, w AS (SELECT *, CASE WHEN list_max(probs) > 0 THEN ['jpeg','pdf','zip'][list_position(probs, list_max(probs))] ELSE 'unknown' END AS predicted,
 CASE file_type WHEN 'JPG' THEN 'jpeg' WHEN 'docx' THEN 'zip' ELSE file_type END AS canon, l_quantity / 50 AS h FROM pb),
 t AS (SELECT *, CASE canon WHEN 'jpeg' THEN probs[1] WHEN 'pdf' THEN probs[2] WHEN 'zip' THEN probs[3] ELSE 0 END AS p FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(greatest(least(CASE WHEN p >= 0.6::DOUBLE THEN 0.8::DOUBLE + (p - 0.6::DOUBLE) * 0.5::DOUBLE WHEN predicted = canon THEN 0.6::DOUBLE + p * 0.4::DOUBLE
 WHEN predicted = 'unknown' THEN 0.5::DOUBLE * h + 0.5::DOUBLE * p ELSE least(0.3::DOUBLE * h + 0.2::DOUBLE * p, 0.4::DOUBLE) END, 1), 0.1::DOUBLE), 5) AS consistency FROM t""")
def consistency(spark, sf):
    w = ml.winner(probabilities(spark, sf), CLASSES)
    p = ml.target_probability(CLASSES, F.col("file_type"), F.col("probs"))
    return w.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", rounded(ml.ml_consistency(
        F.col("file_type"), F.col("predicted"), p, F.col("l_quantity") / 50), 5).alias("consistency"))


@query("ml7_explain")
def explain(spark, sf):
    data = cut_lineage(featured(spark, sf))
    m = language_model(spark, sf, data)
    return ml.explain(ml.classify(data, m), m).select("doc_id", "predicted", "basis")
