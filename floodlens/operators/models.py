"""Classifiers on Spark ML: fitting, scoring, cross-validation, comparison."""
import time

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodlens.functions.columns import name_of
from floodlens.functions.decisions import above
from floodlens.operators.evaluation import accuracy, macro_scores, rate_columns
from floodlens.operators.sampling import with_class_weight
from floodlens.operators.scaling import Scaler, fit_scaler
from floodlens.operators.views import masked_flat

# Fixed values of the compared models
FOREST_TREES = 200
BOOST_ROUNDS = 100
BOOST_STEP = 0.1
THRESHOLD = 0.5

FIT_ROWS = 20_000     # rows of a task of a fit
MAX_DEPTH = 30
MAX_BINS = 255


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def _doubles(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("double") for f in features})


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a fit walks them hundreds of times, and a small table read back is one partition.

    A larger table is dealt to as many tasks as its rows need; every task of every step costs its start.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FIT_ROWS)))


def fit_forest(train: DataFrame, features: list[str], label: str = "y", trees: int = FOREST_TREES, seed: int = 42,
               balanced: bool = True, depth: int = MAX_DEPTH) -> PipelineModel:
    """Random forest with balanced class weights."""
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed,
                                    maxDepth=depth, maxBins=128, cacheNodeIds=True)  # else deep trees go to every task of every step
    if balanced:
        forest = forest.setWeightCol("weight")
        train = with_class_weight(train, label)
    return Pipeline(stages=[assembler(features), forest]).fit(spread(_doubles(train, features)))


def fit_boosted(train: DataFrame, features: list[str], label: str = "y", rounds: int = BOOST_ROUNDS,
                seed: int = 0, depth: int = 5) -> PipelineModel:
    """Gradient-boosted trees over binned features, binary, balanced."""
    boost = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, stepSize=BOOST_STEP,
                          maxBins=MAX_BINS, maxDepth=depth, seed=seed, weightCol="weight")
    return Pipeline(stages=[assembler(features), boost]).fit(spread(_doubles(with_class_weight(train, label), features)))


def score(model: PipelineModel, rows: DataFrame, features: list[str], threshold: float | None = None) -> DataFrame:
    """Add `p` (predicted label) and, for models that give one, `score` (probability of label 1)."""
    keep = [c for c in rows.columns if c not in ("p", "score")]
    plain = rows.select(*keep)
    raw = {f"_x_{f}": F.col(f) for f in features}
    out = model.transform(_doubles(plain.withColumns(raw), features))
    out = out.withColumns({f: F.col(f"_x_{f}") for f in features})
    p = F.col("prediction").cast("int")
    if "probability" in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
        p = above(F.col("score"), threshold).cast("int") if threshold is not None else p
        return out.withColumn("p", p).select(*keep, "score", "p")
    return out.withColumn("p", p).select(*keep, "p")


# --- RBF support vectors, approximated by random cosine features -----------------------------------

class CosineSvm:
    """Linear one-vs-rest SVM on cos(w.x + b): an approximation of the RBF kernel machine."""

    def __init__(self, scaler: Scaler, weights, phase, model):
        self.scaler, self.weights, self.phase, self.model = scaler, weights, phase, model

    @staticmethod
    def features(df: DataFrame, scaler: Scaler, weights, phase) -> DataFrame:
        width = weights.shape[1]

        def project(batches):
            for batch in batches:
                x = np.asarray(batch.column("_x").flatten()).reshape(-1, weights.shape[0])
                z = np.cos(x @ weights + phase) * np.sqrt(2.0 / width)
                flat = pa.array(z.reshape(-1), pa.float64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * width, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "_z"])

        wide = df.withColumn("_x", scaler.vector())
        schema = T.StructType([*wide.schema.fields, T.StructField("_z", T.ArrayType(T.DoubleType()))])
        return wide.mapInArrow(project, schema).withColumn("features", array_to_vector("_z")).drop("_x", "_z")

    def predict(self, rows: DataFrame) -> DataFrame:
        z = self.features(rows, self.scaler, self.weights, self.phase)
        return (self.model.transform(z).withColumn("p", F.col("prediction").cast("int"))
                .select(*rows.columns, "p"))


def fit_svm(train: DataFrame, features: list[str], label: str = "y", width: int = 256, seed: int = 42,
            iterations: int = 50) -> CosineSvm:
    scaler = fit_scaler(train, features)
    # variance of the scaled matrix: one per varying column
    varying = train.agg(*[(F.stddev_pop(F.col(f).cast("double")) > 0).alias(f) for f in features]).first()
    gamma = 1.0 / (len(features) * max(sum(bool(v) for v in varying) / len(features), 1e-9))
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, np.sqrt(2.0 * gamma), (len(features), width))
    phase = rng.uniform(0.0, 2.0 * np.pi, width)
    z = CosineSvm.features(spread(with_class_weight(train, label).select(label, "weight", *features)), scaler, weights, phase)
    svm = LinearSVC(maxIter=iterations, regParam=1e-3)
    model = OneVsRest(classifier=svm, labelCol=label, featuresCol="features", weightCol="weight").fit(
        z.withColumn(label, F.col(label).cast("double")))
    return CosineSvm(scaler, weights, phase, model)


# --- Packet sequences ----------------------------------------------------------------------------------

def sequence_rows(windows: DataFrame) -> DataFrame:
    """Windows with seq and length as vectors; values past `length` are zeroed and cannot matter."""
    return masked_flat(windows).withColumn("features", array_to_vector("flat")).drop("flat", "seq")


def fit_sequence_forest(train: DataFrame, label: str = "y", trees: int = FOREST_TREES, seed: int = 42,
                        depth: int = MAX_DEPTH):
    forest = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed,
                                    maxDepth=depth, weightCol="weight", cacheNodeIds=True)
    return forest.fit(spread(with_class_weight(train, label)))


def balanced_copies(train: DataFrame, label: str = "y") -> DataFrame:
    """Rows of the smaller classes repeated to the size of the largest (the network takes no weights)."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}
    top = max(counts.values())
    times = name_of(F.col(label), {k: max(1, round(top / n)) for k, n in counts.items()})
    return train.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


def fit_network(train: DataFrame, validation: DataFrame, label: str = "y", hidden: int = 64, seed: int = 42,
                budgets: list[int] = (10, 30, 60)):
    """Neural comparator; of several training lengths the one best on the validation groups."""
    width = train.select("features").first()[0].size
    rows = spread(balanced_copies(train, label))
    best = None
    for iterations in budgets:
        model = MultilayerPerceptronClassifier(labelCol=label, featuresCol="features", layers=[width, hidden, 2],
                                               maxIter=iterations, seed=seed).fit(rows)
        pred = model.transform(validation).select(F.col(label).alias("y"), F.col("prediction").cast("int").alias("p"))
        f1 = macro_scores(pred).first()
        value = f1["macro_f1"] if f1 and f1["macro_f1"] is not None else 0.0
        if best is None or value > best[0] + 1e-4:
            best = (value, model, iterations)
    return best[1], best[2]


# --- Reports ------------------------------------------------------------------------------------------------

def cross_validate(rows: DataFrame, fit, predict, folds: int, metric: str = "macro_f1") -> float:
    """Mean of a metric over the folds in column `fold` (grouped folds keep groups whole)."""
    values = []
    for k in range(folds):
        model = fit(rows.where(F.col("fold") != k))
        pred = predict(model, rows.where(F.col("fold") == k))
        table = accuracy(pred) if metric == "accuracy" else macro_scores(pred)
        values.append(table.first()[metric])
    return float(np.mean([v for v in values if v is not None]))


def feature_importance(spark, model: PipelineModel, features: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return (spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")
            .orderBy(F.desc("importance")))


def tree_nodes(model) -> int:
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    return sum(t.numNodes for t in last.trees)


def scoring_efficiency(spark, name: str, model, rows: DataFrame, features: list[str]) -> DataFrame:
    """Tree nodes and throughput of one timed scoring job."""
    n = rows.count()
    start = time.perf_counter()
    score(model, rows, features).write.format("noop").mode("overwrite").save()
    seconds = time.perf_counter() - start
    return spark.createDataFrame([(name, tree_nodes(model), n, n / seconds)],
                                 "model string, nodes bigint, windows bigint, windows_per_s double")


def model_row(spark, name: str, pred: DataFrame, cv: float | None, fit_s: float, predict_s: float) -> DataFrame:
    """One row of the comparison: accuracy, macro-F1, CV score, detection, false positives, times."""
    det, fp = rate_columns(F.col("p") > 0, F.col("y"))
    counts = pred.agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"), det, fp)
    return (counts.withColumn("model", F.lit(name)).join(macro_scores(pred).withColumn("model", F.lit(name)), "model")
            .withColumn("cv_score", F.lit(cv).cast("double"))
            .withColumn("fit_s", F.lit(fit_s)).withColumn("predict_s", F.lit(predict_s)))


def compare_models(spark, train: DataFrame, test: DataFrame, models: dict, folds: int | None = None) -> DataFrame:
    """`models`: name -> (fit(rows), predict(model, rows) adding p). Train rows hold y and, with folds, fold."""
    from functools import reduce

    from floodlens.session import materialise
    parts = []
    for name, (fit, predict) in models.items():
        cv = cross_validate(train, fit, predict, folds) if folds else None
        start = time.perf_counter()
        model = fit(train)
        fit_s = time.perf_counter() - start
        start = time.perf_counter()
        pred = materialise(predict(model, test).select("y", "p"), "predictions")
        parts.append(model_row(spark, name, pred, cv, fit_s, time.perf_counter() - start))
    return reduce(lambda a, b: a.unionByName(b), parts)


def json_scoring(requests: DataFrame, predict, width: int, names: dict, on_error: str = "error") -> DataFrame:
    """Score one JSON list of numbers per row (`body`). A row that cannot be parsed is an error row;
    with on_error="normal" it answers label 0, as a fail-open service would.

    `predict` adds `prediction` given a column `values` (array of doubles).
    """
    values = F.from_json("body", "array<double>", {"mode": "PERMISSIVE"})
    parsed = requests.withColumn("values", values)
    ok = (F.col("values").isNotNull() & (F.size("values") == width)
          & F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v)))
    zeros = F.array(*[F.lit(0.0)] * width)
    safe = parsed.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn(
        "values", F.when(F.col("ok"), F.col("values")).otherwise(zeros))
    fallback = F.lit(0) if on_error == "normal" else F.lit(None).cast("int")
    p = F.when(F.col("ok"), F.col("prediction").cast("int")).otherwise(fallback)
    return (predict(safe).withColumn("prediction", p)
            .withColumn("label", name_of(F.col("prediction"), names))
            .withColumn("error", F.when(~F.col("ok"), F.lit("invalid request"))).drop("values", "ok"))


def score_vector(values: str, scaler: Scaler):
    """The standardised vector of an array column."""
    return F.array(*[(F.col(values)[i] - F.lit(m)) / F.lit(s) for i, (m, s) in enumerate(zip(scaler.mean, scaler.std))])
