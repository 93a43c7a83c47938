"""Queries that fit and apply models (M1, M2, M4, M6-M9, M11, M12, N9, E14, S16). Learners differ between
engines, so most have no SQL; tests hold their metrics to bands."""
from pyspark.sql import functions as F

from floodlens.operators import adaptive as A
from floodlens.operators import evaluation as E
from floodlens.operators import labeling as L
from floodlens.operators import models as M
from floodlens.operators import sampling as R
from floodlens.operators import views as V
from floodlens.operators.neighbours import knn_classify
from floodlens.operators.novelty import novelty_fit
from floodlens.plans.labels import labelled
from floodlens.plans.packet_view import SERVER, packets, pk_sql
from floodlens.plans.registry import query
from floodlens.plans.windows import COUNT_SQL
from floodlens.schemas import COUNT_FEATURES, FEATURES, LABEL_NAMES
from floodlens.session import materialise, shared_dir


def scheduled(df, binary=False):
    """The label of the attack schedule as `y`; no feature takes part in it."""
    return df.withColumn("y", (F.col("label") > 0).cast("int") if binary else F.col("label"))


def split_rows(spark, sf, binary=False):
    d = materialise(R.holdout_session(scheduled(labelled(spark, sf, 3, FEATURES), binary)), "model-rows")
    return d.where("not is_test"), d.where("is_test")


KEYS = ["session", "window_start", "peer_ip"]
FOLDS = 5


@query("rf_fit_score")
def q_rf(spark, sf):
    train, test = split_rows(spark, sf)
    model = M.fit_forest(train, FEATURES)
    return M.score(model, test, FEATURES).select(*KEYS, "y", "p")


@query("gbt_fit_score")
def q_gbt(spark, sf):
    train, test = split_rows(spark, sf, binary=True)
    model = M.fit_boosted(train, FEATURES)
    return M.score(model, test, FEATURES, threshold=0.5).select(*KEYS, "y", "p", "score")


@query("svm_rbf")
def q_svm(spark, sf):
    train, test = split_rows(spark, sf)
    return M.fit_svm(train, FEATURES).predict(test).select(*KEYS, "y", "p")


@query("cross_validate")
def q_cross_validate(spark, sf):
    train, _ = split_rows(spark, sf)
    rows = materialise(R.stratified_group_kfold(train, ["session", "round"], FOLDS, label="y"), "folds")
    value = M.cross_validate(rows, lambda t: M.fit_forest(t, FEATURES), lambda m, t: M.score(m, t, FEATURES), FOLDS)
    return rows.groupBy("fold").agg(F.count("*").alias("windows")).withColumn("cv_macro_f1", F.lit(value))


@query("feature_importance")
def q_importance(spark, sf):
    train, _ = split_rows(spark, sf)
    return M.feature_importance(spark, M.fit_forest(train, FEATURES), FEATURES)


def sequence_split(spark, sf):
    w = labelled(spark, sf, 3, ["n_in"])
    s = V.sequence_view(packets(spark, sf, 3), [SERVER])
    d = materialise(R.holdout_session(scheduled(L.attach_sequences(w, s), binary=True)), "sequence-rows")
    return d.where("not is_test"), d.where("is_test")


@query("rf_sequence")
def q_rf_sequence(spark, sf):
    train, test = sequence_split(spark, sf)
    model = M.fit_sequence_forest(M.sequence_rows(train))
    return model.transform(M.sequence_rows(test)).select(*KEYS, "y", F.col("prediction").cast("int").alias("p"))


@query("neural_sequence")
def q_neural(spark, sf):
    train, test = sequence_split(spark, sf)
    parts = R.group_shuffle_split(train, ["session", "round"], 0.15, 42)
    fit, val = parts.where("not is_val"), parts.where("is_val")
    model, _ = M.fit_network(M.sequence_rows(fit), M.sequence_rows(val))
    return model.transform(M.sequence_rows(test)).select(*KEYS, "y", F.col("prediction").cast("int").alias("p"))


REQUEST_SQL = f"""WITH {pk_sql(3)}, {COUNT_SQL},
req AS (SELECT session, window_no, syn_count, window_no % 7 AS bad FROM count_win)
SELECT session, window_no, CAST(CASE WHEN bad IN (3, 5) THEN {{fallback}} WHEN syn_count > 20 THEN 3 ELSE 0 END AS INT) AS prediction,
  CASE WHEN bad IN (3, 5) THEN {{name}} WHEN syn_count > 20 THEN 'SYN Flood' ELSE 'Normal' END AS label,
  CASE WHEN bad IN (3, 5) THEN 'invalid request' END AS error FROM req"""


def json_requests(spark, sf):
    w = V.count_windows(packets(spark, sf, 3))
    body = F.to_json(F.array(*[F.col(c).cast("double") for c in COUNT_FEATURES]))
    bad = F.col("window_no") % 7
    body = F.when(bad == 3, F.lit("[1, 2")).when(bad == 5, F.lit("[1, 2, 3]")).otherwise(body)
    return w.select("session", "window_no", body.alias("body"))


def syn_rule(df):
    return df.withColumn("prediction", F.when(F.col("values")[2] > 20, 3).otherwise(0))


@query("json_scoring", REQUEST_SQL.format(fallback="NULL", name="NULL"))
def q_json_scoring(spark, sf):
    return M.json_scoring(json_requests(spark, sf), syn_rule, len(COUNT_FEATURES), LABEL_NAMES).drop("body")


@query("json_scoring_open", REQUEST_SQL.format(fallback="0", name="'Normal'"))
def q_json_scoring_open(spark, sf):
    return M.json_scoring(json_requests(spark, sf), syn_rule, len(COUNT_FEATURES), LABEL_NAMES, "normal").drop("body")


@query("scoring_efficiency")
def q_efficiency(spark, sf):
    train, test = split_rows(spark, sf)
    return M.scoring_efficiency(spark, "forest", M.fit_forest(train, FEATURES), test, FEATURES)


@query("model_table")
def q_model_table(spark, sf):
    train, test = split_rows(spark, sf)
    models = {
        "Random Forest": (lambda t: M.fit_forest(t, FEATURES), lambda m, t: M.score(m, t, FEATURES)),
        "KNN": (lambda t: t, lambda m, t: knn_classify(t, m, FEATURES, KEYS, label="y")),
        "SVM": (lambda t: M.fit_svm(t, FEATURES), lambda m, t: m.predict(t)),
    }
    return M.compare_models(spark, train, test, models)


@query("model_store")
def q_model_store(spark, sf):
    from floodlens.sources.sinks import load_model, save_model
    train, test = split_rows(spark, sf)
    path = shared_dir(spark, "model")
    save_model(M.fit_forest(train, FEATURES), path, FEATURES, 1.0, LABEL_NAMES, ["s1", "s2"],
               base=train.select(*FEATURES, "y"))
    model, info, base = load_model(spark, path, FEATURES)
    counts = M.score(model, test, FEATURES).groupBy("p").agg(F.count("*").alias("windows"))
    return counts.withColumn("base_rows", F.lit(base.count())).withColumn("window_s", F.lit(info["window"]))


def replay(spark, sf):
    """Derived network of a few minutes: 120 s of calibration, 30 s steps, a refit per minute; the base is other sessions."""
    rows = materialise(labelled(spark, sf, 1, FEATURES), "replay-rows")
    key = ["session", "window_start", "peer_ip"]
    base = materialise(scheduled(labelled(spark, sf, 3, FEATURES, without="s1"), binary=True), "replay-base")
    cal, _, _ = A.calibration_split(rows, 120.0)
    novelty = novelty_fit(cal, FEATURES, key)

    def fit(data):
        model = M.fit_boosted(data, FEATURES, rounds=5, depth=3)
        return lambda w: M.score(model, w, FEATURES).drop("score")

    return A.adaptive_replay(rows, base, novelty, fit, FEATURES, 120.0, 30.0, 60.0, 60.0)


@query("adaptive_replay")
def q_adaptive_replay(spark, sf):
    return replay(spark, sf).select(*KEYS, "label", "version", "block", "static_sup", "adaptive_sup", "novel", "static", "adaptive")


@query("adaptive_report")
def q_adaptive_report(spark, sf):
    out = replay(spark, sf)
    return E.block_report(out, ["static", "adaptive", "static_sup", "adaptive_sup"])
