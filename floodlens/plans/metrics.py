"""Queries over the evaluation tables (E1-E17, R9), with fixed rules as predictions."""
from pyspark.sql import functions as F

from floodlens.operators import adaptive as A
from floodlens.operators import evaluation as E
from floodlens.operators.sampling import holdout_session, training_settings
from floodlens.plans.labels import LAB, NAMES_SQL, SETTINGS_SQL, attacker_hosts, labelled, schedule
from floodlens.plans.packet_view import ATTACKERS_SQL, ATTACKS_SQL, DIR_SQL, pk_sql, win_sql
from floodlens.plans.registry import query

RULE = ["n_in", "icmp_ratio_in", "udp_ratio_in"]
RULE_SQL = """pred AS (SELECT *, CAST(label AS INT) AS y, CAST(CASE WHEN n_in < 2 THEN 0 WHEN icmp_ratio_in >= 0.5 THEN 1
  WHEN udp_ratio_in >= 0.5 THEN 2 ELSE 3 END AS INT) AS p, n_in >= 3 AS flagged FROM lab)"""
PRED = f"{LAB}, {RULE_SQL}"


def predicted(spark, sf):
    p = (F.when(F.col("n_in") < 2, 0).when(F.col("icmp_ratio_in") >= 0.5, 1)
         .when(F.col("udp_ratio_in") >= 0.5, 2).otherwise(3))
    d = labelled(spark, sf, features=RULE)
    return d.withColumn("y", F.col("label")).withColumn("p", p).withColumn("flagged", F.col("n_in") >= 3)


def per_class_sql(by=""):
    b = f"{by}, " if by else ""
    on = f"USING ({by}, label)" if by else "USING (label)"
    return f"""labels_seen AS (SELECT DISTINCT {b}y AS label FROM pred UNION SELECT DISTINCT {b}p FROM pred),
cls AS (SELECT {b}label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM labels_seen
  LEFT JOIN (SELECT {b}y AS label, count(*) AS tp FROM pred WHERE y = p GROUP BY ALL) {on}
  LEFT JOIN (SELECT {b}p AS label, count(*) AS fp FROM pred WHERE y <> p GROUP BY ALL) {on}
  LEFT JOIN (SELECT {b}y AS label, count(*) AS fn FROM pred WHERE y <> p GROUP BY ALL) {on}),
prf AS (SELECT *, tp + fn AS support, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS prec,
  coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS rec,
  coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1 FROM cls)"""


CLS = f"{PRED}, {per_class_sql()}"


def r9(c):
    return F.round(c, 9).alias(c)


@query("accuracy", f"{PRED} SELECT round(avg(CASE WHEN y = p THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy FROM pred")
def q_accuracy(spark, sf):
    return E.accuracy(predicted(spark, sf)).select(r9("accuracy"))


@query("macro_f1", f"{CLS} SELECT round(avg(f1), 9) AS macro_f1 FROM prf")
def q_macro_f1(spark, sf):
    return E.macro_f1(predicted(spark, sf)).select(r9("macro_f1"))


@query("macro_precision_recall", f"{CLS} SELECT round(avg(prec), 9) AS macro_precision, round(avg(rec), 9) AS macro_recall FROM prf")
def q_macro_pr(spark, sf):
    return E.macro_scores(predicted(spark, sf)).select(r9("macro_precision"), r9("macro_recall"))


@query("classification_report", f"""{CLS}
SELECT CAST(label AS VARCHAR) AS row, round(prec, 9) AS precision, round(rec, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM prf
UNION ALL SELECT 'accuracy', round(sum(tp) / CAST(sum(support) AS DOUBLE), 9), round(sum(tp) / CAST(sum(support) AS DOUBLE), 9),
  round(sum(tp) / CAST(sum(support) AS DOUBLE), 9), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'macro avg', round(avg(prec), 9), round(avg(rec), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT) FROM prf
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / CAST(sum(support) AS DOUBLE), 9),
  round(sum(rec * support) / CAST(sum(support) AS DOUBLE), 9), round(sum(f1 * support) / CAST(sum(support) AS DOUBLE), 9),
  CAST(sum(support) AS BIGINT) FROM prf""")
def q_classification_report(spark, sf):
    return E.classification_report(predicted(spark, sf)).select(
        "row", r9("precision"), r9("recall"), r9("f1"), "support")


LABELS = [0, 1, 2, 3]
GRID_SQL = "grid AS (SELECT CAST(a AS INT) AS y, CAST(b AS INT) AS p FROM (VALUES (0), (1), (2), (3)) t(a), (VALUES (0), (1), (2), (3)) u(b))"


@query("confusion_matrix", f"""{PRED}, {GRID_SQL}
SELECT y, p, CAST(coalesce(n, 0) AS BIGINT) AS n FROM grid LEFT JOIN (SELECT y, p, count(*) AS n FROM pred GROUP BY y, p) USING (y, p)""")
def q_confusion(spark, sf):
    return E.confusion_matrix(predicted(spark, sf), LABELS)


@query("confusion_wide", f"""{PRED}, ys AS (SELECT CAST(a AS INT) AS y FROM (VALUES (0), (1), (2), (3)) t(a))
SELECT ys.y, {", ".join(f"CAST(count(*) FILTER (pred.p = {v}) AS BIGINT) AS p{v}" for v in LABELS)}
FROM ys LEFT JOIN pred ON ys.y = pred.y GROUP BY ys.y""")
def q_confusion_wide(spark, sf):
    return E.confusion_wide(predicted(spark, sf), LABELS)


RATES_SQL = """round(avg(CASE WHEN label > 0 THEN CAST(CAST({f} AS INT) AS DOUBLE) END), 9) AS detection,
  round(avg(CASE WHEN label = 0 THEN CAST(CAST({f} AS INT) AS DOUBLE) END), 9) AS false_positive"""


@query("detection_fp_rates", f"{PRED} SELECT {RATES_SQL.format(f='flagged')} FROM pred")
def q_rates(spark, sf):
    return E.detection_fp_rates(predicted(spark, sf)).select(r9("detection"), r9("false_positive"))


@query("detection_by_attack", f"""{PRED} SELECT y AS label, CAST(count(*) AS BIGINT) AS windows,
  round(avg(CAST(CAST(flagged AS INT) AS DOUBLE)), 9) AS detection, {NAMES_SQL.replace('CASE label', 'CASE y')} AS attack
FROM pred WHERE label > 0 GROUP BY y""")
def q_by_attack(spark, sf):
    return E.detection_by_attack(predicted(spark, sf)).select("label", "windows", r9("detection"), "attack")


SCORES_SQL = """sc AS (SELECT c AS class, CASE c WHEN 0 THEN 1 / CAST(n_in AS DOUBLE) WHEN 1 THEN icmp_ratio_in * n_in
    WHEN 2 THEN udp_ratio_in * n_in ELSE CAST(n_in AS DOUBLE) END AS score, label = c AS positive
  FROM lab, (VALUES (0), (1), (2), (3)) t(c)),
pts AS (SELECT class, score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM sc GROUP BY ALL),
roc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY class) AS np,
    sum(neg) OVER (PARTITION BY class) AS nn FROM pts WINDOW w AS (PARTITION BY class ORDER BY score DESC))"""


def class_score_rows(spark, sf):
    d = labelled(spark, sf, features=RULE)
    n = F.col("n_in").cast("double")
    scores = [F.lit(1.0) / n, F.col("icmp_ratio_in") * n, F.col("udp_ratio_in") * n, n]
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), s.alias("score"), (F.col("label") == c).alias("positive"))
                               for c, s in enumerate(scores)]))
    return d.select(long.alias("r")).select("r.*")


@query("roc_auc", f"""{LAB}, {SCORES_SQL}
SELECT CAST(class AS INT) AS class, round(sum((fpr - pf) * (tpr + pt) / 2), 9) AS auc FROM (
  SELECT class, fp / CAST(nn AS DOUBLE) AS fpr, tp / CAST(np AS DOUBLE) AS tpr,
    coalesce(lag(fp / CAST(nn AS DOUBLE)) OVER w, 0) AS pf, coalesce(lag(tp / CAST(np AS DOUBLE)) OVER w, 0) AS pt
  FROM roc WINDOW w AS (PARTITION BY class ORDER BY score DESC)) GROUP BY class""")
def q_roc_auc(spark, sf):
    return E.roc_auc(class_score_rows(spark, sf)).select("class", r9("auc"))


@query("roc_points", f"""{LAB}, {SCORES_SQL}
SELECT CAST(class AS INT) AS class, round(score, 9) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  round(fp / CAST(nn AS DOUBLE), 9) AS fpr, round(tp / CAST(np AS DOUBLE), 9) AS tpr FROM roc""")
def q_roc_points(spark, sf):
    return E.roc_points(class_score_rows(spark, sf)).select("class", r9("score"), "tp", "fp", r9("fpr"), r9("tpr"))


# --- A grid of trained rules: the mean packet count of the training sessions is the threshold ------

def lab3_sql():
    """Labelled windows of three sessions, the schedule repeated for each."""
    return f"""WITH {pk_sql(3)}, {DIR_SQL}, {win_sql()}, {ATTACKS_SQL},
lab AS (SELECT * FROM (SELECT w.*, e.label AS hit, coalesce(e.label, 0) AS label FROM win w LEFT JOIN attacks e
    ON w.peer_ip = e.ip AND w.window_start + 1 > e.start_ts - 1 AND w.window_start < e.end_ts + 1
  QUALIFY row_number() OVER (PARTITION BY w.session, w.window_start, w.peer_ip ORDER BY e.round DESC NULLS LAST) = 1)
  WHERE NOT (peer_ip IN {ATTACKERS_SQL} AND hit IS NULL))"""


OFFSETS = {"low bar": 0.0, "high bar": 0.4}
SEEDS = [0, 1, 2]
TRAINED_ON = ["s1 only", "s2 only", "s3 only", "all but s1", "all but s2", "all but s3", "all datasets"]
MODELS_SQL = "models AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {s}, CAST({o + 0.3 * s} AS DOUBLE))" for m, o in OFFSETS.items() for s in SEEDS) + ") t(model, seed, extra))"
GRID = f"""{lab3_sql()}, {SETTINGS_SQL}, {MODELS_SQL},
thr AS (SELECT trained_on, avg(CAST(n_in AS DOUBLE)) AS bar FROM settings JOIN lab USING (session) GROUP BY trained_on),
pred AS (SELECT model, seed, trained_on, session AS test, label, CAST(label > 0 AS INT) AS y,
  CAST(n_in > bar + extra AS INT) AS p FROM lab, thr, models),
{per_class_sql("model, seed, trained_on, test")},
results AS (SELECT model, seed, trained_on, test, avg(f1) AS macro_f1 FROM prf GROUP BY ALL)"""


def grid_predictions(spark, sf):
    d = labelled(spark, sf, 3, ["n_in"])
    bars = d.groupBy("session").agg(F.sum("n_in").alias("s"), F.count("*").alias("n"))
    bars = (training_settings(bars).join(bars, "session").groupBy("trained_on")
            .agg((F.sum("s").cast("double") / F.sum("n")).alias("bar")).collect())
    options = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(s).alias("seed"), F.lit(b["trained_on"]).alias("trained_on"),
                 F.lit(b["bar"] + (o + 0.3 * s)).alias("bar"))
        for m, o in OFFSETS.items() for s in SEEDS for b in bars]))
    return d.select("label", "n_in", F.col("session").alias("test"), options.alias("o")).select(
        "o.model", "o.seed", "o.trained_on", "test", "label", (F.col("label") > 0).cast("int").alias("y"),
        (F.col("n_in") > F.col("o.bar")).cast("int").alias("p"))


def grid_results(spark, sf):
    return E.macro_f1(grid_predictions(spark, sf), ["model", "seed", "trained_on", "test"])


SESSIONS = ["s1", "s2", "s3"]


@query("pivot_metric", f"""{GRID}
SELECT trained_on, {", ".join(f"round(first(macro_f1) FILTER (test = '{s}'), 9) AS {s}" for s in SESSIONS)},
  CAST(CASE trained_on {" ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(TRAINED_ON, 1))} END AS INT) AS position
FROM results WHERE model = 'low bar' AND seed = 0 GROUP BY trained_on""")
def q_pivot_metric(spark, sf):
    r = grid_results(spark, sf).where("model = 'low bar' AND seed = 0")
    return E.pivot_metric(r, "macro_f1", TRAINED_ON, SESSIONS).select(
        "trained_on", *[r9(s) for s in SESSIONS], "position")


@query("seed_summary", f"""{GRID},
k AS (SELECT model, seed, CASE WHEN trained_on = 'all datasets' THEN 'all' WHEN trained_on = test || ' only' THEN 'within'
    ELSE 'across' END AS kind, macro_f1 FROM results),
ps AS (SELECT model, kind, seed, avg(macro_f1) AS m FROM k GROUP BY ALL)
SELECT model, {", ".join(f"round(avg(m) FILTER (kind = '{k}'), 9) AS {k}_mean, round(stddev_samp(m) FILTER (kind = '{k}'), 9) AS {k}_std"
                         for k in ["across", "all", "within"])} FROM ps GROUP BY model""")
def q_seed_summary(spark, sf):
    return E.seed_summary(grid_results(spark, sf)).select(
        "model", *[r9(f"{k}_{m}") for k in ["across", "all", "within"] for m in ["mean", "std"]])


@query("metric_ranges", f"""{GRID}
SELECT model, test, round(avg(macro_f1), 9) AS macro_f1_mean, round(min(macro_f1), 9) AS macro_f1_min,
  round(max(macro_f1), 9) AS macro_f1_max FROM results GROUP BY model, test""")
def q_metric_ranges(spark, sf):
    return E.metric_ranges(grid_results(spark, sf), ["model", "test"], ["macro_f1"]).select(
        "model", "test", *[r9(f"macro_f1_{m}") for m in ["mean", "min", "max"]])


@query("grid_detection_by_attack", f"""{GRID}
SELECT model, trained_on, test, CAST(label AS INT) AS label, CAST(count(*) AS BIGINT) AS windows, round(avg(CAST(p AS DOUBLE)), 9) AS detection
FROM pred WHERE label > 0 AND seed = 0 GROUP BY ALL""")
def q_grid_by_attack(spark, sf):
    d = E.detection_by_attack(grid_predictions(spark, sf).where("seed = 0"), "p", ["model", "trained_on", "test"])
    return d.select("model", "trained_on", "test", "label", "windows", r9("detection"))


# --- Detectors over a stream of windows ------------------------------------------------------------

DETECTORS = ["static", "adaptive", "static_sup", "adaptive_sup", "static_nov"]
DECISIONS_SQL = """dec AS (SELECT *, CAST(floor((window_start - (SELECT min(window_start) FROM lab)) / 60) AS INT) AS block,
    n_in >= 3 AS static_sup, n_in >= 4 AS adaptive_sup, uniq_sport_in >= 3 AS static_nov,
    n_in >= 3 OR uniq_sport_in >= 3 AS static, n_in >= 4 OR uniq_sport_in >= 3 AS adaptive FROM lab)"""


def decisions(spark, sf):
    d = labelled(spark, sf, features=["n_in", "uniq_sport_in"])
    start = d.agg(F.min("window_start")).first()[0] or 0.0
    nov = F.col("uniq_sport_in") >= 3
    return (d.withColumn("block", F.floor((F.col("window_start") - start) / 60).cast("int"))
            .withColumn("static_sup", F.col("n_in") >= 3).withColumn("adaptive_sup", F.col("n_in") >= 4)
            .withColumn("static_nov", nov).withColumn("static", F.col("static_sup") | nov)
            .withColumn("adaptive", F.col("adaptive_sup") | nov))


BLOCK_COLS = [f"{d}_{m}" for d in DETECTORS[:4] for m in ("fp", "detection")]
BLOCK_REPORT_SQL = f"""rep AS (SELECT block, count(*) FILTER (label = 0) AS benign, count(*) FILTER (label > 0) AS attack,
  {", ".join(f"avg(CASE WHEN label = 0 THEN CAST(CAST({d} AS INT) AS DOUBLE) END) AS {d}_fp, avg(CASE WHEN label > 0 THEN CAST(CAST({d} AS INT) AS DOUBLE) END) AS {d}_detection" for d in DETECTORS[:4])}
  FROM dec GROUP BY block)"""


@query("block_report", f"""{LAB}, {DECISIONS_SQL}, {BLOCK_REPORT_SQL}
SELECT block, CAST(benign AS BIGINT) AS benign, CAST(attack AS BIGINT) AS attack, {", ".join(f"round({c}, 9) AS {c}" for c in BLOCK_COLS)} FROM rep""")
def q_block_report(spark, sf):
    return E.block_report(decisions(spark, sf), DETECTORS[:4]).select(
        "block", "benign", "attack", *[r9(c) for c in BLOCK_COLS])


@query("group_time_mean", f"""{LAB}, {DECISIONS_SQL}, {BLOCK_REPORT_SQL}
SELECT CAST(block // 2 AS INT) AS minutes, round(avg(static_sup_fp), 9) AS static_sup_fp, round(avg(adaptive_sup_fp), 9) AS adaptive_sup_fp
FROM rep GROUP BY block // 2""")
def q_group_time_mean(spark, sf):
    rep = E.block_report(decisions(spark, sf), DETECTORS[:4]).withColumn("minutes", F.floor(F.col("block") / 2).cast("int"))
    return E.group_time_mean(rep, ["static_sup_fp", "adaptive_sup_fp"]).select(
        "minutes", r9("static_sup_fp"), r9("adaptive_sup_fp"))


LONG_SQL = f"""long AS ({" UNION ALL ".join(f"SELECT session, peer_ip, window_start, label, '{d}' AS detector, {d} AS flagged FROM dec" for d in DETECTORS)}),
st AS (SELECT *, flagged AND coalesce(lag(flagged) OVER w, false) AND coalesce(window_start - lag(window_start) OVER w <= 1, false) AS streak
  FROM long WINDOW w AS (PARTITION BY detector, session, peer_ip ORDER BY window_start))"""


@query("detector_report", f"""{LAB}, {DECISIONS_SQL}, {LONG_SQL}
SELECT detector, {RATES_SQL.format(f='flagged')},
  round(avg(CASE WHEN label > 0 THEN CAST(CAST(streak AS INT) AS DOUBLE) END), 9) AS detection_streak,
  round(avg(CASE WHEN label = 0 THEN CAST(CAST(streak AS INT) AS DOUBLE) END), 9) AS false_positive_streak,
  {", ".join(f"round(avg(CASE WHEN label = {v} THEN CAST(CAST(flagged AS INT) AS DOUBLE) END), 9) AS detection_{v}" for v in (1, 2, 3))}
FROM st GROUP BY detector""")
def q_detector_report(spark, sf):
    long = E.unpivot_decisions(decisions(spark, sf), DETECTORS, ["session", "peer_ip", "window_start", "label"])
    # each detector's rows form their own series of a peer
    series = long.withColumn("session", F.concat_ws("|", "detector", "session"))
    st = A.in_streak(series, "flagged", "streak")
    det, fp = E.rate_columns(F.col("flagged"))
    det2, fp2 = E.rate_columns(F.col("streak"))
    by_type = [F.avg(F.when(F.col("label") == v, F.col("flagged").cast("double"))).alias(f"detection_{v}") for v in (1, 2, 3)]
    out = st.groupBy("detector").agg(det, fp, det2.alias("detection_streak"), fp2.alias("false_positive_streak"), *by_type)
    return out.select("detector", *[r9(c) for c in out.columns if c != "detector"])


@query("split_report", f"""{lab3_sql()}
SELECT session, CAST(count(*) FILTER (session <> 's3') AS BIGINT) AS train, CAST(count(*) FILTER (session = 's3') AS BIGINT) AS test,
  round(avg(CAST(CAST(label > 0 AS INT) AS DOUBLE)), 9) AS attack_share FROM lab GROUP BY session""")
def q_split_report(spark, sf):
    d = holdout_session(labelled(spark, sf, 3, ["n_in"]), "s3")
    return E.split_report(d, ["session"]).select("session", "train", "test", r9("attack_share"))


@query("label_names", f"""{LAB}
SELECT session, window_start, peer_ip, {NAMES_SQL} AS name FROM lab""")
def q_label_names(spark, sf):
    from floodlens.functions.columns import name_of
    from floodlens.schemas import LABEL_NAMES
    return labelled(spark, sf, features=["n_in"]).select(
        "session", "window_start", "peer_ip", name_of(F.col("label"), LABEL_NAMES).alias("name"))


__all__ = ["attacker_hosts", "schedule"]
