"""Evaluation tables (E1-E17). Predictions are reduced to counts first; the rest runs on the counts."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.functions.columns import name_of, share
from floodlens.operators.ordering import running_sums
from floodlens.schemas import LABEL_NAMES


def confusion_counts(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """Sparse counts per (truth y, prediction p)."""
    return pred.groupBy(*by, "y", "p").agg(F.count("*").alias("n"))


def class_scores(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    """tp, fp, fn, support, precision, recall and F1 of every label seen in truth or prediction."""
    counts = confusion_counts(pred, by)
    sides = F.when(F.col("y") == F.col("p"), F.array(F.struct(F.col("y").alias("label"), F.lit("tp").alias("kind")))).otherwise(
        F.array(F.struct(F.col("y").alias("label"), F.lit("fn").alias("kind")),
                F.struct(F.col("p").alias("label"), F.lit("fp").alias("kind"))))
    long = counts.select(*by, "n", F.explode(sides).alias("s"))

    def total(kind):
        return F.coalesce(F.sum(F.when(F.col("s.kind") == kind, F.col("n"))), F.lit(0)).cast("bigint").alias(kind)

    table = long.groupBy(*by, F.col("s.label").alias("label")).agg(total("tp"), total("fp"), total("fn"))
    tp = F.col("tp")
    return (table.withColumn("support", tp + F.col("fn"))
            .withColumn("precision", share(tp, tp + F.col("fp")))
            .withColumn("recall", share(tp, tp + F.col("fn")))
            .withColumn("f1", share(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))))


def accuracy(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    return pred.groupBy(*by).agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def macro_scores(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    return class_scores(pred, by).groupBy(*by).agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"))


def macro_f1(pred: DataFrame, by: list[str] = ()) -> DataFrame:
    return macro_scores(pred, by).select(*by, "macro_f1")


def classification_report(pred: DataFrame) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy, macro and weighted averages."""
    classes = class_scores(pred)
    per_class = classes.select(F.col("label").cast("string").alias("row"), "precision", "recall", "f1", "support")
    n = F.sum("support").cast("double")
    summary = classes.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        (F.sum("tp") / n).alias("acc"), F.sum("support").alias("n"))
    acc = F.col("acc")
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"))
        for name, p, r, f in [
            ("accuracy", acc, acc, acc),
            ("macro avg", F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1")),
            ("weighted avg", F.col("weighted_precision"), F.col("weighted_recall"), F.col("weighted_f1"))]]))
    averages = summary.select(rows.alias("r"), F.col("n").alias("support")).select("r.*", "support")
    return per_class.unionByName(averages)


def confusion_matrix(pred: DataFrame, labels: list[int]) -> DataFrame:
    """Dense label x label counts, zeros included."""
    grid = (pred.sparkSession.range(1)
            .select(F.explode(F.array(*[F.lit(v) for v in labels])).alias("y"))
            .select("y", F.explode(F.array(*[F.lit(v) for v in labels])).alias("p")))
    return (grid.join(confusion_counts(pred), ["y", "p"], "left")
            .select("y", "p", F.coalesce("n", F.lit(0)).alias("n")))


def confusion_wide(pred: DataFrame, labels: list[int]) -> DataFrame:
    return (confusion_matrix(pred, labels).groupBy("y").pivot("p", labels).agg(F.first("n"))
            .select("y", *[F.col(f"`{v}`").alias(f"p{v}".replace("-", "m")) for v in labels]))


def rate_columns(flag: Column, label: Column = None) -> list[Column]:
    """Share of attack rows flagged and share of benign rows flagged; null without such rows."""
    label = F.col("label") if label is None else label
    return [F.avg(F.when(label > 0, flag.cast("double"))).alias("detection"),
            F.avg(F.when(label == 0, flag.cast("double"))).alias("false_positive")]


def detection_fp_rates(df: DataFrame, flag: str = "flagged", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*rate_columns(F.col(flag)))


def detection_by_attack(df: DataFrame, flag: str = "flagged", by: list[str] = ()) -> DataFrame:
    """Share flagged per attack label, with the label's name."""
    return (df.where(F.col("label") > 0).groupBy(*by, "label")
            .agg(F.count("*").alias("windows"), F.avg(F.col(flag).cast("double")).alias("detection"))
            .withColumn("attack", name_of(F.col("label"), LABEL_NAMES)))


def roc_points(scores: DataFrame) -> DataFrame:
    """One-vs-rest ROC per class. Input: class, score, positive (boolean).

    Rows are counted per distinct score; the running sums are cut into score ranges.
    """
    points = scores.groupBy("class", "score").agg(
        F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    cumulative = running_sums(points, ["class"], "score", {"pos": "tp", "neg": "fp"}, descending=True)
    totals = points.groupBy("class").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return cumulative.join(totals, "class").select(
        "class", "score", "pos", "neg", "tp", "fp", "all_pos", "all_neg",
        share(F.col("fp"), F.col("all_neg")).alias("fpr"), share(F.col("tp"), F.col("all_pos")).alias("tpr"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """Area under each class's curve by trapezoids: each step is as wide as its negatives and as
    high as the positives before it plus half of its own."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return roc_points(scores).groupBy("class").agg(
        (area / F.nullif(F.first("all_pos") * F.first("all_neg"), F.lit(0))).alias("auc"))


def pivot_metric(results: DataFrame, metric: str, settings: list[str], tests: list[str]) -> DataFrame:
    """Trained-on x Test table of one metric, rows in setting order."""
    place = F.array_position(F.array(*[F.lit(s) for s in settings]), F.col("trained_on")).cast("int")
    return (results.groupBy("trained_on").pivot("test", tests).agg(F.first(metric))
            .withColumn("position", place).orderBy("position"))


def seed_summary(results: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """Mean over the runs of one kind and seed, then mean and sample deviation over seeds, pivoted."""
    kind = (F.when(F.col("trained_on") == "all datasets", F.lit("all"))
            .when(F.col("trained_on") == F.concat(F.col("test"), F.lit(" only")), F.lit("within"))
            .otherwise(F.lit("across")))
    per_seed = results.groupBy("model", kind.alias("kind"), "seed").agg(F.avg(metric).alias("m"))
    return (per_seed.groupBy("model").pivot("kind", ["across", "all", "within"])
            .agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("std")))


def metric_ranges(results: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return results.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics
                                      for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])


def block_report(stream: DataFrame, detectors: list[str]) -> DataFrame:
    """Counts, false positives and detection of every detector per reporting block."""
    parts = []
    for d in detectors:
        det, fp = rate_columns(F.col(d))
        parts += [fp.alias(f"{d}_fp"), det.alias(f"{d}_detection")]
    return stream.groupBy("block").agg(
        F.count_if(F.col("label") == 0).alias("benign"), F.count_if(F.col("label") > 0).alias("attack"), *parts)


def unpivot_decisions(stream: DataFrame, detectors: list[str], keep: list[str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.col(d).alias("flagged")) for d in detectors]))
    return stream.select(*keep, pairs.alias("d")).select(*keep, "d.detector", "d.flagged")


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n")).withColumn("name", name_of(F.col(label), LABEL_NAMES))


def split_report(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count_if(~F.col("is_test")).alias("train"), F.count_if(F.col("is_test")).alias("test"),
        F.avg((F.col("label") > 0).cast("double")).alias("attack_share"))


def group_time_mean(blocks: DataFrame, metrics: list[str]) -> DataFrame:
    return blocks.groupBy("minutes").agg(*[F.avg(m).alias(m) for m in metrics])
