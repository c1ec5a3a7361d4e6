"""Evaluation: confusion counts, class and instance metrics, chunk reconciliation, class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and IoU of each class with support or predictions; a zero divisor gives 0."""
    long = confusion(rows)
    sides = long.select(F.explode(F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")))).alias("r")).select("r.*")
    t = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("tp"))
    ratio = lambda a, b: F.bround(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    tp, s, p = F.col("tp"), F.col("support"), F.col("predicted")
    return t.select("label", "support", "predicted", "tp", ratio(tp, p).alias("precision"), ratio(tp, s).alias("recall"), ratio(2 * tp, s + p).alias("f1"), ratio(tp, s + p - tp).alias("iou"))


def overall_metrics(rows: DataFrame) -> DataFrame:
    """Accuracy over all rows and macro means over classes with support or predictions."""
    m = class_metrics(rows)
    return m.agg(F.bround(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.bround(F.avg("f1"), 6).alias("macro_f1"), F.bround(F.avg("iou"), 6).alias("mean_iou"))


def instance_iou(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows point_id, object_id of both sides: shared points and IoU of each pair that shares any."""
    t, p = truth.select("point_id", F.col("object_id").alias("gt")), predicted.select("point_id", F.col("object_id").alias("pred"))
    both = t.join(p, "point_id").groupBy("gt", "pred").agg(F.count("*").alias("shared"))
    nt, np_ = t.groupBy("gt").agg(F.count("*").alias("nt")), p.groupBy("pred").agg(F.count("*").alias("np"))
    return both.join(nt, "gt").join(np_, "pred").select("gt", "pred", "shared", F.bround(F.col("shared") / (F.col("nt") + F.col("np") - F.col("shared")), 6).alias("iou"), "nt", "np")


def instance_metrics(pairs: DataFrame, n_truth: DataFrame, least: float = 0.30) -> DataFrame:
    """Of the true objects: how many a proposal recalls, how many have several such, how many are split up."""
    good = pairs.groupBy("gt").agg(F.count_if(F.col("iou") >= least).alias("good"), F.count_if((F.col("shared") >= 0.15 * F.col("nt")) & (F.col("shared") >= 10)).alias("parts"))
    all_ = n_truth.select(F.col("object_id").alias("gt")).distinct().join(good, "gt", "left")
    return all_.agg(F.count("*").alias("n"), F.count_if(F.col("good") >= 1).alias("recalled"), F.count_if(F.col("good") > 1).alias("duplicated"), F.count_if(F.col("parts") >= 2).alias("fragmented"))


def reconciled(votes: DataFrame) -> DataFrame:
    """Rows point_id, label, p from overlapping chunks: the class with the largest mean, the first of equals."""
    mean = votes.groupBy("point_id", "label").agg(F.bround(F.avg("p"), 6).alias("p"))
    return mean.groupBy("point_id").agg(F.max(F.struct(F.col("p"), (-F.col("label")).alias("l"))).alias("m")).select("point_id", (-F.col("m.l")).alias("label"), F.col("m.p").alias("p"))


def class_weights(rows: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Smoothed inverse frequencies, mean 1 over classes."""
    n = rows.groupBy(F.col("y_true").alias("label")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    return n.crossJoin(F.broadcast(total)).select("label", "n", F.bround((F.col("t") + smoothing * F.col("k")) / (F.col("k") * (F.col("n") + smoothing)), 6).alias("weight"))
