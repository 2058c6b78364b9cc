"""Classification, ranking and threshold metrics as aggregates; ratios with an empty denominator are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import running


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def spine(df: DataFrame, name: str, labels: tuple[str, ...]) -> DataFrame:
    return df.sparkSession.createDataFrame([(x,) for x in labels], f"{name} string")


def distribution(df: DataFrame, label: Column, labels: tuple[str, ...] | None = None) -> DataFrame:
    """(label, n); over a fixed list of labels with zeros."""
    got = df.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        return got
    return F.broadcast(spine(df, "label", labels)).join(got, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def class_weights(df: DataFrame, label: str, labels: tuple[str, ...]) -> DataFrame:
    """N / (C * n) for each class; a class without rows stops the query."""
    counts = distribution(df.where(F.col(label).isin(*labels)), F.col(label), labels)
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("label", F.when(F.col("n") == 0, F.raise_error(F.lit("a class has no rows")).cast("double")).otherwise(total / (len(labels) * F.col("n"))).alias("weight"))


def confusion(df: DataFrame, gold: str, pred: str, labels: tuple[str, ...]) -> DataFrame:
    """(gold, pred, n) for every pair of labels."""
    got = df.groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    cells = df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "gold string, pred string")
    return F.broadcast(cells).join(got, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """Confusion cells -> (label, precision, recall, f1, support)."""
    flat = cells.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("x")).select("x.*")
    per = flat.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("g").alias("support"), F.sum("p").alias("predicted"))
    return per.select("label", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def macro(cells: DataFrame) -> DataFrame:
    """(accuracy, macro_precision, macro_recall, macro_f1) over all declared classes."""
    m = per_class(cells).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return cells.agg(ratio(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy")).crossJoin(F.broadcast(m))


def _cells(gt: Column, yes: Column, valid: Column) -> list[Column]:
    n = lambda c: F.count_if(F.coalesce(valid & c, F.lit(False)))
    return [n((gt == "true") & yes).alias("tp"), n((gt == "not_true") & ~yes).alias("tn"), n((gt == "not_true") & yes).alias("fp"), n((gt == "true") & ~yes).alias("fn")]


def _rates(df: DataFrame, *keep: str) -> DataFrame:
    tp, tn, fp, fn = map(F.col, ("tp", "tn", "fp", "fn"))
    return df.select(*keep, "total", "valid", ratio(F.col("valid"), F.col("total")).alias("json_success"), ratio(tp + tn, F.col("valid")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "tp", "tn", "fp", "fn")


def binary_metrics(df: DataFrame) -> DataFrame:
    """df (gt, pred, valid) -> one row; an unknown gt counts in the accuracy's denominator."""
    valid = F.coalesce(F.col("valid"), F.lit(False))
    got = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), *[c for c in _cells(F.col("gt"), F.col("pred") == "true", valid & F.col("pred").isin("true", "not_true"))])
    return _rates(got)


def sweep(df: DataFrame, thresholds: list[float]) -> DataFrame:
    """df (gt, prob) -> metrics at each threshold, prob >= threshold counting as true. Rows are first counted by the
    last threshold that they reach, so the table is read once and not multiplied."""
    steps = F.array(*map(F.lit, thresholds))
    reached = F.size(F.filter(steps, lambda t: F.col("prob") >= t))
    by = df.groupBy(reached.alias("k"), F.col("prob").isNotNull().alias("ok"), "gt").agg(F.count(F.lit(1)).alias("n"))
    by = by.select("gt", "n", "ok", F.posexplode(F.transform(steps, lambda t, i: F.struct(t.alias("threshold"), (F.col("k") > i).alias("yes")))).alias("i", "x")).select("gt", "n", "ok", "x.*")
    some = lambda c: F.sum(F.when(F.col("ok") & c, F.col("n")).otherwise(0))
    yes = F.col("yes")
    got = by.groupBy("threshold").agg(F.sum("n").alias("total"), some(F.lit(True)).alias("valid"), some((F.col("gt") == "true") & yes).alias("tp"), some((F.col("gt") == "not_true") & ~yes).alias("tn"), some((F.col("gt") == "not_true") & yes).alias("fp"), some((F.col("gt") == "true") & ~yes).alias("fn"))
    return _rates(got, "threshold")


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold of the highest F1, the lowest of equal ones."""
    return swept.orderBy(F.desc("f1"), "threshold").limit(1)


def _by_score(df: DataFrame) -> DataFrame:
    """df (y, score) -> positives and negatives by distinct score."""
    return df.groupBy("score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


def roc_auc(df: DataFrame) -> DataFrame:
    """df (y: 0 or 1, score) -> roc_auc, ties counting half; null if one class is missing."""
    s = running(_by_score(df), ["score"], {"upto": "neg"}).withColumn("under", F.col("upto") - F.col("neg"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return s.agg((F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2.0)) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def average_precision(df: DataFrame) -> DataFrame:
    """df (y, score) -> the step-wise area under precision and recall; null if one class is missing."""
    s = running(_by_score(df).withColumn("every", F.col("pos") + F.col("neg")), [F.desc("score")], {"tp": "pos", "n": "every"})
    area = F.sum(F.col("pos") * F.col("tp").cast("double") / F.col("n")) / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))
    return s.agg(F.when(F.sum("neg") > 0, area).alias("average_precision"))


def series(df: DataFrame, history: str, splits: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with an array of epochs (epoch, one struct of metrics a split) -> (epoch, split, metric, value), a row each."""
    each = df.select(F.explode(history).alias("_e"))
    parts = [F.struct(F.lit(s).alias("split"), F.lit(m).alias("metric"), F.col(f"_e.{s}.{m}").cast("double").alias("value")) for s, ms in splits.items() for m in ms]
    return each.select(F.col("_e.epoch").cast("long").alias("epoch"), F.inline(F.array(*parts)))


def grains(df: DataFrame, sets: list[list[str]], columns: list[str], *measures: Column) -> DataFrame:
    """Measures at several grains in one pass (an extension): (grain, *columns, measures), a row for each group of each of
    the sets of columns; grain has a bit for each column, the first the highest, set where the column is not grouped by."""
    return df.groupingSets([[F.col(c) for c in one] for one in sets], *[F.col(c) for c in columns]).agg(F.grouping_id().alias("grain"), *measures).select("grain", *columns, *[F.col(c) for c in _names(df, measures)])


def _names(df: DataFrame, measures: tuple[Column, ...]) -> list[str]:
    return df.groupBy().agg(*measures).columns
