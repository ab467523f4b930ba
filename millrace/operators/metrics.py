"""Evaluation metrics over (truth, prediction, score) columns.

Label metrics come from confusion counts: one aggregate, then arithmetic over a
row for each pair of labels. Curves and AUC count rows for each distinct score
first and accumulate over scores.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import half_up, only_row
from millrace.operators.ranges import placed, quantiles, tallied

EPS = 1e-15
#: Primary metric and direction by kind of task.
PRIMARY = {"classification": ("accuracy", True), "binary": ("roc_auc", True), "regression": ("rmse", False)}
#: Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom (fixed values); beyond, the normal's.
T95 = [
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131,
    2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
]
Z95 = 1.960


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    return df.agg(half_up(F.avg((F.col(truth) == F.col(pred)).cast("double"))).alias("accuracy"), F.count("*").alias("n"))


def binary(df: DataFrame, truth: str, pred: str, positive=1) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1."""
    t, p = F.col(truth) == positive, F.col(pred) == positive
    tp, fp, fn, tn = F.count_if(t & p), F.count_if(~t & p), F.count_if(t & ~p), F.count_if(~t & ~p)
    c = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select(
        "tp", "fp", "fn", "tn", half_up(ratio(tp + tn, tp + fp + fn + tn)).alias("accuracy"), half_up(ratio(tp, tp + fp)).alias("precision"),
        half_up(ratio(tp, tp + fn)).alias("recall"), half_up(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def confusion(df: DataFrame, truth: str, pred: str, normalize: str | None = None) -> DataFrame:
    """(truth, pred, n, share): share of the truth's, the prediction's or all rows."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    by = {"true": ["truth"], "pred": ["pred"], "all": [], None: []}[normalize]
    return counts.withColumn("share", half_up(F.col("n") / F.sum("n").over(W.partitionBy(*by))))


def per_class(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(label, tp, support, predicted, precision, recall, f1) for labels of truths and predictions."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    sides = F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    ))
    c = counts.select(sides.alias("s")).groupBy("s.label").agg(*(F.sum(f"s.{x}").alias(x) for x in ("tp", "support", "predicted")))
    tp, support, predicted = map(F.col, ("tp", "support", "predicted"))
    return c.withColumns({"precision": ratio(tp, predicted), "recall": ratio(tp, support), "f1": ratio(2 * tp, support + predicted)})


def averages(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(average, precision, recall, f1): macro, micro and weighted by support."""
    c = per_class(df, truth, pred)
    weighted = lambda m: ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"))
    micro = (ratio(F.sum("tp"), F.sum("predicted")), ratio(F.sum("tp"), F.sum("support")), ratio(2 * F.sum("tp"), F.sum("support") + F.sum("predicted")))
    rows = [
        ("macro", *(F.avg(m) for m in ("precision", "recall", "f1"))),
        ("micro", *micro),
        ("weighted", *(weighted(m) for m in ("precision", "recall", "f1"))),
    ]
    made = F.array(*(F.struct(F.lit(n).alias("average"), half_up(p).alias("precision"), half_up(r).alias("recall"), half_up(f).alias("f1")) for n, p, r, f in rows))
    return c.agg(made.alias("rows")).select(F.inline("rows"))


def auc(df: DataFrame, positive: Column, score: Column, by: list[Column] = [], names: list[str] = []) -> DataFrame:
    """(by..., auc): the chance that a positive's score is above a negative's, ties counting half; rows without a truth don't count."""
    held = df.select(*by, score.alias("score"), positive.cast("long").alias("pos")).where("pos IS NOT NULL").withColumn("neg", 1 - F.col("pos"))
    won = tallied(held, "score", ["pos", "neg"], names).withColumn("wins", F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2))
    return won.groupBy(*names).agg(half_up(F.try_divide(F.sum("wins"), F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))


def one_against_rest(df: DataFrame, truth: str, classes: list, scores: list[str]) -> DataFrame:
    """(label, is, score): every row once for each class, with whether it is of that class; a null truth is of none."""
    each = (F.struct(F.lit(str(c)).alias("label"), F.coalesce(F.col(truth) == c, F.lit(False)).alias("is"), F.col(s).alias("score")) for c, s in zip(classes, scores, strict=True))
    return df.select(F.inline(F.array(*each)))


def _points_ovr(pairs: DataFrame) -> DataFrame:
    """(label, score, pos, neg) of each distinct score of a class, with sums from that score on (``tp``, ``fp``) and in all, of
    the class and of all classes (``any_``); ``first`` marks one row of each score.

    Both are accumulated in the same ranges of the score, so that the pairs are grouped once and dealt out once.
    """
    values = ["pos", "neg"]
    rows = placed(pairs.select("label", "score", F.col("is").cast("long").alias("pos"), (~F.col("is")).cast("long").alias("neg")), "score")
    total = [F.sum(v).alias(v) for v in values]
    own, below = W.partitionBy("label"), lambda w: w.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, 0)
    above = lambda of, w, name: (F.sum(of).over(below(w)) - F.col(of)).alias(name)
    sums = rows.groupBy("label", "_range").agg(*total)
    whole = sums.groupBy("_range").agg(*total)
    own_sums = sums.select(F.col("label").alias("_label"), F.col("_range").alias("_own_range"), *(x for v in values for x in (above(v, own, f"_own_{v}"), F.sum(v).over(own).alias(f"all_{v}"))))
    any_sums = whole.select(F.col("_range").alias("_any_range"), *(x for v in values for x in (above(v, W.partitionBy(), f"_any_{v}"), F.sum(v).over(W.partitionBy()).alias(f"any_all_{v}"))))
    # Ties share what is summed over all classes; within a class there are none.
    ties = W.partitionBy("_range").orderBy(F.desc("score"))
    counts = rows.groupBy("label", "_range", "score").agg(*total)
    upto = lambda w: w.rangeBetween(W.unboundedPreceding, W.currentRow)
    held = counts.withColumns({f"_any_in_{v}": F.sum(v).over(upto(ties)) for v in values} | {"first": F.row_number().over(ties) == F.rank().over(ties)})
    held = held.withColumns({f"_own_in_{v}": F.sum(v).over(upto(W.partitionBy("_range", "label").orderBy(F.desc("score")))) for v in values})
    held = held.join(F.broadcast(own_sums), (F.col("label") == F.col("_label")) & (F.col("_range") == F.col("_own_range"))).join(F.broadcast(any_sums), F.col("_range") == F.col("_any_range"))
    from_ = {f"{to}{name}": F.col(f"_{level}_{v}") + F.col(f"_{level}_in_{v}") for level, to in (("own", ""), ("any", "any_")) for v, name in (("pos", "tp"), ("neg", "fp"))}
    return held.withColumns(from_).select("label", "score", "pos", "neg", "first", *from_, *(f"{a}all_{v}" for a in ("", "any_") for v in values))


def auc_ovr(df: DataFrame, truth: str, classes: list, scores: list[str]) -> DataFrame:
    """Macro average of each class's AUC against the rest, and the micro one over all pairs."""
    points = _points_ovr(one_against_rest(df, truth, classes, scores))
    # Twice the wins: each positive against the negatives below its score, and against those at it or below.
    wins = lambda a: F.sum(F.col("pos") * (F.col(f"{a}all_neg") - F.col(f"{a}fp")).cast("double") + F.col("neg") * F.col(f"{a}tp").cast("double"))
    cells = lambda a: 2 * F.max(F.col(f"{a}all_pos").cast("double") * F.col(f"{a}all_neg"))
    each = points.groupBy("label").agg(half_up(F.try_divide(wins(""), cells(""))).alias("auc"), wins("any_").alias("wins"), cells("any_").alias("cells"))
    both = each.agg(half_up(F.avg("auc")).alias("macro"), half_up(F.try_divide(F.sum("wins"), F.max("cells"))).alias("micro"))
    return both.select(F.inline(F.array(*(F.struct(F.lit(n).alias("average"), F.col(n).alias("auc")) for n in ("macro", "micro")))))


def log_loss(df: DataFrame, positive: Column, score: Column, eps: float = EPS) -> DataFrame:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), score))
    return df.agg(half_up(-F.avg(F.log(F.when(positive, p).otherwise(1 - p)))).alias("log_loss"))


def agreement(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(kappa, mcc): Cohen's kappa and the multi-class correlation, from the confusion counts' margins."""
    c = per_class(df, truth, pred).agg(
        F.sum("tp").cast("double").alias("hit"), F.sum("support").cast("double").alias("n"), F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp_"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("tt"), F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
    )
    n, hit, tp, tt, pp = map(F.col, ("n", "hit", "tp_", "tt", "pp"))
    kappa = F.try_divide(hit / n - tp / (n * n), 1 - tp / (n * n))
    mcc = F.coalesce(F.try_divide(hit * n - tp, F.sqrt(n * n - pp) * F.sqrt(n * n - tt)), F.lit(0.0))
    return c.select(half_up(kappa).alias("kappa"), half_up(mcc).alias("mcc"))


def regression(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: mae, mse, rmse, r2, mape (percent, rows with truth 0 left out), median_ae, explained_variance."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    d = y - p
    total = F.var_pop(y) * F.count(y)
    middle = only_row(quantiles(df.select(F.abs(d).alias("error")), ["error"], [0.5]))["error"][0]
    return df.agg(
        half_up(F.avg(F.abs(d))).alias("mae"), half_up(F.avg(d * d)).alias("mse"), half_up(F.sqrt(F.avg(d * d))).alias("rmse"),
        half_up(1 - F.try_divide(F.sum(d * d), total)).alias("r2"),
        half_up(F.coalesce(100 * F.avg(F.when(y != 0, F.abs(d / F.nullif(y, F.lit(0.0))))), F.lit(float("inf")))).alias("mape"),
        half_up(1 - F.try_divide(F.var_pop(d), F.var_pop(y))).alias("explained_variance"),
    ).select("mae", "mse", "rmse", "r2", "mape", half_up(middle).alias("median_ae"), "explained_variance")


def losses(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Trainer variants: accuracy of score > 0.5, mse, mae, binary cross-entropy."""
    y, p = F.col(truth).cast("double"), F.col(score)
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return df.agg(
        half_up(F.avg(((p > 0.5).cast("int") == F.col(truth)).cast("double"))).alias("accuracy"), half_up(F.avg((y - p) * (y - p))).alias("mse"),
        half_up(F.avg(F.abs(y - p))).alias("mae"), half_up(-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("bce"),
    )


def _from_highest(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """Each distinct score with the positives and negatives at it (``pos``, ``neg``), from it on (``tp``, ``fp``) and in all; without a truth a row is negative."""
    held = df.select(score.alias("score"), F.coalesce(positive.cast("long"), F.lit(0)).alias("pos")).withColumn("neg", 1 - F.col("pos"))
    from_ = lambda v: F.col(f"all_{v}") - F.col(f"upto_{v}") + F.col(v)
    return tallied(held, "score", ["pos", "neg"]).withColumns({"tp": from_("pos"), "fp": from_("neg")})


def roc_curve(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """(threshold, tpr, fpr) for every distinct score, from the highest."""
    rate = lambda a, b: half_up(F.try_divide(F.col(a), F.col(b)))
    return _from_highest(df, positive, score).select(F.col("score").alias("threshold"), rate("tp", "all_pos").alias("tpr"), rate("fp", "all_neg").alias("fpr"))


def roc_curve_ovr(df: DataFrame, truth: str, classes: list, scores: list[str]) -> DataFrame:
    """(label, threshold, tpr, fpr): the curve of each class against the rest, and ``micro`` over all pairs of row and class."""
    points = _points_ovr(one_against_rest(df, truth, classes, scores))
    # Rates are rounded after the rows are doubled: a filter that is inferred before it would round them once more.
    sums = ("tp", "fp", "all_pos", "all_neg")
    point = lambda label, held, a: F.struct(label.alias("label"), F.col("score").alias("threshold"), held.alias("held"), *(F.col(f"{a}{v}").alias(v) for v in sums))
    both = points.select(F.inline(F.array(point(F.col("label"), F.lit(True), ""), point(F.lit("micro"), F.col("first"), "any_")))).where("held")
    rate = lambda a, b: half_up(F.try_divide(F.col(a), F.col(b)))
    return both.select("label", "threshold", rate("tp", "all_pos").alias("tpr"), rate("fp", "all_neg").alias("fpr"))


def by_fold(df: DataFrame, task: str, truth: str, pred: str, fold: str = "fold") -> DataFrame:
    """(fold, metric, value) in one pass over all folds; classes are weighted by support, rows without truth or prediction don't count."""
    y, p = F.col(truth), F.col(pred)
    seen = df.where(y.isNotNull() & p.isNotNull()).withColumn("_f", F.col(fold))
    if task == "regression":
        gap = y - p
        wide = seen.groupBy(F.col("_f").alias("fold")).agg(
            F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mae"),
            (1 - F.try_divide(F.avg(gap * gap), F.var_pop(y))).alias("r2"),
        )
        names = ["rmse", "mae", "r2"]
    else:
        cells = seen.groupBy("_f", y.alias("y"), p.alias("p")).agg(F.count("*").alias("n"))
        sides = F.array(
            F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hit")),
        )
        each = cells.select("_f", F.inline(sides)).groupBy("_f", "c").agg(*(F.sum(v).alias(v) for v in ("support", "predicted", "hit")))
        precision, recall = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("support"))
        f1 = ratio(2.0 * F.col("hit"), F.col("predicted") + F.col("support"))
        mean = lambda v: F.sum(v * F.col("support")) / F.sum("support")
        wide = each.groupBy(F.col("_f").alias("fold")).agg((F.sum("hit") / F.sum("support")).alias("accuracy"), mean(precision).alias("precision"), mean(recall).alias("recall"), mean(f1).alias("f1"))
        names = ["accuracy", "precision", "recall", "f1"]
    return wide.select("fold", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names))))


def pr_curve(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """(threshold, precision, recall, step) for every distinct score; the steps add up to the average precision."""
    points = _from_highest(df, positive, score)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("all_pos"))
    gain = recall - ratio(F.col("tp") - F.col("pos"), F.col("all_pos"))
    return points.select(F.col("score").alias("threshold"), half_up(precision).alias("precision"), half_up(recall).alias("recall"), half_up(gain * precision, 9).alias("step"))


def cv_summary(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """(metric, mean, std, low, high, min, max, median, n): sample deviation and 95 % Student interval over folds."""
    c = df.groupBy(F.col(metric).alias("metric")).agg(
        F.avg(value).alias("m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"),
        F.percentile(value, F.lit(0.5)).alias("mid"), F.count(value).alias("n"),
    )
    t = F.when(F.col("n") > 1, F.coalesce(F.get(F.array(*map(F.lit, T95)), (F.col("n") - 2).cast("int")), F.lit(Z95))).otherwise(0.0)
    half = t * F.col("s") / F.sqrt("n")
    return c.select("metric", half_up(F.col("m")).alias("mean"), half_up(F.col("s")).alias("std"), half_up(F.col("m") - half).alias("low"), half_up(F.col("m") + half).alias("high"), half_up(F.col("lo")).alias("min"), half_up(F.col("hi")).alias("max"), half_up(F.col("mid")).alias("median"), "n")


def rank_models(df: DataFrame, model: str, value: str, higher_is_better: bool) -> DataFrame:
    """(model, value, rank) by the primary metric in its direction."""
    order = F.desc(value) if higher_is_better else F.asc(value)
    return df.select(F.col(model).alias("model"), F.col(value).alias("value"), F.rank().over(W.orderBy(order)).cast("long").alias("rank"))


def best_epoch(df: DataFrame, epoch: str, value: str, by: str, lower_is_better: bool = True) -> DataFrame:
    """(metric, epoch, value): the first epoch with the best value."""
    sign = F.col(value) if lower_is_better else -F.col(value)
    return df.groupBy(F.col(by).alias("metric")).agg(F.min_by(F.struct(F.col(epoch).alias("epoch"), F.col(value).alias("value")), F.struct(sign, F.col(epoch))).alias("b")).select("metric", "b.epoch", "b.value")


def history_summary(df: DataFrame, epoch: str, value: str, by: str, higher: list[str]) -> DataFrame:
    """(metric, final, best): best is the most for ``higher`` metrics, else the least; zeros of val_loss don't count."""
    counted = df.where((F.col(by) != "val_loss") | (F.col(value) != 0))
    best = F.when(F.first(by).isin(higher), F.max(value)).otherwise(F.min(value))
    return counted.groupBy(F.col(by).alias("metric")).agg(F.max_by(value, epoch).alias("final"), best.alias("best"))


def aligned(truths: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(matched, only_truth, only_prediction): whether two tables hold the same keys."""
    t, p = truths.select(key).withColumn("_t", F.lit(1)), predictions.select(key).withColumn("_p", F.lit(1))
    both = t.join(p, key, "full_outer")
    return both.agg(F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("matched"), F.count_if(F.col("_p").isNull()).alias("only_truth"), F.count_if(F.col("_t").isNull()).alias("only_prediction"))


def consistent(a: DataFrame, b: DataFrame, key: str, value: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """(n, n_close, worst, passed) of two outputs joined on their key: |a - b| <= atol + rtol * |b|."""
    joined = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    gap = F.abs(F.col("x") - F.col("y"))
    close = F.count_if(gap <= atol + rtol * F.abs("y"))
    return joined.agg(F.count("*").alias("n"), close.alias("n_close"), half_up(F.max(gap), 9).alias("worst"), (close == F.count(F.lit(1))).alias("passed"))


def for_task(task: str) -> list[tuple[str, bool]]:
    """The metrics of a task with their directions (True: higher is better), the primary one first."""
    if task == "regression":
        return [("rmse", False), ("mae", False), ("mse", False), ("r2", True), ("mape", False), ("median_ae", False), ("explained_variance", True)]
    return [("accuracy", True), ("precision", True), ("recall", True), ("f1", True)]


#: Metrics of one's own: name to (aggregate of truth and prediction, whether higher is better).
CUSTOM: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {}


def register(name: str, build: Callable[[Column, Column], Column], higher_is_better: bool = True) -> None:
    """Adds a metric: ``build(truth, prediction)`` is an aggregate expression over the rows. A name that a task has is refused."""
    if name in {m for task in ("regression", "classification") for m, _ in for_task(task)}:
        raise ValueError(f"{name!r} is a metric of a task")
    CUSTOM[name] = (build, higher_is_better)


def unregister(name: str) -> None:
    CUSTOM.pop(name, None)


def custom(df: DataFrame, truth: str, pred: str, names: list[str]) -> DataFrame:
    """(metric, value, higher_is_better, is_primary) of registered metrics, all from one pass over the rows."""
    if unknown := [n for n in names if n not in CUSTOM]:
        raise ValueError(f"no metric {unknown}")
    made = F.array(*(F.struct(F.lit(n).alias("metric"), half_up(CUSTOM[n][0](F.col(truth), F.col(pred))).alias("value"), F.lit(CUSTOM[n][1]).alias("higher_is_better"), F.lit(False).alias("is_primary")) for n in names))
    return df.agg(made.alias("all")).select(F.inline("all"))


def timed(predict: Callable[[DataFrame], DataFrame], df: DataFrame) -> DataFrame:
    """(n, seconds, rows_per_second) of a prediction over all rows, which are made and dropped."""
    began = time.perf_counter()
    n = predict(df).agg(F.count("*").alias("n"), F.max(F.xxhash64("*")).alias("h")).first()["n"]  # the hash reads every column
    took = time.perf_counter() - began
    return df.sparkSession.createDataFrame([(n, took, n / took)], "n long, seconds double, rows_per_second double")


def evaluate(df: DataFrame, task: str, truth: str, pred: str, also: list[str] = []) -> DataFrame:
    """(metric, value, higher_is_better, is_primary) of a task; classes are weighted by support. ``also`` names registered metrics."""
    out = _of_task(df, task, truth, pred)
    return out.unionAll(custom(df, truth, pred, also)) if also else out


def _of_task(df: DataFrame, task: str, truth: str, pred: str) -> DataFrame:
    if task == "regression":
        wide = regression(df, truth, pred)
    else:
        scores = averages(df, truth, pred).where("average = 'weighted'")
        wide = scores.select(only_row(accuracy(df, truth, pred))["accuracy"].alias("accuracy"), "precision", "recall", "f1")
    names = for_task(task)
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(up).alias("higher_is_better"), F.lit(n == 0).alias("is_primary")) for n, (m, up) in enumerate(names)))
    return wide.select(F.inline(rows))
