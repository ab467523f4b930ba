"""Queries for metrics, curves, ensembles and comparisons, on predictions made by hashing keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import half_up, hash_unit
from millrace.operators import ensemble, metrics
from millrace.plans.registry import query


def unit_sql(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


#: Truths, scores and predictions of labelled documents.
PREDICTED = f"p AS (SELECT doc_id, quality AS y, {unit_sql('', 'doc_id')} AS s, CAST({unit_sql('', 'doc_id')} > 0.5 AS INTEGER) AS yhat FROM labels)"
#: Three classes: the truth is an order's status, the prediction mostly so.
MULTI = f"m AS (SELECT o_orderkey, o_orderstatus AS y, CASE WHEN {unit_sql('', 'o_orderkey')} < 0.7 THEN o_orderstatus WHEN {unit_sql('', 'o_orderkey')} < 0.85 THEN 'F' ELSE 'O' END AS yhat FROM orders)"


def predicted(t):
    s = hash_unit(F.col("doc_id"), "")
    return t("labels").select("doc_id", F.col("quality").alias("y"), s.alias("s"), (s > 0.5).cast("int").alias("yhat"))


def multi(t):
    s = hash_unit(F.col("o_orderkey"), "")
    return t("orders").select("o_orderkey", F.col("o_orderstatus").alias("y"), F.when(s < 0.7, F.col("o_orderstatus")).when(s < 0.85, "F").otherwise("O").alias("yhat"))


@query("metric_accuracy", f"WITH {PREDICTED} SELECT round(avg(CAST(y = yhat AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM p")
def _(t):
    return metrics.accuracy(predicted(t), "y", "yhat")


@query("metric_prf_binary", f"WITH {PREDICTED}, c AS (SELECT count(*) FILTER (y = 1 AND yhat = 1) AS tp, count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 0 AND yhat = 0) AS tn FROM p) SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(t):
    return metrics.binary(predicted(t), "y", "yhat")


PER_CLASS = f"{MULTI}, l AS (SELECT y AS label FROM m UNION SELECT yhat FROM m), c AS (SELECT label, (SELECT count(*) FROM m WHERE y = label AND yhat = label) AS tp, (SELECT count(*) FROM m WHERE y = label) AS support, (SELECT count(*) FROM m WHERE yhat = label) AS predicted FROM l), r AS (SELECT *, coalesce(tp::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0) AS f1 FROM c)"


@query("metric_per_class", f"WITH {PER_CLASS} SELECT label, tp::BIGINT AS tp, support::BIGINT AS support, predicted::BIGINT AS predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM r")
def _(t):
    out = metrics.per_class(multi(t), "y", "yhat")
    return out.select("label", "tp", "support", "predicted", *(half_up(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


NAMES = ("precision", "recall", "f1")


@query("metric_prf_averages", f"WITH {PER_CLASS} SELECT 'macro' AS average, " + ", ".join(f"round(avg({n}), 6) AS {n}" for n in NAMES) + " FROM r UNION ALL SELECT 'weighted', " + ", ".join(f"round(sum({n} * support) / sum(support), 6)" for n in NAMES) + " FROM r UNION ALL SELECT 'micro', round(sum(tp)::DOUBLE / sum(predicted), 6), round(sum(tp)::DOUBLE / sum(support), 6), round(2.0::DOUBLE * sum(tp) / (sum(support) + sum(predicted)), 6) FROM r")
def _(t):
    return metrics.averages(multi(t), "y", "yhat")


AUC = "(SELECT round((sum(rk) FILTER ({y}) - count(*) FILTER ({y}) * (count(*) FILTER ({y}) + 1) / 2.0::DOUBLE) / (count(*) FILTER ({y})::DOUBLE * count(*) FILTER (NOT ({y}))), 6) AS auc FROM (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM {table}))"


@query("metric_auc_binary", f"WITH {PREDICTED} SELECT * FROM " + AUC.format(y="y = 1", table="p"))
def _(t):
    return metrics.auc(predicted(t), F.col("y") == 1, F.col("s"))


OVR = "o AS (SELECT o_orderstatus AS y, " + ", ".join(f"{unit_sql(c + ':', 'o_orderkey')} AS s{n}" for n, c in enumerate("FOP")) + " FROM orders), x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS label, y = '{c}' AS y, s{n} AS s FROM o" for n, c in enumerate("FOP")) + ")"


def scored(t):
    """Each order's status and a score for each of three statuses."""
    return t("orders").select(F.col("o_orderstatus").alias("y"), *(hash_unit(F.col("o_orderkey"), f"{c}:").alias(f"s{n}") for n, c in enumerate("FOP")))


@query("metric_auc_ovr", f"WITH {OVR} SELECT 'macro' AS average, round(avg(auc), 6) AS auc FROM (" + " UNION ALL ".join("SELECT * FROM " + AUC.format(y="y", table=f"x WHERE label = '{c}'") for c in "FOP") + ") UNION ALL SELECT 'micro', auc FROM " + AUC.format(y="y", table="x"))
def _(t):
    return metrics.auc_ovr(scored(t), "y", list("FOP"), ["s0", "s1", "s2"])


CLIPPED = "greatest(1e-15, least(1 - 1e-15, s))"


@query("metric_logloss", f"WITH {PREDICTED} SELECT round(-avg(CASE WHEN y = 1 THEN ln({CLIPPED}) ELSE ln(1 - {CLIPPED}) END), 6) AS log_loss FROM p")
def _(t):
    return metrics.log_loss(predicted(t), F.col("y") == 1, F.col("s"))


@query("metric_losses", f"WITH {PREDICTED} SELECT round(avg(CAST(yhat = y AS DOUBLE)), 6) AS accuracy, round(avg((y - s) * (y - s)), 6) AS mse, round(avg(abs(y - s)), 6) AS mae, round(-avg(y * ln({CLIPPED}) + (1 - y) * ln(1 - {CLIPPED})), 6) AS bce FROM p")
def _(t):
    return metrics.losses(predicted(t), "y", "s")


@query("metric_kappa_mcc", f"WITH {PER_CLASS}, a AS (SELECT sum(tp)::DOUBLE AS c, sum(support)::DOUBLE AS n, sum(support::DOUBLE * predicted) AS tp, sum(support::DOUBLE * support) AS tt, sum(predicted::DOUBLE * predicted) AS pp FROM r) SELECT round((c / n - tp / (n * n)) / (1 - tp / (n * n)), 6) AS kappa, round((c * n - tp) / (sqrt(n * n - pp) * sqrt(n * n - tt)), 6) AS mcc FROM a")
def _(t):
    return metrics.agreement(multi(t), "y", "yhat")


@query("metric_regression", f"WITH r AS (SELECT CASE WHEN event_id % 100 = 0 THEN 0 ELSE value END AS y, value * (0.8 + 0.4 * {unit_sql('', 'event_id')}) AS p FROM events), d AS (SELECT y, p, y - p AS d FROM r) SELECT round(avg(abs(d)), 6) AS mae, round(avg(d * d), 6) AS mse, round(sqrt(avg(d * d)), 6) AS rmse, round(1 - sum(d * d) / (var_pop(y) * count(y)), 6) AS r2, round(100 * avg(abs(d / y)) FILTER (y <> 0), 6) AS mape, round(quantile_cont(abs(d), 0.5), 6) AS median_ae, round(1 - var_pop(d) / var_pop(y), 6) AS explained_variance FROM d")
def _(t):
    e = t("events").select(F.expr("CASE WHEN event_id % 100 = 0 THEN 0 ELSE value END").alias("y"), (F.col("value") * (0.8 + 0.4 * hash_unit(F.col("event_id"), ""))).alias("p"))
    return metrics.regression(e, "y", "p")


def confusion_sql(over: str) -> str:
    return f"WITH {MULTI} SELECT y AS truth, yhat AS pred, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER ({over}), 6) AS share FROM m GROUP BY y, yhat"


@query("confusion_matrix", confusion_sql("PARTITION BY y"))
def _(t):
    return metrics.confusion(multi(t), "y", "yhat", "true")


@query("confusion_matrix_pred", confusion_sql("PARTITION BY yhat"))
def _(t):
    return metrics.confusion(multi(t), "y", "yhat", "pred")


@query("confusion_matrix_all", confusion_sql(""))
def _(t):
    return metrics.confusion(multi(t), "y", "yhat", "all")


CURVE = f"WITH {PREDICTED}, c AS (SELECT s, count(*) AS n, count(*) FILTER (y = 1) AS pos FROM p GROUP BY 1), k AS (SELECT s, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER () AS allp, sum(n - pos) OVER () AS alln FROM c WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))"


@query("roc_curve", CURVE + " SELECT s AS threshold, round(tp::DOUBLE / allp, 6) AS tpr, round(fp::DOUBLE / alln, 6) AS fpr FROM k")
def _(t):
    return metrics.roc_curve(predicted(t), F.col("y") == 1, F.col("s"))


@query("pr_curve", CURVE + ", q AS (SELECT s, tp::DOUBLE / (tp + fp) AS precision, tp::DOUBLE / allp AS recall FROM k) SELECT s AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round((recall - coalesce(lag(recall) OVER (ORDER BY s DESC), 0)) * precision, 9) AS step FROM q")
def _(t):
    return metrics.pr_curve(predicted(t), F.col("y") == 1, F.col("s"))


@query("roc_curve_ovr", f"WITH {OVR}, b AS (SELECT * FROM x UNION ALL SELECT 'micro', y, s FROM x), c AS (SELECT label, s, count(*) AS n, count(*) FILTER (y) AS pos FROM b GROUP BY label, s), k AS (SELECT label, s, sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY label) AS allp, sum(n - pos) OVER (PARTITION BY label) AS alln FROM c WINDOW w AS (PARTITION BY label ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) SELECT label, s AS threshold, round(tp::DOUBLE / nullif(allp, 0), 6) AS tpr, round(fp::DOUBLE / nullif(alln, 0), 6) AS fpr FROM k")
def _(t):
    return metrics.roc_curve_ovr(scored(t), "y", list("FOP"), ["s0", "s1", "s2"])


FOLDED = "f AS (SELECT event_type AS metric, user_id % 5 AS fold, avg(value) AS value FROM events GROUP BY 1, 2)"


def folded(t):
    return t("events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 5).alias("fold")).agg(F.avg("value").alias("value"))


@query("cv_summary", f"WITH {FOLDED}, s AS (SELECT metric, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS mid, count(*) AS n FROM f GROUP BY metric) SELECT metric, round(m, 6) AS mean, round(s, 6) AS std, round(m - 2.776 * s / sqrt(n), 6) AS low, round(m + 2.776 * s / sqrt(n), 6) AS high, round(lo, 6) AS min, round(hi, 6) AS max, round(mid, 6) AS median, n FROM s")
def _(t):
    return metrics.cv_summary(folded(t))


@query("model_ranking", "WITH v AS (SELECT event_type AS model, round(avg(value), 6) AS value FROM events GROUP BY event_type) SELECT model, value, rank() OVER (ORDER BY value DESC) AS rank FROM v")
def _(t):
    v = t("events").groupBy(F.col("event_type").alias("model")).agg(half_up(F.avg("value")).alias("value"))
    return metrics.rank_models(v, "model", "value", True)


EPOCHS = "h AS (SELECT event_type AS metric, (user_id % 10)::INTEGER AS epoch, round(avg(value), 2) AS value FROM events GROUP BY 1, 2)"


def epochs(t):
    return t("events").groupBy(F.col("event_type").alias("metric"), (F.col("user_id") % 10).cast("int").alias("epoch")).agg(F.round(F.avg("value"), 2).alias("value"))


@query("best_epoch", f"WITH {EPOCHS} SELECT metric, epoch, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, epoch) AS r FROM h) WHERE r = 1")
def _(t):
    return metrics.best_epoch(epochs(t), "epoch", "value", "metric")


@query("history_summary", f"WITH {EPOCHS} SELECT metric, arg_max(value, epoch) AS final, CASE WHEN metric = 'click' THEN max(value) ELSE min(value) END AS best FROM h GROUP BY metric")
def _(t):
    return metrics.history_summary(epochs(t), "epoch", "value", "metric", ["click"])


@query("truth_alignment", "SELECT count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS matched, count(*) FILTER (d.doc_id IS NULL) AS only_truth, count(*) FILTER (l.doc_id IS NULL) AS only_prediction FROM labels l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d ON l.doc_id = d.doc_id")
def _(t):
    return metrics.aligned(t("labels"), t("documents").where("doc_id % 3 <> 0"), "doc_id")


@query("export_consistency", "WITH j AS (SELECT value AS x, CASE WHEN event_id % 1000 = 0 THEN value + 0.01 ELSE value * (1 + 1e-7) END AS y FROM events) SELECT count(*) AS n, count(*) FILTER (abs(x - y) <= 1e-8 + 1e-5 * abs(y)) AS n_close, round(max(abs(x - y)), 9) AS worst, count(*) FILTER (abs(x - y) <= 1e-8 + 1e-5 * abs(y)) = count(*) AS passed FROM j")
def _(t):
    a = t("events").select("event_id", "value")
    b = t("events").select("event_id", F.expr("CASE WHEN event_id % 1000 = 0 THEN value + 0.01D ELSE value * (1 + 1e-7) END").alias("value"))
    return metrics.consistent(a, b, "event_id", "value")


MULTI_WEIGHTED = f"WITH {PER_CLASS}, w AS (SELECT (SELECT round(avg(CAST(y = yhat AS DOUBLE)), 6) FROM m) AS accuracy, " + ", ".join(f"round(sum({n} * support) / sum(support), 6) AS {n}" for n in NAMES) + " FROM r)"


@query("metric_table", MULTI_WEIGHTED + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value, {str(up).lower()} AS higher_is_better, {str(n == 0).lower()} AS is_primary FROM w" for n, (m, up) in enumerate(metrics.for_task("classification"))))
def _(t):
    return metrics.evaluate(multi(t), "classification", "y", "yhat")


# Ensembles

VOTERS = ("a:", "b:", "c:")
VOTES = "v AS (" + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS model, {n + 1}.0::DOUBLE AS w, {unit_sql(s, 'doc_id')} AS p, CAST({unit_sql(s, 'doc_id')} > 0.5 AS INTEGER) AS vote FROM labels" for n, s in enumerate(VOTERS)) + ")"


def votes(t):
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("model"), F.lit(n + 1.0).alias("w"), hash_unit(F.col("doc_id"), s).alias("p")) for n, s in enumerate(VOTERS))))
    return t("labels").select("doc_id", rows.alias("r")).select("doc_id", "r.*").withColumn("vote", (F.col("p") > 0.5).cast("int"))


@query("vote_hard", f"WITH {VOTES}, c AS (SELECT doc_id, vote, count(*) AS support FROM v GROUP BY doc_id, vote) SELECT doc_id, vote, support FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY support DESC, vote) AS r FROM c) WHERE r = 1")
def _(t):
    return ensemble.hard_vote(votes(t), "doc_id", "vote")


@query("vote_hard_weighted", f"WITH {VOTES}, c AS (SELECT doc_id, vote, sum(w) AS support FROM v GROUP BY doc_id, vote) SELECT doc_id, vote, support FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY support DESC, vote) AS r FROM c) WHERE r = 1")
def _(t):
    return ensemble.hard_vote(votes(t), "doc_id", "vote", "w")


SOFT = f"WITH {VOTES}, l AS (SELECT doc_id, w, 1 AS label, p FROM v UNION ALL SELECT doc_id, w, 0, 1 - p FROM v), c AS (SELECT doc_id, label, round({{mean}}, 6) AS probability FROM l GROUP BY doc_id, label) SELECT doc_id, label, probability FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC, label) AS r FROM c) WHERE r = 1"


def soft(t):
    both = F.explode(F.array(F.struct(F.lit(1).alias("label"), F.col("p").alias("q")), F.struct(F.lit(0).alias("label"), (1 - F.col("p")).alias("q"))))
    return votes(t).select("doc_id", "w", both.alias("b")).select("doc_id", "w", "b.*")


@query("vote_soft", SOFT.format(mean="avg(p)"))
def _(t):
    return ensemble.soft_vote(soft(t), "doc_id", "label", "q")


@query("vote_soft_weighted", SOFT.format(mean="sum(p * w) / sum(w)"))
def _(t):
    return ensemble.soft_vote(soft(t), "doc_id", "label", "q", "w")


@query("average_regression", f"WITH {VOTES} SELECT doc_id, round(sum(p * w) / sum(w), 6) AS prediction FROM v GROUP BY doc_id")
def _(t):
    return ensemble.average(votes(t), "doc_id", "p", "w")
