"""Queries for the model registry and for fitted models; fitted results have no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import half_up, only_row
from millrace.functions.storage import stored
from millrace.operators import ensembles, metrics, models, search, split
from millrace.plans.registry import query
from millrace.plans.table_queries import ranked_sql

ROWS = ", ".join(f"('{e.name}', '{e.tasks[0]}', {e.priority}, [{', '.join(chr(39) + t + chr(39) for t in e.tags)}], {e.least}, {n})" for n, e in enumerate(models.REGISTRY.values()))
REGISTRY = f"r(name, task, priority, tags, least, place) AS (VALUES {ROWS})"


@query("registry_stats", f"WITH {REGISTRY} SELECT 'task' AS kind, task AS value, count(*) AS n FROM r GROUP BY task UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(tags) AS tag FROM r) GROUP BY tag")
def _(t):
    return models.registry_stats(models.registry_table(t("region").sparkSession))


@query("model_autoselect", f"WITH {REGISTRY} SELECT name, priority + CASE WHEN list_contains(tags, 'linear') THEN 10 ELSE 0 END AS score FROM r WHERE task = 'classification' AND least <= 50")
def _(t):
    return models.ranked_models(models.registry_table(t("region").sparkSession), "classification", 50, "linear")


FEATURES = ["n_chars", "n_words", "n_marks"]


def labelled(t):
    stats = t("documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"), F.length(F.regexp_replace("text", r"[^!|#$%&*]", "")).cast("double").alias("n_marks"))
    return stats.join(t("labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")


def evaluated(t, name: str):
    out = models.out_of_fold(labelled(t), name, FEATURES, "y", "doc_id")
    return metrics.binary(out, "y", "prediction", 1.0)


@query("fit_random_forest")
def _(t):
    return evaluated(t, "random_forest_classifier")


@query("fit_logistic")
def _(t):
    return evaluated(t, "logistic_regression")


@query("fit_gbt")
def _(t):
    """Fitted on seven tenths of each class, scored on the rest."""
    d = stored(split.stratified_split(labelled(t), "doc_id", "y", 0.7, 0.0, 0.3))
    model = models.fit(d.where("split = 'train'"), "gradient_boosting_classifier", FEATURES, "y")
    return metrics.accuracy(models.predict(model, d.where("split = 'test'"), "doc_id", "y"), "y", "prediction")


@query("fit_linear", "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(a * l_quantity + b, 4) AS prediction FROM lineitem, f")
def _(t):
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    out = models.fit(d, "linear_regression", ["l_quantity"], "l_extendedprice").transform(d)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", half_up(F.col("prediction"), 4).alias("prediction"))


FOLDED = "WITH " + ranked_sql("orders", "o_orderkey") + """, f AS (SELECT o_totalprice AS y, o_custkey::DOUBLE AS x, rk % 5 AS fold FROM r),
l AS (SELECT k.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold),
g AS (SELECT fold, y, y - (a * x + b) AS d FROM f JOIN l USING (fold)),
v AS (SELECT fold, sqrt(avg(d * d)) AS rmse, avg(abs(d)) AS mae, 1 - avg(d * d) / var_pop(y) AS r2 FROM g GROUP BY fold),
m AS (SELECT 'rmse' AS metric, rmse AS value FROM v UNION ALL SELECT 'mae', mae FROM v UNION ALL SELECT 'r2', r2 FROM v)"""


@query("cross_validate", FOLDED + " SELECT metric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(avg(value) - 2.776 * stddev_samp(value) / sqrt(5), 4) AS low, round(avg(value) + 2.776 * stddev_samp(value) / sqrt(5), 4) AS high, count(*) AS n FROM m GROUP BY metric")
def _(t):
    d = t("orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    table = models.cross_validated(d, "linear_regression", ["x"], "y", "o_orderkey")
    return table.select("metric", *(half_up(F.col(c), 4).alias(c) for c in ("mean", "std", "low", "high")), "n")


SEARCHED = FOLDED.replace("g AS (", "h AS (SELECT k.fold, avg(y) AS m FROM f JOIN (SELECT DISTINCT fold FROM f) k ON f.fold <> k.fold GROUP BY k.fold), g AS (") + """,
n AS (SELECT avg(rmse) AS a FROM v), z AS (SELECT avg(e) AS b FROM (SELECT sqrt(avg((y - m) * (y - m))) AS e FROM f JOIN h USING (fold) GROUP BY fold))"""


@query("grid_search", SEARCHED + """ SELECT '{"regParam": 0.0}' AS params, 'rmse' AS metric, round(a, 2) AS score, a <= b AS best FROM n, z UNION ALL SELECT '{"regParam": 1000000000.0}', 'rmse', round(b, 2), b < a FROM n, z""")
def _(t):
    """So heavy a penalty leaves the mean alone."""
    d = t("orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    return models.searched(d, "lasso", {"regParam": [0.0, 1e9]}, ["x"], "y", "o_orderkey").withColumn("score", half_up(F.col("score"), 2))


@query("stacking")
def _(t):
    d = labelled(t)
    model = models.stacked(d, ["logistic_regression", "decision_tree_classifier"], "logistic_regression", FEATURES, "y", "doc_id")
    weights = models.importance(model, ["logistic_regression", "decision_tree_classifier"])
    return t("region").sparkSession.createDataFrame(weights, "model string, weight double")


@query("kmeans")
def _(t):
    d = labelled(t)
    return models.clusters(d, FEATURES, 3).transform(d).groupBy("prediction").agg(F.count("*").alias("n"))


HELD = "SELECT count(*) AS n FROM labels JOIN documents USING (doc_id)"


def judged(t, make):
    """(n, n_kept, better): rows, predictions, and whether a model of one half of the rows beats the majority class on the other."""
    # The split reads its rows twice; the texts are read once.
    d = stored(split.random_split(stored(labelled(t)), "doc_id", 0.5, 0.0, 0.5))
    out = stored(make(d.where("split = 'train'")).transform(d).select("y", "split", "prediction"))
    test = out.where("split = 'test'").agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("right"), F.greatest(F.avg("y"), 1 - F.avg("y")).alias("most"))
    n = out.agg(F.count("*").alias("n"), F.count("prediction").alias("n_kept"))
    return n.select("n", "n_kept", only_row(test.select((F.col("right") > F.col("most")).alias("better")))["better"].alias("better"))


@query("fit_ada_boost", f"SELECT n, n AS n_kept, true AS better FROM ({HELD})")
def _(t):
    return judged(t, lambda d: ensembles.ada_boost_classifier(d, FEATURES, "y", rounds=10))


@query("fit_kernel_svc", f"SELECT n, n AS n_kept, true AS better FROM ({HELD})")
def _(t):
    return judged(t, lambda d: ensembles.kernel_svc(d, FEATURES, "y", "doc_id", components=100))


CURVE = "WITH " + ranked_sql("orders", "o_orderkey") + """, c AS (SELECT *, count(*) OVER () - floor(count(*) OVER () * 0.2)::BIGINT AS able, o_totalprice AS y, o_custkey::DOUBLE AS x FROM r),
s AS (SELECT unnest([0.1, 0.325, 0.55, 0.775, 1.0]::DOUBLE[]) AS share), p AS (SELECT share, greatest(1, floor(able * share))::BIGINT AS n, c.* FROM c, s),
l AS (SELECT share, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM p WHERE rk < n GROUP BY share)
SELECT share, any_value(n) AS n, round(sqrt(avg((y - a * x - b) ** 2) FILTER (rk < n)), 4) AS train, round(sqrt(avg((y - a * x - b) ** 2) FILTER (rk >= able)), 4) AS validation FROM p JOIN l USING (share) GROUP BY share"""


@query("learning_curve", CURVE)
def _(t):
    d = t("orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    return search.learning_curve(d, "linear_regression", ["x"], "y", "o_orderkey")


#: The same draws in SQL: a logarithmic range from a digest of seed, trial and name.
DRAWS = "SELECT t::INTEGER AS trial, exp(ln(1e-3) + ('0x' || substr(md5('42:' || t || ':regParam'), 1, 8))::BIGINT / 4294967296.0::DOUBLE * (ln(1e12) - ln(1e-3))) AS p FROM range(6) r(t)"


@query("random_search", f"SELECT trial, round(ln(p), 6) AS log_penalty, 3 AS folds, 'complete' AS state FROM ({DRAWS})")
def _(t):
    """Six seeded penalties, each scored on three folds."""
    d = t("orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    space = {"regParam": search.Param(1e-3, 1e12, log=True)}
    out = search.searched(d, "ridge", space, ["x"], "y", "o_orderkey", trials=6, sampler="random", prune=False)
    return out.select("trial", half_up(F.log(F.get_json_object("params", "$.regParam").cast("double"))).alias("log_penalty"), "folds", "state")
