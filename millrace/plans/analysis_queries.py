"""Queries for outlier forests, clustering scores, feature selection, forecasts and decomposition."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.functions.columns import half_up
from millrace.operators import anomaly, clustering, forecast, images, metrics, models, robust, selection
from millrace.plans.registry import query

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = "(l_orderkey * 10 + l_linenumber)"


def isolation_sql(trees: int, sample: int, height: int, seed: int) -> str:
    """The forest grown level by level over the least hashed rows, and every row sent down every tree."""
    xs = ", ".join(f"{c}::DOUBLE" for c in NUMBERS)
    d = range(len(NUMBERS))
    ends = ", ".join(f"min(x[{i + 1}]) OVER w" for i in d), ", ".join(f"max(x[{i + 1}]) OVER w" for i in d)
    group_ends = ends[0].replace(" OVER w", ""), ends[1].replace(" OVER w", "")
    varied = f"list_filter({list(d)}, lambda i: hi[i + 1] > lo[i + 1]) AS v"
    drawn = lambda a, b: f"('0x' || substr(md5('{seed}:' || t || ':' || node), {a}, 8))::BIGINT{b}"
    cut = f"v[1 + {drawn(1, '')} % nullif(len(v), 0)] + 1 AS f, {drawn(9, '')} / 4294967296.0::DOUBLE AS u"
    steps = "".join(
        f", d{n + 1} AS (SELECT k, t, x, CASE WHEN s.f IS NULL THEN d.node ELSE 2 * d.node + (x[s.f] > s.cut)::INT END AS node FROM d{n} d JOIN s USING (t, node))" for n in range(height)
    )
    return f"""WITH RECURSIVE a AS (SELECT l_orderkey, l_linenumber, {KEY} AS k, [{xs}] AS x FROM lineitem),
p AS (SELECT row_number() OVER (ORDER BY md5('{seed}:' || k), k, x) - 1 AS rk, x FROM a QUALIFY rk < {trees * sample}), n AS (SELECT count(*) AS n FROM p),
g AS (SELECT t, rk, x FROM range({trees}) t(t), range({sample}) i(i), n JOIN p ON p.rk = (t * {sample} + i) % n.n WHERE i < n.n),
m AS (SELECT t, rk, x, 1 AS node, 0 AS level FROM g
  UNION ALL SELECT t, rk, x, 2 * node + (x[f] > lo[f] + (hi[f] - lo[f]) * u)::INT, level + 1 FROM (SELECT *, {cut} FROM (SELECT *, {varied} FROM (
    SELECT *, [{ends[0]}] AS lo, [{ends[1]}] AS hi FROM m WHERE level < {height} WINDOW w AS (PARTITION BY t, node))) WHERE len(v) > 0)),
s AS (SELECT t, node, CASE WHEN len(v) > 0 AND level < {height} THEN f END AS f, lo[f] + (hi[f] - lo[f]) * u AS cut,
    level + CASE WHEN c <= 1 THEN 0 WHEN c = 2 THEN 1 ELSE 2 * (ln(c - 1) + {anomaly.EULER}) - 2 * (c - 1) / c END AS path
  FROM (SELECT *, {cut} FROM (SELECT *, {varied} FROM (SELECT t, node, level, count(*)::DOUBLE AS c, [{group_ends[0]}] AS lo, [{group_ends[1]}] AS hi FROM m GROUP BY t, node, level)))),
d0 AS (SELECT rowid AS k, t, x, 1 AS node FROM (SELECT row_number() OVER () AS rowid, x FROM a), range({trees}) t(t)){steps},
e AS (SELECT k, avg(path) AS path FROM d{height} JOIN s USING (t, node) GROUP BY k),
z AS (SELECT least(n, {sample})::DOUBLE AS c FROM n),
o AS (SELECT e.k, 2.0 ** (-e.path / (2 * (ln(c - 1) + {anomaly.EULER}) - 2 * (c - 1) / c)) AS score FROM e, z)
SELECT l_orderkey, l_linenumber, l_partkey, round(score, 6) AS score, score > 0.5 AS outlier
FROM o JOIN (SELECT row_number() OVER () AS k, l_orderkey, l_linenumber, l_partkey FROM lineitem) USING (k)"""


@query("isolation_flags", isolation_sql(anomaly.TREES, anomaly.SAMPLE, 8, anomaly.SEED))
def _(t):
    """All rows of lineitem by a forest of 100 trees of 256 rows."""
    d = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *NUMBERS)
    out = anomaly.flagged(d, NUMBERS, F.expr(KEY))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", half_up(F.col("score")).alias("score"), "outlier")


# Clustering scores

POINTS = ["l_quantity", "l_discount", "l_tax"]
MOMENTS = "WITH p AS (SELECT l_returnflag AS c, [l_quantity, l_discount, l_tax]::DOUBLE[] AS x FROM lineitem), m AS (SELECT c, count(*) AS n, sum(x[1]) AS a, sum(x[2]) AS b, sum(x[3]) AS d, sum(list_dot_product(x, x)) AS q FROM p GROUP BY c)"


@query("cluster_silhouette", MOMENTS + """, r AS (SELECT row_number() OVER () AS i, * FROM p),
w AS (SELECT r.i, r.c, r.c = m.c AS own, m.n, greatest(m.n * list_dot_product(x, x) - 2 * (x[1] * a + x[2] * b + x[3] * d) + q, 0) AS s FROM r, m),
v AS (SELECT i, c, max(s / nullif(n - 1, 0)) FILTER (own) AS a, min(s / n) FILTER (NOT own) AS b FROM w GROUP BY i, c),
z AS (SELECT c, coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s FROM v)
SELECT c AS cluster, count(*) AS n, round(avg(s), 6) AS silhouette FROM z GROUP BY c UNION ALL SELECT NULL, count(*), round(avg(s), 6) FROM z""")
def _(t):
    return clustering.silhouette(t("lineitem"), POINTS, "l_returnflag")


@query("cluster_calinski_harabasz", MOMENTS + """, g AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(q - (a * a + b * b + d * d) / n) AS within,
  sum((a * a + b * b + d * d) / n) - (sum(a) ** 2 + sum(b) ** 2 + sum(d) ** 2) / sum(n) AS between FROM m)
SELECT k AS clusters, n, round(within, 4) AS within, round(between, 4) AS between, round((between / (k - 1)) / (within / (n - k)), 4) AS calinski_harabasz FROM g""")
def _(t):
    return clustering.spread(t("lineitem"), POINTS, "l_returnflag")


# Feature selection


def union(columns: list[str], sql: str) -> str:
    return " UNION ALL ".join(sql.replace("$c", c) for c in columns)


CHI2_ROWS = union(NUMBERS, "SELECT '$c' AS feature, l_returnflag AS class, count($c) AS n, sum($c)::DOUBLE AS s FROM lineitem GROUP BY l_returnflag")
RANKED = "row_number() OVER (ORDER BY statistic DESC NULLS LAST, feature)::INTEGER AS rank"


@query("select_chi2", f"""WITH c AS ({CHI2_ROWS}), e AS (SELECT *, n / sum(n) OVER (PARTITION BY feature) * sum(s) OVER (PARTITION BY feature) AS e FROM c),
x AS (SELECT feature, sum((s - e) ** 2 / e) AS statistic, count(*) - 1 AS freedom FROM e GROUP BY feature)
SELECT feature, round(statistic, 4) AS statistic, freedom, round(exp(-statistic / 2), 8) AS p, {RANKED} FROM x""")
def _(t):
    """Three classes leave two degrees of freedom, for which the tail is an exponential."""
    out = selection.best(selection.chi2(t("lineitem"), NUMBERS, "l_returnflag"), 4)
    return out.select("feature", half_up(F.col("statistic"), 4).alias("statistic"), "freedom", half_up(F.col("p"), 8).alias("p"), "rank")


LINE = union(["l_quantity", "l_discount", "l_tax", "l_linenumber"], "SELECT '$c' AS feature, corr($c, l_extendedprice) AS r, count(*) FILTER ($c IS NOT NULL AND l_extendedprice IS NOT NULL) - 2 AS rest FROM lineitem")


@query("select_f_regression", f"""WITH x AS (SELECT feature, r AS correlation, r * r * rest / (1 - r * r) AS statistic, rest FROM ({LINE}))
SELECT feature, round(correlation, 6) AS correlation, round(statistic, 4) AS statistic, rest, {RANKED} FROM x""")
def _(t):
    out = selection.best(selection.f_regression(t("lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice"), 4)
    return out.select("feature", half_up(F.col("correlation")).alias("correlation"), half_up(F.col("statistic"), 4).alias("statistic"), "rest", "rank")


CLASS_ROWS = union(NUMBERS, "SELECT '$c' AS feature, count($c) AS n, sum($c)::DOUBLE AS s, sum($c::DOUBLE * $c::DOUBLE) AS q FROM lineitem GROUP BY l_returnflag")


@query("select_f_classes", f"""WITH c AS ({CLASS_ROWS}), g AS (SELECT feature, count(*) AS k, sum(n)::BIGINT AS n, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS own FROM c GROUP BY feature),
x AS (SELECT feature, ((own - s * s / n) / (k - 1)) / ((q - own) / (n - k)) AS statistic, k - 1 AS freedom, n - k AS rest FROM g)
SELECT feature, round(statistic, 4) AS statistic, freedom, rest, {RANKED} FROM x""")
def _(t):
    out = selection.best(selection.f_classes(t("lineitem"), NUMBERS, "l_returnflag"), 4)
    return out.select("feature", half_up(F.col("statistic"), 4).alias("statistic"), "freedom", "rest", "rank")


CATEGORIES = ["l_linestatus", "l_linenumber", "l_quantity", "l_discount"]
JOINT = union(CATEGORIES, "SELECT '$c' AS feature, $c::DOUBLE::VARCHAR AS value, l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY ALL").replace("l_linestatus::DOUBLE::", "l_linestatus::")


@query("select_mutual_information", f"""WITH j AS ({JOINT}), o AS (SELECT *, sum(n) OVER (PARTITION BY feature, value) AS v, sum(n) OVER (PARTITION BY feature, class) AS c, sum(n) OVER (PARTITION BY feature) AS a FROM j)
SELECT feature, round(greatest(sum(n / a * ln(n * a / (v * c))), 0), 6) AS information FROM o GROUP BY feature""")
def _(t):
    out = selection.mutual_information(t("lineitem"), CATEGORIES, "l_returnflag")
    return out.select("feature", half_up(F.col("information")).alias("information"))


# Forecasts

DAILY = "s AS (SELECT o_orderpriority AS series, date_trunc('day', o_orderdate) AS time, sum(o_totalprice)::DOUBLE AS value FROM orders GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY time) - 1 AS place FROM s)"
ALPHA, BETA, PHI, HORIZON = 0.3, 0.1, 0.9, 3
STATES = f"""WITH RECURSIVE {DAILY},
w AS (SELECT series, place, value, NULL::DOUBLE AS forecast, value AS level, 0::DOUBLE AS trend FROM o WHERE place = 0
  UNION ALL SELECT o.series, o.place, o.value, w.level + {PHI} * w.trend, {ALPHA} * o.value + {1 - ALPHA} * (w.level + {PHI} * w.trend),
    {BETA} * ({ALPHA} * o.value + {1 - ALPHA} * (w.level + {PHI} * w.trend) - w.level) + {1 - BETA} * {PHI} * w.trend FROM w JOIN o ON o.series = w.series AND o.place = w.place + 1)"""


def daily(t):
    day = F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("time")
    return t("orders").groupBy("o_orderpriority", day).agg(F.sum("o_totalprice").alias("value")).withColumn("key", F.lit(0))


def states(t):
    return forecast.smoothed(daily(t), "value", "time", "key", "o_orderpriority", ALPHA, BETA, PHI)


@query("forecast_smoothed", STATES + " SELECT series, place, round(value, 2) AS value, round(forecast, 2) AS forecast, round(level, 2) AS level, round(trend, 2) AS trend FROM w")
def _(t):
    """Damped trends of each priority's daily totals."""
    return states(t).select("series", "place", *(half_up(F.col(c), 2).alias(c) for c in ("value", "forecast", "level", "trend")))


@query("forecast_next", STATES + f", l AS (SELECT series, arg_max(level, place) AS level, arg_max(trend, place) AS trend FROM w GROUP BY series), g(h, s) AS (VALUES {', '.join(f'({h}, {sum(PHI**i for i in range(1, h + 1))}::DOUBLE)' for h in range(1, HORIZON + 1))}) SELECT series, h, round(level + s * trend, 2) AS forecast FROM l, g")
def _(t):
    return forecast.forecasts(states(t), HORIZON, PHI).select("series", "h", half_up(F.col("forecast"), 2).alias("forecast"))


@query("forecast_backtest", STATES + f", g(h, s) AS (VALUES {', '.join(f'({h}, {sum(PHI**i for i in range(1, h + 1))}::DOUBLE)' for h in range(1, HORIZON + 1))}), e AS (SELECT w.series, h, a.value, abs(a.value - (w.level + s * w.trend)) AS e FROM w, g JOIN w a ON a.series = w.series AND a.place = w.place + h WHERE w.place >= 9) SELECT series, h, count(*) AS n, round(avg(e), 2) AS mae, round(sqrt(avg(e * e)), 2) AS rmse, round(100 * avg(e / nullif(abs(value), 0)), 2) AS mape FROM e GROUP BY series, h")
def _(t):
    """Every state from the tenth on forecasts three steps."""
    out = forecast.backtest(states(t), HORIZON, PHI)
    return out.select("series", "h", "n", *(half_up(F.col(c), 2).alias(c) for c in ("mae", "rmse", "mape")))


def decomposition_sql(period: int, multiplicative: bool) -> str:
    half = period // 2
    total = f"sum(value) OVER v{' - (lag(value, %d) OVER n + lead(value, %d) OVER n) / 2' % (half, half) if period % 2 == 0 else ''}"
    left, season, rest = ("value / trend", "m / avg(m) OVER (PARTITION BY series)", "left_ / season") if multiplicative else ("value - trend", "m - avg(m) OVER (PARTITION BY series)", "left_ - season")
    return f"""WITH {DAILY}, t AS (SELECT *, CASE WHEN count(*) OVER v = {2 * half + 1} THEN ({total}) / {period} END AS trend FROM o
  WINDOW n AS (PARTITION BY series ORDER BY place), v AS (PARTITION BY series ORDER BY place ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
l AS (SELECT *, {left} AS left_, place % {period} AS phase FROM t), p AS (SELECT series, phase, avg(left_) AS m FROM l GROUP BY series, phase), q AS (SELECT series, phase, {season} AS season FROM p)
SELECT series, place, round(value, 2) AS value, round(trend, 4) AS trend, round(season, 4) AS season, round({rest}, 4) AS rest FROM l JOIN q USING (series, phase)"""


def decomposed(t, period: int, multiplicative: bool):
    out = forecast.decomposed(daily(t), "value", "time", "key", period, "o_orderpriority", multiplicative)
    return out.select("series", "place", half_up(F.col("value"), 2).alias("value"), *(half_up(F.col(c), 4).alias(c) for c in ("trend", "season", "rest")))


@query("seasonal_decomposition", decomposition_sql(7, False))
def _(t):
    return decomposed(t, 7, False)


@query("seasonal_decomposition_ratio", decomposition_sql(14, True))
def _(t):
    """An even period, and a season that multiplies."""
    return decomposed(t, 14, True)


# Images: embeddings as eight rows of eight pixels

PIXELS = "e AS (SELECT vec_id, (k - 1) // 8 AS y, (k - 1) % 8 AS x, embedding[k]::DOUBLE AS v FROM embeddings, range(1, 65) r(k))"


def picture(t):
    return t("embeddings").select("vec_id", images.from_flat(F.col("embedding"), 8).alias("image"))


def pixels(df):
    rows = df.select("vec_id", F.posexplode("image").alias("i", "row"))
    return rows.select("vec_id", "i", F.posexplode("row").alias("j", "v")).withColumn("v", half_up(F.col("v")))


def warp_sql(y: str, x: str, height: int, width: int, near: bool) -> str:
    """Each source pixel weighs as a tent of width one around the place that is looked up; ``near`` clamps that place."""
    y, x = (f"least(greatest({p}, 0), 7)" if near else p for p in (y, x))
    return f"""WITH {PIXELS}, g AS (SELECT i, j, {y} AS sy, {x} AS sx FROM range({height}) a(i), range({width}) b(j))
SELECT vec_id, i::INTEGER AS i, j::INTEGER AS j, round(coalesce(sum(v * (1 - abs(sy - y)) * (1 - abs(sx - x))) FILTER (abs(sy - y) < 1 AND abs(sx - x) < 1), 0), 6) AS v FROM e, g GROUP BY vec_id, i, j"""


@query("image_resize", warp_sql("(i + 0.5::DOUBLE) * (8 / 5.0::DOUBLE) - 0.5::DOUBLE", "(j + 0.5::DOUBLE) * (8 / 12.0::DOUBLE) - 0.5::DOUBLE", 5, 12, True))
def _(t):
    return pixels(picture(t).withColumn("image", images.resized(F.col("image"), 5, 12)))


TURN = [f"{f}(radians(25))" for f in ("cos", "sin")]


@query("image_rotate", warp_sql(f"(i - 3.5::DOUBLE) * {TURN[0]} + (j - 3.5::DOUBLE) * {TURN[1]} + 3.5", f"(j - 3.5::DOUBLE) * {TURN[0]} - (i - 3.5::DOUBLE) * {TURN[1]} + 3.5", 8, 8, False))
def _(t):
    return pixels(picture(t).withColumn("image", images.rotated(F.col("image"), 25, 8, 8)))


@query("image_zoom_shift", warp_sql("(i - 3.5::DOUBLE - 1.25) / 1.5::DOUBLE + 3.5", "(j - 3.5::DOUBLE + 0.5) / 1.5::DOUBLE + 3.5", 8, 8, False))
def _(t):
    out = images.affine(F.col("image"), (1.5, 0.0, 0.0, 1.5), (1.25, -0.5), 8, 8)
    return pixels(picture(t).withColumn("image", out))


# Failing rows, registered metrics


def reciprocal(prices: list[float]) -> list[float]:
    """Fails for a whole list if one price ends in seven cents."""
    for p in prices:
        if round(p * 100) % 10 == 7:
            raise ValueError(f"{p:.2f} can't be")
    return [1000 / p for p in prices]


BAD = "round(o_totalprice * 100)::BIGINT % 10 = 7"


@query("row_failures", f"SELECT o_orderkey, CASE WHEN NOT ({BAD}) THEN round(1000 / o_totalprice, 6) END AS result, {BAD} AS failed FROM orders")
def _(t):
    """Poisoned rows are reported, all others have their results."""
    out = robust.mapped(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", reciprocal, "double")
    return out.select("o_orderkey", half_up(F.col("result")).alias("result"), F.col("error").isNotNull().alias("failed"))


@query("custom_metrics", "SELECT unnest(['within_a_tenth', 'bias', 'worst']) AS metric, unnest([round(avg((abs(l_extendedprice - p) <= 0.1 * l_extendedprice)::INT), 6), round(avg(p - l_extendedprice), 6), round(max(abs(p - l_extendedprice)), 6)]) AS value, unnest([true, false, false]) AS higher_is_better, false AS is_primary FROM (SELECT l_extendedprice, l_quantity * 1500.0 AS p FROM lineitem)")
def _(t):
    """Three metrics of one's own in one pass."""
    metrics.register("within_a_tenth", lambda y, p: F.avg((F.abs(y - p) <= 0.1 * y).cast("int")))
    metrics.register("bias", lambda y, p: F.avg(p - y), False)
    metrics.register("worst", lambda y, p: F.max(F.abs(p - y)), False)
    d = t("lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500.0).alias("p"))
    return metrics.custom(d, "l_extendedprice", "p", ["within_a_tenth", "bias", "worst"])


# Principal components: as many as features, so that the total variance is that of the features


@query("pca_variance", "SELECT count(*) AS n, round(var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax), 4) AS variance FROM lineitem")
def _(t):
    """Components turn the features; what they vary in all stays."""
    features = ["l_quantity", "l_discount", "l_tax"]
    d = t("lineitem").select(*features)
    out = models.components(d, features, 3).transform(d).select(vector_to_array("components").alias("c"))
    return out.agg(F.count("*").alias("n"), half_up(sum((F.var_samp(F.col("c")[i]) for i in range(3)), F.lit(0.0)), 4).alias("variance"))
