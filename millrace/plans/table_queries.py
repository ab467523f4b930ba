"""Queries over tables: profiles, quality rules, cleaning, transforms, splits, features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_up
from millrace.operators import augment, clean, features, profile, quality, split, transform
from millrace.plans.registry import query
from millrace.sources import readers

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOLED = ["l_quantity", "l_discount"]
K = "(l_orderkey * 10 + l_linenumber)"
#: lineitem with missing cells, infinities and a constant column, the same in Spark and in SQL.
HOLES = {
    "l_quantity": f"CASE WHEN {K} % 13 = 0 THEN NULL ELSE l_quantity END",
    "l_discount": f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE l_discount END",
    "l_returnflag": f"CASE WHEN {K} % 19 = 0 THEN NULL ELSE l_returnflag END",
    "l_tax": f"CASE WHEN {K} % 997 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_tax END",
    "one": "CAST(1.0 AS DOUBLE)",
}
HOLED_SQL = "holed AS (SELECT l_orderkey, l_linenumber, l_extendedprice, " + ", ".join(f"{sql} AS {c}" for c, sql in HOLES.items()) + " FROM lineitem)"


def holed(t) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", *(F.expr(sql).alias(c) for c, sql in HOLES.items()))


def each(columns: list[str], sql: str, joint: str = " UNION ALL ") -> str:
    return joint.join(sql.replace("$c", c) for c in columns)


# Profiles

numeric_sql = "SELECT '$c' AS feature, round(avg($c), 6) AS mean, round(stddev_pop($c), 6) AS std, min($c)::DOUBLE AS min, max($c)::DOUBLE AS max, count(*) FILTER ($c IS NULL) AS missing FROM "


@query("profile_numeric", each(NUMBERS, numeric_sql + "lineitem"))
def _(t):
    return profile.numeric(t("lineitem"), NUMBERS)


CATEGORIES = ["p_brand", "p_type", "p_size"]


@query("profile_categorical", each(CATEGORIES, "SELECT '$c' AS feature, count(DISTINCT $c) AS categories, count(*) FILTER ($c IS NULL) AS missing, min($c::VARCHAR) AS first, max($c::VARCHAR) AS last FROM part"))
def _(t):
    return profile.categorical(t("part"), CATEGORIES)


@query("profile_missing", "WITH " + HOLED_SQL + " " + each([*HOLED, "l_returnflag"], "SELECT '$c' AS feature, count(*) AS n_rows, count(*) FILTER ($c IS NULL) AS missing, round(count(*) FILTER ($c IS NULL)::DOUBLE / count(*), 6) AS ratio FROM holed"))
def _(t):
    return profile.missing(holed(t), [*HOLED, "l_returnflag"])


@query("profile_missing_cells", "WITH " + HOLED_SQL + " SELECT (count(*) * 2)::BIGINT AS cells, (count(*) FILTER (l_quantity IS NULL) + count(*) FILTER (l_discount IS NULL))::BIGINT AS missing, round((count(*) FILTER (l_quantity IS NULL) + count(*) FILTER (l_discount IS NULL))::DOUBLE / (count(*) * 2), 6) AS ratio FROM holed")
def _(t):
    return profile.missing_cells(holed(t), HOLED)


@query("profile_schema", "SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'timestamp_ntz'), ('o_orderpriority', 'string')) v(feature, kind), (SELECT 0::BIGINT AS missing)")
def _(t):
    return profile.schema_summary(t("orders"))


def histogram_sql(value: str, table: str, bins: int) -> str:
    return f"""WITH v AS (SELECT ({value})::DOUBLE AS v FROM {table}), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    b AS (SELECT least(floor((v - lo) / (hi - lo) * {bins}) + 1, {bins})::INTEGER AS bin FROM v, e WHERE v IS NOT NULL)
    SELECT r::INTEGER AS bin, count(b.bin) AS n FROM range(1, {bins + 1}) g(r) LEFT JOIN b ON b.bin = r GROUP BY r"""


@query("profile_histogram30", histogram_sql("l_extendedprice", "lineitem", 30))
def _(t):
    return profile.histogram(t("lineitem"), F.col("l_extendedprice"))


@query("text_length_histogram", histogram_sql("length(text)", "documents", 30))
def _(t):
    return profile.histogram(t("documents"), F.length("text"))


@query("pixel_histogram50", histogram_sql("x", "(SELECT unnest(embedding) AS x FROM embeddings)", 50))
def _(t):
    return profile.histogram(t("embeddings").select(F.explode("embedding").alias("x")), F.col("x"), 50)


@query("text_length_stats", "SELECT round(avg(length(text)), 6) AS mean, round(stddev_pop(length(text)), 6) AS std, min(length(text))::INTEGER AS min, max(length(text))::INTEGER AS max, count(text) AS n FROM documents")
def _(t):
    return profile.text_lengths(t("documents"), "text")


@query("class_balance", "SELECT quality AS class, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS ratio FROM labels GROUP BY quality")
def _(t):
    return profile.class_balance(t("labels"), "quality")


@query("class_discovery", "SELECT count(*) AS n_rows, count(DISTINCT l_returnflag)::BIGINT AS n_classes, count(DISTINCT l_returnflag) < 0.5 * count(*) AS is_classification, min(l_returnflag) AS first_class, max(l_returnflag) AS last_class FROM lineitem")
def _(t):
    return profile.class_discovery(t("lineitem"), "l_returnflag")


@query("resource_summary", "SELECT event_type, round(avg(value), 6) AS mean, round(max(value), 6) AS max, round(min(value), 6) AS min, round(coalesce(stddev_samp(value), 0), 6) AS std, (epoch_us(max(ts)) - epoch_us(min(ts)))::BIGINT AS duration_us, count(*) AS samples FROM events GROUP BY event_type")
def _(t):
    return profile.resource_summary(t("events"), "value", "ts", "event_type")


@query("profile_channels", "WITH p AS (SELECT unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1) % 4 AS channel FROM embeddings) SELECT channel::INTEGER AS channel, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 1e-8), 6) AS std FROM p GROUP BY channel")
def _(t):
    row = lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(F.col("embedding").cast("array<double>"), r * 16 + c * 4 + 1, F.lit(4)))
    return profile.channel_stats(t("embeddings").select(F.transform(F.sequence(F.lit(0), F.lit(3)), row).alias("image")), "image")


@query("profile_durations", "WITH d AS (SELECT len(embedding) / (8.0::DOUBLE + vec_id % 5) AS s FROM embeddings) SELECT round(avg(s), 6) AS mean, round(min(s), 6) AS min, round(max(s), 6) AS max FROM d")
def _(t):
    return profile.durations(t("embeddings"), "embedding", 8.0 + F.col("vec_id") % 5)


@query("rows_at", "SELECT event_id, value FROM events WHERE event_id IN (SELECT doc_id * 3 FROM documents)")
def _(t):
    return readers.rows_at(t("events").select("event_id", "value"), "event_id", t("documents").select((F.col("doc_id") * 3).alias("event_id")))


# Quality rules

ISSUE = "{severity} AS severity, '{category}' AS category, '{feature}' AS feature, ({n})::BIGINT AS n, round(({n})::DOUBLE / nullif({of}, 0), 6) AS ratio"


def issue(severity: str, category: str, feature: str, n: str, of: str, source: str) -> str:
    return f"SELECT * FROM (SELECT {ISSUE.format(severity=severity, category=category, feature=feature, n=n, of=of)} FROM {source}) WHERE severity IS NOT NULL"


MISSING = "count(*) FILTER (l_quantity IS NULL) + count(*) FILTER (l_discount IS NULL)"


@query("quality_missing", "WITH " + HOLED_SQL + " " + issue(f"CASE WHEN {MISSING} = 0 THEN NULL WHEN {MISSING} < 0.1 * 2 * count(*) THEN 'warning' ELSE 'error' END", "missing", "*", MISSING, "count(*) * 2", "holed"))
def _(t):
    return quality.missing(holed(t), HOLED)


INFINITE = "count(*) FILTER (isinf($c))"


@query("quality_inf", "WITH " + HOLED_SQL + " " + each(["l_tax", "l_extendedprice"], issue(f"CASE WHEN {INFINITE} > 0 THEN 'error' END", "infinite", "$c", INFINITE, "count(*)", "holed")))
def _(t):
    return quality.infinite(holed(t), ["l_tax", "l_extendedprice"])


@query("quality_constant", "WITH " + HOLED_SQL + " " + each(["one", "l_quantity"], issue("CASE WHEN min($c) = max($c) AND count(*) FILTER ($c IS NULL) = 0 THEN 'warning' END", "constant", "$c", "count(*)", "count(*)", "holed")))
def _(t):
    return quality.constant(holed(t), ["one", "l_quantity"])


FENCES = "q AS (SELECT quantile_cont({v}::DOUBLE, 0.25) AS q1, quantile_cont({v}::DOUBLE, 0.75) AS q3 FROM {table}), f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"


@query("quality_outliers_iqr", "WITH " + FENCES.format(v="n_chars", table="documents") + " " + issue("CASE WHEN count(*) FILTER (n_chars < lo OR n_chars > hi) > 0.05 * count(*) THEN 'info' END", "outliers", "n_chars", "count(*) FILTER (n_chars < lo OR n_chars > hi)", "count(*)", "documents, f"))
def _(t):
    return quality.outliers(t("documents"), ["n_chars"])


@query("quality_imbalance", "WITH c AS (SELECT CAST(l_quantity > 48 AS INTEGER) AS big, count(*) AS c FROM lineitem GROUP BY 1) " + issue("CASE WHEN count(*) < 0.5 * sum(c) AND max(c) > 10 * min(c) THEN 'warning' END", "imbalance", "big", "max(c)", "min(c)", "c"))
def _(t):
    return quality.imbalance(t("lineitem").select((F.col("l_quantity") > 48).cast("int").alias("big")), "big")


@query("quality_missing_target", "WITH " + HOLED_SQL + " " + issue("CASE WHEN count(*) FILTER (l_returnflag IS NULL) > 0 THEN 'error' END", "missing_target", "l_returnflag", "count(*) FILTER (l_returnflag IS NULL)", "count(*)", "holed"))
def _(t):
    return quality.missing_target(holed(t), "l_returnflag")


RANGE = "count(*) FILTER (value < 0 OR value > 150)"


@query("quality_range", issue(f"CASE WHEN {RANGE} > 0 THEN 'error' END", "out_of_range", "value", RANGE, "count(*)", "events"))
def _(t):
    return quality.within(t("events"), "value", 0, 150)


BLANKED = "b AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 77 = 0 THEN NULL ELSE text END AS text FROM documents)"


def blanked(t) -> DataFrame:
    return t("documents").select("doc_id", F.expr("CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 77 = 0 THEN NULL ELSE text END").alias("text"))


BARE = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
TEXT_ISSUES = [
    ("'warning'", "empty_text", f"count(*) FILTER (length({BARE}) = 0)", "0"),
    ("'error'", "not_text", "count(*) FILTER (text IS NULL)", "0"),
    ("'warning'", "long_text", "count(*) FILTER (length(text) > 100000)", "0"),
    ("'warning'", "short_texts", "count(*) FILTER (length(text) < 10)", "0.1 * count(*)"),
]
TEXT_SQL = " UNION ALL ".join(issue(f"CASE WHEN {n} > {least} THEN {s} END", c, "text", n, "count(*)", "b") for s, c, n, least in TEXT_ISSUES)


@query("quality_text", "WITH " + BLANKED + " " + TEXT_SQL)
def _(t):
    return quality.texts(blanked(t), "text")


@query("quality_summary", f"WITH {BLANKED}, i AS ({TEXT_SQL}) SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS is_valid FROM i")
def _(t):
    return quality.summary(quality.texts(blanked(t), "text"))


@query("quality_media", "WITH s AS (SELECT p_size AS h, 1 + p_partkey % 3 AS w, 3 AS c FROM part), a AS (SELECT count(*) FILTER (NOT (h BETWEEN 1 AND 10000 AND w BETWEEN 1 AND 10000)) AS bad, count(DISTINCT (h, w, c)) AS shapes, count(*) AS n FROM s) SELECT * FROM (SELECT CASE WHEN bad > 0 THEN 'error' END AS severity, 'image_size' AS category, '*' AS feature, bad AS n, round(bad::DOUBLE / n, 6) AS ratio FROM a UNION ALL SELECT CASE WHEN shapes > 1 THEN 'warning' END, 'image_shapes', '*', shapes, round(shapes::DOUBLE / n, 6) FROM a) WHERE severity IS NOT NULL")
def _(t):
    return quality.media(t("part").select(F.col("p_size").alias("h"), (1 + F.col("p_partkey") % 3).alias("w"), F.lit(3).alias("c")), "h", "w", "c")


# Cleaning


def filled_sql(stat: str) -> str:
    return f"WITH {HOLED_SQL}, s AS (SELECT {stat.replace('$c', 'l_quantity')} AS a, {stat.replace('$c', 'l_discount')} AS b FROM holed) SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, a), 6) AS l_quantity, round(coalesce(l_discount, b), 6) AS l_discount FROM holed, s"


def filled(t, strategy: str) -> DataFrame:
    out = clean.impute(holed(t), HOLED, strategy)
    return out.select("l_orderkey", "l_linenumber", *(half_up(F.col(c)).alias(c) for c in HOLED))


@query("clean_impute_mean", filled_sql("avg($c)"))
def _(t):
    return filled(t, "mean")


@query("clean_impute_median", filled_sql("quantile_cont($c, 0.5)"))
def _(t):
    return filled(t, "median")


@query("clean_impute_mode", filled_sql("(SELECT $c FROM holed WHERE $c IS NOT NULL GROUP BY $c ORDER BY count(*) DESC, $c LIMIT 1)").replace(" FROM holed) SELECT", ") SELECT"))
def _(t):
    return filled(t, "mode")


@query("clean_drop_missing", "WITH " + HOLED_SQL + " SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM holed WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL")
def _(t):
    return clean.drop_missing(holed(t), HOLED).select("l_orderkey", "l_linenumber", *HOLED)


EVENT_FENCES = FENCES.format(v="value", table="events")
EVENT_Z = "f AS (SELECT avg(value) - 3 * stddev_pop(value) AS lo, avg(value) + 3 * stddev_pop(value) AS hi FROM events)"


@query("clean_clip_iqr", "WITH " + EVENT_FENCES + " SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value FROM events, f")
def _(t):
    return clean.clip(t("events"), ["value"]).select("event_id", half_up(F.col("value")).alias("value"))


@query("clean_clip_zscore", "WITH " + EVENT_Z + " SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value FROM events, f")
def _(t):
    return clean.clip(t("events"), ["value"], "zscore").select("event_id", half_up(F.col("value")).alias("value"))


@query("clean_outlier_counts", "WITH " + EVENT_FENCES + ", z AS (SELECT avg(value) - 3 * stddev_pop(value) AS lo, avg(value) + 3 * stddev_pop(value) AS hi FROM events) SELECT 'iqr' AS method, count(*) FILTER (value < f.lo OR value > f.hi) AS n, count(value) AS of FROM events, f UNION ALL SELECT 'zscore', count(*) FILTER (value < z.lo OR value > z.hi), count(value) FROM events, z")
def _(t):
    rows = [clean.outlier_counts(t("events"), ["value"], m).select(F.lit(m).alias("method"), "n", "of") for m in ("iqr", "zscore")]
    return rows[0].unionAll(rows[1])


@query("clean_outlier_flag", "WITH " + EVENT_FENCES + " SELECT event_id, value < lo OR value > hi AS value_outlier FROM events, f")
def _(t):
    return clean.flag_outliers(t("events"), ["value"]).select("event_id", "value_outlier")


@query("clean_outlier_remove", "WITH " + EVENT_FENCES + " SELECT event_id, value FROM events, f WHERE NOT (value < lo OR value > hi)")
def _(t):
    return clean.remove_outliers(t("events"), ["value"]).select("event_id", "value")


@query("tabular_dedup_features", "SELECT min(event_id) AS event_id, event_type, user_id FROM events GROUP BY event_type, user_id")
def _(t):
    return clean.dedup_features(t("events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"], "event_id")


@query("embedding_dedup", "WITH u AS (SELECT vec_id, embedding, label FROM embeddings UNION ALL SELECT vec_id + 1000000, embedding, label FROM embeddings WHERE vec_id % 3 = 0) SELECT min(vec_id) AS vec_id, arg_min(label, vec_id) AS label FROM u GROUP BY embedding")
def _(t):
    e = t("embeddings")
    both = e.unionAll(e.where("vec_id % 3 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    return clean.dedup_arrays(both, "embedding", "vec_id").select("vec_id", "label")


@query("array_rescale", "WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi FROM m) SELECT vec_id, round(list_sum(CASE WHEN lo < 0 OR hi > 1 THEN list_transform(e, lambda v: (v - lo) / (hi - lo)) ELSE e END), 4) AS total FROM s")
def _(t):
    e = t("embeddings").select("vec_id", clean.rescale_array(F.col("embedding").cast("array<double>")).alias("e"))
    return e.select("vec_id", half_up(F.aggregate("e", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


# Transforms


@query("scale_standard", "WITH s AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, greatest(stddev_pop({c}), 1e-8) AS {c}_s" for c in NUMBERS) + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - {c}_m) / {c}_s, 6) AS {c}" for c in NUMBERS) + " FROM lineitem, s")
def _(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", *NUMBERS)
    out = transform.StandardScaler(NUMBERS).fit(df).transform(df)
    return out.select("l_orderkey", "l_linenumber", *(half_up(F.col(c)).alias(c) for c in NUMBERS))


@query("scale_minmax", "WITH s AS (SELECT min(p_retailprice) AS a, max(p_retailprice) - min(p_retailprice) AS b FROM part) SELECT p_partkey, round((p_retailprice - a) / b, 6) AS p_retailprice FROM part, s")
def _(t):
    df = t("part").select("p_partkey", "p_retailprice")
    return transform.RangeScaler(["p_retailprice"]).fit(df).transform(df).withColumn("p_retailprice", half_up(F.col("p_retailprice")))


@query("scale_robust", "WITH s AS (SELECT quantile_cont(p_retailprice, 0.5) AS a, quantile_cont(p_retailprice, 0.75) - quantile_cont(p_retailprice, 0.25) AS b FROM part) SELECT p_partkey, round((p_retailprice - a) / b, 6) AS p_retailprice FROM part, s")
def _(t):
    df = t("part").select("p_partkey", "p_retailprice")
    return transform.RangeScaler(["p_retailprice"], "robust").fit(df).transform(df).withColumn("p_retailprice", half_up(F.col("p_retailprice")))


@query("encode_label", "WITH v AS (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#3')) SELECT p_partkey, coalesce(code, -1)::INTEGER AS code FROM part LEFT JOIN v USING (p_brand)")
def _(t):
    part = t("part").select("p_partkey", "p_brand")
    seen = part.where("p_partkey % 2 = 0 AND p_brand < 'Brand#3'")
    return transform.LabelEncoder("p_brand").fit(seen).transform(part, "code").select("p_partkey", "code")


TRAIN = f"{K} % 5 <> 0"


@query("impute_fit_transform", f"WITH {HOLED_SQL}, s AS (SELECT avg(l_quantity) AS a FROM holed WHERE {TRAIN}) SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, a), 6) AS l_quantity FROM holed, s WHERE NOT ({TRAIN})")
def _(t):
    df = holed(t)
    out = clean.impute(df.where(f"NOT ({TRAIN})"), ["l_quantity"], "mean", df.where(TRAIN))
    return out.select("l_orderkey", "l_linenumber", half_up(F.col("l_quantity")).alias("l_quantity"))


@query("clip_transform", "WITH " + FENCES.format(v="value", table="events WHERE event_id % 5 <> 0") + " SELECT event_id, round(greatest(lo, least(hi, value)), 6) AS value FROM events, f WHERE event_id % 5 = 0")
def _(t):
    e = t("events")
    return clean.clip(e.where("event_id % 5 = 0"), ["value"], fitted_on=e.where("event_id % 5 <> 0")).select("event_id", half_up(F.col("value")).alias("value"))


@query("pipeline_tabular", f"""WITH b AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS value, event_type FROM events),
tr AS (SELECT * FROM b WHERE event_id % 5 <> 0), m AS (SELECT avg(value) AS mean FROM tr), fi AS (SELECT event_id, event_type, coalesce(value, mean) AS value FROM b, m),
ft AS (SELECT * FROM fi WHERE event_id % 5 <> 0), s AS (SELECT avg(value) AS a, greatest(stddev_pop(value), 1e-8) AS d FROM ft), sc AS (SELECT event_id, event_type, (value - a) / d AS value FROM fi, s),
{FENCES.format(v="value", table="sc WHERE event_id % 5 <> 0")}, c AS (SELECT event_type, (row_number() OVER (ORDER BY event_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT event_type FROM tr))
SELECT event_id, round(greatest(lo, least(hi, value)), 5) AS value, coalesce(code, -1)::INTEGER AS event_type FROM sc LEFT JOIN c USING (event_type), f""")
def _(t):
    df = t("events").select("event_id", F.expr("CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END").alias("value"), "event_type")
    out = transform.TabularPreprocessor(["value"], ["event_type"]).fit(df.where("event_id % 5 <> 0")).transform(df)
    return out.select("event_id", half_up(F.col("value"), 5).alias("value"), "event_type")


# Splits and samples. The seeded order is md5('42:' || key).


def ranked_sql(table: str, key: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"r AS (SELECT *, row_number() OVER ({part}ORDER BY md5('42:' || {key}::VARCHAR), {key}) - 1 AS rk, count(*) OVER ({part}) AS size FROM {table})"


NAMED = "CASE WHEN rk < {a} THEN 'train' WHEN rk < {a} + floor(size * 0.15::DOUBLE) THEN 'validation' ELSE 'test' END"
STRATIFIED = ranked_sql("orders", "o_orderkey", "o_orderstatus") + ", s AS (SELECT o_orderkey, o_orderstatus, " + NAMED.format(a="greatest(1, floor(size * 0.7::DOUBLE))") + " AS split FROM r)"


@query("split_random", "WITH " + ranked_sql("orders", "o_orderkey") + " SELECT o_orderkey, " + NAMED.format(a="floor(size * 0.7::DOUBLE)") + " AS split FROM r")
def _(t):
    return split.random_split(t("orders").select("o_orderkey"), "o_orderkey")


@query("split_stratified", "WITH " + STRATIFIED + " SELECT * FROM s")
def _(t):
    return split.stratified_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query("split_stats", "WITH " + STRATIFIED + " SELECT split, o_orderstatus AS class, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS ratio FROM s GROUP BY split, o_orderstatus")
def _(t):
    done = split.stratified_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    return profile.class_balance(done, "o_orderstatus", ["split"])


@query("train_test_split", "WITH " + ranked_sql("labels", "doc_id", "quality") + " SELECT doc_id, quality, CASE WHEN rk < greatest(1, floor(size * 0.8::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM r")
def _(t):
    return split.stratified_split(t("labels").select("doc_id", "quality"), "doc_id", "quality", 0.8, 0.0, 0.2)


@query("kfold", "WITH " + ranked_sql("orders", "o_orderkey") + " SELECT o_orderkey, (rk % 5)::INTEGER AS fold FROM r")
def _(t):
    return split.folds(t("orders").select("o_orderkey"), "o_orderkey")


@query("stratified_kfold", "WITH " + ranked_sql("labels", "doc_id", "quality") + " SELECT doc_id, quality, (rk % 5)::INTEGER AS fold FROM r")
def _(t):
    return split.folds(t("labels").select("doc_id", "quality"), "doc_id", target="quality")


@query("may_stratify", "WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality) SELECT count(*) <= 0.5 * sum(n) AND min(n) >= 2 AS stratify FROM c")
def _(t):
    return split.may_stratify(t("labels"), "quality")


@query("stride_sample", "WITH " + ranked_sql("events", "event_id") + " SELECT event_id FROM r WHERE rk % 10 = 0")
def _(t):
    return split.stride_sample(t("events").select("event_id"), "event_id", 10)


@query("bootstrap_sample", "WITH " + ranked_sql("events", "event_id") + ", d AS (SELECT i AS draw, ('0x' || substr(md5('42:' || i::VARCHAR), 1, 15))::BIGINT % (SELECT count(*) FROM events) AS pick FROM range((SELECT count(*) FROM events)) g(i)) SELECT draw, event_id FROM d JOIN r ON pick = rk")
def _(t):
    return split.bootstrap(t("events").select("event_id"), "event_id")


# Augmentation


def unit_sql(salt: str, key: str) -> str:
    return f"(('0x' || substr(md5('{salt}' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("augment_tabular_noise", f"WITH s AS (SELECT stddev_pop(value) AS d FROM events) SELECT event_id, round(CASE WHEN {unit_sql('value?:', 'event_id')} < 0.5 THEN value + sqrt(-2 * ln(greatest({unit_sql('value1:', 'event_id')}, 1e-12))) * cos(2 * 3.141592653589793 * {unit_sql('value2:', 'event_id')}) * d * 0.05 ELSE value END, 4) AS value FROM events, s")
def _(t):
    return augment.noisy(t("events").select("event_id", "value"), ["value"], "event_id").select("event_id", half_up(F.col("value"), 4).alias("value"))


@query("augment_feature_dropout", f"WITH s AS (SELECT avg(value) AS m FROM events) SELECT event_id, round(CASE WHEN {unit_sql('value!:', 'event_id')} < 0.1 THEN m ELSE value END, 6) AS value FROM events, s")
def _(t):
    return augment.dropped_features(t("events").select("event_id", "value"), ["value"], "event_id").select("event_id", half_up(F.col("value")).alias("value"))


# Features


@query("lag_features", "SELECT event_id, " + ", ".join(f"lag(value, {n}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_lag_{n}" for n in features.LAGS) + " FROM events")
def _(t):
    return features.lags(t("events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", *(f"value_lag_{n}" for n in features.LAGS))


@query("rolling_features", "SELECT event_id, " + ", ".join(f"round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS value_mean_{n}" for n in features.ROLLING) + " FROM events")
def _(t):
    return features.rolling(t("events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", *(f"value_mean_{n}" for n in features.ROLLING))


@query("forward_fill", "WITH b AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events) SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM b")
def _(t):
    b = t("events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return features.filled(b, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "value")


@query("backward_fill", "WITH b AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events) SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM b")
def _(t):
    b = t("events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return features.filled(b, "value", ["ts", "event_id"], ["user_id"], forward=False).select("event_id", "value")


@query("calendar_features", "SELECT event_id, year(ts)::INTEGER AS year, month(ts)::INTEGER AS month, day(ts)::INTEGER AS day, ((isodow(ts) - 1))::INTEGER AS weekday, hour(ts)::INTEGER AS hour FROM events")
def _(t):
    return features.calendar(t("events").select("event_id", "ts"), "ts").drop("ts")


STATUSES = ["F", "O", "P"]


@query("onehot", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderstatus = '{s}' AS INTEGER) AS o_orderstatus_{s}" for s in STATUSES) + " FROM orders")
def _(t):
    return features.one_hot(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", STATUSES).drop("o_orderstatus")


@query("binary_encode", "SELECT p_partkey, " + ", ".join(f"((p_size >> {b}) & 1)::INTEGER AS p_size_bit_{b}" for b in range(6)) + " FROM part")
def _(t):
    return features.binary_codes(t("part").select("p_partkey", "p_size"), "p_size", 6).drop("p_size")


@query("target_encode", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS encoded FROM part GROUP BY p_brand")
def _(t):
    return features.target_means(t("part"), "p_brand", "p_retailprice")


@query("class_weights", "SELECT toxic AS class, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY toxic")
def _(t):
    return features.class_weights(t("labels"), "toxic")


@query("polynomial_features", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_quantity, 6) AS l_quantity__l_quantity, round(l_quantity * l_discount, 6) AS l_quantity__l_discount, round(l_discount * l_discount, 6) AS l_discount__l_discount FROM lineitem")
def _(t):
    out = features.polynomial(t("lineitem").select("l_orderkey", "l_linenumber", *HOLED), HOLED).drop(*HOLED)
    return out.select("l_orderkey", "l_linenumber", *(half_up(F.col(c)).alias(c) for c in out.columns[2:]))


@query("seasonal_means", "SELECT hour(ts)::INTEGER AS period, count(value) AS n, round(sum(sqrt(abs(value))) / count(value) - sum(sum(sqrt(abs(value)))) OVER () / sum(count(value)) OVER (), 6) AS seasonal FROM events GROUP BY hour(ts)")
def _(t):
    return features.seasonal(t("events").withColumn("root", F.sqrt(F.abs("value"))), "root", F.hour("ts"))


@query("drift_psi", "WITH c AS (SELECT floor(n_chars / 500) AS b, count(*) FILTER (doc_id % 2 = 0)::DOUBLE AS e, count(*) FILTER (doc_id % 2 = 1)::DOUBLE AS a FROM documents GROUP BY 1), p AS (SELECT greatest(e / sum(e) OVER (), 1e-4) AS e, greatest(a / sum(a) OVER (), 1e-4) AS a FROM c) SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM p")
def _(t):
    c = t("documents").groupBy(F.floor(F.col("n_chars") / 500).alias("b")).agg(F.count_if(F.col("doc_id") % 2 == 0).alias("e"), F.count_if(F.col("doc_id") % 2 == 1).alias("a"))
    return features.drift(c, "b", "e", "a")


@query("sparse_columns", "WITH b AS (SELECT CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type FROM events) SELECT 'value' AS feature, round(count(*) FILTER (value IS NULL)::DOUBLE / count(*), 6) AS ratio, round(count(*) FILTER (value IS NULL)::DOUBLE / count(*), 6) > 0.5 AS dropped FROM b UNION ALL SELECT 'event_type', round(count(*) FILTER (event_type IS NULL)::DOUBLE / count(*), 6), round(count(*) FILTER (event_type IS NULL)::DOUBLE / count(*), 6) > 0.5 FROM b")
def _(t):
    e = t("events")
    return features.sparse_columns(e.select(F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type")))


@query("flagship_clean_split_balance", f"WITH {FENCES.format(v='o_totalprice', table='orders')}, c AS (SELECT o_orderkey, o_orderstatus, greatest(lo, least(hi, o_totalprice)) AS o_totalprice FROM orders, f), " + ranked_sql("c", "o_orderkey", "o_orderstatus") + ", s AS (SELECT *, " + NAMED.format(a="greatest(1, floor(size * 0.7::DOUBLE))") + " AS split FROM r) SELECT split, o_orderstatus AS class, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 6) AS ratio FROM s GROUP BY split, o_orderstatus")
def _(t):
    """Clip totals, split by class, report the balance of each split."""
    cleaned = clean.clip(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), ["o_totalprice"])
    return profile.class_balance(split.stratified_split(cleaned, "o_orderkey", "o_orderstatus"), "o_orderstatus", ["split"])
