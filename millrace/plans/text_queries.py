"""Queries over texts, files and requests: cleaning, tokenising, detection, serving, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.columns import half_up, hash_int
from millrace.operators import augment, bench_compare, clean, serving, text
from millrace.plans.registry import query
from millrace.sources import modality, readers
from millrace.streaming import events as stream

BROKEN = "CASE WHEN doc_id % 7 = 0 THEN concat('Itâ€™s a â€œgreatâ€ cafÃ© ', text) ELSE text END"


def replaced_sql(value: str) -> str:
    for wrong, right in text.MOJIBAKE:
        value = f"replace({value}, '{wrong}', '{right.replace(chr(39), chr(39) * 2)}')"
    return value


SPACED = r"trim(regexp_replace({v}, '\s+', ' ', 'g'))"
STRIPPED = r"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


@query("text_fix_encoding", f"SELECT doc_id, {replaced_sql(BROKEN)} AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", text.fix_encoding(F.expr(BROKEN)).alias("text"))


PADDED = "CASE WHEN doc_id % 5 = 0 THEN concat('  ', text, '   ') ELSE text END"


@query("text_normalize_ws", f"SELECT doc_id, {SPACED.format(v=PADDED)} AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", text.normalize_space(F.expr(PADDED)).alias("text"))


BLANKED = "CASE WHEN doc_id % 50 = 0 THEN ' a ' ELSE text END"


@query("text_drop_short", f"SELECT doc_id FROM documents WHERE length({STRIPPED.format(v=BLANKED)}) >= 3")
def _(t):
    return text.drop_short(t("documents").select("doc_id", F.expr(BLANKED).alias("text")), "text").select("doc_id")


SHOUTED = "CASE WHEN doc_id % 11 = 0 THEN concat('  ', translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) ELSE text END"


@query("text_dedup_first", f"WITH u AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000, {SHOUTED} FROM documents) SELECT min(doc_id) AS doc_id FROM u GROUP BY lower({STRIPPED.format(v='text')})")
def _(t):
    d = t("documents").select("doc_id", "text")
    again = d.select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.expr(SHOUTED).alias("text"))
    return text.dedup(d.unionAll(again), "text", "doc_id").select("doc_id")


@query("clean_report", f"WITH c AS (SELECT doc_id, {SPACED.format(v=replaced_sql('text'))} AS text FROM documents), s AS (SELECT * FROM c WHERE length(text) >= 3), d AS (SELECT count(DISTINCT lower(text)) AS a FROM s), b AS (SELECT count(*) AS b FROM documents) SELECT b AS samples_before, a AS samples_after, b - a AS removed, 5 AS features_before, 2 AS features_after, round((b - a)::DOUBLE / b, 6) AS removed_ratio FROM b, d")
def _(t):
    d = t("documents")
    after = text.clean(d.select("doc_id", "text"), "text", "doc_id")
    return clean.report(d, after, len(d.columns), len(after.columns))


PUNCT = text.PUNCTUATION.replace("'", "''")


@query("text_lowercase_punct", f"SELECT doc_id, translate(lower(text), '{PUNCT}', '') AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", text.prepared(F.col("text"), punctuation=True).alias("text"))


@query("text_stopwords", "SELECT doc_id, array_to_string(list_filter(string_split(" + SPACED.format(v="lower(text)") + ", ' '), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + ")), ' ') AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", text.prepared(F.col("text"), stopwords=True).alias("text"))


@query("text_truncate", "SELECT doc_id, substr(lower(text), 1, 100) AS text FROM documents")
def _(t):
    return t("documents").select("doc_id", text.prepared(F.col("text"), most=100).alias("text"))


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("text_tokenize", f"SELECT doc_id, len({TOKENS})::INTEGER AS n_tokens, md5(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def _(t):
    words = text.tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(words).alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("digest"))


VOCAB = f"v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT unnest({TOKENS}) AS token FROM documents))"


@query("text_vocab", f"WITH {VOCAB} SELECT token, id FROM v")
def _(t):
    return text.vocabulary(t("documents"), "text")


@query("text_token_ids", f"WITH {VOCAB}, w AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS pos FROM documents), i AS (SELECT doc_id, pos, coalesce(id, 0) AS id FROM w LEFT JOIN v USING (token)) SELECT d.doc_id, coalesce(string_agg(id::VARCHAR, ',' ORDER BY pos), '') AS ids FROM documents d LEFT JOIN i USING (doc_id) GROUP BY d.doc_id")
def _(t):
    ids = text.token_ids(t("documents"), "text", "doc_id")
    return ids.select("doc_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def int_sql(salt: str, key: str = "doc_id") -> str:
    return f"('0x' || substr(md5('{salt}' || {key}::VARCHAR), 1, 8))::BIGINT"


WORDS = f"w AS (SELECT doc_id, string_split({SPACED.format(v='text')}, ' ') AS w FROM documents)"


@query("augment_text_swap", f"WITH {WORDS}, p AS (SELECT doc_id, w, {int_sql('swap1:')} % len(w) + 1 AS i, {int_sql('swap2:')} % len(w) + 1 AS j FROM w) SELECT doc_id, array_to_string(list_transform(w, lambda x, k: CASE WHEN k = i THEN w[j] WHEN k = j THEN w[i] ELSE x END), ' ') AS text FROM p")
def _(t):
    return augment.text_with(t("documents").select("doc_id", "text"), "text", "doc_id", "swap")


@query("augment_text_insert", f"WITH {WORDS}, p AS (SELECT doc_id, w, {int_sql('ins:')} % (len(w) + 1) AS i, (ARRAY[" + ", ".join(f"'{x}'" for x in augment.INSERTED) + f"])[{int_sql('word:')} % {len(augment.INSERTED)} + 1] AS x FROM w) SELECT doc_id, array_to_string(list_concat(list_concat(w[1:i], [x]), w[i+1:]), ' ') AS text FROM p")
def _(t):
    return augment.text_with(t("documents").select("doc_id", "text"), "text", "doc_id", "insert")


@query("augment_text_delete", f"WITH {WORDS}, p AS (SELECT doc_id, w, {int_sql('del:')} % len(w) + 1 AS i FROM w) SELECT doc_id, array_to_string(CASE WHEN len(w) > 2 THEN list_concat(w[1:i-1], w[i+1:]) ELSE w END, ' ') AS text FROM p")
def _(t):
    return augment.text_with(t("documents").select("doc_id", "text"), "text", "doc_id", "delete")


#: Whole texts, with common words in place of others so that many have synonyms.
SYNONYM_TEXT = "replace(replace(replace(text, ' the ', ' Good '), ' de ', ' fast '), ' und ', ' big ')"


@query("augment_text_synonym", "WITH s(w, o) AS (VALUES " + ", ".join(f"('{w}', [{', '.join(chr(39) + x + chr(39) for x in o)}])" for w, o in augment.SYNONYMS.items()) + f"), d AS (SELECT doc_id, string_split({SPACED.format(v=SYNONYM_TEXT)}, ' ') AS w FROM documents), p AS (SELECT doc_id, w, {int_sql('syn:')} % len(w) AS i FROM d) SELECT doc_id, array_to_string(CASE WHEN o IS NULL THEN p.w ELSE list_concat(list_concat(p.w[1:i], [o[{int_sql('pick:')} % len(o) + 1]]), p.w[i+2:]) END, ' ') AS text FROM p LEFT JOIN s ON s.w = lower(p.w[i+1])")
def _(t):
    return augment.text_with(t("documents").select("doc_id", F.expr(SYNONYM_TEXT).alias("text")), "text", "doc_id", "synonym")


def befalls(name: str) -> str:
    return f"({int_sql(name + '?:')} / 4294967296.0::DOUBLE < 0.1 AND len(w) >= 2)"


#: The four operations one after the other, each on a tenth of the rows.
CHAIN = f"""{WORDS}, p1 AS (SELECT doc_id, w, {int_sql('swap1:')} % len(w) + 1 AS i, {int_sql('swap2:')} % len(w) + 1 AS j FROM w),
a1 AS (SELECT doc_id, CASE WHEN {befalls('swap')} THEN list_transform(w, lambda x, k: CASE WHEN k = i THEN w[j] WHEN k = j THEN w[i] ELSE x END) ELSE w END AS w FROM p1),
s(word, o) AS (VALUES """ + ", ".join(f"('{w}', [{', '.join(chr(39) + x + chr(39) for x in o)}])" for w, o in augment.SYNONYMS.items()) + f"""), p2 AS (SELECT doc_id, w, {int_sql('syn:')} % len(w) AS i FROM a1),
a2 AS (SELECT doc_id, CASE WHEN {befalls('synonym')} AND o IS NOT NULL THEN list_concat(list_concat(w[1:i], [o[{int_sql('pick:')} % len(o) + 1]]), w[i+2:]) ELSE w END AS w FROM p2 LEFT JOIN s ON s.word = lower(w[i+1])),
p3 AS (SELECT doc_id, w, {int_sql('ins:')} % (len(w) + 1) AS i, (ARRAY[""" + ", ".join(f"'{x}'" for x in augment.INSERTED) + f"""])[{int_sql('word:')} % {len(augment.INSERTED)} + 1] AS x FROM a2),
a3 AS (SELECT doc_id, CASE WHEN {befalls('insert')} THEN list_concat(list_concat(w[1:i], [x]), w[i+1:]) ELSE w END AS w FROM p3),
p4 AS (SELECT doc_id, w, {int_sql('del:')} % len(w) + 1 AS i FROM a3),
a4 AS (SELECT doc_id, array_to_string(CASE WHEN {befalls('delete')} AND len(w) > 2 THEN list_concat(w[1:i-1], w[i+1:]) ELSE w END, ' ') AS text FROM p4)"""


@query("augment_union_counts", f"WITH {CHAIN} SELECT generated, count(*) AS n, sum({int_sql('', 'text')})::BIGINT AS digest FROM (SELECT false AS generated, text FROM documents UNION ALL SELECT true, text FROM a4) GROUP BY generated")
def _(t):
    both = augment.texts(t("documents").select("doc_id", "text"), "text", "doc_id")
    return both.groupBy("generated").agg(F.count("*").alias("n"), F.sum(hash_int(F.col("text"), "")).alias("digest"))


# Detection

PATHS = [f"/data/set{n % 3}/file{n}.{e.upper() if n % 2 else e}" for n, e in enumerate(e for names in modality.EXTENSIONS.values() for e in names)] + ["/data/set1/readme", "/data/set2/x.unknown"]
PATH_ROWS = "paths(path) AS (VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ")"
EXT = r"lower(regexp_extract({p}, '[^/]\.([^./?#]+)$', 1))"


def kind_sql(path: str) -> str:
    ext = EXT.format(p=path)
    return "CASE " + " ".join(f"WHEN {ext} IN ({', '.join(chr(39) + n + chr(39) for n in names)}) THEN '{kind}'" for kind, names in modality.EXTENSIONS.items()) + " ELSE 'unknown' END"


def paths(t):
    spark = t("documents").sparkSession
    return spark.createDataFrame([(p,) for p in PATHS], "path string")


@query("detect_extension", f"WITH {PATH_ROWS} SELECT path, {kind_sql('path')} AS modality FROM paths UNION ALL SELECT url, {kind_sql('url')} FROM pages")
def _(t):
    both = paths(t).unionAll(t("pages").select("url"))
    return both.select("path", modality.by_extension(F.col("path")).alias("modality"))


@query("supported_extensions", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{e}')" for k, names in modality.EXTENSIONS.items() for e in names) + ") v(modality, extension)")
def _(t):
    return modality.supported_extensions(t("documents").sparkSession)


@query("directory_majority", f"WITH {PATH_ROWS} SELECT modality, count(*) AS n FROM (SELECT {kind_sql('path')} AS modality FROM paths) WHERE modality <> 'unknown' GROUP BY modality ORDER BY n DESC, modality LIMIT 1")
def _(t):
    return modality.directory_majority(paths(t))


MIMES = "CASE doc_id % 8 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/csv' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'application/json' WHEN 4 THEN 'audio/x-wav' WHEN 5 THEN 'video/mp4' WHEN 6 THEN 'application/zip' END"
MIME_SQL = "CASE " + " ".join(f"WHEN m = '{m}' THEN '{k}'" for m, k in modality.MIME_EXACT.items()) + " " + " ".join(f"WHEN starts_with(m, '{f}/') THEN '{f}'" for f in modality.MIME_FAMILIES) + " ELSE 'unknown' END"


@query("detect_mime", f"SELECT doc_id, {MIME_SQL} AS modality FROM (SELECT doc_id, {MIMES} AS m FROM documents)")
def _(t):
    return t("documents").select("doc_id", modality.by_mime(F.expr(MIMES)).alias("modality"))


TABLED = "CASE WHEN doc_id % 3 = 0 THEN concat('a,b,c', chr(10), doc_id::STRING, ',2,3', chr(10), 'x,y,z') WHEN doc_id % 3 = 1 THEN concat('a;b', chr(10), 'no delimiter') ELSE text END"


def delimiter_sql(d: str) -> str:
    n = lambda line: f"(length({line}) - length(replace({line}, {d}, '')))"
    near = lambda i: f"(len(l) < {i} OR abs({n(f'l[{i}]')} - {n('l[1]')}) <= 1)"
    return f"({n('l[1]')} > 0 AND {near(2)} AND {near(3)})"


@query("detect_text_format", rf"WITH c AS (SELECT doc_id, string_split(regexp_replace({TABLED.replace('::STRING', '::VARCHAR')}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), chr(10)) AS l FROM documents) SELECT doc_id, CASE WHEN len(l) >= 2 AND (" + " OR ".join(map(delimiter_sql, ("','", "chr(9)", "';'"))) + ") THEN 'tabular' ELSE 'text' END AS format FROM c")
def _(t):
    return t("documents").select("doc_id", modality.by_text(F.expr(TABLED)).alias("format"))


MAGIC = {0: "89504E470D0A1A0A00", 1: "FFD8FFE000", 2: "4944330300", 3: "5249464600", 4: "664C614300", 5: "00000018667479706D7034", 6: "DEADBEEF00", 7: "68656C6C6F"}
MAGIC_SQL = "CASE doc_id % 8 " + " ".join(f"WHEN {n} THEN {{f}}('{h}')" for n, h in MAGIC.items()) + " END"
FOUND_SQL = "CASE doc_id % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'audio' WHEN 3 THEN 'image' WHEN 4 THEN 'audio' WHEN 5 THEN 'video' WHEN 6 THEN 'unknown' END"


@query("detect_binary", f"SELECT doc_id, {FOUND_SQL} AS modality FROM documents")
def _(t):
    return t("documents").select("doc_id", modality.by_bytes(F.expr(MAGIC_SQL.format(f="unhex"))).alias("modality"))


RECORD = "CASE conv_id % 3 WHEN 0 THEN to_json({s}('content', text, 'role', role)) WHEN 1 THEN to_json({s}('role', role, 'message', text)) ELSE to_json({s}('role', role)) END"


@query("json_text_field", "SELECT conv_id, turn, CASE conv_id % 3 WHEN 2 THEN '{\"role\":\"' || role || '\"}' ELSE text END AS text FROM conversations")
def _(t):
    record = F.when(F.col("conv_id") % 3 == 0, F.to_json(F.struct(F.col("text").alias("content"), "role"))).when(F.col("conv_id") % 3 == 1, F.to_json(F.struct("role", F.col("text").alias("message")))).otherwise(F.to_json(F.struct("role")))
    return t("conversations").select("conv_id", "turn", readers.text_of_json(record).alias("text"))


@query("json_flatten", "SELECT event_id, (props->>'$.k')::BIGINT AS \"props.k\" FROM events")
def _(t):
    e = t("events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return readers.flattened(e)


# Serving


@query("serving_metrics", "SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed, round(100.0::DOUBLE * count(*) FILTER (event_type <> 'error') / count(*), 6) AS success_percent, round(avg(value), 6) AS mean_duration FROM events")
def _(t):
    return serving.request_metrics(t("events").withColumn("failed", F.col("event_type") == "error"), "failed", "value")


@query("serving_errors", "SELECT event_type AS error, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return serving.errors_by(t("events"), "event_type")


@query("serving_rolling_latency", "SELECT event_id, round(avg(sqrt(abs(value))) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 4) AS rolling_mean FROM events")
def _(t):
    return serving.rolling_mean(t("events").withColumn("latency", F.sqrt(F.abs("value"))), "latency", ["ts", "event_id"], 1000, ["event_type"]).select("event_id", F.round("rolling_mean", 4).alias("rolling_mean"))


@query("rate_limiter", """WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT user_id, rn, event_id, ts, true AS allowed, NULL::TIMESTAMP AS before, ts AS last FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn, e.event_id, e.ts, w.before IS NULL OR w.before <= e.ts - INTERVAL 1 DAY,
  CASE WHEN w.before IS NULL OR w.before <= e.ts - INTERVAL 1 DAY THEN w.last ELSE w.before END,
  CASE WHEN w.before IS NULL OR w.before <= e.ts - INTERVAL 1 DAY THEN e.ts ELSE w.last END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
SELECT event_id, allowed FROM w""")
def _(t):
    return serving.rate_limited(t("events"), "user_id", "ts", "event_id", limit=2, window_s=86_400)


SUITE = "SELECT event_type AS name, round(avg(value), 6) AS duration, round(max(value), 6) AS memory FROM events WHERE event_id % 2 = {p} GROUP BY event_type"


SUITE_OF_ALL = SUITE.replace(" WHERE event_id % 2 = {p}", "")


def suite(t, parity: int | None = None):
    """Durations and memory by event type, of all events or of the even or odd ones: two runs to compare."""
    events = t("events") if parity is None else t("events").where(F.col("event_id") % 2 == parity)
    return events.groupBy(F.col("event_type").alias("name")).agg(half_up(F.avg("value")).alias("duration"), half_up(F.max("value")).alias("memory"))


@query("bench_summary", "SELECT count(*) AS benchmarks, round(sum(duration), 6) AS total, round(avg(duration), 6) AS mean, round(min(duration), 6) AS fastest, round(max(duration), 6) AS slowest FROM (" + SUITE_OF_ALL + ")")
def _(t):
    return bench_compare.summary(suite(t))


@query("bench_compare", f"WITH a AS ({SUITE.format(p=0)}), b AS ({SUITE.format(p=1)}), c AS (SELECT a.name, (b.duration - a.duration) / a.duration AS d, (b.memory - a.memory) / a.memory AS m FROM a JOIN b ON a.name = b.name) SELECT name, round(d, 6) AS duration_change, round(m, 6) AS memory_change, CASE WHEN greatest(d, m) > 0.1 THEN 'regression' WHEN least(d, m) < -0.1 THEN 'improvement' ELSE 'same' END AS verdict FROM c")
def _(t):
    return bench_compare.compare(suite(t, 0), suite(t, 1))


# Windows over event time; the streams of the same functions are tested against these.


@query("event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(t):
    out = stream.windowed_counts(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    out = stream.sessions(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
