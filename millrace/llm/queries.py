"""The registered corpus queries: thin contracts over the operators of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, fingerprints, infill, language, language_model, manifest, mixing, near_dedup, packing, pii, quality_model, quality_rules, secrets
from millrace.llm.text import documents, fold_is

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("op1_quality_rules", quality_rules.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return out.drop("text").withColumns({f"kept_{v}": quality_rules.passes(v) for v in ("v1", "v2")})


@query("rule_ablation", quality_rules.ABLATION_ORACLE)
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablation(quality_rules.ledger(documents(spark, sf_dir).select("doc_id", "text")))


@query("op2_secret_scan", secrets.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["rank"] < len(secrets.BASE_RULES))
    count = lambda n: F.size(F.filter("secret_spans", lambda s: s["rank"] == n)).cast("long")
    return found.select(
        "doc_id",
        *(count(n).alias(f"n_{r.kind}") for n, r in enumerate(secrets.BASE_RULES)),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secret_spans")).alias("spans"),
    )


@query("op10_source_mixing", mixing.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), path)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op6_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(documents(spark, sf_dir))


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = pii.scan(docs, pii.train(negatives=pii.hard_negatives(docs)))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in pii.BASE_KINDS),
        F.sha2(pii.spans_text(F.filter("pii_spans", lambda s: s["base"])), 256).alias("base_sha256"),
        pii.spans_text(F.col("pii_spans")).alias("spans"),
    )


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_is(F.col("doc_id"), 5, 0)
    model = language.fit(docs, F.col("doc_id").isNotNull() & ~held_out)
    return language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold_is(F.col("doc_id"), 5, 0)
    model = quality_model.fit(docs, documents(spark, sf_dir, "labels"), F.col("doc_id").isNotNull() & ~held_out)
    return quality_model.predict(docs.select("*", held_out.alias("held_out")), model).drop("text")


@query("op5_near_dedup", near_dedup.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=2)


@query("op4_lm_scores")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold_is(F.col("doc_id"), 7, 2)
    scored = language_model.score(documents(spark, sf_dir), F.col("doc_id").isNotNull() & ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: crc32 of a number's digits, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length($k) + 1), lambda i: ascii(substr($k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
LEAF_SQL = "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS) + ")"
#: Trees level by level, for the languages and, over their roots, for the table; paths and folds climb them once more.
MANIFEST_SQL = f"""WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '') AS tree, coalesce({CRC32_SQL.replace("$k", "doc_id::VARCHAR")} % 7 = 0, false) AS bad FROM documents),
l AS (SELECT doc_id, tree, {LEAF_SQL} AS leaf, CASE WHEN bad THEN {LEAF_SQL.replace("n_chars", "(n_chars + 1)")} ELSE {LEAF_SQL} END AS changed FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (SELECT tree, 0 AS level, place, leaf AS h, n FROM r
  UNION ALL SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY tree, level, place // 2, n),
g AS (SELECT tree, h AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
w AS (SELECT 0 AS level, place, subroot AS h, n FROM g
  UNION ALL SELECT level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM w WHERE n > 1 GROUP BY level, place // 2, n),
s AS (SELECT r.tree, r.place, g.height + w.level AS step, w.h, (g.place >> w.level) % 2 = 1 AS to_left, xor(g.place >> w.level, 1) = w.place AS other
    FROM r JOIN g USING (tree) JOIN w ON w.n > 1 AND w.place // 2 = (g.place >> w.level) // 2
  UNION ALL SELECT r.tree, r.place, t.level, t.h, (r.place >> t.level) % 2 = 1, xor(r.place >> t.level, 1) = t.place
    FROM r JOIN t ON t.tree = r.tree AND t.n > 1 AND t.place // 2 = (r.place >> t.level) // 2),
e AS (SELECT tree, place, step, max(h) FILTER (other) AS h, bool_or(to_left) AS to_left FROM s GROUP BY tree, place, step),
f AS (SELECT tree, place, 0 AS step, changed AS h FROM r
  UNION ALL SELECT f.tree, f.place, f.step + 1, sha256(CASE WHEN e.h IS NULL THEN f.h WHEN e.to_left THEN e.h || f.h ELSE f.h || e.h END) FROM f JOIN e USING (tree, place, step)),
x AS (SELECT tree, place, arg_max(h, step) AS folded FROM f GROUP BY tree, place),
p AS (SELECT tree, place, sha256(coalesce(string_agg(h, '' ORDER BY step), '')) AS proof FROM e GROUP BY tree, place)
SELECT r.doc_id, r.leaf, g.subroot, z.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, x.folded AS folded_root, x.folded = z.h AS verified
FROM r JOIN g USING (tree) JOIN x ON x.tree = r.tree AND x.place = r.place LEFT JOIN p ON p.tree = r.tree AND p.place = r.place, (SELECT h FROM w WHERE n = 1) z"""


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*FIELDS)
    tampered = fold_is(F.col("doc_id"), 7, 0)
    changed = manifest.leaf([F.try_add("n_chars", F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS])
    proved = manifest.manifest(docs, list(FIELDS), carry={"changed": F.when(tampered, changed)})
    folded = manifest.fold(F.coalesce("changed", "leaf"), F.col("steps"))
    out = proved.select("doc_id", "leaf", "subroot", "root", manifest.siblings_digest(F.col("steps")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


INFILL_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


@query("op12_fill_in_middle", INFILL_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(documents(spark, sf_dir).select("doc_id", "text"), path, ids=False)
