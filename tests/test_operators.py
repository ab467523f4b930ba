"""Operators on small literals with exact expectations."""

import math
import os
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F

from millrace.functions.columns import nan_to_null
from millrace.operators import augment, bench_compare, clean, ensemble, features, metrics, models, profile, quality, ranges, serving, split, text, transform
from millrace.sources import modality, readers
from millrace.streaming import events as stream


def one(df):
    return df.collect()[0]


def test_impute_mean(spark):
    df = nan_to_null(spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, math.nan, 6.0), (7.0, 8.0, math.nan), (10.0, 11.0, 12.0)], "a double, b double, c double"))
    got = clean.impute(df, ["a", "b", "c"]).orderBy("a").collect()
    assert [r.b for r in got] == [2.0, 7.0, 8.0, 11.0] and [r.c for r in got] == [3.0, 6.0, 7.0, 12.0]


def test_impute_mode_and_median(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (5.0,), (None,)], "a double")
    assert sorted(r.a for r in clean.impute(df, ["a"], "mode").collect()) == [1.0, 1.0, 1.0, 5.0]
    assert sorted(r.a for r in clean.impute(df, ["a"], "median").collect()) == [1.0, 1.0, 1.0, 5.0]


def test_clip_iqr_and_zscore(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 100, 5)], "a double")
    assert sorted(r.a for r in clean.clip(df, ["a"]).collect()) == [1.0, 2.0, 3.0, 5.0, 9.5]
    assert one(clean.outlier_counts(df, ["a"], "zscore", 2.0)).n == 0


def test_dedup(spark):
    rows = spark.createDataFrame([(0, 1, 2, 3), (1, 4, 5, 6), (2, 1, 2, 3), (3, 7, 8, 9)], "k int, a int, b int, c int")
    assert sorted(r.k for r in clean.dedup_features(rows, ["a", "b", "c"], "k").collect()) == [0, 1, 3]
    texts = spark.createDataFrame(list(enumerate(["Hello world", "Different text", "hello world", "Another text"])), "k int, t string")
    assert sorted(r.k for r in text.dedup(texts, "t", "k").collect()) == [0, 1, 3]


def value(spark, column, **inputs):
    return one(spark.createDataFrame([tuple(inputs.values())], list(inputs)).select(column.alias("v"))).v


def test_text_cleaning(spark):
    c = F.col("t")
    assert value(spark, text.fix_encoding(c), t="Itâ€™s a â€œgreatâ€ day") == "It's a \"great\" day"
    assert value(spark, text.normalize_space(c), t="  This   has\tmultiple\n\nwhitespace   ") == "This has multiple whitespace"
    assert value(spark, text.prepared(c), t="Hello WORLD") == "hello world"
    assert value(spark, text.no_punctuation(c), t="Hello, world!") == "Hello world"
    assert value(spark, text.prepared(c, lowercase=False, most=5), t="Hello world") == "Hello"
    assert value(spark, text.no_stopwords(c), t="The cat and a  dog") == "cat dog"


def test_vocabulary_and_ids(spark):
    df = spark.createDataFrame([(0, "hello world"), (1, "world test"), (2, ""), (3, None)], "k int, t string")
    vocab = text.vocabulary(df, "t")
    assert {r.token: r.id for r in vocab.collect()} == {"hello": 0, "test": 1, "world": 2}
    ids = {r.k: r.ids for r in text.token_ids(df, "t", "k", vocab).collect()}
    assert ids == {0: [0, 2], 1: [2, 1], 2: [], 3: []}


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)], "a double, b double")
    got = one(transform.StandardScaler(["a", "b"]).fit(df).transform(df).agg(F.avg("a").alias("m"), F.stddev_pop("b").alias("s")))
    assert abs(got.m) < 1e-10 and abs(got.s - 1) < 1e-10
    with pytest.raises(transform.NotFitted):
        transform.StandardScaler(["a"]).transform(df)


def test_splits(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(12)], "k int, y int")
    got = split.stratified_split(df, "k", "y", 0.5, 0.25, 0.25).groupBy("y", "split").count().collect()
    assert sorted({(r.split, r["count"]) for r in got}) == [("test", 1), ("train", 2), ("validation", 1)]
    parts = split.random_split(df, "k").collect()
    assert len({r.k for r in parts}) == 12 and sorted(r.split for r in parts).count("train") == 8
    again = {r.k: r.split for r in split.random_split(df.repartition(5), "k").collect()}
    assert again == {r.k: r.split for r in parts}
    assert sorted(r.fold for r in split.folds(df, "k", 4).collect()) == sorted([0, 1, 2, 3] * 3)
    with pytest.raises(ValueError):
        split.check_ratios(0.5, 0.2, 0.2)


def test_binary_metrics(spark):
    y, p = [0, 1, 1, 0, 1, 0, 1, 1, 0, 0], [0, 1, 0, 0, 1, 1, 1, 1, 0, 0]
    got = one(metrics.binary(spark.createDataFrame(list(zip(y, p)), "y int, p int"), "y", "p"))
    assert (got.tp, got.fp, got.fn, got.tn) == (4, 1, 1, 4)
    assert (got.accuracy, got.precision, got.recall, got.f1) == (0.8, 0.8, 0.8, 0.8)


def test_multiclass_accuracy(spark):
    y, p = [0, 1, 2, 0, 1, 2, 0, 1, 2, 0], [0, 1, 1, 0, 2, 2, 0, 1, 2, 1]
    assert one(metrics.accuracy(spark.createDataFrame(list(zip(y, p)), "y int, p int"), "y", "p")).accuracy == 0.7


def test_auc_with_ties_and_mape_of_zeros(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert one(metrics.auc(df, F.col("y") == 1, F.col("s"))).auc == 0.625
    assert one(metrics.regression(spark.createDataFrame([(0.0, 1.0)], "y double, p double"), "y", "p")).mape == math.inf


def test_quality_rules(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (1.0, math.inf, 2.0), (1.0, 3.0, 4.0)], "a double, b double, c double")
    assert [(r.severity, r.feature) for r in quality.constant(df, ["a", "b", "c"]).collect()] == [("warning", "a")]
    assert [(r.severity, r.feature, r.n) for r in quality.infinite(df, ["a", "b", "c"]).collect()] == [("error", "b", 1)]
    assert one(quality.missing(df, ["a", "b", "c"])).severity == "error"
    assert quality.empty(df).count() == 0 and quality.empty(df.limit(0)).count() == 1


def test_empty_tables_are_no_error(spark):
    df = spark.createDataFrame([], "k int, a double, t string")
    assert clean.clip(clean.impute(df, ["a"]), ["a"]).count() == 0
    assert text.clean(df, "t", "k").count() == 0 and split.random_split(df, "k").count() == 0
    assert profile.numeric(df, ["a"]).collect()[0].missing == 0


def test_votes(spark):
    votes = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0), (2, 1, 1.0), (2, 0, 0.5)], "k int, v int, w double")
    assert {r.k: r.vote for r in ensemble.hard_vote(votes, "k", "v").collect()} == {1: 0, 2: 0}
    assert {r.k: r.vote for r in ensemble.hard_vote(votes, "k", "v", "w").collect()} == {1: 0, 2: 1}


def test_benchmark_regression(spark):
    a = spark.createDataFrame([("x", 1.0, 100.0), ("y", 1.0, 0.0)], "name string, duration double, memory double")
    b = spark.createDataFrame([("x", 1.5, 150.0), ("y", 1.0, 5.0)], "name string, duration double, memory double")
    assert {r.name: r.verdict for r in bench_compare.compare(a, b).collect()} == {"x": "regression", "y": "same"}


def test_rate_limiter(spark):
    at = datetime(2024, 1, 1)
    rows = [(n, 1, at + timedelta(seconds=s)) for n, s in enumerate((0, 1, 2, 59, 60, 61, 62))]
    got = serving.rate_limited(spark.createDataFrame(rows, "id long, c int, ts timestamp"), "c", "ts", "id", 2, 60)
    assert [r.allowed for r in got.orderBy("id").collect()] == [True, True, False, False, True, True, False]


def test_augmentation_is_repeatable(spark):
    df = spark.createDataFrame([(i, "one two three four five") for i in range(50)], "k int, t string")
    a, b = (sorted((r.k, r.t, r.generated) for r in augment.texts(d, "t", "k", 0.5).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == 100 and len({t for _, t, _ in a}) > 5
    assert augment.text_with(df, "t", "k", "delete").where("size(split(t, ' ')) <> 4").count() == 0


def test_features(spark):
    df = spark.createDataFrame([(i, float(i) if i % 2 else None) for i in range(6)], "k int, v double")
    assert [r.v for r in features.filled(df, "v", ["k"], []).orderBy("k").collect()] == [None, 1.0, 1.0, 3.0, 3.0, 5.0]


def test_detection(spark):
    paths = {"/a/b.JPG": "image", "/a/b.csv": "tabular", "/a/b.jsonl": "unknown", "/a.d/b": "unknown", "x.mp3": "audio", "y.mkv": "video", "n.md": "text"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", modality.by_extension(F.col("p")).alias("m")).collect()
    assert {r.p: r.m for r in rows} == paths
    assert value(spark, modality.by_text(F.col("t")), t="a,b\n1,2\n3,4") == "tabular"
    assert value(spark, modality.by_text(F.col("t")), t="just one line") == "text"
    assert value(spark, modality.by_bytes(F.col("b")), b=bytearray(b"\x89PNG\r\n\x1a\n\x00")) == "image"
    assert value(spark, modality.by_bytes(F.col("b")), b=bytearray(b"plain text")) is None


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"content": "x"}\n{"other": 1}\n')
    assert sorted(r.text for r in readers.read(spark, str(tmp_path / "a.jsonl"), "text").collect()) == ["x", '{"other": 1}']
    (tmp_path / "b.json").write_text('[{"text": "p"}, {"body": "q"}]')
    assert sorted(r.text for r in readers.read(spark, str(tmp_path / "b.json")).collect()) == ["p", "q"]
    (tmp_path / "c.txt").write_text("  one \n\n two\n")
    assert [r.text for r in readers.read(spark, str(tmp_path / "c.txt")).collect()] == ["one", "two"]
    (tmp_path / "d.csv").write_text("a,b\n1,x\n2,y\n")
    assert readers.read(spark, str(tmp_path / "d.csv")).dtypes == [("a", "int"), ("b", "string")]
    feather.write_feather(pa.table({"a": [1.0, math.nan], "b": ["x", "y"]}), str(tmp_path / "e.feather"), compression="uncompressed")
    assert [(r.a, r.b) for r in readers.read(spark, str(tmp_path / "e.feather")).orderBy("b").collect()] == [(1.0, "x"), (None, "y")]
    with pytest.raises(readers.UnsupportedFormat):
        readers.read(spark, "x.h5")
    for kind in ("pos", "neg"):
        os.makedirs(tmp_path / "dir" / kind)
        (tmp_path / "dir" / kind / "1.txt").write_text(f"{kind} text")
    assert {(r.class_name, r.class_id) for r in readers.text_directory(spark, str(tmp_path / "dir")).collect()} == {("neg", 0), ("pos", 1)}


def test_target_separation(spark):
    df = spark.createDataFrame([(1, 2.0, 0)], "k int, a double, y int")
    x, y = readers.DatasetSpec("k", ("a", "y"), "y").separate(df)
    assert x.columns == ["k", "a"] and y.columns == ["k", "y"]
    with pytest.raises(readers.DataNotFound):
        readers.DatasetSpec("k", ("a",), "nope").separate(df)


def test_streams_agree_with_batches(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.event_stream(spark, str(tmp_path / "in"), table.schema)
    got = stream.run_available(stream.windowed_counts(live, "ts", ["event_type"]), str(tmp_path / "windows"), str(tmp_path / "ck1"))
    want = stream.windowed_counts(table.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    live = stream.event_stream(spark, str(tmp_path / "in"), table.schema)
    got = stream.run_available(stream.sessions(live, "ts", "user_id"), str(tmp_path / "sessions"), str(tmp_path / "ck2"))
    want = stream.sessions(table.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_models(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7), float(i % 10 > 4)) for i in range(200)], "k int, a double, b double, y double")
    out = models.out_of_fold(df, "decision_tree_classifier", ["a", "b"], "y", "k", 3)
    assert out.count() == 200 and out.where("prediction = y").count() > 190
    assert [r.name for r in models.ranked_models(models.registry_table(spark), "regression", 1000, "linear").limit(2).collect()] == ["linear_regression", "ridge"]


def test_formatting(spark):
    from millrace.functions.formatting import human_bytes, human_duration

    sizes = {0: "0.0 B", 1023: "1023.0 B", 1536: "1.5 KB", 5 * 1024**3: "5.0 GB"}
    assert {n: value(spark, human_bytes(F.col("n")), n=n) for n in sizes} == sizes
    times = {2.25: "2.25s", 65.0: "1m 5.0s", 3725.5: "1h 2m 5.5s"}
    assert {n: value(spark, human_duration(F.col("n")), n=n) for n in times} == times


def test_cumulative_in_groups(spark):
    rows = [(g, float(s), s + 1) for g in ("a", None) for s in range(10)] + [("one", 5.0, 7)]
    got = ranges.cumulative(spark.createDataFrame(rows, "g string, s double, v long"), "s", ["v"], ["g"]).collect()
    assert {(r.g, r.s): (r.upto_v, r.all_v) for r in got} == {(g, float(s)): ((s + 1) * (s + 2) // 2, 55) for g in ("a", None) for s in range(10)} | {("one", 5.0): (7, 7)}


def test_train_from_table_to_metrics(spark, tmp_path):
    from millrace import api

    rows = [(i, float(i % 10), None if i % 13 == 0 else float(i % 7), "high" if i % 10 > 4 else "low") for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y string")
    got = api.train(spark, df, "y", "k", model="decision_tree_classifier")
    assert got.task == "classification" and got.features == ["a", "b"]
    assert {r.metric: r.value for r in got.metrics.collect()}["accuracy"] == 1.0
    assert [r.category for r in got.issues.collect()] == ["missing"]
    api.deploy(got, str(tmp_path / "model"))
    assert api.PipelineModel.load(str(tmp_path / "model")).stages
    assert api.detect_task(df, "a") == "classification" and api.detect_task(df.withColumn("z", F.col("k") * 0.5), "z") == "regression"


def test_streamed_limiter_agrees_with_the_batch(spark, tmp_path):
    from millrace.streaming import limiter

    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    live = stream.event_stream(spark, str(tmp_path / "in"), table.schema)
    got = stream.run_available(limiter.rate_limited(live, "user_id", "ts", "event_id", 2, 86_400), str(tmp_path / "limited"), str(tmp_path / "ck"), "append")
    want = serving.rate_limited(table, "user_id", "ts", "event_id", 2, 86_400)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_small_guards(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 200.0)], "k int, v double")
    assert [(r.category, r.n) for r in quality.within(df, "v", 0, 150).collect()] == [("out_of_range", 1)]
    assert quality.within(df, "k", allowed=[1, 2]).count() == 0 and quality.first_rows(df, "k", 1).first().k == 1
    assert readers.require_rows(df, 2) is df
    with pytest.raises(readers.EngineError):
        readers.require_rows(df, 3)
    assert value(spark, transform.unit_pixels(F.col("i")), i=[[[255, 0]]]) == [[[1.0, 0.0]]]


def test_tokens_beyond_the_vocabulary_are_unknown(spark):
    docs = spark.createDataFrame([(1, "b a c"), (2, "zz a"), (3, ""), (4, None)], "doc_id long, text string")
    vocab = text.vocabulary(docs.where("doc_id = 1"), "text")
    assert [(r.token, r.id) for r in vocab.orderBy("id").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    got = {r.doc_id: r.ids for r in text.token_ids(docs, "text", "doc_id", vocab, unknown=9).collect()}
    assert got == {1: [1, 0, 2], 2: [9, 0], 3: [], 4: []}


def test_only_distinct_tokens_of_a_chunk_are_looked_up(spark, monkeypatch):
    """Chunks that end within and between rows, hot tokens, rows without any; no occurrence is exploded."""
    monkeypatch.setattr(text, "CHUNK_TOKENS", 40)
    rows = [(n, None if n % 13 == 0 else "" if n % 11 == 0 else " ".join(["the", f"w{n % 7}", "The"] * (n % 5) + [f"\u00e9{n}"] * 60 * (n % 17 == 0))) for n in range(200)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    words = {k: (t or "").lower().split() for k, t in rows}
    place = {w: n for n, w in enumerate(sorted({w for ws in words.values() for w in ws}))}
    own = text.token_ids(df, "t", "k")
    assert {r.k: r.ids for r in own.collect()} == {k: [place[w] for w in ws] for k, ws in words.items()} and own.count() == 200
    assert "Generate" not in own._jdf.queryExecution().optimizedPlan().toString()
    some = spark.createDataFrame([("the", 5)], "token string, id long")
    assert {r.k: r.ids for r in text.token_ids(df, "t", "k", some, unknown=-1).collect()} == {k: [5 if w == "the" else -1 for w in ws] for k, ws in words.items()}
