"""Text cleaning, tokenising and vocabularies, as expressions and joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.storage import stored
from millrace.operators.clean import keep_first

#: Wrongly decoded sequences and what they stand for, in the order they are replaced.
MOJIBAKE = [
    ("â€™", "'"), ("â€œ", '"'), ("â€", '"'), ("Ã¡", "á"), ("Ã©", "é"), ("Ã­", "í"), ("Ã³", "ó"), ("Ãº", "ú"), ("Ã±", "ñ"),
]
#: ASCII punctuation, and the stopwords that are dropped.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOPWORDS = (
    "a an and are as at be by for from has he in is it its of on that the to was will with this but they have had what said each which she do how their "
    "if up out many then them these so some her would make like into him time two more go no way could my than first been call who oil sit now find down "
    "day did get come made may part"
).split()
TOKEN = r"[\p{L}\p{N}_]+"
SHORTEST = 3


def fix_encoding(text: Column) -> Column:
    for wrong, right in MOJIBAKE:
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def no_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def no_stopwords(text: Column) -> Column:
    """Words that aren't stopwords in any case, joined by single spaces."""
    words = F.split(normalize_space(text), " ")
    return F.array_join(F.filter(words, lambda w: ~F.lower(w).isin(STOPWORDS)), " ")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def drop_short(df: DataFrame, text: str, least: int = SHORTEST) -> DataFrame:
    """Rows whose stripped text has ``least`` characters or more; null texts go."""
    return df.where(F.length(strip(F.col(text))) >= least)


def dedup(df: DataFrame, text: str, key: str) -> DataFrame:
    """First row of each text, case and outer white space aside."""
    return keep_first(df, [F.md5(F.lower(strip(F.col(text))))], key)


def clean(df: DataFrame, text: str, key: str, encoding: bool = True, space: bool = True, least: int = SHORTEST, duplicates: bool = True) -> DataFrame:
    """Encoding repair, white space, short texts, duplicates, in this order."""
    value = F.col(text)
    value = fix_encoding(value) if encoding else value
    value = normalize_space(value) if space else value
    out = drop_short(df.withColumn(text, value), text, least)
    return dedup(out, text, key) if duplicates else out


def prepared(text: Column, lowercase=True, punctuation=False, stopwords=False, most: int | None = None) -> Column:
    """Lower case, then punctuation out, then stopwords out, then cut: as configured, in this order."""
    text = F.lower(text) if lowercase else text
    text = no_punctuation(text) if punctuation else text
    text = no_stopwords(text) if stopwords else text
    return F.substring(text, 1, most) if most is not None else text


#: First characters by which a vocabulary is dealt out to be ranked.
HEAD = 2
#: Rows, and about as many tokens, whose distinct tokens are looked up together.
CHUNK, CHUNK_TOKENS = 1_000, 2_000_000


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, id) of the sorted distinct tokens, ids from 0."""
    return numbered(df.select(F.explode(tokens(F.col(text))).alias("token")))


def numbered(found: DataFrame) -> DataFrame:
    """(token, id) of the distinct ones of ``token``, sorted, ids from 0.

    The distinct tokens are stored, so that the texts are read once. Ids come from counts of their first characters and a rank
    among the tokens that share these, so no task ranks the whole vocabulary.
    """
    distinct = stored(found.select("token").distinct()).withColumn("_head", F.substring("token", 1, HEAD))
    heads = distinct.groupBy("_head").agg(F.count("*").alias("n")).withColumn("_before", F.sum("n").over(W.orderBy("_head")) - F.col("n"))
    ranked = distinct.withColumn("_rank", F.row_number().over(W.partitionBy("_head").orderBy("token")) - 1)
    return ranked.join(heads, "_head").select("token", (F.col("_before") + F.col("_rank")).cast("long").alias("id"))


def coded(df: DataFrame, text: str, key: str) -> DataFrame:
    """Stored (chunk, key, codes) of each row and (chunk, code, token) of each distinct token of its chunk; a code is a token's place among these."""
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("chunk", T.StringType()), T.StructField(key, kind), T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("code", T.IntegerType()), T.StructField("token", T.StringType())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(ends, before + CHUNK_TOKENS, "right")))
                keys, lists = batch.column(0)[start:end], batch.column(1)[start:end]
                seen = lists.flatten().dictionary_encode()
                codes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends[start:end] - before)), pa.int32()), seen.indices)
                held, found, chunk = len(keys), len(seen.dictionary), f"{task}-{n}"
                yield made([pa.repeat(chunk, held), keys, codes, pa.nulls(held, pa.int32()), pa.nulls(held, pa.string())])
                if found:
                    yield made([pa.repeat(chunk, found), pa.nulls(found, keys.type), pa.nulls(found, codes.type), pa.array(np.arange(found), pa.int32()), seen.dictionary])
                start, n = end, n + 1

    def made(columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return stored(df.select(key, tokens(F.col(text)).alias("_tokens")).mapInArrow(chunks, schema), CHUNK)


def token_ids(df: DataFrame, text: str, key: str, vocab: DataFrame | None = None, unknown: int = 0) -> DataFrame:
    """(key, ids) of each row: its text's tokens as vocabulary ids in order, ``unknown`` for tokens that aren't in it.

    Without ``vocab`` it is the texts' own, made of the chunks' tokens. Only a chunk's distinct tokens meet the vocabulary; its rows then look up their codes among the ids found.
    """
    table = coded(df, text, key)
    entries = table.where("token IS NOT NULL").select("chunk", "code", "token")
    vocab = numbered(entries) if vocab is None else vocab
    found = entries.join(vocab, "token", "left").select(F.col("chunk").alias("_chunk"), "code", F.coalesce("id", F.lit(unknown)).cast("long").alias("id"))
    rows = table.where("codes IS NOT NULL").select("chunk", key, "codes")

    def looked_up(rows: pa.Table, found: pa.Table) -> pa.Table:
        ids = np.zeros(found.num_rows, np.int64)
        ids[found["code"].to_numpy()] = found["id"].to_numpy()
        lists = rows["codes"].combine_chunks()
        values = pa.array(ids[lists.flatten().to_numpy()])
        lengths = pc.list_value_length(lists).to_numpy()
        return pa.table({key: rows[key], "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), values)})

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.LongType()))])
    return rows.groupBy("chunk").cogroup(found.groupBy("_chunk")).applyInArrow(looked_up, schema)
