"""Augmentation: the originals and generated rows, made by hashes of the row key, so that reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import hash_int, hash_unit, only_row

#: Words with synonyms, and words that may be inserted.
SYNONYMS = {
    "good": ["great", "excellent", "fine", "nice"],
    "bad": ["poor", "terrible", "awful", "horrible"],
    "big": ["large", "huge", "enormous", "massive"],
    "small": ["tiny", "little", "miniature", "compact"],
    "fast": ["quick", "rapid", "swift", "speedy"],
    "slow": ["sluggish", "gradual", "leisurely", "delayed"],
    "happy": ["joyful", "cheerful", "glad", "pleased"],
    "sad": ["unhappy", "sorrowful", "depressed", "melancholy"],
}
INSERTED = ["the", "a", "an", "and", "or", "but", "very", "really", "quite"]


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def _place(key: Column, salt: str, n: Column) -> Column:
    return F.pmod(hash_int(key, salt), n)


def _given(body, **values: Column) -> Column:
    """``body`` over a struct of values: they are computed once a row, not once an element of what the body walks."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), body), F.lit(0))


def swapped(words: Column, key: Column) -> Column:
    """Two words change places."""

    def body(s: Column) -> Column:
        return F.transform(s["w"], lambda w, at: F.when(at == s["i"], F.get(s["w"], s["j"])).when(at == s["j"], F.get(s["w"], s["i"])).otherwise(w))

    n = F.size(words)
    return _given(body, w=words, i=_place(key, "swap1:", n).cast("int"), j=_place(key, "swap2:", n).cast("int"))


def synonym(words: Column, key: Column) -> Column:
    """One word, if it has synonyms, becomes one of them."""
    table = F.create_map(*(x for w, s in SYNONYMS.items() for x in (F.lit(w), F.array(*map(F.lit, s)))))

    def body(s: Column) -> Column:
        options = F.try_element_at(table, F.lower(F.get(s["w"], s["at"])))
        chosen = F.get(options, F.pmod(s["pick"], F.size(options)).cast("int"))
        changed = F.concat(F.slice(s["w"], F.lit(1), s["at"]), F.array(chosen), F.slice(s["w"], s["at"] + 2, F.size(s["w"])))
        return F.when(options.isNotNull(), changed).otherwise(s["w"])

    return _given(body, w=words, at=_place(key, "syn:", F.size(words)).cast("int"), pick=hash_int(key, "pick:"))


def inserted(words: Column, key: Column) -> Column:
    """A common word comes in somewhere."""
    word = F.get(F.array(*map(F.lit, INSERTED)), _place(key, "word:", F.lit(len(INSERTED))).cast("int"))
    body = lambda s: F.concat(F.slice(s["w"], F.lit(1), s["at"]), F.array(s["word"]), F.slice(s["w"], s["at"] + 1, F.size(s["w"])))
    return _given(body, w=words, at=_place(key, "ins:", F.size(words) + 1).cast("int"), word=word)


def deleted(words: Column, key: Column) -> Column:
    """A word goes, if there are more than two."""

    def body(s: Column) -> Column:
        left = F.concat(F.slice(s["w"], F.lit(1), s["at"]), F.slice(s["w"], s["at"] + 2, F.size(s["w"])))
        return F.when(F.size(s["w"]) > 2, left).otherwise(s["w"])

    return _given(body, w=words, at=_place(key, "del:", F.size(words)).cast("int"))


OPERATIONS = {"swap": swapped, "synonym": synonym, "insert": inserted, "delete": deleted}


def texts(df: DataFrame, text: str, key: str, probability: float = 0.1) -> DataFrame:
    """The originals (generated false) and one generated row each; each operation befalls a row with ``probability``."""
    made = df.withColumn("_words", words_of(F.col(text)))
    for name, change in OPERATIONS.items():
        hit = (hash_unit(F.col(key), f"{name}?:") < probability) & (F.size("_words") >= 2)
        made = made.withColumn("_words", F.when(hit, change(F.col("_words"), F.col(key))).otherwise(F.col("_words")))
    made = made.withColumn(text, F.array_join("_words", " ")).drop("_words").withColumn("generated", F.lit(True))
    return df.withColumn("generated", F.lit(False)).unionByName(made)


def text_with(df: DataFrame, text: str, key: str, operation: str) -> DataFrame:
    """Every row with one operation applied."""
    return df.withColumn(text, F.array_join(OPERATIONS[operation](words_of(F.col(text)), F.col(key)), " "))


def noisy(df: DataFrame, columns: list[str], key: str, factor: float = 0.05, probability: float = 0.5) -> DataFrame:
    """Every row with normal noise of ``factor`` deviations on each feature with ``probability`` (Box and Muller on hashes)."""
    std = only_row(df.agg(*(F.stddev_pop(c).alias(c) for c in columns)))
    out = {}
    for c in columns:
        u1, u2 = hash_unit(F.col(key), f"{c}1:"), hash_unit(F.col(key), f"{c}2:")
        normal = F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * F.lit(3.141592653589793) * u2)
        out[c] = F.when(hash_unit(F.col(key), f"{c}?:") < probability, F.col(c) + normal * std[c] * factor).otherwise(F.col(c))
    return df.withColumns(out)


def dropped_features(df: DataFrame, columns: list[str], key: str, share: float = 0.1) -> DataFrame:
    """Each feature set to its mean with probability ``share``, by a hash of the key."""
    mean = only_row(df.agg(*(F.avg(c).alias(c) for c in columns)))
    return df.withColumns({c: F.when(hash_unit(F.col(key), f"{c}!:") < share, mean[c]).otherwise(F.col(c)) for c in columns})


def flipped(image: Column, vertical: bool = False) -> Column:
    """An image (rows of pixels) mirrored."""
    return F.reverse(image) if vertical else F.transform(image, F.reverse)


def brightened(image: Column, factor: Column) -> Column:
    return F.transform(image, lambda row: F.transform(row, lambda v: F.least(F.lit(255.0), v * factor)))
