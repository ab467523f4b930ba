"""Combining the predictions of several models, one row for each key and model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import half_up


def hard_vote(votes: DataFrame, key: str, vote: str, weight: str | None = None) -> DataFrame:
    """(key, vote, support): the vote with the most weight, of ties the least."""
    w = F.sum(weight) if weight else F.count("*")
    tally = votes.groupBy(key, F.col(vote).alias("vote")).agg(w.alias("support"))
    best = F.min_by(F.struct("vote", "support"), F.struct(-F.col("support"), F.col("vote")))
    return tally.groupBy(key).agg(best.alias("b")).select(key, "b.vote", "b.support")


def soft_vote(probabilities: DataFrame, key: str, label: str, probability: str, weight: str | None = None) -> DataFrame:
    """(key, label, probability): the label of the highest mean probability, of ties the least."""
    p = F.sum(F.col(probability) * F.col(weight)) / F.sum(weight) if weight else F.avg(probability)
    mean = probabilities.groupBy(key, F.col(label).alias("label")).agg(half_up(p).alias("probability"))
    best = F.min_by(F.struct("label", "probability"), F.struct(-F.col("probability"), F.col("label")))
    return mean.groupBy(key).agg(best.alias("b")).select(key, "b.label", "b.probability")


def average(predictions: DataFrame, key: str, prediction: str, weight: str | None = None) -> DataFrame:
    p = F.sum(F.col(prediction) * F.col(weight)) / F.sum(weight) if weight else F.avg(prediction)
    return predictions.groupBy(key).agg(half_up(p).alias("prediction"))
