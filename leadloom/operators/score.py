"""Lead score, grade and data-quality flags: a table of weighted signals compiled to one expression with its reasons."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the signals, 100 in all, so that points are percent; other weights are scaled to that.
WEIGHTS = {"email": 25, "phone": 20, "website": 15, "rating": 15, "reviews": 10, "social": 10, "category": 5}
#: Least score of each grade; below the last it is D.
GRADES = [(80, "A"), (60, "B"), (40, "C")]
GOOD_RATING, MANY_REVIEWS = 4.0, 50
SOCIALS = ("facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok")
REQUIRED = ("email", "phone", "website")


def _has(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) != "", F.lit(False))


def signals(categories: list[str] | None = None) -> dict[str, Column]:
    """Conditions on stored leads; `category` holds for leads of one of `categories`, or with any category without a list."""
    listed = F.coalesce(F.lower("category").isin([c.lower() for c in categories]), F.lit(False)) if categories is not None else _has("category")
    social = F.greatest(*[_has(s) for s in SOCIALS])
    reviews = F.coalesce(F.col("total_reviews") >= MANY_REVIEWS, F.lit(False))
    return {"email": _has("email"), "phone": _has("phone"), "website": _has("website"), "rating": F.coalesce(F.col("average_rating") >= GOOD_RATING, F.lit(False)), "reviews": reviews, "social": social, "category": listed}


def points(hits: Mapping[str, Column], weights: Mapping[str, float]) -> dict[str, Column]:
    """Percent of all weights that each signal gives, to four places."""
    if unknown := set(weights) - set(hits):
        raise ValueError(f"unknown signals: {sorted(unknown)}")
    if min(weights.values(), default=0) < 0 or not sum(weights.values()):
        raise ValueError("weights must not be negative, and some must be positive")
    total = sum(weights.values())
    return {name: F.when(hits[name], F.lit(round(100.0 * w / total, 4))).otherwise(F.lit(0.0)) for name, w in weights.items()}


def grade(score: Column) -> Column:
    out = F.lit("D")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def quality_flags() -> Column:
    """Names of what is missing or cannot be right in a lead, in order."""
    rating, reviews = F.col("average_rating"), F.col("total_reviews")
    checks = {f"no_{c}": ~_has(c) for c in REQUIRED}
    checks["rating_out_of_range"] = F.coalesce((rating < 0) | (rating > 5), F.lit(False))
    checks["rated_without_reviews"] = F.coalesce((rating > 0) & (F.coalesce(reviews, F.lit(0)) == 0), F.lit(False))
    checks["no_place_id"] = ~_has("place_id")
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())


def score_leads(leads: DataFrame, weights: Mapping[str, float] = WEIGHTS, categories: list[str] | None = None) -> DataFrame:
    """leads with score (0 to 100), score_grade, score_reasons and flags.

    score_reasons lists the signals that hold, with their points, in the order of the weights.  Null and blank values never
    count.  New weights are a new call: scoring is one projection without a shuffle.
    """
    of = points(signals(categories), weights)
    score = F.round(sum(of.values(), F.lit(0.0)), 2)
    reason = [F.when(p > 0, F.struct(F.lit(name).alias("signal"), p.alias("points"))) for name, p in of.items()]
    reasons = F.filter(F.array(*reason), lambda x: x.isNotNull())
    return leads.select("*", score.alias("score"), grade(score).alias("score_grade"), reasons.alias("score_reasons"), quality_flags().alias("flags"))


def flag_counts(scored: DataFrame, *by: str) -> DataFrame:
    """Leads by flag: (by..., flag, leads)."""
    return scored.select(*by, F.explode("flags").alias("flag")).groupBy(*by, "flag").agg(F.count("*").alias("leads"))
