"""Composable lead filters: each rule is a Column, the engine folds them with AND or OR after deduplication."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present, strip
from .dedup import keep_first

INVALID_KEYS = ["", "—", "-", "n/a", "none", "null", "undefined", "'—", "'-", "'"]
PLATFORMS = ["facebook", "instagram", "twitter", "linkedin", "youtube", "tiktok"]


@dataclass(frozen=True)
class FilterConfig:
    """What the filter command takes.  Unset rules are not active; `logic` combines the active ones."""

    phone: bool = False
    website: bool = False
    email: bool = False
    min_rating: float | None = None
    min_reviews: int | None = None
    whitelist: list[str] = field(default_factory=list)
    blacklist: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    socials: list[str] = field(default_factory=list)
    social_logic: str = "AND"
    logic: str = "AND"
    dedup: bool = True


def contact_rule(*columns: str) -> Column:
    return reduce(and_, [present(F.col(c)) for c in columns])


def quality_rule(min_rating: float | None = None, min_reviews: int | None = None) -> Column:
    """Null fails."""
    checks = [F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in (("average_rating", min_rating), ("total_reviews", min_reviews)) if v is not None]
    return reduce(and_, checks, F.lit(True))


def category_rule(whitelist: list[str] = (), blacklist: list[str] = ()) -> Column:
    """Exact match in any case over the primary and all other categories."""
    both = F.concat(F.coalesce("all_categories", F.array().cast("array<string>")), F.array("category"))
    names = F.transform(F.filter(both, present), F.lower)
    has = lambda values: F.arrays_overlap(names, F.array(*[F.lit(v.lower()) for v in values]))
    ok = F.coalesce(has(whitelist), F.lit(False)) if whitelist else F.lit(True)
    return ok & ~F.coalesce(has(blacklist), F.lit(False)) if blacklist else ok


def keyword_rule(keywords: list[str]) -> Column:
    """Any keyword in 'name description'; it may span the two, and an empty keyword is in every text."""
    text = F.lower(F.concat(F.coalesce("business_name", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    return reduce(or_, [F.contains(text, F.lit(k.lower())) for k in keywords])


def social_rule(platforms: list[str], logic: str = "AND") -> Column:
    """A profile on all or any of the platforms; an unknown platform is on none."""
    checks = [present(F.col(p)) if p in PLATFORMS else F.lit(False) for p in platforms]
    return reduce(and_ if logic == "AND" else or_, checks)


def active_rules(cfg: FilterConfig) -> list[Column]:
    contact = [c for c in ("phone", "website", "email") if getattr(cfg, c)]
    rules = [contact_rule(*contact)] if contact else []
    if cfg.min_rating is not None or cfg.min_reviews is not None:
        rules.append(quality_rule(cfg.min_rating, cfg.min_reviews))
    if cfg.whitelist or cfg.blacklist:
        rules.append(category_rule(cfg.whitelist, cfg.blacklist))
    if cfg.keywords:
        rules.append(keyword_rule(cfg.keywords))
    if cfg.socials:
        rules.append(social_rule(cfg.socials, cfg.social_logic))
    return rules


def filter_leads(leads: DataFrame, cfg: FilterConfig, rules: list[Column] = ()) -> DataFrame:
    """Dedup by place id first - the first occurrence claims the id even if it then fails - and then the rules."""
    kept = keep_first(leads, "place_id", "seq") if cfg.dedup else leads
    every = [*active_rules(cfg), *rules]
    return kept.where(reduce(and_ if cfg.logic == "AND" else or_, every)) if every else kept


def clean_key(c: Column) -> Column:
    return strip(F.ltrim(c, F.lit("'")))


def is_valid_key(c: Column) -> Column:
    k = F.lower(clean_key(F.coalesce(c, F.lit(""))))
    return ~k.isin(INVALID_KEYS) & (F.length(k) > 2)


def clean_phone(c: Column) -> Column:
    return F.when(is_valid_key(c), clean_key(c)).otherwise("")


def is_sent(*columns: Column) -> Column:
    """Any cell that contains SENT or SUCCESS."""
    return F.exists(F.array(*[F.upper(F.coalesce(c.cast("string"), F.lit(""))) for c in columns]), lambda c: F.contains(c, F.lit("SENT")) | F.contains(c, F.lit("SUCCESS")))


def unsent(leads: DataFrame) -> DataFrame:
    """Rows with an e-mail and no status."""
    return leads.where((F.coalesce(strip(F.col("email")), F.lit("")) != "") & (strip(F.coalesce("status", F.lit(""))) == ""))


def query_leads(df: DataFrame, city: str | None = None, category: str | None = None, min_rating: float | None = None, has_email: bool | None = None, has_phone: bool | None = None, source_query: str | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Leads by city and category (parts, any case), rating, contact and query, in the order of place id and seq.

    A limit of 0 is no limit.  Limit and offset are the feature.
    """
    for c, v in (("city", city), ("category", category)):
        df = df.where(F.col(c).ilike(f"%{v}%")) if v else df
    rating = "average_rating" if "average_rating" in df.columns else "rating"
    df = df.where(F.col(rating) >= min_rating) if min_rating is not None else df
    for c, v in (("email", has_email), ("phone", has_phone)):
        df = df if v is None else df.where(present(F.col(c)) if v else ~present(F.col(c)))
    df = df.where(F.col("source_query") == source_query) if source_query else df
    if limit or offset:
        df = df.orderBy("place_id", *[c for c in ("seq",) if c in df.columns]).offset(offset)
        df = df.limit(limit) if limit else df
    return df
