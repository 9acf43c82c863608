"""Normalising identifiers, names and bank narrations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists.
UTR = r"\b[A-Za-z]{4}[A-Za-z0-9]\d{10,14}\b"
LONG_NUMBER = r"\b\d{10,22}\b"
GATEWAY_WORDS = "razorpay|rzp|settl"  # the longer words for settlements and gateway settlements hold the last of these
COMPANY_WORDS = ("pvt", "private", "ltd", "limited", "llp", "co", "company", "the", "and")
DATE_FORMATS = ("yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "yyyy/M/d")
TIME_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m", "yyyy-M-d")


def utrs(narration: Column) -> Column:
    """Distinct upper-case transfer references, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(narration, F.lit("")), F.lit(UTR), F.lit(0)), F.upper))


def long_numbers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LONG_NUMBER), F.lit(0))


def looks_like_settlement(narration: Column) -> Column:
    return F.lower(F.coalesce(narration, F.lit(""))).rlike(GATEWAY_WORDS)


def norm_id(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")


def name_tokens(value: Column) -> Column:
    """Distinct name words without company forms."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z ]", " "), " +")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*COMPANY_WORDS)))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 where either is empty."""
    common, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / union).otherwise(0.0)


def optional(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def flag(text: Column) -> Column:
    return F.coalesce(F.upper(F.trim(text)).isin("Y", "YES", "TRUE", "1"), F.lit(False))


def parse_date(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in DATE_FORMATS]).cast("date")


def parse_time(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")
