"""Exact money: integer paise from and to text, and rates in basis points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Merchant discount rates and taxes in basis points.
MDR_BPS = {"upi": 0, "netbanking": 150, "card": 200, "amex": 350, "wallet": 180, "emi": 300}
MDR_DEFAULT_BPS = 200
GST_BPS = 1800
TDS_BPS = (100, 200, 1000)


def to_paise(text: Column) -> Column:
    """Paise of a rupee amount as text; null where it is no amount.

    Currency marks, commas and spaces are ignored; parentheses mean negative;
    halves round away from zero.
    """
    t = F.trim(text)
    negative = t.startswith("(") & t.endswith(")")
    inner = F.when(negative, F.substring(t, 2, F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(t)
    bare = F.regexp_replace(inner, r"₹|INR|Rs\.|Rs|,| ", "")
    paise = F.round(bare.try_cast("decimal(38,18)") * 100, 0).try_cast("bigint")
    return F.when(negative, -paise).otherwise(paise)


def half_even(amount: Column, bps: int | Column) -> Column:
    """amount * bps / 10000 to the nearest integer, halves to even; amount must not be negative."""
    bps = F.lit(bps) if isinstance(bps, int) else bps
    x = amount.cast("bigint") * bps.cast("bigint")
    rest = F.pmod(x, F.lit(10000))
    whole = F.try_divide((x - rest).cast("decimal(38,0)"), F.lit(10000)).cast("bigint")
    return whole + F.when((rest > 5000) | ((rest == 5000) & (whole % 2 == 1)), 1).otherwise(0)


def expected_fee(amount: Column, method: Column) -> tuple[Column, Column]:
    """Fee and the tax on it that the rate card asks for."""
    bps = F.lit(MDR_DEFAULT_BPS)
    for name, rate in MDR_BPS.items():
        bps = F.when(method == name, F.lit(rate)).otherwise(bps)
    fee = half_even(amount, bps)
    return fee, half_even(fee, GST_BPS)


def indian_format(paise: Column, sign: bool = False) -> Column:
    """12345678 becomes 1,23,456.78."""
    whole = F.floor(F.abs(paise) / 100).cast("bigint").cast("string")
    head = F.regexp_replace(F.reverse(F.substring(F.reverse(whole), 4, 40)), r"(\d)(?=(\d\d)+$)", "$1,")
    grouped = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.substring(F.lpad(whole, 40, "0"), 38, 3))).otherwise(whole)
    mark = F.when(paise < 0, "-").otherwise("+" if sign else "")
    return F.concat(mark, grouped, F.lit("."), F.lpad((F.abs(paise) % 100).cast("string"), 2, "0"))


def percent_of(part: Column, whole: Column) -> Column:
    """Two-place decimal percentage; 0 where the whole is 0."""
    value = (part.cast("decimal(20,0)") * 100 / F.when(whole != 0, whole.cast("decimal(20,0)"))).cast("decimal(20,2)")
    return F.coalesce(value, F.lit(0).cast("decimal(20,2)"))


def tds_relation(gross: Column, credit: Column, tolerance: int = 100) -> Column:
    """gross, net_of_tds_1pct, _2pct or _10pct, tried in this order; else null."""
    out = F.lit(None).cast("string")
    for bps in reversed(TDS_BPS):
        out = F.when(F.abs(credit - (gross - half_even(gross, bps))) <= tolerance, F.lit(f"net_of_tds_{bps // 100}pct")).otherwise(out)
    return F.when(F.abs(credit - gross) <= tolerance, F.lit("gross")).otherwise(out)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
