"""What is true of a derived or generated world, from the rules that made it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import legs
from ..sources.world import RULES


def number(key) -> F.Column:
    return F.regexp_extract(key, "[0-9]+$", 0).cast("bigint")


def erp_links(sources: dict[str, DataFrame]) -> DataFrame:
    """leg, a, b: an invoice and the first payment of its order, wherever both exist."""
    inv = sources["inv"].select(number("invoice_no").alias("k"), F.col("invoice_no").alias("a"))
    pay = sources["pg"].where("type = 'payment' and entity_id like 'pay\\_%'").select(number("entity_id").alias("k"), F.col("entity_id").alias("b"))
    return inv.join(pay, "k").select(F.lit("erp_to_gateway").alias("leg"), "a", "b")


def _batches(sources: dict[str, DataFrame]) -> DataFrame:
    return sources["pg"].where("settlement_id is not null").select("settlement_id", F.upper("settlement_utr").alias("utr"), F.col("settled_at").cast("date").alias("sday"), number("settlement_id").alias("dn")).distinct()


def links(sources: dict[str, DataFrame]) -> DataFrame:
    """leg, a, b of all three legs."""
    own = _batches(sources)
    lines = sources["bank"].select(legs.bank_key().alias("b"), "value_date", F.upper("narration").alias("told"))
    pair = lambda df: df.select(F.lit("settlement_to_bank").alias("leg"), F.col("settlement_id").alias("a"), "b")
    quoted = lines.withColumn("utr", F.explode(text.utrs(F.col("told")))).join(own, "utr")
    bare = lines.withColumn("dn", F.expr("try_cast(regexp_extract(told, '^IMPS GATEWAY SETTLEMENT ([0-9]+)$', 1) as bigint)")).join(own.select("dn", "settlement_id"), "dn")
    # A consolidated credit comes a day after the second of its two batches.
    consolidated = lines.where("told like '%CONSOLIDATED'").withColumn("sday", F.explode(F.array(F.date_sub("value_date", 2), F.date_sub("value_date", 1)))).join(own, "sday")
    paid = lines.withColumn("k", F.expr("try_cast(regexp_extract(told, 'AXISN([0-9]{12})-', 1) as bigint)")).join(sources["inv"].select(number("invoice_no").alias("k"), F.col("invoice_no").alias("a")), "k")
    return legs.union(erp_links(sources), pair(quoted), pair(bare), pair(consolidated), paid.select(F.lit("invoice_to_bank").alias("leg"), "a", "b"))


def codes(sources: dict[str, DataFrame], rules: dict[str, str] = RULES, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """key, code: all that was planted, whether or not a detector looks for it there; a key may have several.

    ``prepare`` adds to (key, kind, k) whatever else the rules read.
    """
    inv, pg = sources["inv"], sources["pg"]
    records = inv.select(F.col("invoice_no").alias("key")).unionByName(pg.select(F.col("entity_id").alias("key")))
    records = prepare(records.withColumns({"k": number("key"), "kind": F.regexp_extract("key", "^[A-Za-z]+", 0)}))
    planted = (
        ("UNPAID_INVOICE", f"kind = 'INV' and ({rules['unpaid']}) and k % 2 = 1"), ("TDS_WITHHELD", f"kind = 'INV' and ({rules['unpaid']}) and k % 4 = 0"), ("TAX_LINE_MISMATCH", f"kind = 'INV' and ({rules['mistaxed']})"),
        ("UNBILLED_PAYMENT", f"kind = 'pay' and ({rules['unbilled']})"), ("FUNDS_ON_HOLD", f"kind = 'pay' and ({rules['held']})"), ("FEE_VARIANCE", f"kind in ('pay', 'payd') and ({rules['overcharged']})"),
        ("DUPLICATE_PAYMENT", "kind = 'payd'"), ("ORPHAN_REFUND", "kind = 'rfnd' and k % 2 = 1"), ("CHARGEBACK_ADJUSTMENT", "kind = 'adjs'"),
    )
    of_records = records.select("key", F.explode(F.array_compact(F.array(*[F.when(F.expr(rule), code) for code, rule in planted]))).alias("code"))
    own = _batches(sources).select("settlement_id", "dn")
    has = lambda step, name: own.select((F.col("dn") - step).alias("dn"), F.lit(True).alias(name))
    mode = F.expr("case when dn % 13 = 1 then 'MISSING_IN_BANK' when dn % 13 = 2 then 'SETTLEMENT_AMOUNT_MISMATCH' when dn % 13 = 3 then 'SPLIT_SETTLEMENT' when (dn % 13 = 5 and after) or (dn % 13 = 6 and before) then 'MERGED_PAYOUT' end")
    of_batches = own.join(has(1, "after"), "dn", "left").join(has(-1, "before"), "dn", "left").select(F.col("settlement_id").alias("key"), mode.alias("code")).where("code is not null")
    of_lines = sources["bank"].where("narration = 'INT.PD:12345678' and amount_paise > 0").select(legs.bank_key().alias("key"), F.lit("UNEXPECTED_BANK_CREDIT").alias("code"))
    return legs.union(of_records, of_batches, of_lines)
