"""What each finding rests on, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, text
from .legs import bank_key, batches, ranked_payments
from .reporting import pairs

#: The fields shown for a finding of each code, in this order.
FIELDS = {
    "DUPLICATE_PAYMENT": ("order_id", "first_capture", "first_at", "created_at", "amount"),
    "UNPAID_INVOICE": ("order_id", "customer", "invoice_date", "gross", "age_days"),
    "UNBILLED_PAYMENT": ("order_id", "order_receipt", "created_at", "method", "amount"),
    "FUNDS_ON_HOLD": ("created_at", "method", "amount", "order_id"),
    "FEE_VARIANCE": ("method", "expected_fee", "fee", "expected_gst", "gst"),
    "ORPHAN_REFUND": ("parent_payment_id", "amount", "created_at"),
    "CHARGEBACK_ADJUSTMENT": ("dispute_id", "amount", "created_at", "settlement_id"),
    "TAX_LINE_MISMATCH": ("taxable", "tax", "tax_due", "customer"),
    "SPLIT_SETTLEMENT": ("utr", "lines", "paid"),
    "SETTLEMENT_AMOUNT_MISMATCH": ("utr", "net", "lines", "paid"),
    "MERGED_PAYOUT": ("lines", "paid", "net"),
    "MISSING_IN_BANK": ("utr", "settled_at", "net", "members", "batch_gross", "fee_and_gst"),
    "UNEXPECTED_BANK_CREDIT": ("value_date", "narration", "amount", "claims_settlement"),
    "TDS_WITHHELD": ("customer", "gross", "lines", "paid"),
}


def rupees(paise: Column) -> Column:
    """1234.50, without grouping."""
    sign = F.when(paise < 0, "-").otherwise("")
    return F.concat(sign, F.floor(F.abs(paise) / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.abs(paise) % 100).cast("string"), 2, "0"))


def _facts(df: DataFrame, key: Column, **fields: Column) -> DataFrame:
    """key, facts: a map of texts without the fields that are null."""
    all_ = F.create_map(*[x for name, value in fields.items() for x in (F.lit(name), value.cast("string"))])
    return df.select(key.alias("key"), F.map_filter(all_, lambda _, v: v.isNotNull()).alias("facts"))


def records(sources: dict[str, DataFrame], matches: DataFrame) -> DataFrame:
    """key, facts of every invoice, gateway row, batch and bank line."""
    inv, pg, bank = (sources[k] for k in ("inv", "pg", "bank"))
    lines = bank.select(bank_key().alias("b"), "amount_paise")
    links = pairs(matches).where("leg <> 'erp_to_gateway'").join(lines, "b")
    paid = links.groupBy(F.col("a").alias("key")).agg(F.array_join(F.array_sort(F.collect_list("b")), ", ").alias("lines"), F.sum("amount_paise").alias("paid"))
    newest = F.broadcast(inv.agg(F.max("invoice_date").alias("newest")))  # one row
    of_inv = inv.join(newest).withColumn("key", F.col("invoice_no")).join(paid, "key", "left")
    fee, gst = money.expected_fee(F.abs("amount_paise"), F.col("method"))
    first = ranked_payments(pg).where("nth > 1").select("entity_id", "first_capture")
    times = pg.select(F.col("entity_id").alias("first_capture"), F.col("created_at").alias("first_at"))
    of_pg = pg.join(first.join(times, "first_capture"), "entity_id", "left")
    of_batch = batches(pg).withColumn("key", F.col("settlement_id")).join(paid, "key", "left")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    parts = [
        _facts(
            of_inv, F.col("key"), order_id=F.col("order_id"), customer=F.col("customer"), invoice_date=F.col("invoice_date"), gross=rupees(F.col("gross_paise")), age_days=F.datediff("newest", "invoice_date"),
            taxable=rupees(F.col("taxable_paise")), tax=rupees(F.col("tax_paise")), tax_due=rupees(money.half_even(F.col("taxable_paise"), money.GST_BPS)), lines=F.col("lines"), paid=rupees(F.col("paid")),
        ),
        _facts(
            of_pg, F.col("entity_id"), order_id=F.col("order_id"), order_receipt=F.col("order_receipt"), created_at=shown("created_at"), method=F.col("method"), amount=rupees(F.abs("amount_paise")), first_capture=F.col("first_capture"),
            first_at=shown("first_at"), fee=rupees(F.col("fee_paise")), gst=rupees(F.col("tax_paise")), expected_fee=rupees(fee), expected_gst=rupees(gst), parent_payment_id=F.col("parent_payment_id"), dispute_id=F.col("dispute_id"), settlement_id=F.col("settlement_id"),
        ),
        _facts(
            of_batch, F.col("key"), utr=F.col("utr"), settled_at=shown("settled_at"), net=rupees(F.col("net_paise")), members=F.size("members"), batch_gross=rupees(F.col("amount_paise")),
            fee_and_gst=rupees(F.col("fee_paise") + F.col("tax_paise")), lines=F.col("lines"), paid=rupees(F.col("paid")),
        ),
        _facts(bank, bank_key(), value_date=F.col("value_date"), narration=F.col("narration"), amount=rupees(F.col("amount_paise")), claims_settlement=text.looks_like_settlement(F.col("narration"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def action(code: Column, value: Column, key: Column, facts: Column) -> Column:
    """What to do about a finding, in one sentence."""
    amount, of = rupees(F.abs(value)), lambda name: F.coalesce(facts[name], F.lit("unknown"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    texts = {
        "DUPLICATE_PAYMENT": say("Refund ", key, " or confirm a second order beside ", of("first_capture"), "."),
        "UNPAID_INVOICE": say("Collect ", amount, " from ", of("customer"), " or write off ", key, "."),
        "UNBILLED_PAYMENT": say("Invoice ", amount, " for ", F.coalesce(facts["order_id"], F.lit("the captured order")), "."),
        "FUNDS_ON_HOLD": F.lit("Ask the gateway to release the hold; leave it out of the cash forecast."),
        "FEE_VARIANCE": say(F.when(value > 0, "Recover ").otherwise("Credit back "), amount, " of fees on ", key, "."),
        "ORPHAN_REFUND": say("Find payment ", of("parent_payment_id"), " in another period or account."),
        "CHARGEBACK_ADJUSTMENT": F.lit("Book the dispute and decide in time whether to contest it."),
        "TAX_LINE_MISMATCH": say("Check the tax rate of ", key, F.when(value > 0, "; issue a revised invoice for ").otherwise("; issue a credit note for "), amount, "."),
        "SPLIT_SETTLEMENT": F.lit("None: the parts add up; post them as one receipt."),
        "SETTLEMENT_AMOUNT_MISMATCH": F.when(value < 0, "Look for a bank charge or a recovery.").otherwise("Look for an earlier shortfall made good."),
        "MERGED_PAYOUT": F.lit("None: the credit adds up; ask for a reference of each batch."),
        "MISSING_IN_BANK": say("Trace ", of("utr"), " with the bank; until then ", amount, " is due from the gateway."),
        "UNEXPECTED_BANK_CREDIT": F.lit("Find the payer before posting it anywhere."),
        "TDS_WITHHELD": say("Book ", amount, " as tax receivable from ", of("customer"), " and collect the certificate."),
    }
    out = F.lit("Look into it.")
    for name, told in texts.items():
        out = F.when(code == name, told).otherwise(out)
    return out


def explained(findings: DataFrame, sources: dict[str, DataFrame], matches: DataFrame) -> DataFrame:
    """The findings with ``evidence``, an ordered array of (field, value), and ``action``; narrative is empty."""
    joined = findings.join(records(sources, matches), "key", "left").withColumn("facts", F.coalesce("facts", F.expr("map()").cast("map<string,string>")))
    wanted = F.lit(None).cast("array<string>")
    for code, names in FIELDS.items():
        wanted = F.when(F.col("code") == code, F.array(*map(F.lit, names))).otherwise(wanted)
    rows = F.transform(F.coalesce(wanted, F.array().cast("array<string>")), lambda n: F.struct(n.alias("field"), F.col("facts")[n].alias("value")))
    evidence = F.filter(rows, lambda r: r["value"].isNotNull())
    return joined.select(*findings.columns, evidence.alias("evidence"), action(F.col("code"), F.col("value_paise"), F.col("key"), F.col("facts")).alias("action"), F.lit("").alias("narrative"))


def exceptions_by_code(found: DataFrame, shown: int = 4) -> DataFrame:
    """Explained findings for a report: place of the code by its whole exposure, place within it by value, and the first fields."""
    w = W.partitionBy("code")
    total = F.sum(F.abs("value_paise")).over(w)
    ranked = found.withColumns({"exposure_paise": total.cast("bigint"), "nth": F.row_number().over(w.orderBy(F.desc(F.abs("value_paise")), "key"))})
    evidence = F.array_join(F.transform(F.slice("evidence", 1, shown), lambda e: F.concat(e["field"], F.lit("="), e["value"])), "; ")
    return ranked.select("code", "exposure_paise", "nth", "key", "value_paise", evidence.alias("evidence"), "action")
