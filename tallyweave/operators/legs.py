"""The four legs of a reconciliation, as cascades of joins over what is left.

Tables read more than once are written; unions of written ones are not written again.

Matches: leg, lkey, rkey, tier, confidence (thousandths), delta_paise; a match
with several partners is several rows. Findings: key, source, code,
disposition, value_paise.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, text
from ..sources.scratch import keep
from . import solvers

# Tolerances in paise and windows in days, all inclusive.
AMOUNT_TOL, FEE_TOL, TAX_TOL, ADJUDICATION_TOL = 100, 100, 100, 5000
ERP_DAYS, BANK_DAYS, DIRECT_DAYS = 5, 4, 45
NAME_TOL = 0.34
AUTO, REVIEW = "auto_resolved", "needs_review"
MEANING = {
    "MISSING_IN_BANK": "a settlement batch without a bank credit",
    "UNEXPECTED_BANK_CREDIT": "a bank credit that nothing explains",
    "SETTLEMENT_AMOUNT_MISMATCH": "a credit that differs from its batch",
    "FEE_VARIANCE": "fees off the rate card",
    "DUPLICATE_PAYMENT": "a second capture of an order",
    "UNBILLED_PAYMENT": "a payment without an invoice",
    "UNPAID_INVOICE": "an invoice without a payment",
    "ORPHAN_REFUND": "a refund of an unknown payment",
    "FUNDS_ON_HOLD": "captured money that the gateway holds",
    "TAX_LINE_MISMATCH": "invoice tax off the rate",
    "SPLIT_SETTLEMENT": "a batch paid in several credits",
    "CHARGEBACK_ADJUSTMENT": "a dispute debit",
    "MERGED_PAYOUT": "batches paid in one credit",
    "TDS_WITHHELD": "tax withheld by the customer",
    "UNCLASSIFIED": "nothing of the above",
}


def finding(df: DataFrame, key: str, source: str, code: str, disposition: str, value: Column | str) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    return df.select(F.col(key).alias("key"), F.lit(source).alias("source"), F.lit(code).alias("code"), F.lit(disposition).alias("disposition"), value.cast("bigint").alias("value_paise"))


def match(df: DataFrame, leg: str, left: str, right: str, tier: str, confidence: Column, delta: Column | str) -> DataFrame:
    delta = F.col(delta) if isinstance(delta, str) else delta
    return df.select(F.lit(leg).alias("leg"), F.col(left).alias("lkey"), F.col(right).alias("rkey"), F.lit(tier).alias("tier"), confidence.cast("int").alias("confidence"), delta.cast("bigint").alias("delta_paise"))


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bank_key() -> Column:
    return F.format_string("bank:%04d", "line_no")


# --- invoices and payments


def ranked_payments(pg: DataFrame) -> DataFrame:
    """Payments with order_key, nth capture of it, the first capture, and the order's place."""
    key = F.coalesce(F.nullif("order_id", F.lit("")), F.concat(F.lit("__none__"), "entity_id"))
    w = W.partitionBy("order_key").orderBy("created_at", "entity_id")
    return pg.where("type = 'payment'").withColumn("order_key", key).withColumns({"nth": F.row_number().over(w), "first_capture": F.first("entity_id").over(w), "place": F.min("seq").over(W.partitionBy("order_key"))})


def erp_gateway(inv: DataFrame, pg: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, findings) of invoices against gateway payments."""
    leg = "erp_to_gateway"
    ranked = keep(ranked_payments(pg))
    duplicates = finding(ranked.where("nth > 1"), "entity_id", "pg", "DUPLICATE_PAYMENT", REVIEW, "amount_paise")
    primary = ranked.where("nth = 1")
    delta = F.col("amount_paise") - F.col("gross_paise")
    by_order = inv.where("order_id <> ''").withColumn("r", F.row_number().over(W.partitionBy("order_id").orderBy(F.desc("seq")))).where("r = 1")
    t0 = keep(match(primary.join(by_order.select("order_id", "invoice_no", "gross_paise"), "order_id"), leg, "invoice_no", "entity_id", "T0_EXACT_ID", F.when(F.abs(delta) <= AMOUNT_TOL, 1000).otherwise(920), delta))

    def left_over(done: DataFrame) -> tuple[DataFrame, DataFrame]:
        return inv.join(done.select(F.col("lkey").alias("invoice_no")), "invoice_no", "left_anti"), primary.join(done.select(F.col("rkey").alias("entity_id")), "entity_id", "left_anti")

    open_inv, open_pay = left_over(t0)
    named = open_inv.withColumn("nk", text.norm_id(F.col("invoice_no"))).where("nk <> ''").withColumn("r", F.row_number().over(W.partitionBy("nk").orderBy(F.desc("seq")))).where("r = 1")
    receipts = open_pay.withColumn("nk", text.norm_id(F.col("order_receipt"))).where("nk <> ''").select("nk", "entity_id", "amount_paise", "place")
    hits = named.join(receipts, "nk").withColumn("r2", F.row_number().over(W.partitionBy("invoice_no").orderBy("place", "entity_id"))).where("r2 = 1")
    t1 = keep(match(hits, leg, "invoice_no", "entity_id", "T1_NORMALIZED_ID", F.lit(950), delta))
    done = t0.unionByName(t1)
    open_inv, open_pay = left_over(done)
    edges = solvers.band_pairs(
        open_inv.select(F.col("invoice_no").alias("lkey"), F.col("gross_paise").alias("amount"), F.col("invoice_date").alias("ldate")),
        open_pay.select(F.col("entity_id").alias("rkey"), F.col("amount_paise").alias("amount"), F.col("created_at").cast("date").alias("rdate")),
        AMOUNT_TOL, ERP_DAYS, ERP_DAYS,
    )
    t2 = keep(_assigned(edges, leg))
    done = done.unionByName(t2)
    open_inv, open_pay = left_over(done)
    unpaid = finding(open_inv, "invoice_no", "erp", "UNPAID_INVOICE", REVIEW, "gross_paise")
    unbilled = finding(open_pay, "entity_id", "pg", "UNBILLED_PAYMENT", REVIEW, "amount_paise")
    return done, keep(union(duplicates, unpaid, unbilled))


def priced(edges: DataFrame) -> DataFrame:
    """Edges with the days between them and the cost of taking them: amounts first, days as a tie-break."""
    gap = F.abs(F.datediff("ldate", "rdate"))
    return edges.withColumn("gap", gap).withColumn("cost", F.abs(F.col("lamount") - F.col("ramount")) + F.col("gap") * 10)


def _assigned(edges: DataFrame, leg: str) -> DataFrame:
    best = solvers.assign(priced(edges).select("lkey", "rkey", "cost", "gap", "lamount", "ramount"))
    return match(best, leg, "lkey", "rkey", "T2_AMOUNT_DATE", F.greatest(F.lit(700), 920 - 30 * F.col("gap")), F.col("ramount") - F.col("lamount"))


# --- integrity of the gateway and of invoices


def integrity(inv: DataFrame, pg: DataFrame) -> DataFrame:
    payments = pg.where("type = 'payment'")
    held = finding(payments.where("on_hold"), "entity_id", "pg", "FUNDS_ON_HOLD", REVIEW, F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise"))
    fee, gst = money.expected_fee(F.col("amount_paise"), F.col("method"))
    drift = payments.where("not on_hold").withColumn("drift", F.col("fee_paise") + F.col("tax_paise") - fee - gst).where(F.abs("drift") > FEE_TOL)
    known = payments.select(F.col("entity_id").alias("parent_payment_id")).distinct()
    orphans = pg.where("type = 'refund' and parent_payment_id is not null").join(known, "parent_payment_id", "left_anti")
    due = money.half_even(F.col("taxable_paise"), money.GST_BPS) - F.col("tax_paise")
    return union(
        held,
        finding(drift, "entity_id", "pg", "FEE_VARIANCE", AUTO, "drift"),
        finding(orphans, "entity_id", "pg", "ORPHAN_REFUND", REVIEW, F.abs("amount_paise")),
        finding(pg.where("type = 'adjustment'"), "entity_id", "pg", "CHARGEBACK_ADJUSTMENT", REVIEW, F.abs("amount_paise")),
        finding(inv.withColumn("due", due).where(F.abs("due") > TAX_TOL), "invoice_no", "erp", "TAX_LINE_MISMATCH", REVIEW, "due"),
    )


# --- batches and bank lines


def batches(pg: DataFrame) -> DataFrame:
    """Settlement batches: utr and time of the first row, members in order, and sums."""
    rows = pg.where("settlement_id is not null")
    total = lambda c: F.sum(f"{c}_paise").cast("bigint").alias(f"{c}_paise")
    return rows.groupBy("settlement_id").agg(
        F.upper(F.min_by("settlement_utr", "seq")).alias("utr"),
        F.min_by(F.coalesce("settled_at", "created_at"), "seq").alias("settled_at"),
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "entity_id"))), lambda x: x["entity_id"]).alias("members"),
        total("amount"),
        total("fee"),
        total("tax"),
        F.sum(F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")).cast("bigint").alias("net_paise"),
    )


def batch_bank(pg: DataFrame, bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, findings) of settlement batches against bank credits."""
    leg = "settlement_to_bank"
    own = keep(batches(pg).select("settlement_id", "utr", F.col("settled_at").cast("date").alias("day"), F.col("net_paise").alias("net")))
    credits = keep(bank.where("amount_paise > 0").select("line_no", bank_key().alias("line"), "value_date", "narration", F.col("amount_paise").alias("amount")))
    quoted = credits.select("line", "amount", F.explode(text.utrs(F.col("narration"))).alias("utr")).join(own.where("utr is not null"), "utr")
    hits = quoted.withColumn("r", F.row_number().over(W.partitionBy("line").orderBy("settlement_id"))).where("r = 1")
    summed = hits.groupBy("settlement_id").agg(F.sum("amount").alias("paid"), F.count(F.lit(1)).alias("lines"), F.first("net").alias("net")).withColumn("delta", F.col("paid") - F.col("net"))
    kind = F.when(F.abs("delta") > AMOUNT_TOL, "differs").when(F.col("lines") == 1, "exact").otherwise("split")
    summed = keep(summed.withColumn("kind", kind))
    tier = F.when(F.col("kind") == "exact", "T0_EXACT_ID").when(F.col("kind") == "split", "T3_AGGREGATE").otherwise("T1_NORMALIZED_ID")
    sure = F.when(F.col("kind") == "exact", 1000).when(F.col("kind") == "split", 970).otherwise(800)
    by_utr = hits.select("line", "settlement_id").join(summed, "settlement_id").select(F.lit(leg).alias("leg"), F.col("settlement_id").alias("lkey"), F.col("line").alias("rkey"), tier.alias("tier"), sure.cast("int").alias("confidence"), F.col("delta").cast("bigint").alias("delta_paise"))
    by_utr = keep(by_utr)
    notes = [finding(summed.where("kind = 'split'"), "settlement_id", "settlement", "SPLIT_SETTLEMENT", AUTO, F.lit(0)), finding(summed.where("kind = 'differs'"), "settlement_id", "settlement", "SETTLEMENT_AMOUNT_MISMATCH", REVIEW, "delta")]

    def left_over(done_batches: DataFrame, done_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        return own.join(done_batches, "settlement_id", "left_anti"), credits.join(done_lines, "line", "left_anti")

    took_b, took_l = by_utr.select(F.col("lkey").alias("settlement_id")).distinct(), by_utr.select(F.col("rkey").alias("line"))
    open_b, open_l = left_over(took_b, took_l)
    gate = open_l.where(text.looks_like_settlement(F.col("narration")))
    merged = keep(solvers.consolidated(gate.select("line_no", "value_date", "amount"), open_b.select("settlement_id", "day", "net"), BANK_DAYS, AMOUNT_TOL))
    parts = merged.select(bank_key().alias("line"), F.explode("members").alias("settlement_id"), (F.col("amount") - F.col("total")).alias("delta"))
    by_sum = match(parts, leg, "line", "settlement_id", "T3_AGGREGATE", F.lit(900), "delta")
    notes.append(finding(parts, "settlement_id", "settlement", "MERGED_PAYOUT", AUTO, F.lit(0)))
    took_b, took_l = took_b.unionByName(by_sum.select(F.col("rkey").alias("settlement_id"))), took_l.unionByName(by_sum.select(F.col("lkey").alias("line")).distinct())
    open_b, open_l = left_over(took_b, took_l)
    edges = solvers.band_pairs(
        open_b.select(F.col("settlement_id").alias("lkey"), F.col("net").alias("amount"), F.col("day").alias("ldate")),
        open_l.where(text.looks_like_settlement(F.col("narration"))).select(F.col("line").alias("rkey"), "amount", F.col("value_date").alias("rdate")),
        AMOUNT_TOL, BANK_DAYS, BANK_DAYS,
    )
    t2 = keep(_assigned(edges, leg))
    open_b, open_l = left_over(took_b.unionByName(t2.select(F.col("lkey").alias("settlement_id"))), took_l.unionByName(t2.select(F.col("rkey").alias("line"))))
    notes.append(finding(open_b, "settlement_id", "settlement", "MISSING_IN_BANK", REVIEW, "net"))
    notes.append(finding(open_l, "line", "bank", "UNEXPECTED_BANK_CREDIT", REVIEW, "amount"))
    return union(by_utr, by_sum, t2), keep(union(*notes))


# --- direct receipts


def direct_edges(inv: DataFrame, bank: DataFrame, found: DataFrame) -> DataFrame:
    """Unpaid invoices and unexplained credits whose amounts and dates agree: lkey, rkey, relation, score, ..."""
    unpaid = inv.join(found.where("code = 'UNPAID_INVOICE'").select(F.col("key").alias("invoice_no")), "invoice_no", "left_semi")
    lines = bank.withColumn("line", bank_key()).join(found.where("code = 'UNEXPECTED_BANK_CREDIT'").select(F.col("key").alias("line")), "line", "left_semi")
    gross = F.col("gross_paise")
    wanted = F.array_distinct(F.array(gross, *[gross - money.half_even(gross, b) for b in money.TDS_BPS]))
    left = unpaid.select(F.col("invoice_no").alias("lkey"), F.col("seq").alias("lseq"), "customer", F.col("invoice_date").alias("ldate"), "gross_paise", F.explode(wanted).alias("amount"))
    right = lines.select(F.col("line").alias("rkey"), F.col("line_no").alias("rseq"), "narration", F.col("value_date").alias("rdate"), F.col("amount_paise").alias("amount"))
    pairs = solvers.band_pairs(left, right, AMOUNT_TOL, 0, DIRECT_DAYS).withColumn("relation", money.tds_relation(F.col("gross_paise"), F.col("ramount"), AMOUNT_TOL))
    score = text.token_overlap(text.name_tokens(F.col("customer")), text.name_tokens(F.col("narration")))
    return pairs.where(F.col("relation").isNotNull()).select("lkey", "rkey", "lseq", "rseq", "relation", "gross_paise", F.col("ramount"), score.alias("score")).distinct()


def direct(inv: DataFrame, bank: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, all findings after it): resolved UNPAID and UNEXPECTED findings go, TDS_WITHHELD is added."""
    chosen = keep(solvers.first_come(direct_edges(inv, bank, found).where(F.col("score") >= NAME_TOL)))
    matches = match(chosen, "invoice_to_bank", "lkey", "rkey", "T2_AMOUNT_DATE", F.round(F.least(F.lit(0.96), 0.75 + F.col("score")) * 1000), F.col("ramount") - F.col("gross_paise"))
    solved = chosen.select(F.explode(F.array("lkey", "rkey")).alias("key")).distinct()
    open_ = found.where("code in ('UNPAID_INVOICE', 'UNEXPECTED_BANK_CREDIT')").join(solved, "key", "left_anti").select(found.columns)
    withheld = finding(chosen.where("relation <> 'gross'"), "lkey", "erp", "TDS_WITHHELD", AUTO, F.col("gross_paise") - F.col("ramount"))
    return matches, keep(union(found.where("code not in ('UNPAID_INVOICE', 'UNEXPECTED_BANK_CREDIT')"), open_, withheld))


def reconcile(sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """matches and findings of all legs; the legs that do not need each other run side by side."""
    inv, pg, bank = (sources[k] for k in ("inv", "pg", "bank"))
    with ThreadPoolExecutor(2) as pool:
        of_erp, of_bank = pool.submit(erp_gateway, inv, pg), pool.submit(batch_bank, pg, bank)
        (m1, f1), (m3, f3) = of_erp.result(), of_bank.result()
    before = union(f1, integrity(inv, pg), f3)
    m4, found = direct(inv, bank, keep(before))
    return {"matches": union(m1, m3, m4), "findings": found}
