"""The three sources derived from orders, customers and events, by rules on keys.

Every finding code and every tier of joins fires; no two rows contend for the
same partner. The rules are plain arithmetic, so
that SQL elsewhere can state them too. Tables are made once per folder and
session and written to the shared folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import half_even
from .scratch import keep

#: Which orders carry which defect.
RULES = {
    "unbilled": "k % 29 = 7", "unpaid": "k % 23 = 5", "overcharged": "k % 47 = 8", "no_ids": "k % 31 = 3", "receipt_only": "k % 31 = 4",
    "held": "k % 43 = 7", "twice": "k % 41 = 6", "refunded": "k % 53 = 9", "disputed": "k % 59 = 10", "mistaxed": "k % 37 = 5",
}
_built: dict[tuple, dict[str, DataFrame]] = {}
PG = ["entity_id", "type", "amount_paise", "fee_paise", "tax_paise", "created_at", "method", "order_id", "order_receipt", "on_hold", "parent_payment_id", "dispute_id"]


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    taxable = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_orderdate").cast("date").alias("d"),
        F.concat(F.lit("Acme "), F.translate(F.col("o_custkey").cast("string"), "0123456789", "bcdfghjklm")).alias("customer"),
        taxable.alias("taxable"),
        half_even(taxable, 1800).alias("tax0"),
    )


def _hours(col: str, hours) -> F.Column:
    return F.col(col) + F.make_interval(hours=hours)


def _payments(base: DataFrame, rules: dict[str, str]) -> DataFrame:
    amount = F.col("taxable") + F.col("tax0")
    paid = base.where(f"not ({rules['unpaid']})").withColumn("amount_paise", amount)
    m = F.element_at(F.array(*[F.lit(x) for x in ("upi", "netbanking", "card", "amex", "wallet", "emi")]), (F.col("k") % 6 + 1).cast("int"))
    bps = F.element_at(F.array(*[F.lit(x) for x in (0, 150, 200, 350, 180, 300)]), (F.col("k") % 6 + 1).cast("int"))
    paid = paid.withColumns({"method": m, "fee_paise": half_even(F.col("amount_paise"), bps) + F.when(F.expr(rules["overcharged"]), 350).otherwise(0)})
    return paid.withColumns(
        {
            "tax_paise": half_even(F.col("fee_paise"), 1800),
            "created_at": _hours("ts", (F.lit(6) + F.col("k") % 17).cast("int")),
            "order_id": F.when(F.expr(f"not ({rules['no_ids']}) and not ({rules['receipt_only']})"), F.concat(F.lit("order_"), "k")),
            "order_receipt": F.expr(f"case when {rules['no_ids']} then null when {rules['receipt_only']} then concat('inv_', k) else concat('INV-', k) end"),
        }
    )


def invoices(base: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    tax = F.when(F.expr(rules["mistaxed"]), half_even(F.col("taxable"), 1200)).otherwise(F.col("tax0"))
    return base.where(f"not ({rules['unbilled']})").select(
        F.concat(F.lit("INV-"), "k").alias("invoice_no"), F.concat(F.lit("order_"), "k").alias("order_id"), "customer", F.col("d").alias("invoice_date"), F.col("taxable").alias("taxable_paise"),
        tax.alias("tax_paise"), (F.col("taxable") + tax).alias("gross_paise"), F.lit("INR").alias("currency"), F.col("k").alias("seq"),
    )


def gateway(base: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    p = _payments(base, rules)
    none = F.lit(None).cast("string")

    def rows(of: DataFrame, prefix: str, kind: str, **changes) -> DataFrame:
        fixed = {"entity_id": F.concat(F.lit(prefix), "k"), "type": F.lit(kind), "parent_payment_id": none, "dispute_id": none, "on_hold": F.lit(False)}
        return of.withColumns(fixed | changes).select(*PG)

    zero = {"fee_paise": F.lit(0).cast("bigint"), "tax_paise": F.lit(0).cast("bigint")}
    parent = F.expr("case when k % 2 = 0 then concat('pay_', k) else concat('ghost_', k) end")
    parts = [
        rows(p, "pay_", "payment", on_hold=F.expr(rules["held"])),
        rows(p.where(f"({rules['twice']}) and order_id is not null"), "payd_", "payment", created_at=_hours("created_at", F.lit(30))),
        rows(p.where(rules["refunded"]), "rfnd_", "refund", amount_paise=F.expr("-(amount_paise div 2)"), created_at=_hours("created_at", F.lit(72)), parent_payment_id=parent, **zero),
        rows(p.where(rules["disputed"]), "adjs_", "adjustment", amount_paise=F.expr("-(amount_paise div 10)"), created_at=_hours("created_at", F.lit(96)), dispute_id=F.concat(F.lit("disp_"), "k"), **zero),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def settled(pg: DataFrame, utr: F.Column | None = None) -> DataFrame:
    """Settlement columns: a batch a day, unless held or the day's net is not positive."""
    day = F.date_add(F.col("created_at").cast("date"), 2)
    net = F.sum(F.when(~F.col("on_hold"), F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")))
    days = pg.select("*", day.alias("sday")).groupBy("sday").agg(net.alias("net")).where("net > 0").select("sday", F.datediff("sday", F.lit("1995-01-01").cast("date")).alias("dn"))
    joined = pg.withColumn("sday", F.when(~F.col("on_hold"), day)).join(days, "sday", "left")
    utr = F.concat(F.lit("SBIN0"), F.lpad(F.col("dn").cast("string"), 12, "0")) if utr is None else utr
    return joined.select(
        *PG,
        F.when(F.col("dn").isNotNull(), F.concat(F.lit("setl_"), F.lpad(F.col("dn").cast("string"), 5, "0"))).alias("settlement_id"),
        F.when(F.col("dn").isNotNull(), utr).alias("settlement_utr"),
        F.when(F.col("dn").isNotNull(), F.col("sday").cast("timestamp_ntz")).alias("settled_at"),
        F.col("entity_id").alias("seq"),
    )


def bank(events: DataFrame, base: DataFrame, inv: DataFrame, pg: DataFrame, rules: dict[str, str] = RULES, garbled: F.Column | None = None) -> DataFrame:
    """Lines for batches and direct receipts by rule, and other credits (ts, value) as noise."""
    net = F.sum(F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")).alias("net")
    b = pg.where("settlement_id is not null").groupBy(F.col("settled_at").cast("date").alias("sday"), "settlement_utr").agg(net).withColumn("dn", F.datediff("sday", F.lit("1995-01-01").cast("date")))
    order = W.orderBy("dn")  # one row a day
    near = lambda step, c: F.when(F.lead("dn", step).over(order) == F.col("dn") + step, F.lead(c, step).over(order))
    b = b.withColumns({"net2": near(1, "net"), "sday2": near(1, "sday"), "has_prev": near(-1, "dn").isNotNull()})
    b = b.withColumn("mode", F.expr("case when dn % 13 = 1 or (dn % 13 = 6 and has_prev) then 'none' when dn % 13 = 2 then 'short' when dn % 13 = 3 then 'split' when dn % 13 = 8 then 'plain' when dn % 13 = 5 and net2 is not null then 'merged' else 'exact' end"))
    quote = F.concat(F.lit("NEFT CR "), "settlement_utr", F.lit(" GATEWAY SETTLEMENT"))
    quote = F.when(F.col("dn") % 2 == 1, F.lower(quote)).otherwise(quote)
    line = lambda df, day, text, amount: df.select(F.expr(day).cast("date").alias("value_date"), text.alias("narration"), F.expr(amount).cast("bigint").alias("amount_paise"))
    direct = base.where(f"({rules['unpaid']}) and k % 2 = 0").join(inv.select(F.expr("cast(substring(invoice_no, 5) as bigint)").alias("k"), "gross_paise"), "k")
    less = F.col("gross_paise") - half_even(F.col("gross_paise"), 200)
    k12 = F.lpad(F.col("k").cast("string"), 12, "0")
    parts = [
        line(b.where("mode = 'exact'"), "sday", quote, "net"),
        line(b.where("mode = 'short'"), "sday", quote, "net - 1180"),
        line(b.where("mode = 'split'"), "sday", quote, "net * 4 div 10"),
        line(b.where("mode = 'split'"), "date_add(sday, 1)", quote, "net - net * 4 div 10"),
        line(b.where("mode = 'merged'"), "date_add(sday2, 1)", F.lit("NEFT CR GATEWAY SETTLEMENT CONSOLIDATED"), "net + net2"),
        line(b.where("mode = 'plain'"), "date_add(sday, 1)", F.concat(F.lit("IMPS GATEWAY SETTLEMENT "), "dn"), "net"),
        direct.where("k % 8 = 4").select(F.date_add("d", 3).alias("value_date"), F.concat(F.lit("RTGS-AXISN"), k12, F.lit("-"), F.lit("ACME-PMT AGST BILL") if garbled is None else garbled).alias("narration"), less.alias("amount_paise")),
        direct.where("k % 8 <> 4").select(F.date_add("d", 3).alias("value_date"), F.concat(F.lit("NEFT-AXISN"), k12, F.lit("-"), F.upper("customer"), F.lit("-DIRECT")).alias("narration"), F.when(F.expr("k % 4 = 0"), less).otherwise(F.col("gross_paise")).alias("amount_paise")),
        events.select(F.col("ts").cast("date").alias("value_date"), F.lit("INT.PD:12345678").alias("narration"), F.round(F.col("value") * 100).cast("bigint").alias("amount_paise")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    # Numbering a statement is one total order; each day is numbered by itself and days are offset.
    w = W.partitionBy("value_date").orderBy("narration", "amount_paise")
    days = out.groupBy("value_date").count()
    starts = days.select("value_date", F.coalesce(F.sum("count").over(W.orderBy("value_date").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return out.withColumn("nth", F.row_number().over(w)).join(starts, "value_date").select((F.col("start") + F.col("nth")).cast("int").alias("line_no"), "value_date", "narration", "amount_paise")


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """What the derived tables depend on: the session, the folder, and each read table's files as they are now."""
    jvm = spark.sparkContext._jvm
    seen = []
    for name in ("orders", "events"):
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        now = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        seen.append((now.getModificationTime(), now.getLen()))
    return (spark.sparkContext.applicationId, sf_dir, *seen)


WORLDS, CALENDAR = 8, 12_000  # worlds side by side; days from one calendar to the next


def world_of(key: F.Column) -> F.Column:
    """Of an invoice or gateway row by its number, of a batch by its day; null for bank lines."""
    number = F.regexp_extract(key, "[0-9]+$", 0).cast("bigint")
    return F.when(key.startswith("setl_"), F.floor(number / CALENDAR)).when(~key.startswith("bank:"), number % WORLDS).cast("int")


def _apart(df: DataFrame, number: str, *stamps: str) -> DataFrame:
    """Rows of world w on a calendar of their own: nothing matches without dates or ids that are near, so no two worlds meet."""
    days = (F.col(number) % WORLDS * CALENDAR).cast("int")
    return df.withColumns({c: (F.col(c) + F.make_interval(days=days)).cast(df.schema[c].dataType) for c in stamps})


def world(spark: SparkSession, sf_dir: str, apart: bool = False) -> dict[str, DataFrame]:
    """inv, pg and bank; ``apart``: of WORLDS worlds side by side."""
    at = (*state(spark, sf_dir), apart)
    if at not in _built:
        base = _base(spark, sf_dir)
        events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'purchase'")
        if apart:
            base, events = _apart(base, "k", "ts", "d"), _apart(events, "event_id", "ts")
        with ThreadPoolExecutor(2) as pool:
            of_inv, of_pg = pool.submit(lambda: keep(invoices(base))), pool.submit(lambda: keep(settled(gateway(base))))
            inv, pg = of_inv.result(), of_pg.result()
        _built[at] = {"inv": inv, "pg": pg, "bank": keep(bank(events, base, inv, pg))}
    return _built[at]
