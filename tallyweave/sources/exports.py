"""The three CSV exports: typed rows, and rejects with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, text
from .records import records

# The columns of the three exports.
INVOICE_COLUMNS = ("invoice_no", "order_id", "customer", "invoice_date", "taxable_amount", "tax_amount", "gross_amount", "currency")
GATEWAY_COLUMNS = ("entity_id", "type", "debit", "credit", "amount", "currency", "fee", "tax", "on_hold", "settled", "created_at", "settled_at", "settlement_id", "settlement_utr", "order_id", "order_receipt", "method", "dispute_id", "parent_payment_id")
BANK_COLUMNS = ("line_no", "value_date", "narration", "ref_no", "debit", "credit", "balance")


def _scan(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """The columns as strings, ``seq`` (file order) and ``rownum`` (the header is 1)."""
    fields = F.from_csv("value", ", ".join(f"{c} string" for c in columns), {"escape": '"'})
    return records(spark, path).where("rownum > 1").select(fields.alias("r"), "file", "rownum").select("r.*", F.struct("file", "rownum").alias("seq"), "rownum")


def _split(rows: DataFrame, checks: dict[str, Column], out: list[Column], name: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects): a row is rejected for the first check that is not true."""
    reason = F.lit(None).cast("string")
    for what, ok in reversed(checks.items()):
        reason = F.when(F.coalesce(ok, F.lit(False)), reason).otherwise(F.lit(what))
    judged = rows.withColumn("reason", reason)
    rejects = judged.where("reason is not null").select(F.lit(name).alias("file"), "rownum", "reason", F.concat(F.lit(f"{name}:"), "rownum", F.lit(": "), "reason").alias("error"))
    return judged.where("reason is null").select(*out, "seq"), rejects


def _amount(c: str) -> Column:
    return F.coalesce(money.to_paise(F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "0").otherwise(F.col(c))))


def invoices(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = _scan(spark, path, INVOICE_COLUMNS)
    day, paise = text.parse_date(F.col("invoice_date")), {c: money.to_paise(F.col(f"{c}_amount")) for c in ("taxable", "tax", "gross")}
    checks = {"no invoice number": F.col("invoice_no").isNotNull(), "bad date": day.isNotNull()} | {f"bad {c} amount": v.isNotNull() for c, v in paise.items()}
    out = [F.trim("invoice_no").alias("invoice_no"), F.trim("order_id").alias("order_id"), F.trim("customer").alias("customer"), day.alias("invoice_date"), *[v.alias(f"{c}_paise") for c, v in paise.items()], F.coalesce(text.optional(F.col("currency")), F.lit("INR")).alias("currency")]
    return _split(rows, checks, out, "erp_invoices")


def gateway(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = _scan(spark, path, GATEWAY_COLUMNS)
    created, settled = text.parse_time(F.col("created_at")), text.parse_time(F.col("settled_at"))
    paise = {c: money.to_paise(F.col(c)) for c in ("amount", "fee", "tax")}
    checks = {"no entity": F.col("entity_id").isNotNull(), "bad time": created.isNotNull(), "bad settlement time": settled.isNotNull() | text.optional(F.col("settled_at")).isNull()} | {f"bad {c}": v.isNotNull() for c, v in paise.items()}
    out = [
        F.trim("entity_id").alias("entity_id"),
        F.lower(F.trim("type")).alias("type"),
        *[v.alias(f"{c}_paise") for c, v in paise.items()],
        created.alias("created_at"),
        F.lower(F.trim("method")).alias("method"),
        text.optional(F.col("order_id")).alias("order_id"),
        text.optional(F.col("order_receipt")).alias("order_receipt"),
        text.optional(F.col("settlement_id")).alias("settlement_id"),
        F.upper(text.optional(F.col("settlement_utr"))).alias("settlement_utr"),
        settled.alias("settled_at"),
        text.flag(F.col("on_hold")).alias("on_hold"),
        text.optional(F.col("dispute_id")).alias("dispute_id"),
        text.optional(F.col("parent_payment_id")).alias("parent_payment_id"),
    ]
    return _split(rows, checks, out, "pg_settlement_report")


def bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = _scan(spark, path, BANK_COLUMNS)
    day, line = text.parse_date(F.col("value_date")), F.trim("line_no").try_cast("int")
    debit, credit, balance = (_amount(c) for c in ("debit", "credit", "balance"))
    checks = {"bad line number": line.isNotNull(), "bad date": day.isNotNull(), "bad debit": debit.isNotNull(), "bad credit": credit.isNotNull(), "bad balance": balance.isNotNull()}
    out = [line.alias("line_no"), day.alias("value_date"), F.coalesce("narration", F.lit("")).alias("narration"), F.trim("ref_no").alias("ref_no"), (credit - F.abs(debit)).alias("amount_paise"), balance.alias("balance_paise")]
    return _split(rows, checks, out, "bank_statement")


def load(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The three sources, and all rejects."""
    inv, bad_inv = invoices(spark, f"{folder}/erp_invoices.csv")
    pg, bad_pg = gateway(spark, f"{folder}/pg_settlement_report.csv")
    lines, bad_lines = bank(spark, f"{folder}/bank_statement.csv")
    return {"inv": inv, "pg": pg, "bank": lines}, bad_inv.unionByName(bad_pg).unionByName(bad_lines)


def truth(spark: SparkSession, path: str) -> DataFrame:
    """kind, key, value of a ground-truth file's link maps and exceptions; the file is one JSON object, so one task reads it."""
    maps = ("invoice_to_payment", "payment_to_batch", "invoice_to_bank", "exceptions")
    schema = ", ".join([*[f"{m} map<string,string>" for m in maps], "batch_to_bank map<string,array<string>>"])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    out = None
    for m in maps:
        part = raw.select(F.lit(m).alias("kind"), F.explode(m).alias("key", "value"))
        out = part if out is None else out.unionByName(part)
    lists = raw.select(F.explode("batch_to_bank").alias("key", "values")).select(F.lit("batch_to_bank").alias("kind"), "key", F.explode("values").alias("value"))
    return out.unionByName(lists)
