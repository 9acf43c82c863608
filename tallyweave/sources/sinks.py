"""Writers: the three exports, ground truth and manifest, report packs and metrics.

Record-sized output is written by Spark as folders of part files, in the order
each export asks for. Only roll-ups and bounded lists come to the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money
from ..operators import evidence, reporting
from ..operators.legs import batches, union
from .exports import BANK_COLUMNS, GATEWAY_COLUMNS, INVOICE_COLUMNS
from .records import csv_line, write_one
from .scratch import keep

def running_balance(bank: DataFrame) -> DataFrame:
    """line_no, balance_paise: sums within each day, and days offset by the sums before."""
    day = W.partitionBy("value_date").orderBy("line_no")
    days = bank.groupBy("value_date").agg(F.sum("amount_paise").alias("total"), F.min("line_no").alias("first"))
    before = F.sum("total").over(W.orderBy("value_date")) - F.col("total")  # one row a day
    inside = F.sum("amount_paise").over(day)
    return bank.withColumn("inside", inside).join(days.select("value_date", before.alias("before")), "value_date").select("line_no", (F.col("before") + F.col("inside")).cast("bigint").alias("balance_paise"))


def _csv(df: DataFrame, order: list, columns: tuple[str, ...], path: str, one_file: bool) -> None:
    if one_file:
        write_one(df.select(csv_line(list(columns)), *order), order, path, ",".join(columns))
    else:
        df.orderBy(*order).select(*columns).write.option("header", True).option("emptyValue", "").option("escape", '"').mode("overwrite").csv(path)


def write_exports(sources: dict[str, DataFrame], folder: str, one_file: bool = False) -> None:
    """erp_invoices.csv, pg_settlement_report.csv and bank_statement.csv, each sorted as its readers expect; folders of parts in order, or one file each."""
    inv, pg, bank = (sources[k] for k in ("inv", "pg", "bank"))
    none, rupees = F.lit(""), evidence.rupees
    stamp = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), none)
    _csv(
        inv.withColumns({f"{c}_amount": rupees(F.col(f"{c}_paise")) for c in ("taxable", "tax", "gross")}),
        ["invoice_date", "invoice_no"], INVOICE_COLUMNS, f"{folder}/erp_invoices.csv", one_file,
    )
    side = lambda cond: F.when(cond, rupees(F.abs("amount_paise"))).otherwise("0.00")
    _csv(
        pg.withColumns(
            {
                "debit": side(F.col("amount_paise") < 0), "credit": side(F.col("amount_paise") > 0), "amount": rupees(F.col("amount_paise")), "fee": rupees(F.col("fee_paise")), "tax": rupees(F.col("tax_paise")), "currency": F.lit("INR"),
                "at": F.col("created_at"), "hold": F.when(F.col("on_hold"), "Y").otherwise("N"), "settled": F.when(F.col("settlement_id").isNotNull(), "Y").otherwise("N"), "created": stamp("created_at"), "settled_on": stamp("settled_at"),
            }
        ).drop("created_at", "settled_at", "on_hold").withColumnsRenamed({"created": "created_at", "settled_on": "settled_at", "hold": "on_hold"}),
        ["at", "entity_id"], GATEWAY_COLUMNS, f"{folder}/pg_settlement_report.csv", one_file,
    )
    blank = lambda cond: F.when(cond, rupees(F.abs("amount_paise"))).otherwise(none)
    ref = F.lit("") if "ref_no" not in bank.columns else F.col("ref_no")
    _csv(
        bank.join(running_balance(bank), "line_no").withColumns({"debit": blank(F.col("amount_paise") < 0), "credit": blank(F.col("amount_paise") > 0), "balance": rupees(F.col("balance_paise")), "ref_no": ref}),
        ["line_no"], BANK_COLUMNS, f"{folder}/bank_statement.csv", one_file,
    )


def manifest(sources: dict[str, DataFrame], links: DataFrame, codes: DataFrame, **told) -> dict:
    """Counts of records, of true links by leg and of planted exceptions by code."""
    n = lambda df, by: {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(by).collect()}
    planted = n(codes, "code")
    counts = {name: df.count() for name, df in sources.items()}
    return told | {"counts": counts | {"total": sum(counts.values())}, "true_links": n(links, "leg"), "injected": planted, "injected_total": sum(planted.values())}


#: Sections of the truth file, and the leg each is about.
SECTIONS = {"invoice_to_payment": "erp_to_gateway", "payment_to_batch": None, "invoice_to_bank": "invoice_to_bank", "exceptions": None, "batch_to_bank": "settlement_to_bank"}


def write_truth(spark: SparkSession, folder: str, links: DataFrame, codes: DataFrame, about: dict, members: DataFrame | None = None) -> None:
    """ground_truth.json, one object of maps as ``exports.truth`` reads it, and manifest.json.

    ``members``: entity_id, settlement_id of gateway rows. A record with several codes
    has the first by name, as a map holds one; links of a left key to several right
    ones are lists in ``batch_to_bank`` and the first one elsewhere.
    """
    as_json = lambda c: F.expr(f"substring(to_json(struct({c} as x)), 6, length(to_json(struct({c} as x))) - 6)")
    entries, names = [], list(SECTIONS)
    for i, (name, leg) in enumerate(SECTIONS.items()):
        if name == "exceptions":
            rows = codes.select("key", F.col("code").alias("value"))
        elif name == "payment_to_batch":
            rows = links.limit(0).select(F.col("a").alias("key"), F.col("b").alias("value")) if members is None else members.where("settlement_id is not null").select(F.col("entity_id").alias("key"), F.col("settlement_id").alias("value"))
        else:
            rows = links.where(F.col("leg") == leg).select(F.col("a").alias("key"), F.col("b").alias("value"))
        if name == "batch_to_bank":
            rows = rows.groupBy("key").agg(F.array_sort(F.collect_set("value")).alias("all")).select("key", as_json("all").alias("value"))
        else:
            rows = rows.groupBy("key").agg(F.min("value").alias("value")).select("key", as_json("value").alias("value"))
        entries.append(rows.select(F.lit(i).alias("section"), "key", F.concat(as_json("key"), F.lit(": "), "value").alias("entry")))
    every = keep(union(*entries))
    first = F.broadcast(every.groupBy("section").agg(F.min("key").alias("first")))  # a row a section
    body = every.join(first, "section").select("section", F.lit(1).alias("part"), "key", F.concat(F.when(F.col("key") == F.col("first"), F.lit("    ")).otherwise(F.lit("  , ")), "entry").alias("line"))
    about_line = json.dumps(about)
    frame = [(-1, 0, "", "{"), (-1, 1, "", f'  "manifest": {about_line},')]
    for i, name in enumerate(names):
        frame += [(i, 0, "", f'  "{name}": {{'), (i, 2, "", "  }" + ("," if i < len(names) - 1 else ""))]
    frame.append((len(names), 0, "", "}"))
    rows = body.unionByName(spark.createDataFrame(frame, "section int, part int, key string, line string"))
    write_one(rows, ["section", "part", "key"], f"{folder}/ground_truth.json")
    write_text(spark, f"{folder}/manifest.json", json.dumps(about, indent=2))


def read_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest, or a seed that says unknown."""
    path = f"{folder}/manifest.json"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return {"seed": "unknown"}
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One small file, through Hadoop's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content.encode()))
    out.close()


def _table(df: DataFrame, *order) -> str:
    rows = [["" if v is None else str(v) for v in r] for r in df.orderBy(*order).collect()]
    escape = lambda v: v.replace("|", "\\|").replace("\n", " ")
    return "\n".join("| " + " | ".join(map(escape, r)) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])


def markdown(sources: dict[str, DataFrame], run: dict[str, DataFrame], scores: DataFrame | None = None, log: DataFrame | None = None, seed: object = "unknown") -> str:
    """The report: bridge, tiers, scores and verdicts, all of them short tables."""
    bridge = reporting.bridge_rows(reporting.position(sources["pg"], run)).withColumn("amount", money.indian_format(F.col("amount_paise"))).drop("amount_paise")
    parts = ["# Reconciliation", f"Seed {seed}.", "## Cash", _table(bridge, "step"), "## Matches", _table(reporting.tiers(run["matches"]), "leg", "tier"), "## Findings", _table(reporting.by_code(run["findings"]), F.desc("exposure_paise"), "code")]
    if scores is not None:
        parts += ["## Scores", _table(scores, scores.columns[0])]
    parts += ["## Exceptions", "All of them, by code, are in exceptions.md beside this report."]
    if log is not None:
        parts += ["## Judged", _table(log.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")), "verdict")]
    return "\n\n".join(parts) + "\n"


def write_exceptions(sources: dict[str, DataFrame], run: dict[str, DataFrame], path: str) -> None:
    """One Markdown file of every finding, codes by exposure and findings by value, written by many tasks."""
    lists = evidence.exceptions_by_code(evidence.explained(run["findings"], sources, run["matches"]))
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")
    rows = lists.select("exposure_paise", "code", "nth", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("nth", "key", "value_paise", "action")]), F.lit(" |")).alias("line"))
    heads = lists.where("nth = 1").select("exposure_paise", "code", F.posexplode(F.array(F.lit(""), F.concat(F.lit("## "), "code"), F.lit(""), F.lit("| nth | key | paise | action |"), F.lit("|---|---|---|---|"))).alias("i", "line"))
    write_one(rows.unionByName(heads.select("exposure_paise", "code", (F.col("i") - 5).cast(rows.schema["nth"].dataType).alias("nth"), "line")), [F.desc("exposure_paise"), "code", "nth"], path, "# Exceptions")


def _json(df: DataFrame, path: str) -> None:
    """JSON lines that keep nulls."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_pack(spark: SparkSession, folder: str, sources: dict[str, DataFrame], run: dict[str, DataFrame], scores: DataFrame | None = None, log: DataFrame | None = None, seed: object = "unknown") -> dict:
    """recon.md, exceptions.md, the JSON pack (position, matches/, findings/, adjudications/) and metrics.json."""
    _json(run["matches"], f"{folder}/matches")
    _json(evidence.explained(run["findings"], sources, run["matches"]), f"{folder}/findings")
    if log is not None:
        _json(log, f"{folder}/adjudications")
    write_text(spark, f"{folder}/recon.md", markdown(sources, run, scores, log, seed))
    write_exceptions(sources, run, f"{folder}/exceptions.md")
    position = reporting.position(sources["pg"], run).first().asDict()
    write_text(spark, f"{folder}/position.json", json.dumps(position, indent=2))
    counts = {r["source"]: r["n"] for r in reporting.record_counts(sources).collect()} | {"settlement_batches": batches(sources["pg"]).count(), "matches": run["matches"].count(), "findings": run["findings"].count()}
    metrics = {"seed": seed, "counts": counts, "tiers": {f"{r['leg']}/{r['tier']}": r["n"] for r in reporting.tiers(run["matches"]).collect()}, "scores": [] if scores is None else [r.asDict() for r in scores.collect()]}
    write_text(spark, f"{folder}/metrics.json", json.dumps(metrics, indent=2))
    return metrics
