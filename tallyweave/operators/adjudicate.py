"""A judge's choice among fixed candidates, and the arithmetic its choice must pass.

A judge is any callable (key, candidate keys) -> candidate key or None, such as a
model or a rule. It sees the three best candidates of an item that are still
free, and may only pick among them. Items are served in order, as each accepted
pick takes its candidate from the later ones; ``serial`` keeps that order by asking
all open items at once and keeping what no earlier pick can upset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import keep
from . import legs, serial
from .nearest import nearest

Judge = Callable[[str, list[str]], str | None]
OFFERED = 3
LISTED = 32  # nearest candidates found at once, so that some may be taken by earlier items
CONFIDENCE = 620
LOG = "lkey string, candidates array<string>, chose string, verdict string"
_DECIDED = "candidates array<string>, chose string, verdict string"


def decline(key: str, candidates: list[str]) -> None:
    """The default judge."""


def take_first(key: str, candidates: list[str]) -> str:
    """A scripted judge: the nearest candidate."""
    return candidates[0]


def top_candidates(edges: DataFrame, k: int = OFFERED) -> DataFrame:
    """The k right rows nearest in amount, then in days, of each left row: lkey, rank, rkey, diff, gap."""
    w = W.partitionBy("lkey").orderBy("diff", "gap", "rkey")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("lkey", "rank", "rkey", "diff", "gap")


def _asking(judge: Judge) -> serial.Decide:
    def decide(item: str, options: list[dict]) -> tuple[int | None, int, tuple | None]:
        offered = [o["rkey"] for o in options[:OFFERED]]
        if not offered:
            return None, 0, None  # all taken: nobody is asked
        pick = judge(item, offered)
        at = offered.index(pick) if pick in offered else None
        verdict = "declined" if at is None else "accepted" if options[at]["fits"] else "rejected_by_arithmetic"
        return (at if verdict == "accepted" else None), len(offered), (offered, pick, verdict)

    return decide


def _in_order(edges: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("lkey").orderBy("diff", "gap", "rkey"))
    return edges.select(F.col("lkey").alias("ord"), F.col("lkey").alias("item"), place.alias("place"), F.array("rkey").alias("takes"), "rkey", "fits")


def adjudicate(edges: DataFrame, judge: Judge = decline, chunk: int = serial.CHUNK) -> DataFrame:
    """The log of all decisions: lkey, candidates, chose, verdict (accepted, declined or rejected_by_arithmetic).

    edges: lkey, rkey, diff, gap, fits (whether the arithmetic holds), all that there are; items go in order of lkey.
    """
    return serial.choose(_in_order(edges), _asking(judge), _DECIDED, chunk=chunk).withColumnRenamed("item", "lkey")


def adjudicate_nearest(left: DataFrame, right: DataFrame, judge: Judge = decline, gate: Column | None = None, chunk: int = serial.CHUNK) -> DataFrame:
    """The same log where an item's candidates are the three rows of ``right`` that are nearest and free, however far.

    left: lkey, amount, ldate; right: rkey, amount, rdate and what ``gate`` reads. A pick
    fits within ADJUDICATION_TOL, where the gate holds too; so an item can only ever take
    rows in the cells of amounts around its own.
    """
    left, right = keep(left), keep(right)
    listed = [LISTED]  # grows, as later rounds stand where more is taken
    cell = lambda amount: F.floor(amount / legs.ADJUDICATION_TOL)
    names = lambda cells: F.transform(cells, lambda c: F.concat(F.lit("cell "), c.cast("string")))

    def offers(decided: DataFrame | None, taken: DataFrame | None) -> DataFrame:
        items, free = left, right.withColumn("by", F.lit(None).cast("string"))
        if decided is not None:
            items = keep(left.join(decided, left["lkey"] == decided["item"], "left_anti"))
            first = F.broadcast(items.agg(F.min("lkey").alias("first")))  # one row
            free = right.join(taken, right["rkey"] == taken["t"], "left").join(first).where("by is null or by > first").drop("t", "first")
        k, found = listed[0], None
        visible = F.expr("by is null or by > lkey")
        while found is None:
            near = keep(nearest(items, free, k))
            count = near.groupBy("lkey").agg(F.count_if(visible).alias("seen"), (F.count(F.lit(1)) == k).alias("more"))
            if count.where((F.col("seen") < OFFERED) & F.col("more")).isEmpty():
                found = near.where(visible).join(count.select("lkey", "more"), "lkey")
                listed[0] = k
            k *= 2  # rows that earlier items took stand in the way of some
        fits = F.col("diff") <= legs.ADJUDICATION_TOL
        found = found.withColumn("fits", fits if gate is None else fits & gate)
        own = cell(F.col("lamount"))
        return found.select(
            F.col("lkey").alias("ord"), F.col("lkey").alias("item"), F.col("rank").alias("place"), F.array("rkey").alias("takes"), "rkey", "fits", "more", F.col("lamount").alias("deal"),
            names(F.array(cell(F.col("ramount")))).alias("tokens"), names(F.array(own - 1, own, own + 1)).alias("reach"),
        )

    return serial.choose(offers(None, None), _asking(judge), _DECIDED, offers, chunk, OFFERED).withColumnRenamed("item", "lkey")


def verdicts(log: DataFrame) -> DataFrame:
    """verdict, n."""
    return log.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


# --- candidates of the three legs, from a run's open findings


def _open(df: DataFrame, key: str, findings: DataFrame, code: str) -> DataFrame:
    return df.join(findings.where(F.col("code") == code).select(F.col("key").alias(key)).distinct(), key, "left_semi")


def payments_for_invoices(inv: DataFrame, pg: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame, None]:
    """(open invoices, open payments, no gate but the amounts)"""
    left = _open(inv, "invoice_no", findings, "UNPAID_INVOICE").select(F.col("invoice_no").alias("lkey"), F.col("gross_paise").alias("amount"), F.col("invoice_date").alias("ldate"))
    right = _open(pg, "entity_id", findings, "UNBILLED_PAYMENT").select(F.col("entity_id").alias("rkey"), F.col("amount_paise").alias("amount"), F.col("created_at").cast("date").alias("rdate"))
    return left, right, None


def lines_for_batches(pg: DataFrame, bank: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """(open batches, open lines, the gate: a line also has to read like a settlement)"""
    left = _open(legs.batches(pg), "settlement_id", findings, "MISSING_IN_BANK").select(F.col("settlement_id").alias("lkey"), F.col("net_paise").alias("amount"), F.col("settled_at").cast("date").alias("ldate"))
    right = _open(bank.withColumn("rkey", legs.bank_key()), "rkey", findings, "UNEXPECTED_BANK_CREDIT").select("rkey", F.col("amount_paise").alias("amount"), F.col("value_date").alias("rdate"), text.looks_like_settlement(F.col("narration")).alias("gateway"))
    return left, right, F.col("gateway")


def invoices_for_lines(inv: DataFrame, bank: DataFrame, findings: DataFrame) -> DataFrame:
    """Items are bank lines; candidates share a name word, and fit since their amounts and dates agree."""
    edges = legs.direct_edges(inv, bank, findings).where("score > 0")
    return edges.select(F.col("rkey").alias("lkey"), F.col("lkey").alias("rkey"), F.abs(F.col("ramount") - F.col("gross_paise")).alias("diff"), F.lit(0).alias("gap"), F.lit(True).alias("fits"), "relation", "gross_paise", "ramount")


def consult(sources: dict[str, DataFrame], run: dict[str, DataFrame], judge: Judge = decline, on: frozenset[str] = frozenset({"invoice_to_bank"})) -> dict[str, DataFrame]:
    """The run after a judge has seen what it left open, on the legs asked for: matches, findings and the log.

    Accepted picks become T4 matches, and the findings they answer are retracted.
    """
    inv, pg, bank = (sources[k] for k in ("inv", "pg", "bank"))
    matches, found, logs = run["matches"], run["findings"], []
    for leg, gone in (("erp_to_gateway", ("UNPAID_INVOICE", "UNBILLED_PAYMENT")), ("settlement_to_bank", ("MISSING_IN_BANK", "UNEXPECTED_BANK_CREDIT")), ("invoice_to_bank", ("UNPAID_INVOICE", "UNEXPECTED_BANK_CREDIT"))):
        if leg not in on:
            continue
        if leg == "invoice_to_bank":
            offers = keep(invoices_for_lines(inv, bank, found))
            log = keep(adjudicate(offers, judge))
        else:
            left, right, gate = payments_for_invoices(inv, pg, found) if leg == "erp_to_gateway" else lines_for_batches(pg, bank, found)
            log = keep(adjudicate_nearest(left, right, judge, gate))
            offers = None
        logs.append(log.select(F.lit(leg).alias("leg"), "*"))
        picked = log.where("verdict = 'accepted'").select("lkey", F.col("chose").alias("rkey"))
        if offers is None:
            picked = picked.join(left.select("lkey", F.col("amount").alias("lamount")), "lkey").join(right.select("rkey", F.col("amount").alias("ramount")), "rkey")
        else:
            picked = picked.join(offers, ["lkey", "rkey"])
        picked = keep(picked)
        direct = leg == "invoice_to_bank"
        left, right = ("rkey", "lkey") if direct else ("lkey", "rkey")
        delta = F.col("ramount") - (F.col("gross_paise") if direct else F.col("lamount"))
        matches = matches.unionByName(legs.match(picked, leg, left, right, "T4_ADJUDICATED", F.lit(CONFIDENCE), delta))
        solved = picked.select(F.explode(F.array("lkey", "rkey")).alias("key"))
        answered = F.col("code").isin(*gone)
        found = found.where(~answered).unionByName(found.where(answered).join(solved, "key", "left_anti").select(found.columns))
        if direct:
            found = found.unionByName(legs.finding(picked.where("relation <> 'gross'"), "rkey", "erp", "TDS_WITHHELD", legs.AUTO, F.col("gross_paise") - F.col("ramount")))
        found = keep(found)
    log = legs.union(*logs) if logs else bank.sparkSession.createDataFrame([], f"leg string, {LOG}")
    return {"matches": keep(matches), "findings": found, "log": log}
