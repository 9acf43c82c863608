"""The reconciliation queries by name, and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, text
from ..operators import adjudicate, answers, evidence, legs, reporting
from ..operators.nearest import nearest
from ..sources import exports, sinks
from ..sources import records as files
from ..sources.scratch import keep, shared_folder
from ..sources.world import world
from . import runs, truth
from .world_sql import WORLD, he

FLAGSHIP = "tier_counts"
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None, derived: bool = True):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = (WORLD if derived else "") + sql
        return f

    return put


def _w(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return world(spark, sf_dir)[name]


# --- sources and scalar functions


@query("derived_invoices", "SELECT invoice_no, order_id, customer, invoice_date, taxable_paise, tax_paise, gross_paise FROM inv")
def _(spark, sf_dir):
    return _w(spark, sf_dir, "inv").drop("currency", "seq")


@query("derived_gateway", "SELECT entity_id, type, amount_paise, fee_paise, tax_paise, created_at, method, order_id, order_receipt, on_hold, parent AS parent_payment_id, settlement_id, amount_paise - fee_paise - tax_paise AS net_paise FROM pg")
def _(spark, sf_dir):
    cols = ["entity_id", "type", "amount_paise", "fee_paise", "tax_paise", "created_at", "method", "order_id", "order_receipt", "on_hold", "parent_payment_id", "settlement_id"]
    return _w(spark, sf_dir, "pg").select(*cols, (F.col("amount_paise") - F.col("fee_paise") - F.col("tax_paise")).alias("net_paise"))


@query("derived_bank", "SELECT line_no, value_date, narration, amount_paise FROM bank")
def _(spark, sf_dir):
    return _w(spark, sf_dir, "bank")


@query("running_balance", "SELECT line_no, CAST(sum(amount_paise) OVER (ORDER BY line_no) AS BIGINT) AS balance_paise FROM bank")
def _(spark, sf_dir):
    return sinks.running_balance(_w(spark, sf_dir, "bank"))


_AMOUNT = "printf('%s%d.%02d', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'INR ' WHEN 2 THEN 'Rs.' ELSE '(' END, p // 100, p % 100) || CASE WHEN o_orderkey % 4 = 3 THEN ')' ELSE '' END"


@query("paise_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN -p ELSE p END AS paise FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders)", False)
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"))
    plain = F.format_string("%d.%02d", F.expr("p div 100"), F.expr("p % 100"))
    shown = F.expr("o_orderkey % 4")
    written = F.when(shown == 0, plain).when(shown == 1, F.concat(F.lit("INR "), plain)).when(shown == 2, F.concat(F.lit("Rs."), plain)).otherwise(F.concat(F.lit("("), plain, F.lit(")")))
    return o.select("o_orderkey", money.to_paise(written).alias("paise"))


@query("indian_format", "SELECT o_orderkey, CASE WHEN len(w) > 3 THEN reverse(regexp_replace(reverse(substr(w, 1, len(w) - 3)), '(..)', '\\1,', 'g')) ELSE '' END AS head, w, c FROM (SELECT o_orderkey, CAST(p // 100 AS VARCHAR) AS w, p % 100 AS c FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders))", False)
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("p"))
    return o.select("o_orderkey", money.indian_format(F.col("p")).alias("shown"))


ORACLES["indian_format"] = """SELECT o_orderkey, (CASE WHEN len(w) > 3 THEN ltrim(reverse(regexp_replace(reverse(substr(w, 1, len(w) - 3)), '(..)', '\\1,', 'g')), ',') || ',' || substr(w, len(w) - 2) ELSE w END) || '.' || lpad(CAST(c AS VARCHAR), 2, '0') AS shown
FROM (SELECT o_orderkey, CAST(p // 100 AS VARCHAR) AS w, p % 100 AS c FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders))"""


@query("percent_of", f"SELECT invoice_no, CAST(round(tax_paise * 100.0 / gross_paise * 100) AS BIGINT) AS hundredths FROM inv")
def _(spark, sf_dir):
    return _w(spark, sf_dir, "inv").select("invoice_no", F.round(money.percent_of(F.col("tax_paise"), F.col("gross_paise")) * 100).cast("bigint").alias("hundredths"))


@query("date_parse_formats", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed FROM orders", False)
def _(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    shown = F.lit(None).cast("string")
    for i, f in enumerate(text.DATE_FORMATS):
        shown = F.when(F.col("o_orderkey") % len(text.DATE_FORMATS) == i, F.date_format("o_orderdate", f)).otherwise(shown)
    return o.select("o_orderkey", text.parse_date(shown).alias("parsed"))


@query("utr_extract", "SELECT line_no, list_distinct(regexp_extract_all(upper(narration), '\\b[A-Z]{4}[A-Z0-9][0-9]{10,14}\\b'))[1] AS utr FROM bank")
def _(spark, sf_dir):
    return _w(spark, sf_dir, "bank").select("line_no", F.get(text.utrs(F.col("narration")), F.lit(0)).alias("utr"))


@query("settlement_gate", "SELECT line_no, regexp_matches(lower(narration), 'razorpay|rzp|settl') AS gateway FROM bank")
def _(spark, sf_dir):
    return _w(spark, sf_dir, "bank").select("line_no", text.looks_like_settlement(F.col("narration")).alias("gateway"))


@query("long_digit_runs", "SELECT line_no, array_to_string(regexp_extract_all(narration, '\\b[0-9]{10,22}\\b'), ' ') AS runs FROM bank")
def _(spark, sf_dir):
    return _w(spark, sf_dir, "bank").select("line_no", F.array_join(text.long_numbers(F.col("narration")), " ").alias("runs"))


@query("norm_id_keys", "SELECT entity_id, regexp_replace(lower(coalesce(order_receipt, '')), '[^a-z0-9]', '', 'g') AS nk FROM pg")
def _(spark, sf_dir):
    return _w(spark, sf_dir, "pg").select("entity_id", text.norm_id(F.col("order_receipt")).alias("nk"))


@query("expected_fee_by_method", f"SELECT method, CAST(sum({he('amount_paise', 'bps')}) AS BIGINT) AS fee, count(*) AS n FROM p GROUP BY method")
def _(spark, sf_dir):
    fee, _gst = money.expected_fee(F.col("amount_paise"), F.col("method"))
    return _w(spark, sf_dir, "pg").where("entity_id like 'pay\\_%' and type = 'payment'").groupBy("method").agg(F.sum(fee).cast("bigint").alias("fee"), F.count(F.lit(1)).alias("n"))


# --- legs


@query("duplicate_payments", "SELECT entity_id, first_capture, amount_paise FROM ranked WHERE nth > 1")
def _(spark, sf_dir):
    return legs.ranked_payments(_w(spark, sf_dir, "pg")).where("nth > 1").select("entity_id", "first_capture", "amount_paise")


@query("primary_payments", "SELECT entity_id, amount_paise FROM prim")
def _(spark, sf_dir):
    return legs.ranked_payments(_w(spark, sf_dir, "pg")).where("nth = 1").select("entity_id", "amount_paise")


@query("settlement_batches", "SELECT settlement_id, utr, amount_paise, fee_paise, tax_paise, net AS net_paise FROM batch")
def _(spark, sf_dir):
    return legs.batches(_w(spark, sf_dir, "pg")).select("settlement_id", "utr", "amount_paise", "fee_paise", "tax_paise", "net_paise")


def _matches(name: str, leg: str, tier: str, which) -> None:
    @query(name, f"SELECT lkey, rkey, confidence, delta_paise FROM matches WHERE leg = '{leg}' AND tier = '{tier}'")
    def _(spark, sf_dir):
        return which(spark, sf_dir).where(f"leg = '{leg}' and tier = '{tier}'").select("lkey", "rkey", F.col("confidence").cast("int"), "delta_paise")


_erp = lambda spark, sf_dir: runs.erp(spark, sf_dir)[0]
_bank = lambda spark, sf_dir: runs.bank(spark, sf_dir)[0]
_full = lambda spark, sf_dir: runs.full(spark, sf_dir)["matches"]
_matches("match_t0_order", "erp_to_gateway", "T0_EXACT_ID", _erp)
_matches("match_t1_receipt", "erp_to_gateway", "T1_NORMALIZED_ID", _erp)
_matches("match_t2_amount_date", "erp_to_gateway", "T2_AMOUNT_DATE", _erp)
_matches("match_utr", "settlement_to_bank", "T0_EXACT_ID", _bank)
_matches("amount_mismatches", "settlement_to_bank", "T1_NORMALIZED_ID", _bank)
_matches("split_and_merged", "settlement_to_bank", "T3_AGGREGATE", _bank)
_matches("match_batch_amount_date", "settlement_to_bank", "T2_AMOUNT_DATE", _bank)
_matches("direct_receipts", "invoice_to_bank", "T2_AMOUNT_DATE", _full)


def _findings(name: str, code: str, which) -> None:
    @query(name, f"SELECT key, source, disposition, CAST(value_paise AS BIGINT) AS value_paise FROM findings WHERE code = '{code}'")
    def _(spark, sf_dir):
        return which(spark, sf_dir).where(f"code = '{code}'").select("key", "source", "disposition", "value_paise")


def _integrity(spark, sf_dir):
    return legs.integrity(_w(spark, sf_dir, "inv"), _w(spark, sf_dir, "pg"))


_all = lambda spark, sf_dir: runs.full(spark, sf_dir)["findings"]
for _name, _code, _which in (
    ("fee_variance", "FEE_VARIANCE", _integrity), ("tax_line_mismatch", "TAX_LINE_MISMATCH", _integrity), ("funds_on_hold", "FUNDS_ON_HOLD", _integrity),
    ("chargebacks", "CHARGEBACK_ADJUSTMENT", _integrity), ("orphan_refunds", "ORPHAN_REFUND", _integrity), ("residual_unpaid", "UNPAID_INVOICE", _all),
    ("residual_unbilled", "UNBILLED_PAYMENT", _all), ("split_settlements", "SPLIT_SETTLEMENT", _all), ("settlement_mismatch", "SETTLEMENT_AMOUNT_MISMATCH", _all),
    ("merged_payouts", "MERGED_PAYOUT", _all), ("missing_in_bank", "MISSING_IN_BANK", _all), ("unexpected_credits", "UNEXPECTED_BANK_CREDIT", _all), ("tds_withheld", "TDS_WITHHELD", _all),
):
    _findings(_name, _code, _which)


@query("token_overlap_pairs", "SELECT invoice_no, line, CAST(round(score * 1000) AS BIGINT) AS overlap FROM dscored")
def _(spark, sf_dir):
    edges = legs.direct_edges(_w(spark, sf_dir, "inv"), _w(spark, sf_dir, "bank"), runs.before_direct(spark, sf_dir))
    return edges.select(F.col("lkey").alias("invoice_no"), F.col("rkey").alias("line"), F.round(F.col("score") * 1000).cast("bigint").alias("overlap"))


# --- roll-ups


@query("tier_counts", "SELECT leg, tier, count(DISTINCT lkey) AS n FROM matches GROUP BY leg, tier")
def _(spark, sf_dir):
    return reporting.tiers(runs.full(spark, sf_dir)["matches"])


@query("findings_by_code", "SELECT code, count(*) AS n, CAST(sum(abs(value_paise)) AS BIGINT) AS exposure_paise, count(*) FILTER (disposition = 'needs_review') AS to_review FROM findings GROUP BY code")
def _(spark, sf_dir):
    return reporting.by_code(runs.full(spark, sf_dir)["findings"])


@query("primary_finding", "SELECT key, code, CAST(value_paise AS BIGINT) AS value_paise FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(value_paise) DESC, code) AS r FROM findings) WHERE r = 1")
def _(spark, sf_dir):
    return reporting.primary_finding(runs.full(spark, sf_dir)["findings"])


@query("aging", "SELECT invoice_no, datediff('day', invoice_date, (SELECT max(invoice_date) FROM inv)) AS age_days FROM unpaid")
def _(spark, sf_dir):
    inv, found = _w(spark, sf_dir, "inv"), runs.before_direct(spark, sf_dir).where("code = 'UNPAID_INVOICE'")
    newest = F.broadcast(inv.agg(F.max("invoice_date").alias("newest")))  # one row
    return inv.join(found.select(F.col("key").alias("invoice_no")), "invoice_no").join(newest).select("invoice_no", F.datediff("newest", "invoice_date").cast("bigint").alias("age_days"))


_POSITION = """, bridge AS (SELECT
  CAST(sum(amount_paise) FILTER (type = 'payment') AS BIGINT) AS captured, CAST(sum(amount_paise) FILTER (type = 'payment' AND on_hold) AS BIGINT) AS on_hold,
  CAST(coalesce(sum(amount_paise) FILTER (type = 'payment' AND NOT on_hold AND settlement_id IS NULL), 0) AS BIGINT) AS unbatched,
  CAST(sum(amount_paise) FILTER (type = 'payment' AND NOT on_hold AND settlement_id IS NOT NULL) AS BIGINT) AS entering,
  CAST(sum(fee_paise) FILTER (type = 'payment' AND NOT on_hold AND settlement_id IS NOT NULL) AS BIGINT) AS fees,
  CAST(sum(tax_paise) FILTER (type = 'payment' AND NOT on_hold AND settlement_id IS NOT NULL) AS BIGINT) AS gst,
  CAST(sum(-amount_paise) FILTER (type = 'refund' AND settlement_id IS NOT NULL) AS BIGINT) AS refunds,
  CAST(sum(-amount_paise) FILTER (type = 'adjustment' AND settlement_id IS NOT NULL) AS BIGINT) AS disputes FROM pg
), nets AS (SELECT CAST(sum(net) AS BIGINT) AS batch_net, CAST(coalesce((SELECT sum(net) FROM missing), 0) AS BIGINT) AS in_transit FROM batch
), codes AS (SELECT CAST(coalesce(sum(value_paise) FILTER (code = 'UNEXPECTED_BANK_CREDIT'), 0) AS BIGINT) AS unexplained_credits, CAST(coalesce(sum(value_paise) FILTER (code = 'UNPAID_INVOICE'), 0) AS BIGINT) AS open_receivables,
  CAST(coalesce(sum(value_paise) FILTER (code = 'UNBILLED_PAYMENT'), 0) AS BIGINT) AS unbilled_revenue, CAST(coalesce(sum(value_paise) FILTER (code = 'TDS_WITHHELD'), 0) AS BIGINT) AS tds_receivable FROM findings
), pos AS (SELECT *, entering - refunds - fees - gst - disputes AS settled_net, batch_net - in_transit AS landed, entering - refunds - fees - gst - disputes - batch_net AS residual FROM bridge, nets, codes)
"""


@query("cash_bridge", _POSITION + "SELECT * FROM pos")
def _(spark, sf_dir):
    return reporting.position(_w(spark, sf_dir, "pg"), runs.full(spark, sf_dir))


@query("bridge_rows", _POSITION + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS label, {s} * {n} AS amount_paise FROM pos" for i, (n, s) in enumerate(reporting.BRIDGE, 1)) + ")")
def _(spark, sf_dir):
    return reporting.bridge_rows(reporting.position(_w(spark, sf_dir, "pg"), runs.full(spark, sf_dir)))


# --- scores against the rules that made the world


def _true_links(spark, sf_dir) -> DataFrame:
    return truth.erp_links(world(spark, sf_dir))


_SCORE = "round(1000000 * {0})"


@query("link_scores", """, truth AS (SELECT 'INV-' || k AS a, 'pay_' || k AS b FROM inv JOIN (SELECT k FROM p) USING (k)), pred AS (SELECT DISTINCT lkey AS a, rkey AS b FROM matches WHERE leg = 'erp_to_gateway'),
n AS (SELECT (SELECT count(*) FROM pred JOIN truth USING (a, b)) AS tp, (SELECT count(*) FROM pred) AS np, (SELECT count(*) FROM truth) AS nt)
SELECT 'erp_to_gateway' AS leg, tp, np - tp AS fp, nt - tp AS fn, CAST(round(1000000 * tp / np) AS BIGINT) AS "precision", CAST(round(1000000 * tp / nt) AS BIGINT) AS recall, CAST(round(1000000 * 2 * tp / (np + nt)) AS BIGINT) AS f1, nt AS support FROM n""")
def _(spark, sf_dir):
    predicted = reporting.pairs(runs.erp(spark, sf_dir)[0])
    return reporting.scores(predicted, _true_links(spark, sf_dir), "leg", ["a", "b"])


def _truth_codes(spark, sf_dir) -> DataFrame:
    pg = _w(spark, sf_dir, "pg")
    hold = pg.where("type = 'payment' and on_hold").select(F.col("entity_id").alias("key"), F.lit("FUNDS_ON_HOLD").alias("code"))
    twice = pg.where("entity_id like 'payd\\_%'").select(F.col("entity_id").alias("key"), F.lit("DUPLICATE_PAYMENT").alias("code"))
    charge = pg.where("type = 'adjustment'").select(F.col("entity_id").alias("key"), F.lit("CHARGEBACK_ADJUSTMENT").alias("code"))
    return legs.union(hold, twice, charge)


_TRUTH = ", truth AS (SELECT entity_id AS key, 'FUNDS_ON_HOLD' AS code FROM pg WHERE type = 'payment' AND on_hold UNION ALL SELECT entity_id, 'DUPLICATE_PAYMENT' FROM pg WHERE entity_id LIKE 'payd%' UNION ALL SELECT entity_id, 'CHARGEBACK_ADJUSTMENT' FROM pg WHERE type = 'adjustment'), pred AS (SELECT DISTINCT key, code FROM findings WHERE code IN ('FUNDS_ON_HOLD', 'DUPLICATE_PAYMENT', 'CHARGEBACK_ADJUSTMENT'))"
_EXC = _TRUTH + ", n AS (SELECT code, count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t IS NULL) AS fp, count(*) FILTER (p IS NULL AND t = 1) AS fn FROM (SELECT *, 1 AS p FROM pred) FULL JOIN (SELECT *, 1 AS t FROM truth) USING (key, code) GROUP BY code), s AS (SELECT *, CAST(round(1000000 * tp / (tp + fp)) AS BIGINT) AS \"precision\", CAST(round(1000000 * tp / (tp + fn)) AS BIGINT) AS recall, CAST(round(1000000 * 2 * tp / (2 * tp + fp + fn)) AS BIGINT) AS f1, tp + fn AS support FROM n)"


def _exception_scores(spark, sf_dir) -> DataFrame:
    found = runs.full(spark, sf_dir)["findings"].where("code in ('FUNDS_ON_HOLD', 'DUPLICATE_PAYMENT', 'CHARGEBACK_ADJUSTMENT')")
    return reporting.scores(found, _truth_codes(spark, sf_dir), "code", ["key"])


@query("exception_scores", _EXC + "SELECT * FROM s")
def _(spark, sf_dir):
    return _exception_scores(spark, sf_dir)


@query("macro_f1", _EXC + "SELECT CAST(round(avg(f1) FILTER (support > 0)) AS BIGINT) AS macro_f1 FROM s")
def _(spark, sf_dir):
    return reporting.macro_f1(_exception_scores(spark, sf_dir))


@query("confusion", _TRUTH + ", prim2 AS (SELECT key, code FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(value_paise) DESC, code) AS r FROM findings) WHERE r = 1) SELECT coalesce(t.code, 'CLEAN') AS truth, coalesce(q.code, 'CLEAN') AS predicted, count(*) AS n FROM truth t FULL JOIN prim2 q USING (key) GROUP BY 1, 2")
def _(spark, sf_dir):
    return reporting.confusion(_truth_codes(spark, sf_dir), reporting.primary_finding(runs.full(spark, sf_dir)["findings"]))


# --- the same scores over every leg and every code, from the rules that made the world


def _all_links(spark, sf_dir) -> DataFrame:
    return truth.links(world(spark, sf_dir))


def _all_codes(spark, sf_dir) -> DataFrame:
    return truth.codes(world(spark, sf_dir))


_ALL_LINKS = """, truth AS (SELECT 'erp_to_gateway' AS leg, 'INV-' || k AS a, 'pay_' || k AS b FROM inv JOIN (SELECT k FROM p) USING (k)
  UNION ALL SELECT 'settlement_to_bank', settlement_id, printf('bank:%04d', line_no) FROM batch JOIN bank ON contains(upper(narration), utr)
  UNION ALL SELECT 'settlement_to_bank', settlement_id, printf('bank:%04d', line_no) FROM batch JOIN bank ON narration = 'IMPS GATEWAY SETTLEMENT ' || dn
  UNION ALL SELECT 'settlement_to_bank', settlement_id, printf('bank:%04d', line_no) FROM bank JOIN batch ON sday IN (value_date - 1, value_date - 2) WHERE narration LIKE '%CONSOLIDATED'
  UNION ALL SELECT 'invoice_to_bank', no, printf('bank:%04d', line_no) FROM direct JOIN bank ON contains(narration, 'AXISN' || lpad(CAST(k AS VARCHAR), 12, '0') || '-')
), pred AS (SELECT DISTINCT leg, CASE WHEN lkey LIKE 'bank:%' THEN rkey ELSE lkey END AS a, CASE WHEN lkey LIKE 'bank:%' THEN lkey ELSE rkey END AS b FROM matches)"""
_ALL_CODES = """, truth AS (SELECT 'INV-' || k AS key, 'UNPAID_INVOICE' AS code FROM inv WHERE k % 23 = 5 AND k % 2 = 1
  UNION ALL SELECT 'INV-' || k, 'TDS_WITHHELD' FROM inv WHERE k % 23 = 5 AND k % 4 = 0 UNION ALL SELECT 'INV-' || k, 'TAX_LINE_MISMATCH' FROM inv WHERE k % 37 = 5
  UNION ALL SELECT 'pay_' || k, 'UNBILLED_PAYMENT' FROM p WHERE k % 29 = 7 UNION ALL SELECT 'pay_' || k, 'FUNDS_ON_HOLD' FROM p WHERE k % 43 = 7 UNION ALL SELECT 'pay_' || k, 'FEE_VARIANCE' FROM p WHERE k % 47 = 8
  UNION ALL SELECT 'payd_' || k, unnest(CASE WHEN k % 47 = 8 THEN ['DUPLICATE_PAYMENT', 'FEE_VARIANCE'] ELSE ['DUPLICATE_PAYMENT'] END) FROM p WHERE k % 41 = 6 AND k % 31 NOT IN (3, 4)
  UNION ALL SELECT 'rfnd_' || k, 'ORPHAN_REFUND' FROM p WHERE k % 53 = 9 AND k % 2 = 1 UNION ALL SELECT 'adjs_' || k, 'CHARGEBACK_ADJUSTMENT' FROM p WHERE k % 59 = 10
  UNION ALL SELECT settlement_id, CASE WHEN mode = 'short' THEN 'SETTLEMENT_AMOUNT_MISMATCH' WHEN mode = 'split' THEN 'SPLIT_SETTLEMENT' WHEN dn % 13 = 1 THEN 'MISSING_IN_BANK' ELSE 'MERGED_PAYOUT' END FROM moded WHERE mode NOT IN ('exact', 'plain')
  UNION ALL SELECT printf('bank:%04d', line_no), 'UNEXPECTED_BANK_CREDIT' FROM bank WHERE narration = 'INT.PD:12345678' AND amount_paise > 0
), pred AS (SELECT DISTINCT key, code FROM findings)"""


def _all_scores(by: str, keys: str) -> str:
    full = f"(SELECT *, 1 AS p FROM pred) FULL JOIN (SELECT *, 1 AS t FROM truth) USING ({by}, {keys})"
    counts = "count(*) FILTER (p = 1 AND t = 1) AS tp, count(*) FILTER (p = 1 AND t IS NULL) AS fp, count(*) FILTER (p IS NULL AND t = 1) AS fn"
    part = lambda x, y: f"CAST(round(1000000 * coalesce({x} / nullif({y}, 0), 0)) AS BIGINT)"
    return f"""SELECT *, {part("tp", "(tp + fp)")} AS "precision", {part("tp", "(tp + fn)")} AS recall, {part("(2 * tp)", "(2 * tp + fp + fn)")} AS f1, tp + fn AS support FROM (
      SELECT {by}, {counts} FROM {full} GROUP BY {by} UNION ALL SELECT 'OVERALL', {counts} FROM {full})"""


def _link_scores_all(spark, sf_dir) -> DataFrame:
    predicted, truth = reporting.pairs(runs.full(spark, sf_dir)["matches"]), _all_links(spark, sf_dir)
    return reporting.scores(*[reporting.with_overall(x, "leg", ["a", "b"]) for x in (predicted, truth)], "leg", ["a", "b"])


@query("link_scores_all", _ALL_LINKS + _all_scores("leg", "a, b"))
def _(spark, sf_dir):
    """Every leg and an overall row."""
    return _link_scores_all(spark, sf_dir)


@query("link_macro_f1_all", _ALL_LINKS + f"SELECT CAST(round(avg(f1) FILTER (support > 0)) AS BIGINT) AS macro_f1 FROM ({_all_scores('leg', 'a, b')}) WHERE leg <> 'OVERALL'")
def _(spark, sf_dir):
    """Mean over legs with support."""
    return reporting.macro_f1(_link_scores_all(spark, sf_dir).where("leg <> 'OVERALL'"))


def _exception_scores_all(spark, sf_dir) -> DataFrame:
    found, truth = runs.full(spark, sf_dir)["findings"], _all_codes(spark, sf_dir)
    return reporting.scores(*[reporting.with_overall(x, "code", ["key"]) for x in (found, truth)], "code", ["key"])


@query("exception_scores_all", _ALL_CODES + _all_scores("code", "key"))
def _(spark, sf_dir):
    """Every code and an overall row."""
    return _exception_scores_all(spark, sf_dir)


@query("macro_f1_all", _ALL_CODES + f"SELECT CAST(round(avg(f1)) AS BIGINT) AS macro_f1 FROM ({_all_scores('code', 'key')}) WHERE code <> 'OVERALL'")
def _(spark, sf_dir):
    """Mean over all codes that are planted or found."""
    scored = _exception_scores_all(spark, sf_dir).where("code <> 'OVERALL'")
    return scored.agg(F.coalesce(F.round(F.avg("f1")), F.lit(0)).cast("bigint").alias("macro_f1"))


@query("confusion_all", _ALL_CODES + """, prim2 AS (SELECT key, code FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(value_paise) DESC, code) AS r FROM findings) WHERE r = 1), true2 AS (SELECT key, list_sort(list(DISTINCT code)) AS codes FROM truth GROUP BY key)
SELECT CASE WHEN list_contains(codes, code) THEN code ELSE coalesce(codes[1], 'CLEAN') END AS truth, coalesce(code, 'CLEAN') AS predicted, count(*) AS n FROM true2 FULL JOIN prim2 USING (key) GROUP BY 1, 2""")
def _(spark, sf_dir):
    return reporting.confusion_of_sets(_all_codes(spark, sf_dir), reporting.primary_finding(runs.full(spark, sf_dir)["findings"]))


@query("auto_clear", _ALL_LINKS + """, good AS (SELECT DISTINCT leg, a, b FROM pred JOIN truth USING (leg, a, b)), linked AS (SELECT a FROM good WHERE leg <> 'settlement_to_bank' UNION SELECT b FROM good), paid AS (SELECT DISTINCT a FROM pred WHERE leg = 'settlement_to_bank'),
review AS (SELECT DISTINCT key FROM findings WHERE disposition = 'needs_review'), records AS (SELECT invoice_no AS key, NULL AS s FROM inv UNION ALL SELECT entity_id, settlement_id FROM pg UNION ALL SELECT printf('bank:%04d', line_no), NULL FROM bank)
SELECT count(*) AS records, count(*) FILTER ((key IN (SELECT a FROM linked) OR (s IS NOT NULL AND s IN (SELECT a FROM paid))) AND key NOT IN (SELECT key FROM review)) AS cleared FROM records""")
def _(spark, sf_dir):
    """Records on correctly predicted links, and gateway rows of batches that are linked at all, without an open finding."""
    w, run = world(spark, sf_dir), runs.full(spark, sf_dir)
    return reporting.auto_clear(w, run, _all_links(spark, sf_dir))


# --- judged candidates and lookups


def _near(spark, sf_dir) -> DataFrame:
    """Unpaid invoices and unexplained credits with close amounts, for a judge."""
    found = runs.full(spark, sf_dir)["findings"]
    edges = legs.direct_edges(_w(spark, sf_dir, "inv"), _w(spark, sf_dir, "bank"), found).where("score > 0")
    return edges.select("lkey", "rkey", F.abs(F.col("ramount") - F.col("gross_paise")).alias("diff"), F.lit(0).alias("gap"))


@query("topk_candidates", "SELECT * FROM (SELECT invoice_no AS lkey, row_number() OVER (PARTITION BY invoice_no ORDER BY abs(paid - gross_paise), line) AS rank, line AS rkey, abs(paid - gross_paise) AS diff FROM dscored WHERE score > 0 AND invoice_no NOT IN (SELECT invoice_no FROM dmatch) AND line NOT IN (SELECT line FROM dmatch)) WHERE rank <= 3")
def _(spark, sf_dir):
    return adjudicate.top_candidates(_near(spark, sf_dir)).drop("gap")


@query("candidates_for_lines", """SELECT * FROM (SELECT line AS lkey, row_number() OVER (PARTITION BY line ORDER BY abs(paid - gross_paise), invoice_no) AS rank, invoice_no AS rkey, abs(paid - gross_paise) AS diff FROM dscored
WHERE score > 0 AND invoice_no NOT IN (SELECT invoice_no FROM dmatch) AND line NOT IN (SELECT line FROM dmatch)) WHERE rank <= 3""")
def _(spark, sf_dir):
    w, found = world(spark, sf_dir), runs.full(spark, sf_dir)["findings"]
    return adjudicate.top_candidates(adjudicate.invoices_for_lines(w["inv"], w["bank"], found)).drop("gap")


@query("candidates_for_invoices", """SELECT * FROM (SELECT invoice_no AS lkey, row_number() OVER (PARTITION BY invoice_no ORDER BY abs(gross_paise - amount_paise), abs(datediff('day', invoice_date, CAST(created_at AS DATE))), entity_id) AS rank, entity_id AS rkey, abs(gross_paise - amount_paise) AS diff,
  abs(datediff('day', invoice_date, CAST(created_at AS DATE))) AS gap FROM unpaid, unbilled WHERE invoice_no NOT IN (SELECT invoice_no FROM dmatch)) WHERE rank <= 3""")
def _(spark, sf_dir):
    w, found = world(spark, sf_dir), runs.full(spark, sf_dir)["findings"]
    left, right, _ = adjudicate.payments_for_invoices(w["inv"], w["pg"], found)
    return nearest(left, right).select("lkey", "rank", "rkey", "diff", "gap")


@query("candidates_for_batches", """SELECT * FROM (SELECT settlement_id AS lkey, row_number() OVER (PARTITION BY settlement_id ORDER BY abs(net - u.amount_paise), abs(datediff('day', sday, value_date)), line) AS rank, line AS rkey, CAST(abs(net - u.amount_paise) AS BIGINT) AS diff,
  abs(datediff('day', sday, value_date)) AS gap FROM missing, unexp u WHERE line NOT IN (SELECT line FROM dmatch)) WHERE rank <= 3""")
def _(spark, sf_dir):
    w, found = world(spark, sf_dir), runs.full(spark, sf_dir)["findings"]
    left, right, _ = adjudicate.lines_for_batches(w["pg"], w["bank"], found)
    return nearest(left, right).select("lkey", "rank", "rkey", "diff", "gap")


def _judged(spark, sf_dir) -> dict[str, DataFrame]:
    """A scripted judge that takes the nearest candidate, on the leg that may ask one by default."""
    return runs.once(spark, sf_dir, "judged", lambda: adjudicate.consult(world(spark, sf_dir), runs.full(spark, sf_dir), adjudicate.take_first))


# No invoice here is a candidate of two lines, so each line simply takes its nearest.
_PICKS = """, picks AS (SELECT line, invoice_no, paid, gross_paise, rel FROM dscored WHERE score > 0 AND invoice_no NOT IN (SELECT invoice_no FROM dmatch) AND line NOT IN (SELECT line FROM dmatch)
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY abs(paid - gross_paise), invoice_no) = 1)
"""


@query("adjudicated_matches", _PICKS + "SELECT line AS lkey, invoice_no AS rkey, 'accepted' AS verdict FROM picks")
def _(spark, sf_dir):
    return _judged(spark, sf_dir)["log"].select("lkey", F.col("chose").alias("rkey"), "verdict")


@query("adjudication_verdicts", _PICKS + "SELECT 'accepted' AS verdict, count(*) AS n FROM picks HAVING count(*) > 0")
def _(spark, sf_dir):
    return adjudicate.verdicts(_judged(spark, sf_dir)["log"])


@query("match_t4_adjudicated", _PICKS + "SELECT invoice_no AS lkey, line AS rkey, 620 AS confidence, paid - gross_paise AS delta_paise FROM picks")
def _(spark, sf_dir):
    return _judged(spark, sf_dir)["matches"].where("tier = 'T4_ADJUDICATED'").select("lkey", "rkey", "confidence", "delta_paise")


@query("findings_after_adjudication", _PICKS + """SELECT code, count(*) AS n, CAST(sum(abs(value_paise)) AS BIGINT) AS exposure_paise FROM (
  SELECT code, value_paise FROM findings WHERE NOT (code IN ('UNPAID_INVOICE', 'UNEXPECTED_BANK_CREDIT') AND key IN (SELECT line FROM picks UNION ALL SELECT invoice_no FROM picks))
  UNION ALL SELECT 'TDS_WITHHELD', gross_paise - paid FROM picks WHERE rel <> 'gross') GROUP BY code""")
def _(spark, sf_dir):
    return reporting.by_code(_judged(spark, sf_dir)["findings"]).drop("to_review")


QUESTION = "Which settlement batches are missing in the bank?"


@query("retrieve_facts")
def _(spark, sf_dir):
    return answers.ranked(answers.facts(world(spark, sf_dir), runs.full(spark, sf_dir)), QUESTION)


_STEMS = "list_distinct(list_transform({0}, lambda w: CASE WHEN len(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, len(w) - 1) ELSE w END))"


@query("lookup_matches", f""", facts AS (SELECT leg, tier, lkey, rkey, abs(delta_paise) AS exposure, lower(lkey || ' ' || rkey || ' ' || leg || ' ' || tier) AS raw,
  '[MATCHED ' || tier || '] ' || lkey || ' and ' || rkey || ', confidence ' || printf('%.2f', confidence / 1000.0) AS fact FROM matches),
known AS (SELECT *, {_STEMS.format("regexp_extract_all(translate(raw, '_', ' '), '[a-z]+')")} AS words FROM facts),
asked AS (SELECT settlement_id AS q, settlement_id AS id, ['credit', 'pay', 'bank', 'settlement', 'setl'] AS toks FROM batch WHERE dn % 13 = 2 UNION ALL SELECT invoice_no, lower(invoice_no), ['invoice', 'receipt', 'inv'] FROM inv WHERE k % 97 = 0)
SELECT q, nth, CAST(score AS INT) AS score, exposure, lkey AS key, fact FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, exposure DESC, lkey, fact) AS nth FROM (
  SELECT q, 6 * CAST(contains(raw, id) AS INT) + len(list_intersect(toks, words)) AS score, CAST(exposure AS BIGINT) AS exposure, lkey, fact FROM asked, known) WHERE score > 0) WHERE nth <= 6""")
def _(spark, sf_dir):
    """A question on each of many batches and invoices, looked up in the postings of all matches."""
    facts = answers.match_facts(runs.full(spark, sf_dir)["matches"])
    w = world(spark, sf_dir)
    batches = legs.batches(w["pg"]).where("try_cast(substring(settlement_id, 6) as int) % 13 = 2").select(F.col("settlement_id").alias("q"), F.concat(F.lit("Which credit pays the bank settlement "), "settlement_id", F.lit("?")).alias("question"))
    invoices = w["inv"].where("seq % 97 = 0").select(F.col("invoice_no").alias("q"), F.concat(F.lit("What is the receipt of the invoice "), "invoice_no", F.lit("?")).alias("question"))
    return answers.lookup(answers.index(facts), batches.unionByName(invoices)).drop("kind")


@query("reply_guard", """SELECT entity_id, list_sort(list_filter(CASE WHEN s % 3 = 0 THEN [a, b] ELSE [a] END, lambda x: x <> a)) AS invented, CASE WHEN s % 5 = 0 THEN 'total' END AS phrase, (s % 3 = 0 AND a <> b) OR s % 5 = 0 AS withheld
FROM (SELECT entity_id, fee_paise AS s, printf('%d.%02d', amount_paise // 100, amount_paise % 100) AS a, printf('%d.%02d', fee_paise // 100, fee_paise % 100) AS b FROM pg WHERE type = 'payment')""")
def _(spark, sf_dir):
    """Replies that quote a payment's amount, some with a figure of their own and some with a forbidden word."""
    pg = _w(spark, sf_dir, "pg").where("type = 'payment'")
    a, b, s = evidence.rupees(F.col("amount_paise")), evidence.rupees(F.col("fee_paise")), F.col("fee_paise")
    reply = F.concat(F.lit("It is "), a, F.when(s % 3 == 0, F.concat(F.lit(" and "), b)).otherwise(""), F.when(s % 5 == 0, " in total").otherwise(""))
    return answers.guard(pg.select("entity_id", reply.alias("reply"), F.array(F.concat(F.lit("captured "), money.indian_format(F.col("amount_paise")))).alias("facts"))).drop("reply", "facts")


# --- evidence, actions and further roll-ups


def _explained(spark, sf_dir) -> DataFrame:
    w, run = world(spark, sf_dir), runs.full(spark, sf_dir)
    return evidence.explained(run["findings"], w, run["matches"])


_RUPEES = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || CAST(abs({0}) // 100 AS VARCHAR) || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0')"


def _r(x: str) -> str:
    return "(" + _RUPEES.format(x) + ")"


@query("finding_actions", f"""SELECT f.key, f.code, CASE f.code WHEN 'DUPLICATE_PAYMENT' THEN 'Refund ' || f.key || ' or confirm a second order beside ' || r.first_capture || '.'
  WHEN 'UNPAID_INVOICE' THEN 'Collect ' || {_r("abs(value_paise)")} || ' from ' || i.customer || ' or write off ' || f.key || '.'
  WHEN 'UNBILLED_PAYMENT' THEN 'Invoice ' || {_r("abs(value_paise)")} || ' for ' || coalesce(q.order_id, 'the captured order') || '.'
  WHEN 'FUNDS_ON_HOLD' THEN 'Ask the gateway to release the hold; leave it out of the cash forecast.'
  WHEN 'FEE_VARIANCE' THEN CASE WHEN value_paise > 0 THEN 'Recover ' ELSE 'Credit back ' END || {_r("abs(value_paise)")} || ' of fees on ' || f.key || '.'
  WHEN 'ORPHAN_REFUND' THEN 'Find payment ' || q.parent || ' in another period or account.'
  WHEN 'CHARGEBACK_ADJUSTMENT' THEN 'Book the dispute and decide in time whether to contest it.'
  WHEN 'TAX_LINE_MISMATCH' THEN 'Check the tax rate of ' || f.key || CASE WHEN value_paise > 0 THEN '; issue a revised invoice for ' ELSE '; issue a credit note for ' END || {_r("abs(value_paise)")} || '.'
  WHEN 'SPLIT_SETTLEMENT' THEN 'None: the parts add up; post them as one receipt.'
  WHEN 'SETTLEMENT_AMOUNT_MISMATCH' THEN CASE WHEN value_paise < 0 THEN 'Look for a bank charge or a recovery.' ELSE 'Look for an earlier shortfall made good.' END
  WHEN 'MERGED_PAYOUT' THEN 'None: the credit adds up; ask for a reference of each batch.'
  WHEN 'MISSING_IN_BANK' THEN 'Trace ' || b.utr || ' with the bank; until then ' || {_r("abs(value_paise)")} || ' is due from the gateway.'
  WHEN 'UNEXPECTED_BANK_CREDIT' THEN 'Find the payer before posting it anywhere.'
  ELSE 'Book ' || {_r("abs(value_paise)")} || ' as tax receivable from ' || i.customer || ' and collect the certificate.' END AS action
FROM findings f LEFT JOIN inv i ON f.key = i.invoice_no LEFT JOIN pg q ON f.key = q.entity_id LEFT JOIN batch b ON f.key = b.settlement_id LEFT JOIN ranked r ON f.key = r.entity_id""")
def _(spark, sf_dir):
    return _explained(spark, sf_dir).select("key", "code", "action")


@query("finding_evidence", f"""SELECT key, code, unnest(['order_id', 'customer', 'invoice_date', 'gross', 'age_days']) AS field, unnest([order_id, customer, CAST(invoice_date AS VARCHAR), {_r("gross_paise")}, CAST(datediff('day', invoice_date, (SELECT max(invoice_date) FROM inv)) AS VARCHAR)]) AS value FROM findings JOIN inv ON key = invoice_no WHERE code = 'UNPAID_INVOICE'
UNION ALL SELECT key, code, unnest(['taxable', 'tax', 'tax_due', 'customer']), unnest([{_r("taxable_paise")}, {_r("tax_paise")}, {_r(he("taxable_paise", 1800))}, customer]) FROM findings JOIN inv ON key = invoice_no WHERE code = 'TAX_LINE_MISMATCH'
UNION ALL SELECT key, code, unnest(['order_id', 'first_capture', 'first_at', 'created_at', 'amount']), unnest([r.order_id, r.first_capture, strftime(f.created_at, '%Y-%m-%d %H:%M:%S'), strftime(r.created_at, '%Y-%m-%d %H:%M:%S'), {_r("r.amount_paise")}]) FROM findings JOIN ranked r ON key = r.entity_id JOIN pg f ON f.entity_id = r.first_capture WHERE code = 'DUPLICATE_PAYMENT'
UNION ALL SELECT key, code, unnest(['utr', 'net', 'lines', 'paid']), unnest([utr, {_r("b.net")}, h.line, {_r("h.amount_paise")}]) FROM findings JOIN batch b ON key = b.settlement_id JOIN hits h ON key = h.settlement_id WHERE code = 'SETTLEMENT_AMOUNT_MISMATCH'
UNION ALL SELECT key, code, unnest(['value_date', 'narration', 'amount', 'claims_settlement']), unnest([CAST(value_date AS VARCHAR), narration, {_r("amount_paise")}, CAST(regexp_matches(lower(narration), 'razorpay|rzp|settl') AS VARCHAR)]) FROM findings JOIN unexp ON key = line WHERE code = 'UNEXPECTED_BANK_CREDIT'""")
def _(spark, sf_dir):
    shown = ("UNPAID_INVOICE", "TAX_LINE_MISMATCH", "DUPLICATE_PAYMENT", "SETTLEMENT_AMOUNT_MISMATCH", "UNEXPECTED_BANK_CREDIT")
    return _explained(spark, sf_dir).where(F.col("code").isin(*shown)).select("key", "code", F.inline("evidence"))


_FEE = he("q.amount_paise", "CASE q.method WHEN 'upi' THEN 0 WHEN 'netbanking' THEN 150 WHEN 'card' THEN 200 WHEN 'amex' THEN 350 WHEN 'wallet' THEN 180 ELSE 300 END")
_AT = "strftime(q.created_at, '%Y-%m-%d %H:%M:%S')"


@query("finding_evidence_more", f""", paid AS (SELECT a AS key, array_to_string(list_sort(list(b)), ', ') AS lines, CAST(sum(amount_paise) AS BIGINT) AS paid FROM (
  SELECT DISTINCT CASE WHEN lkey LIKE 'bank:%' THEN rkey ELSE lkey END AS a, CASE WHEN lkey LIKE 'bank:%' THEN lkey ELSE rkey END AS b FROM matches WHERE leg <> 'erp_to_gateway') JOIN credits ON b = line GROUP BY a
), fees AS (SELECT q.entity_id, abs({_FEE}) AS fee FROM pg q
), counted AS (SELECT settlement_id, count(*) AS members FROM pg WHERE settlement_id IS NOT NULL GROUP BY settlement_id
), shown AS (
SELECT key, code, unnest(['order_id', 'order_receipt', 'created_at', 'method', 'amount']) AS field, unnest([q.order_id, q.order_receipt, {_AT}, q.method, {_r("abs(q.amount_paise)")}]) AS value FROM findings JOIN pg q ON key = q.entity_id WHERE code = 'UNBILLED_PAYMENT'
UNION ALL SELECT key, code, unnest(['created_at', 'method', 'amount', 'order_id']), unnest([{_AT}, q.method, {_r("abs(q.amount_paise)")}, q.order_id]) FROM findings JOIN pg q ON key = q.entity_id WHERE code = 'FUNDS_ON_HOLD'
UNION ALL SELECT key, code, unnest(['method', 'expected_fee', 'fee', 'expected_gst', 'gst']), unnest([q.method, {_r("f.fee")}, {_r("q.fee_paise")}, {_r(he("f.fee", 1800))}, {_r("q.tax_paise")}]) FROM findings JOIN pg q ON key = q.entity_id JOIN fees f ON f.entity_id = key WHERE code = 'FEE_VARIANCE'
UNION ALL SELECT key, code, unnest(['parent_payment_id', 'amount', 'created_at']), unnest([q.parent, {_r("abs(q.amount_paise)")}, {_AT}]) FROM findings JOIN pg q ON key = q.entity_id WHERE code = 'ORPHAN_REFUND'
UNION ALL SELECT key, code, unnest(['dispute_id', 'amount', 'created_at', 'settlement_id']), unnest(['disp_' || regexp_extract(key, '[0-9]+$'), {_r("abs(q.amount_paise)")}, {_AT}, q.settlement_id]) FROM findings JOIN pg q ON key = q.entity_id WHERE code = 'CHARGEBACK_ADJUSTMENT'
UNION ALL SELECT findings.key, code, unnest(['utr', 'lines', 'paid']), unnest([b.utr, p.lines, {_r("p.paid")}]) FROM findings JOIN batch b ON findings.key = b.settlement_id LEFT JOIN paid p ON p.key = findings.key WHERE code = 'SPLIT_SETTLEMENT'
UNION ALL SELECT findings.key, code, unnest(['lines', 'paid', 'net']), unnest([p.lines, {_r("p.paid")}, {_r("b.net")}]) FROM findings JOIN batch b ON findings.key = b.settlement_id LEFT JOIN paid p ON p.key = findings.key WHERE code = 'MERGED_PAYOUT'
UNION ALL SELECT key, code, unnest(['utr', 'settled_at', 'net', 'members', 'batch_gross', 'fee_and_gst']), unnest([b.utr, CAST(b.sday AS VARCHAR) || ' 00:00:00', {_r("b.net")}, CAST(members AS VARCHAR), {_r("b.amount_paise")}, {_r("(b.fee_paise + b.tax_paise)")}]) FROM findings JOIN batch b ON key = b.settlement_id JOIN counted c ON c.settlement_id = key WHERE code = 'MISSING_IN_BANK'
UNION ALL SELECT findings.key, code, unnest(['customer', 'gross', 'lines', 'paid']), unnest([i.customer, {_r("i.gross_paise")}, p.lines, {_r("p.paid")}]) FROM findings JOIN inv i ON findings.key = i.invoice_no LEFT JOIN paid p ON p.key = findings.key WHERE code = 'TDS_WITHHELD'
) SELECT * FROM shown WHERE value IS NOT NULL""")
def _(spark, sf_dir):
    """The codes that finding_evidence does not show."""
    shown = [c for c in evidence.FIELDS if c not in ("UNPAID_INVOICE", "TAX_LINE_MISMATCH", "DUPLICATE_PAYMENT", "SETTLEMENT_AMOUNT_MISMATCH", "UNEXPECTED_BANK_CREDIT")]
    return _explained(spark, sf_dir).where(F.col("code").isin(*shown)).select("key", "code", F.inline("evidence"))


@query("exceptions_by_code", "SELECT code, CAST(sum(abs(value_paise)) OVER (PARTITION BY code) AS BIGINT) AS exposure_paise, row_number() OVER (PARTITION BY code ORDER BY abs(value_paise) DESC, key) AS nth, key, CAST(value_paise AS BIGINT) AS value_paise FROM findings")
def _(spark, sf_dir):
    return evidence.exceptions_by_code(_explained(spark, sf_dir)).drop("evidence", "action")


@query("exposure_by_code", "SELECT *, row_number() OVER (ORDER BY exposure_paise DESC, code) AS place FROM (SELECT code, count(*) AS n, CAST(sum(abs(value_paise)) AS BIGINT) AS exposure_paise FROM findings GROUP BY code)")
def _(spark, sf_dir):
    return reporting.exposure_by_code(runs.full(spark, sf_dir)["findings"])


@query("bridge_rollups", _POSITION + "SELECT unexplained_credits, open_receivables, unbilled_revenue, tds_receivable FROM pos")
def _(spark, sf_dir):
    return reporting.position(_w(spark, sf_dir, "pg"), runs.full(spark, sf_dir)).select("unexplained_credits", "open_receivables", "unbilled_revenue", "tds_receivable")


@query("norm_name_tokens", "SELECT invoice_no, array_to_string(list_filter(string_split_regex(regexp_replace(lower(customer || ' Co. (Pvt) & Sons Ltd'), '[^a-z ]', ' ', 'g'), ' +'), lambda w: w NOT IN ('', 'pvt', 'private', 'ltd', 'limited', 'llp', 'co', 'company', 'the', 'and')), ' ') AS name FROM inv")
def _(spark, sf_dir):
    return _w(spark, sf_dir, "inv").select("invoice_no", F.array_join(text.name_tokens(F.concat("customer", F.lit(" Co. (Pvt) & Sons Ltd"))), " ").alias("name"))


@query("record_counts", "SELECT 'inv' AS source, count(*) AS n FROM inv UNION ALL SELECT 'pg', count(*) FROM pg UNION ALL SELECT 'bank', count(*) FROM bank UNION ALL SELECT 'total', (SELECT count(*) FROM inv) + (SELECT count(*) FROM pg) + (SELECT count(*) FROM bank)")
def _(spark, sf_dir):
    return reporting.record_counts(world(spark, sf_dir))


@query("score_distribution", _ALL_CODES + f"""SELECT metric, CAST(round(avg(x)) AS BIGINT) AS mean, min(x) AS least, max(x) AS most, CAST(round(stddev_samp(x)) AS BIGINT) AS deviation
FROM (SELECT unnest(['precision', 'recall', 'f1']) AS metric, unnest(["precision", recall, f1]) AS x FROM ({_all_scores("code", "key")}) WHERE code <> 'OVERALL') GROUP BY metric""")
def _(spark, sf_dir):
    spread = reporting.distribution(_exception_scores_all(spark, sf_dir).where("code <> 'OVERALL'"), ["precision", "recall", "f1"])
    return spread.select("metric", *[F.round(c).cast("bigint").alias(c) for c in ("mean", "least", "most", "deviation")])


# --- files


@query("reject_rows", """SELECT 'bank_statement' AS file, rownum, CASE k % 11 WHEN 3 THEN 'bad line number' WHEN 5 THEN 'bad date' ELSE 'bad credit' END AS reason,
  'bank_statement:' || rownum || ': ' || CASE k % 11 WHEN 3 THEN 'bad line number' WHEN 5 THEN 'bad date' ELSE 'bad credit' END AS error
FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) + 1 AS rownum FROM orders) WHERE k % 11 IN (3, 5, 7)""", False)
def _(spark, sf_dir):
    """A statement with damaged rows, written and read again."""
    k = F.col("o_orderkey")
    cells = {"line_no": F.when(k % 11 == 3, "x").otherwise(k.cast("string")), "value_date": F.when(k % 11 == 5, "someday").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")), "credit": F.when(k % 11 == 7, "1.2.3").otherwise("10.50")}
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, *[cells.get(c, F.lit("")).alias(c) for c in exports.BANK_COLUMNS])
    path = f"{shared_folder(spark)}/tallyweave-recon/{uuid.uuid4().hex}/bank_statement.csv"
    files.write_one(rows.select("o_orderkey", files.csv_line(list(exports.BANK_COLUMNS))), ["o_orderkey"], path, ",".join(exports.BANK_COLUMNS))
    return exports.bank(spark, path)[1]


@query("multiline_records", """SELECT row_number() OVER (ORDER BY o_orderkey) + 1 AS rownum, CAST(o_orderkey AS VARCHAR) AS key,
  'no ' || o_orderkey || CASE o_orderkey % 5 WHEN 0 THEN chr(10) || 'second "line", it is' || chr(10) || chr(10) || 'last' WHEN 1 THEN ', "quoted"' WHEN 2 THEN ' 5" pipe' ELSE '' END AS note FROM orders""", False)
def _(spark, sf_dir):
    """Records whose notes hold line breaks, quotes and commas, written as one ordered file by many tasks and read again."""
    k = F.col("o_orderkey")
    note = F.concat(F.lit("no "), k, F.expr("case o_orderkey % 5 when 0 then '\nsecond \"line\", it is\n\nlast' when 1 then ', \"quoted\"' when 2 then ' 5\" pipe' else '' end"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, k.cast("string").alias("key"), note.alias("note"))
    path = f"{shared_folder(spark)}/tallyweave-recon/{uuid.uuid4().hex}/notes.csv"
    files.write_one(rows.select(k, files.csv_line(["key", "note"])), ["o_orderkey"], path, "key,note")
    read = files.records(spark, path).where("rownum > 1")
    return read.select("rownum", F.from_csv("value", "key string, note string", {"escape": '"'}).alias("r")).select("rownum", "r.*")


def _from_files(spark, sf_dir) -> dict[str, DataFrame]:
    def make():
        folder = f"{shared_folder(spark)}/tallyweave-recon/{uuid.uuid4().hex}"
        sinks.write_exports(world(spark, sf_dir), folder)
        return {name: keep(df) for name, df in exports.load(spark, folder)[0].items()}

    return runs.once(spark, sf_dir, "files", make)


@query("csv_round_trip", """SELECT 'inv' AS source, count(*) AS n, CAST(sum(gross_paise) AS BIGINT) AS paise, CAST(sum(k % 1000) AS BIGINT) AS keys FROM inv
UNION ALL SELECT 'pg', count(*), CAST(sum(amount_paise - fee_paise - tax_paise) AS BIGINT), CAST(sum(CAST(regexp_extract(entity_id, '[0-9]+$') AS BIGINT) % 1000) AS BIGINT) FROM pg
UNION ALL SELECT 'bank', count(*), CAST(sum(amount_paise) AS BIGINT), CAST(sum(line_no % 1000) AS BIGINT) FROM bank""")
def _(spark, sf_dir):
    read = _from_files(spark, sf_dir)
    total = lambda name, paise, key: read[name].agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(paise)).cast("bigint").alias("paise"), F.sum(F.expr(key) % 1000).cast("bigint").alias("keys")).select(F.lit(name).alias("source"), "n", "paise", "keys")
    return legs.union(total("inv", "gross_paise", "cast(substring(invoice_no, 5) as bigint)"), total("pg", "amount_paise - fee_paise - tax_paise", "cast(regexp_extract(entity_id, '[0-9]+$', 0) as bigint)"), total("bank", "amount_paise", "line_no"))


@query("tier_counts_from_files", "SELECT leg, tier, count(DISTINCT lkey) AS n FROM matches GROUP BY leg, tier")
def _(spark, sf_dir):
    """The whole way: files are written, read with their rejects, and reconciled."""
    return reporting.tiers(legs.reconcile(_from_files(spark, sf_dir))["matches"])


from . import contested  # noqa: E402, F401  (it adds its queries to these)
