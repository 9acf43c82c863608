"""DuckDB SQL for the derived world and its tiers, the oracle side of the queries."""

HE = "(({0}) * ({1}) // 10000 + CASE WHEN ({0}) * ({1}) % 10000 > 5000 OR (({0}) * ({1}) % 10000 = 5000 AND (({0}) * ({1}) // 10000) % 2 = 1) THEN 1 ELSE 0 END)"


def he(x: str, bps: str | int) -> str:
    return HE.format(x, bps)


WORLD = f"""WITH base AS (
  SELECT o_orderkey AS k, o_orderdate AS ts, CAST(o_orderdate AS DATE) AS d, 'Acme ' || translate(CAST(o_custkey AS VARCHAR), '0123456789', 'bcdfghjklm') AS customer,
    CAST(round(o_totalprice * 100) AS BIGINT) AS taxable, {he("CAST(round(o_totalprice * 100) AS BIGINT)", 1800)} AS tax0 FROM orders
), inv AS (
  SELECT k, 'INV-' || k AS invoice_no, 'order_' || k AS order_id, customer, d AS invoice_date, taxable AS taxable_paise,
    CASE WHEN k % 37 = 5 THEN {he("taxable", 1200)} ELSE tax0 END AS tax_paise, taxable + CASE WHEN k % 37 = 5 THEN {he("taxable", 1200)} ELSE tax0 END AS gross_paise
  FROM base WHERE k % 29 <> 7
), p0 AS (
  SELECT *, taxable + tax0 AS amount_paise, list_extract(['upi','netbanking','card','amex','wallet','emi'], CAST(k % 6 + 1 AS INT)) AS method,
    list_extract([0,150,200,350,180,300], CAST(k % 6 + 1 AS INT)) AS bps FROM base WHERE k % 23 <> 5
), p1 AS (
  SELECT *, {he("amount_paise", "bps")} + CASE WHEN k % 47 = 8 THEN 350 ELSE 0 END AS fee_paise FROM p0
), p AS (
  SELECT *, {he("fee_paise", 1800)} AS tax_paise, ts + to_hours(CAST(6 + k % 17 AS INT)) AS created_at,
    CASE WHEN k % 31 NOT IN (3, 4) THEN 'order_' || k END AS order_id,
    CASE WHEN k % 31 = 3 THEN NULL WHEN k % 31 = 4 THEN 'inv_' || k ELSE 'INV-' || k END AS order_receipt FROM p1
), pg0 AS (
  SELECT 'pay_' || k AS entity_id, 'payment' AS type, amount_paise, fee_paise, tax_paise, created_at, method, order_id, order_receipt, k % 43 = 7 AS on_hold, CAST(NULL AS VARCHAR) AS parent FROM p
  UNION ALL SELECT 'payd_' || k, 'payment', amount_paise, fee_paise, tax_paise, created_at + INTERVAL 30 HOUR, method, order_id, order_receipt, false, NULL FROM p WHERE k % 41 = 6 AND order_id IS NOT NULL
  UNION ALL SELECT 'rfnd_' || k, 'refund', -(amount_paise // 2), 0, 0, created_at + INTERVAL 72 HOUR, method, order_id, order_receipt, false, CASE WHEN k % 2 = 0 THEN 'pay_' ELSE 'ghost_' END || k FROM p WHERE k % 53 = 9
  UNION ALL SELECT 'adjs_' || k, 'adjustment', -(amount_paise // 10), 0, 0, created_at + INTERVAL 96 HOUR, method, order_id, order_receipt, false, NULL FROM p WHERE k % 59 = 10
), days AS (
  SELECT CAST(created_at AS DATE) + 2 AS sday, sum(amount_paise - fee_paise - tax_paise) AS net FROM pg0 WHERE NOT on_hold GROUP BY 1 HAVING sum(amount_paise - fee_paise - tax_paise) > 0
), pg AS (
  SELECT pg0.*, sday, datediff('day', DATE '1995-01-01', sday) AS dn, 'setl_' || lpad(CAST(datediff('day', DATE '1995-01-01', sday) AS VARCHAR), 5, '0') AS settlement_id
  FROM pg0 LEFT JOIN days ON NOT on_hold AND CAST(created_at AS DATE) + 2 = sday
), batch AS (
  SELECT settlement_id, sday, dn, 'SBIN0' || lpad(CAST(dn AS VARCHAR), 12, '0') AS utr, CAST(sum(amount_paise) AS BIGINT) AS amount_paise, CAST(sum(fee_paise) AS BIGINT) AS fee_paise, CAST(sum(tax_paise) AS BIGINT) AS tax_paise,
    CAST(sum(amount_paise - fee_paise - tax_paise) AS BIGINT) AS net FROM pg WHERE settlement_id IS NOT NULL GROUP BY ALL
), moded AS (
  SELECT b.*, n.net AS net2, n.sday AS sday2, CASE WHEN b.dn % 13 = 1 OR (b.dn % 13 = 6 AND v.dn IS NOT NULL) THEN 'none' WHEN b.dn % 13 = 2 THEN 'short' WHEN b.dn % 13 = 3 THEN 'split' WHEN b.dn % 13 = 8 THEN 'plain'
    WHEN b.dn % 13 = 5 AND n.dn IS NOT NULL THEN 'merged' ELSE 'exact' END AS mode
  FROM batch b LEFT JOIN batch n ON n.dn = b.dn + 1 LEFT JOIN batch v ON v.dn = b.dn - 1 AND v.dn % 13 = 5
), direct AS (
  SELECT i.*, 'INV-' || i.k AS no, CASE WHEN k % 4 = 0 THEN gross_paise - {he("gross_paise", 200)} ELSE gross_paise END AS paid FROM inv i WHERE k % 23 = 5 AND k % 2 = 0
), lines AS (
  SELECT sday AS value_date, CASE WHEN dn % 2 = 1 THEN lower('NEFT CR ' || utr || ' GATEWAY SETTLEMENT') ELSE 'NEFT CR ' || utr || ' GATEWAY SETTLEMENT' END AS narration,
    CASE mode WHEN 'short' THEN net - 1180 WHEN 'split' THEN net * 4 // 10 ELSE net END AS amount_paise FROM moded WHERE mode IN ('exact', 'short', 'split')
  UNION ALL SELECT sday + 1, CASE WHEN dn % 2 = 1 THEN lower('NEFT CR ' || utr || ' GATEWAY SETTLEMENT') ELSE 'NEFT CR ' || utr || ' GATEWAY SETTLEMENT' END, net - net * 4 // 10 FROM moded WHERE mode = 'split'
  UNION ALL SELECT sday2 + 1, 'NEFT CR GATEWAY SETTLEMENT CONSOLIDATED', net + net2 FROM moded WHERE mode = 'merged'
  UNION ALL SELECT sday + 1, 'IMPS GATEWAY SETTLEMENT ' || dn, net FROM moded WHERE mode = 'plain'
  UNION ALL SELECT invoice_date + 3, CASE WHEN k % 8 = 4 THEN 'RTGS-AXISN' || lpad(CAST(k AS VARCHAR), 12, '0') || '-ACME-PMT AGST BILL' ELSE 'NEFT-AXISN' || lpad(CAST(k AS VARCHAR), 12, '0') || '-' || upper(customer) || '-DIRECT' END, paid FROM direct
  UNION ALL SELECT CAST(ts AS DATE), 'INT.PD:12345678', CAST(round(value * 100) AS BIGINT) FROM events WHERE event_type = 'purchase'
), bank AS (
  SELECT CAST(row_number() OVER (ORDER BY value_date, narration, amount_paise) AS INT) AS line_no, * FROM lines
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY coalesce(order_id, '__none__' || entity_id) ORDER BY created_at, entity_id) AS nth,
    first_value(entity_id) OVER (PARTITION BY coalesce(order_id, '__none__' || entity_id) ORDER BY created_at, entity_id) AS first_capture FROM pg WHERE type = 'payment'
), prim AS (SELECT * FROM ranked WHERE nth = 1
), t0 AS (SELECT invoice_no, entity_id, amount_paise - gross_paise AS delta FROM prim JOIN inv USING (order_id)
), t1 AS (
  SELECT invoice_no, entity_id, amount_paise - gross_paise AS delta FROM prim JOIN inv ON regexp_replace(lower(order_receipt), '[^a-z0-9]', '', 'g') = regexp_replace(lower(invoice_no), '[^a-z0-9]', '', 'g')
  WHERE invoice_no NOT IN (SELECT invoice_no FROM t0) AND entity_id NOT IN (SELECT entity_id FROM t0)
), oi AS (SELECT * FROM inv WHERE invoice_no NOT IN (SELECT invoice_no FROM t0 UNION ALL SELECT invoice_no FROM t1)
), op AS (SELECT * FROM prim WHERE entity_id NOT IN (SELECT entity_id FROM t0 UNION ALL SELECT entity_id FROM t1)
), t2 AS (
  SELECT invoice_no, entity_id, amount_paise - gross_paise AS delta, abs(datediff('day', invoice_date, CAST(created_at AS DATE))) AS gap FROM oi JOIN op ON abs(gross_paise - amount_paise) <= 100 AND abs(datediff('day', invoice_date, CAST(created_at AS DATE))) <= 5
), unpaid AS (SELECT * FROM oi WHERE invoice_no NOT IN (SELECT invoice_no FROM t2)
), unbilled AS (SELECT * FROM op WHERE entity_id NOT IN (SELECT entity_id FROM t2)
), credits AS (SELECT *, printf('bank:%04d', line_no) AS line FROM bank WHERE amount_paise > 0
), hits AS (
  SELECT line, c.amount_paise, b.settlement_id, b.net FROM (SELECT *, unnest(list_distinct(regexp_extract_all(upper(narration), '\\b[A-Z]{{4}}[A-Z0-9][0-9]{{10,14}}\\b'))) AS q FROM credits) c JOIN batch b ON q = b.utr
), summed AS (
  SELECT settlement_id, CAST(sum(amount_paise) - any_value(net) AS BIGINT) AS delta, count(*) AS n, CASE WHEN abs(sum(amount_paise) - any_value(net)) > 100 THEN 'differs' WHEN count(*) = 1 THEN 'exact' ELSE 'split' END AS kind FROM hits GROUP BY 1
), ob AS (SELECT * FROM batch WHERE settlement_id NOT IN (SELECT settlement_id FROM hits)
), ol AS (SELECT * FROM credits WHERE line NOT IN (SELECT line FROM hits)
), merged AS (
  SELECT l.line, a.settlement_id AS s1, b.settlement_id AS s2, l.amount_paise - a.net - b.net AS delta FROM ob a JOIN ob b ON a.settlement_id < b.settlement_id JOIN ol l ON abs(datediff('day', a.sday, l.value_date)) <= 4 AND abs(datediff('day', b.sday, l.value_date)) <= 4
    AND abs(a.net + b.net - l.amount_paise) <= 100 WHERE regexp_matches(lower(narration), 'razorpay|rzp|settl')
), bt2 AS (
  SELECT settlement_id, line, abs(datediff('day', sday, value_date)) AS gap, ol.amount_paise - net AS delta FROM ob JOIN ol ON abs(ol.amount_paise - net) <= 100 AND abs(datediff('day', sday, value_date)) <= 4
    WHERE regexp_matches(lower(narration), 'razorpay|rzp|settl') AND line NOT IN (SELECT line FROM merged) AND settlement_id NOT IN (SELECT s1 FROM merged UNION ALL SELECT s2 FROM merged)
), missing AS (SELECT * FROM ob WHERE settlement_id NOT IN (SELECT s1 FROM merged UNION ALL SELECT s2 FROM merged UNION ALL SELECT settlement_id FROM bt2)
), unexp AS (SELECT * FROM ol WHERE line NOT IN (SELECT line FROM merged UNION ALL SELECT line FROM bt2)
), dedges AS (
  SELECT invoice_no, line, gross_paise, u.amount_paise AS paid, CASE WHEN abs(u.amount_paise - gross_paise) <= 100 THEN 'gross' ELSE 'tds' END AS rel,
    list_distinct(list_filter(string_split_regex(regexp_replace(lower(customer), '[^a-z ]', ' ', 'g'), ' +'), lambda w: w NOT IN ('', 'pvt', 'private', 'ltd', 'limited', 'llp', 'co', 'company', 'the', 'and'))) AS ta,
    list_distinct(list_filter(string_split_regex(regexp_replace(lower(narration), '[^a-z ]', ' ', 'g'), ' +'), lambda w: w NOT IN ('', 'pvt', 'private', 'ltd', 'limited', 'llp', 'co', 'company', 'the', 'and'))) AS tb
  FROM unpaid JOIN unexp u ON datediff('day', invoice_date, value_date) BETWEEN 0 AND 45 AND (abs(u.amount_paise - gross_paise) <= 100 OR abs(u.amount_paise - (gross_paise - {he("gross_paise", 100)})) <= 100
    OR abs(u.amount_paise - (gross_paise - {he("gross_paise", 200)})) <= 100 OR abs(u.amount_paise - (gross_paise - {he("gross_paise", 1000)})) <= 100)
), dscored AS (SELECT *, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) AS score FROM dedges
), dmatch AS (SELECT * FROM dscored WHERE score >= 0.34
), matches AS (
  SELECT 'erp_to_gateway' AS leg, invoice_no AS lkey, entity_id AS rkey, 'T0_EXACT_ID' AS tier, CASE WHEN abs(delta) <= 100 THEN 1000 ELSE 920 END AS confidence, delta AS delta_paise FROM t0
  UNION ALL SELECT 'erp_to_gateway', invoice_no, entity_id, 'T1_NORMALIZED_ID', 950, delta FROM t1
  UNION ALL SELECT 'erp_to_gateway', invoice_no, entity_id, 'T2_AMOUNT_DATE', greatest(700, 920 - 30 * gap), delta FROM t2
  UNION ALL SELECT 'settlement_to_bank', settlement_id, line, CASE kind WHEN 'exact' THEN 'T0_EXACT_ID' WHEN 'split' THEN 'T3_AGGREGATE' ELSE 'T1_NORMALIZED_ID' END, CASE kind WHEN 'exact' THEN 1000 WHEN 'split' THEN 970 ELSE 800 END, summed.delta FROM hits JOIN summed USING (settlement_id)
  UNION ALL SELECT 'settlement_to_bank', settlement_id, line, 'T2_AMOUNT_DATE', greatest(700, 920 - 30 * gap), delta FROM bt2
  UNION ALL SELECT 'settlement_to_bank', line, unnest([s1, s2]), 'T3_AGGREGATE', 900, delta FROM merged
  UNION ALL SELECT 'invoice_to_bank', invoice_no, line, 'T2_AMOUNT_DATE', CAST(round(least(0.96, 0.75 + score) * 1000) AS INT), paid - gross_paise FROM dmatch
), findings AS (
  SELECT entity_id AS key, 'pg' AS source, 'DUPLICATE_PAYMENT' AS code, 'needs_review' AS disposition, amount_paise AS value_paise FROM ranked WHERE nth > 1
  UNION ALL SELECT invoice_no, 'erp', 'UNPAID_INVOICE', 'needs_review', gross_paise FROM unpaid WHERE invoice_no NOT IN (SELECT invoice_no FROM dmatch)
  UNION ALL SELECT entity_id, 'pg', 'UNBILLED_PAYMENT', 'needs_review', amount_paise FROM unbilled
  UNION ALL SELECT entity_id, 'pg', 'FUNDS_ON_HOLD', 'needs_review', amount_paise - fee_paise - tax_paise FROM pg WHERE type = 'payment' AND on_hold
  UNION ALL SELECT entity_id, 'pg', 'FEE_VARIANCE', 'auto_resolved', drift FROM (SELECT pg.entity_id, pg.fee_paise + pg.tax_paise - (f.fee + {he("f.fee", 1800)}) AS drift FROM pg JOIN (SELECT q.entity_id, {he("q.amount_paise", "CASE q.method WHEN 'upi' THEN 0 WHEN 'netbanking' THEN 150 WHEN 'card' THEN 200 WHEN 'amex' THEN 350 WHEN 'wallet' THEN 180 WHEN 'emi' THEN 300 ELSE 200 END")} AS fee FROM pg q WHERE q.type = 'payment' AND NOT q.on_hold) f USING (entity_id)) WHERE abs(drift) > 100
  UNION ALL SELECT entity_id, 'pg', 'ORPHAN_REFUND', 'needs_review', abs(amount_paise) FROM pg WHERE type = 'refund' AND parent IS NOT NULL AND parent NOT IN (SELECT entity_id FROM pg WHERE type = 'payment')
  UNION ALL SELECT entity_id, 'pg', 'CHARGEBACK_ADJUSTMENT', 'needs_review', abs(amount_paise) FROM pg WHERE type = 'adjustment'
  UNION ALL SELECT invoice_no, 'erp', 'TAX_LINE_MISMATCH', 'needs_review', {he("taxable_paise", 1800)} - tax_paise FROM inv WHERE abs({he("taxable_paise", 1800)} - tax_paise) > 100
  UNION ALL SELECT settlement_id, 'settlement', 'SPLIT_SETTLEMENT', 'auto_resolved', 0 FROM summed WHERE kind = 'split'
  UNION ALL SELECT settlement_id, 'settlement', 'SETTLEMENT_AMOUNT_MISMATCH', 'needs_review', delta FROM summed WHERE kind = 'differs'
  UNION ALL SELECT unnest([s1, s2]), 'settlement', 'MERGED_PAYOUT', 'auto_resolved', 0 FROM merged
  UNION ALL SELECT settlement_id, 'settlement', 'MISSING_IN_BANK', 'needs_review', net FROM missing
  UNION ALL SELECT line, 'bank', 'UNEXPECTED_BANK_CREDIT', 'needs_review', amount_paise FROM unexp WHERE line NOT IN (SELECT line FROM dmatch)
  UNION ALL SELECT invoice_no, 'erp', 'TDS_WITHHELD', 'auto_resolved', gross_paise - paid FROM dmatch WHERE rel <> 'gross'
)
"""
