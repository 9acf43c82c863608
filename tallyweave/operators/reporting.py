"""Cash position, roll-ups, scores against labels, and lookups over a finished run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.money import ratio
from .legs import bank_key, batches


def position(pg: DataFrame, run: dict[str, DataFrame]) -> DataFrame:
    """The cash bridge, one row."""
    when = lambda cond, value: F.coalesce(F.sum(F.when(F.expr(cond), F.expr(value))), F.lit(0)).cast("bigint")
    entering = "type = 'payment' and not on_hold and settlement_id is not null"
    bridge = pg.agg(
        when("type = 'payment'", "amount_paise").alias("captured"),
        when("type = 'payment' and on_hold", "amount_paise").alias("on_hold"),
        when("type = 'payment' and not on_hold and settlement_id is null", "amount_paise").alias("unbatched"),
        when(entering, "amount_paise").alias("entering"),
        when(entering, "fee_paise").alias("fees"),
        when(entering, "tax_paise").alias("gst"),
        when("type = 'refund' and settlement_id is not null", "abs(amount_paise)").alias("refunds"),
        when("type = 'adjustment' and settlement_id is not null", "abs(amount_paise)").alias("disputes"),
    ).withColumn("settled_net", F.expr("entering - refunds - fees - gst - disputes"))
    own = batches(pg).select("settlement_id", "net_paise")
    leg = run["matches"].where("leg = 'settlement_to_bank'")
    landed = leg.select(F.when(F.col("lkey").startswith("bank:"), F.col("rkey")).otherwise(F.col("lkey")).alias("settlement_id"), F.lit(True).alias("landed")).distinct()
    sums = own.join(landed, "settlement_id", "left").agg(when("true", "net_paise").alias("batch_net"), when("landed", "net_paise").alias("landed"), when("landed is null", "net_paise").alias("in_transit"))
    codes = run["findings"].agg(*[when(f"code = '{c}'", "value_paise").alias(n) for n, c in (("unexplained_credits", "UNEXPECTED_BANK_CREDIT"), ("open_receivables", "UNPAID_INVOICE"), ("unbilled_revenue", "UNBILLED_PAYMENT"), ("tds_receivable", "TDS_WITHHELD"))])
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(bridge).join(one(sums), "one").join(one(codes), "one").drop("one").withColumn("residual", F.col("settled_net") - F.col("batch_net"))


BRIDGE = (
    ("captured", 1), ("on_hold", -1), ("unbatched", -1), ("entering", 1), ("refunds", -1), ("fees", -1), ("gst", -1),
    ("disputes", -1), ("settled_net", 1), ("batch_net", 1), ("residual", 1), ("landed", 1), ("in_transit", 1),
)


def bridge_rows(pos: DataFrame) -> DataFrame:
    """step, label, amount_paise: the bridge as thirteen labelled rows."""
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("label"), (F.col(n) * s).alias("amount_paise")) for i, (n, s) in enumerate(BRIDGE, 1)])
    return pos.select(F.inline(rows))


def by_code(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("value_paise")).cast("bigint").alias("exposure_paise"), F.sum(F.when(F.col("disposition") == "needs_review", 1).otherwise(0)).cast("bigint").alias("to_review"))


def tiers(matches: DataFrame) -> DataFrame:
    """leg, tier, n: a match counts once however many partners it has."""
    return matches.groupBy("leg", "tier").agg(F.count_distinct("lkey").alias("n"))


def primary_finding(findings: DataFrame) -> DataFrame:
    """The finding of each key with the largest absolute value, ties by code."""
    w = W.partitionBy("key").orderBy(F.desc(F.abs("value_paise")), "code")
    return findings.withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "code", "value_paise")


def pairs(matches: DataFrame) -> DataFrame:
    """leg, a, b: links in one direction, batches before bank lines."""
    flip = F.col("lkey").startswith("bank:")
    return matches.select("leg", F.when(flip, F.col("rkey")).otherwise(F.col("lkey")).alias("a"), F.when(flip, F.col("lkey")).otherwise(F.col("rkey")).alias("b")).distinct()


def scores(predicted: DataFrame, truth: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (millionths) for each value of ``by``."""
    both = predicted.select(by, *keys).distinct().withColumn("p", F.lit(1)).join(truth.select(by, *keys).distinct().withColumn("t", F.lit(1)), [by, *keys], "full_outer")
    n = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0)).cast("bigint")
    counted = both.groupBy(by).agg(n("p = 1 and t = 1").alias("tp"), n("p = 1 and t is null").alias("fp"), n("p is null and t = 1").alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    million = lambda x: F.round(x * 1_000_000).cast("bigint")
    return counted.withColumns({"precision": million(p), "recall": million(r), "f1": million(ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))), "support": F.col("tp") + F.col("fn")})


def with_overall(df: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """``df`` and its rows once more under ``by`` = OVERALL, where the first key names the old value too."""
    once_more = df.select(F.lit("OVERALL").alias(by), F.concat_ws("/", by, keys[0]).alias(keys[0]), *keys[1:])
    return df.select(by, *keys).unionByName(once_more)


def macro_f1(scored: DataFrame) -> DataFrame:
    """Mean of f1 over rows with support."""
    return scored.agg(F.coalesce(F.round(F.avg(F.when(F.col("support") > 0, F.col("f1")))), F.lit(0)).cast("bigint").alias("macro_f1"))


def confusion(truth: DataFrame, primary: DataFrame) -> DataFrame:
    """truth, predicted, n over keys with either; the other side is CLEAN."""
    t, p = truth.select("key", F.col("code").alias("truth")), primary.select("key", F.col("code").alias("predicted"))
    clean = lambda c: F.coalesce(c, F.lit("CLEAN")).alias(c)
    return t.join(p, "key", "full_outer").select(clean("truth"), clean("predicted")).groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_of_sets(truth: DataFrame, primary: DataFrame) -> DataFrame:
    """``confusion`` where a key may have several true codes.

    Each key counts once: under the predicted code if that is one of its true
    codes, else under the first of them by name.
    """
    t = truth.groupBy("key").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    p = primary.select("key", F.col("code").alias("predicted"))
    true = F.when(F.array_contains("codes", F.col("predicted")), F.col("predicted")).otherwise(F.coalesce(F.element_at("codes", 1), F.lit("CLEAN")))
    both = t.join(p, "key", "full_outer").select(true.alias("truth"), F.coalesce("predicted", F.lit("CLEAN")).alias("predicted"))
    return both.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))


def auto_clear(sources: dict[str, DataFrame], run: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    """records, cleared. truth: leg, a, b of the true links.

    A record is cleared if it is on a correct link, or a gateway row of a batch
    that is linked to any bank line, and has no finding that needs review.
    """
    predicted = pairs(run["matches"])
    good = predicted.join(truth.distinct(), ["leg", "a", "b"], "left_semi")
    linked = good.where("leg <> 'settlement_to_bank'").select(F.col("a").alias("key")).unionByName(good.select(F.col("b").alias("key"))).distinct().withColumn("hit", F.lit(True))
    paid = predicted.where("leg = 'settlement_to_bank'").select(F.col("a").alias("s")).distinct().withColumn("batch_hit", F.lit(True))
    review = run["findings"].where("disposition = 'needs_review'").select("key").distinct().withColumn("open", F.lit(True))
    none = F.lit(None).cast("string").alias("s")
    records = sources["inv"].select(F.col("invoice_no").alias("key"), none)
    records = records.unionByName(sources["pg"].select(F.col("entity_id").alias("key"), F.col("settlement_id").alias("s"))).unionByName(sources["bank"].select(bank_key().alias("key"), none))
    seen = records.join(linked, "key", "left").join(paid, "s", "left").join(review, "key", "left")
    clear = (F.col("hit").isNotNull() | F.col("batch_hit").isNotNull()) & F.col("open").isNull()
    return seen.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.when(clear, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("cleared"))


def record_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """source, n, and a row for the total."""
    parts = None
    for name, df in sources.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")
        parts = part if parts is None else parts.unionByName(part)
    return parts.unionByName(parts.agg(F.sum("n").alias("n")).select(F.lit("total").alias("source"), "n"))


def exposure_by_code(findings: DataFrame) -> DataFrame:
    """code, n, exposure_paise, place: codes by their whole exposure, the largest first."""
    return by_code(findings).select("code", "n", "exposure_paise", F.row_number().over(W.orderBy(F.desc("exposure_paise"), "code")).alias("place"))  # one row a code


def distribution(scores: DataFrame, of: list[str]) -> DataFrame:
    """metric, mean, least, most, deviation (of the sample) over rows, one for each seed or code."""
    rows = scores.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in of])))
    return rows.groupBy("metric").agg(F.avg("x").alias("mean"), F.min("x").alias("least"), F.max("x").alias("most"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("deviation"))


def over_worlds(predicted: DataFrame, truth: DataFrame, keys: list[str], of: str) -> DataFrame:
    """metric, mean, least, most, deviation of precision, recall and f1 over the values of ``world``; metrics are named after ``of``."""
    scored = scores(predicted, truth, "world", keys)
    names = ["precision", "recall", "f1"]
    return distribution(scored.select(*[F.col(c).alias(f"{of}_{c}") for c in names]), [f"{of}_{c}" for c in names])
