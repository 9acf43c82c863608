"""A seeded world of any size: the rules of ``world`` over generated orders, each defect in a slice of orders of its own.

Everything is a hash of the seed and the order's number, so a row does not
depend on how Spark deals the orders.
"""

from __future__ import annotations

import random
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import half_even
from . import world
from .scratch import keep

BANKS = ("HDFC0", "ICIC0", "SBIN0", "AXIS0")
NAMES = ("Acme", "Bharat", "Coral", "Deccan", "Ember", "Falcon")
TRADES = ("Textiles", "Foundry", "Ceramics", "Orchards", "Logistics", "Printers")
FIRST_DAY, DAYS = "2026-01-01", 90


@dataclass(frozen=True)
class Defects:
    """How many orders carry each defect."""

    unbilled: int = 8
    unpaid: int = 12
    overcharged: int = 6
    no_ids: int = 8
    receipt_only: int = 8
    held: int = 4
    twice: int = 5
    refunded: int = 6
    disputed: int = 4
    mistaxed: int = 5


def jittered(seed: int, scale: float = 1.0, spread: float = 0.6, base: Defects = Defects()) -> Defects:
    """Each count times ``scale`` and a factor of its own from 1 - spread to 1 + spread; never negative."""
    rng = random.Random(seed)
    return Defects(**{name: max(0, round(n * scale * rng.uniform(1 - spread, 1 + spread))) for name, n in asdict(base).items()})


def slots(df: DataFrame, seed: int, orders: int) -> DataFrame:
    return df.withColumn("slot", F.pmod(F.xxhash64(F.col("k").cast("bigint"), F.lit(seed)), F.lit(orders)))


def rules(defects: Defects, orders: int) -> dict[str, str]:
    """A range of slots for each defect; the ranges do not meet."""
    out, at = {}, 0
    for name, n in asdict(defects).items():
        out[name] = f"slot >= {at} and slot < {at + n}"
        at += n
    if at > orders:
        raise ValueError(f"{at} defects do not fit {orders} orders")
    return out


def reference(day: Column, number: Column) -> Column:
    """A transfer reference: bank, date, six digits."""
    bank = F.element_at(F.array(*map(F.lit, BANKS)), (F.pmod(F.xxhash64(number), F.lit(len(BANKS))) + 1).cast("int"))
    return F.concat(bank, F.date_format(day, "yyMMdd"), F.lpad(F.pmod(F.xxhash64(number, F.lit(7)), F.lit(10**6)).cast("string"), 6, "0"))


def abbreviated(name: Column) -> Column:
    """A name as a payer's bank squeezes it: the first word, then words without later vowels, six letters at most."""
    all_ = F.split(F.upper(name), " +")
    squeeze = lambda w: F.substring(F.concat(F.substring(w, 1, 1), F.regexp_replace(F.substring(w, 2, 100), "[AEIOU]", "")), 1, 6)
    return F.array_join(F.transform(all_, lambda w, i: F.when(i == 0, w).otherwise(squeeze(w))), " ")


def build(spark: SparkSession, seed: int, orders: int = 400, defects: Defects | None = None) -> dict[str, DataFrame]:
    """inv, pg and bank."""
    planted = rules(defects or Defects(), orders)
    share = lambda name: F.pmod(F.xxhash64("k", F.lit(seed), F.lit(name)), F.lit(1_000_000))
    pick = lambda name, values: F.element_at(F.array(*map(F.lit, values)), (share(name) % len(values) + 1).cast("int"))
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (share("day") % DAYS).cast("int"))
    taxable = (50_000 + share("amount") * 7).cast("bigint")
    base = spark.range(1, orders + 1).select(F.col("id").alias("k")).select("k", day.alias("d"), F.concat_ws(" ", pick("name", NAMES), pick("trade", TRADES)).alias("customer"), taxable.alias("taxable"))
    base = keep(slots(base.withColumns({"ts": F.col("d").cast("timestamp_ntz"), "tax0": half_even(F.col("taxable"), 1800)}), seed, orders))
    inv = keep(world.invoices(base, planted))
    pg = keep(world.settled(world.gateway(base, planted), reference(F.col("sday"), F.col("dn"))))
    noise = spark.range(orders // 20).select(F.lit(FIRST_DAY).cast("timestamp").alias("ts"), (F.lit(5) + F.col("id") / 4).alias("value"))
    told = F.concat(F.regexp_replace(abbreviated(F.col("customer")), "[^A-Z ]", ""), F.lit("-PMT AGST BILL"))
    return {"inv": inv, "pg": pg, "bank": keep(world.bank(noise, base, inv, pg, planted, told))}


def defects_prepared(seed: int, orders: int):
    """For ``truth.codes``: the slot of a record's order."""
    return lambda df: slots(df, seed, orders)
