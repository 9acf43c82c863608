"""The k nearest in amount, then in days, without a reach and without comparing all with all.

Amounts of the right side, each once, are cut into ranges; inside a range each row
knows its neighbours, and the ends of the ranges, a few rows a range, reach over the
borders. Of k amounts below and k above, the k + 1 closest to a left amount hold its k
nearest rows, as two amounts at most are equally far. In one amount the same is done with days. All of it is done once for each
left amount and day, however many rows share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import keep


def _around(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """rows (by, value, right, left) plus ``near``: up to k values of right rows on either side inside ``by``, its own among them."""
    at = W.partitionBy(*by).orderBy(value)
    right = rows.where("right")
    chain = right.withColumn("below", F.array(F.col(value), *[F.lag(value, i).over(at) for i in range(1, k)])).withColumn("above", F.array(F.col(value), *[F.lead(value, i).over(at) for i in range(1, k)]))
    both = rows.join(chain.select(*by, value, "below", "above"), [*by, value], "left")
    below = F.last("below", True).over(at.rowsBetween(W.unboundedPreceding, 0))
    down = W.partitionBy(*by).orderBy(F.desc(value))  # a frame that ends at the last row would be read anew for each row
    above = F.last("above", True).over(down.rowsBetween(W.unboundedPreceding, 0))
    none = F.array().cast(rows.schema[value].dataType.simpleString().join(("array<", ">")))
    return both.select(*by, value, "left", F.array_compact(F.array_union(F.coalesce(below, none), F.coalesce(above, none))).alias("near"))


def _closest(values: Column, to: Column, k: int) -> Column:
    """Of distinct values the k closest and what may lie as far as the last of them on the other side."""
    far = F.transform(values, lambda v: F.struct(F.abs(v - to).alias("far"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(far), 1, k + 1), lambda x: x["value"])


def _amounts(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """lamount, amount: for each left amount, the k right amounts closest to it and one more."""
    both = left.select("amount", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(right.select("amount", F.lit(False).alias("l"), F.lit(True).alias("r")))
    both = both.groupBy("amount").agg(F.max("r").alias("right"), F.max("l").alias("left"))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keep(both.repartitionByRange(parts, "amount").withColumn("range", F.spark_partition_id()))
    inside = _around(ranged, ["range"], "amount", k).where("left")
    order = W.partitionBy("range").orderBy
    low = ranged.where("right").withColumn("n", F.row_number().over(order("amount"))).where(F.col("n") <= k)
    high = ranged.where("right").withColumn("n", F.row_number().over(order(F.desc("amount")))).where(F.col("n") <= k)
    ends = lambda df, name: df.groupBy("range").agg(F.sort_array(F.collect_list("amount")).alias(name))
    ranges = ranged.select("range").distinct().join(ends(low, "low"), "range", "left").join(ends(high, "high"), "range", "left")
    none = F.array().cast("array<bigint>")
    every = W.orderBy("range")  # a row of k amounts for each range, so bounded by the number of ranges
    earlier = F.flatten(F.collect_list(F.coalesce("high", none)).over(every.rowsBetween(W.unboundedPreceding, -1)))
    later = F.flatten(F.collect_list(F.coalesce("low", none)).over(every.rowsBetween(1, W.unboundedFollowing)))
    before, after = F.slice(earlier, F.greatest(F.size(earlier) - k + 1, F.lit(1)), k), F.slice(later, 1, k)
    halo = ranges.select("range", F.concat(before, after).alias("halo"))
    return inside.join(F.broadcast(halo), "range").select(F.col("amount").alias("lamount"), F.explode(_closest(F.array_union("near", "halo"), F.col("amount"), k)).alias("amount"))


def nearest(left: DataFrame, right: DataFrame, k: int = 3) -> DataFrame:
    """lkey, rank, and the k right rows nearest by amount, then by days, then by rkey, with diff and gap.

    left: lkey, amount, ldate; right: rkey, amount, rdate, and what else it has.
    """
    left, right = keep(left), keep(right.withColumn("rdate", F.col("rdate").cast("date")))
    asked = keep(left.groupBy("amount", "ldate").agg(F.count(F.lit(1)).alias("n")).select(F.col("amount").alias("lamount"), "ldate"))
    amounts = keep(_amounts(left.select("amount").distinct(), right.select("amount").distinct(), k))
    first = W.partitionBy("amount", "rdate").orderBy("rkey")
    few = keep(right.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).drop("nth"))
    wanted = asked.join(amounts, "lamount")
    days = few.select("amount", F.col("rdate").alias("day"), F.lit(True).alias("right"), F.lit(False).alias("left")).unionByName(wanted.select("amount", F.col("ldate").alias("day"), F.lit(False).alias("right"), F.lit(True).alias("left")))
    days = keep(days.groupBy("amount", "day").agg(F.max("right").alias("right"), F.max("left").alias("left")))
    since = F.lit("1970-01-01").cast("date")
    near = F.transform("near", lambda d: F.datediff(d, since))
    close = _around(days, ["amount"], "day", k).where("left").select("amount", F.col("day").alias("ldate"), F.explode(_closest(near, F.datediff("day", since), k)).alias("rday"))
    close = close.select("amount", "ldate", F.date_add(since, F.col("rday")).alias("rdate"))
    found = wanted.join(close, ["amount", "ldate"]).join(few, ["amount", "rdate"])
    found = found.withColumns({"diff": F.abs(F.col("lamount") - F.col("amount")), "gap": F.abs(F.datediff("ldate", "rdate"))})
    rank = F.row_number().over(W.partitionBy("lamount", "ldate").orderBy("diff", "gap", "rkey"))
    best = keep(found.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("amount", "ramount"))
    return left.withColumnRenamed("amount", "lamount").join(best, ["lamount", "ldate"])
