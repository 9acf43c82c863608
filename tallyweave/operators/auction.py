"""Optimal assignment of one connected group of any size: an auction in rounds.

Left and right keys are written down twice, as bidders and as objects, so that a key
without a partner takes its own copy: a left key at a price above all others together
(so most pairs come first), a right key for nothing. All bidders then find an object.

A round joins the edges with the price table, and each task lets its own bidders bid
against each other until each holds something; of the bids for an object the highest
of all tasks wins, and who lost bids again in the next round. A bid raises a price so
far that the bidder is within epsilon of its best choice, and prices only rise, so
bids on prices of the round before are good ones. Epsilon shrinks by phases; costs are
whole numbers times more than the number of bidders, and with a last epsilon of 1 the
result is within less than one of the optimum, so it is one.

Within a task bids cost microseconds; a fight that crosses tasks costs a round for
each bid. Tasks therefore get many edges, and a group that spans several of them is
slow, but bounded in memory.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import keep

EDGES_A_TASK = 1_000_000
SHRINK = 7
PRICES = "obj long, price long, owner long"


def _bid(epsilon: int):
    def run(batches):
        found = [b for b in batches if b.num_rows]  # about EDGES_A_TASK rows
        if not found:
            return
        table = pa.Table.from_batches(found).sort_by([("bidder", "ascending"), ("obj", "ascending")])
        bidder, obj, worth, price, owner = (table.column(c).to_numpy() for c in ("bidder", "obj", "worth", "price", "owner"))
        objects, at, edge_obj = np.unique(obj, return_index=True, return_inverse=True)
        now, holder = price[at].copy(), owner[at].copy()
        before = now.copy()
        starts = np.flatnonzero(np.r_[True, bidder[1:] != bidder[:-1]])
        ends = np.r_[starts[1:], len(bidder)]
        own = {b: i for i, b in enumerate(bidder[starts].tolist())}
        held = {own[h] for h in holder.tolist() if h in own}
        waiting = deque(i for i in range(len(starts)) if i not in held)
        while waiting:
            i = waiting.popleft()
            a, z = starts[i], ends[i]
            objs = edge_obj[a:z]
            net = worth[a:z] - now[objs]
            best = int(net.argmax())
            top = net[best]
            net[best] = np.iinfo(np.int64).min
            second = net.max() if z - a > 1 else top
            j = objs[best]
            now[j] += top - second + epsilon
            lost = own.get(int(holder[j]))
            if lost is not None:
                waiting.append(lost)
            holder[j] = bidder[a]
        new = now > before
        yield pa.RecordBatch.from_arrays([pa.array(objects[new]), pa.array(now[new]), pa.array(holder[new])], ["obj", "price", "owner"])

    return run


def assign(edges: DataFrame, edges_a_task: int = EDGES_A_TASK) -> DataFrame:
    """The edges (lkey, rkey, cost, ...) of a matching with most pairs and, of these, least cost; costs are whole and not negative.

    Of several such matchings it is any one.
    """
    spark = edges.sparkSession
    names = edges.columns
    least = keep(edges.groupBy("lkey", "rkey").agg(F.min("cost").cast("long").alias("cost")))
    nodes = least.select("lkey", F.lit(None).cast("string").alias("rkey")).distinct().unionByName(least.select(F.lit(None).cast("string").alias("lkey"), "rkey").distinct())
    nodes = keep(nodes.repartitionByRange("lkey", "rkey").sortWithinPartitions("lkey", "rkey").withColumn("id", F.monotonically_increasing_id()))
    lefts, rights = nodes.where("lkey is not null").select("lkey", F.col("id").alias("l")), nodes.where("rkey is not null").select("rkey", F.col("id").alias("r"))
    known = keep(least.join(lefts, "lkey").join(rights, "rkey").select("l", "r", "cost"))
    n_left, n, most, count = known.agg(F.count_distinct("l"), F.count_distinct("l") + F.count_distinct("r"), F.max("cost"), F.count(F.lit(1))).first()
    alone, scale = n_left * most + 1, n + 1
    if alone * scale >= 1 << 58:
        raise ValueError("costs are too large for whole-number prices")
    parts = max(1, -(-2 * count // edges_a_task))
    # A right key bids beside the first of its left keys, so that most bids for an object come from one task.
    beside = known.groupBy("r").agg(F.min("l").alias("near"))
    worth = lambda c: (-F.col(c) * scale).cast("long") if isinstance(c, str) else F.lit(-c * scale).cast("long")
    of_left = known.select(F.col("l").alias("near"), F.col("l").alias("bidder"), F.col("r").alias("obj"), worth("cost").alias("worth"))
    stay = known.select("l").distinct().select(F.col("l").alias("near"), F.col("l").alias("bidder"), F.col("l").alias("obj"), worth(alone).alias("worth"))
    of_right = known.join(beside, "r").select("near", F.col("r").alias("bidder"), F.col("l").alias("obj"), worth(0).alias("worth"))
    unused = beside.select("near", F.col("r").alias("bidder"), F.col("r").alias("obj"), worth(0).alias("worth"))
    every = of_left.unionByName(stay).unionByName(of_right).unionByName(unused)
    # A bidder's edges share ``near``, and ranges of it keep them together.
    every = keep(every.repartitionByRange(parts, "near").withColumn("part", F.spark_partition_id()).drop("near"))
    prices = keep(nodes.select(F.col("id").alias("obj"), F.lit(0).cast("long").alias("price"), F.lit(None).cast("long").alias("owner")))
    epsilon = max(1, alone * scale // SHRINK)
    while True:
        prices = prices.withColumn("owner", F.lit(-1).cast("long"))
        while True:
            seen = every.join(prices, "obj").repartition(parts, "part")
            bids = seen.mapInArrow(_bid(epsilon), PRICES).groupBy("obj").agg(F.max(F.struct("price", "owner")).alias("bid"))
            after = prices.join(bids, "obj", "left").select("obj", F.coalesce("bid.price", "price").alias("price"), F.coalesce("bid.owner", "owner").alias("owner"))
            prices = keep(after)
            if not prices.where("owner = -1").limit(1).count():
                break
        if epsilon == 1:
            break
        epsilon = max(1, epsilon // SHRINK)
    won = prices.join(lefts, F.col("owner") == F.col("l")).select("lkey", F.col("obj").alias("r")).join(rights, "r").select("lkey", "rkey")
    cheapest = F.row_number().over(W.partitionBy("lkey", "rkey").orderBy("cost"))
    return edges.join(won, ["lkey", "rkey"]).withColumn("nth", cheapest).where("nth = 1").select(names)
