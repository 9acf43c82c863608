"""The set-to-set steps: optimal assignment, consolidated payouts and contested receipts.

Set operations decide everything uncontested. Contested rows of the serial steps go to
``serial``; those of the assignment are solved a connected group at a time, many in a task
while groups are small and by ``auction`` when they are not.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import keep
from . import auction, serial


CELL = 20_000  # left rows of a cell that one task may get
IN_TASK = 200_000  # edges of a contested group that one task may solve


def _cells(value: Column, before: int, after: int) -> Column:
    """The cells of width before + after + 1 that hold value - before to value + after: one or two."""
    width = before + after + 1
    return F.sequence(F.floor((value - before) / width), F.floor((value + after) / width))


def _day(column: str) -> Column:
    return F.datediff(column, F.lit("1970-01-01").cast("date")).cast("long")


def band_pairs(left: DataFrame, right: DataFrame, tolerance: int | None, before: int, after: int) -> DataFrame:
    """Join on |lamount - ramount| <= tolerance and ldate - before <= rdate <= ldate + after, as an equi-join on a grid of amounts and days.

    left: lkey, amount, ldate, ...; right: rkey, amount, rdate, ...; the amounts become
    lamount and ramount. Without a tolerance days alone count. Left rows of a cell with
    more than CELL of them are dealt to several tasks, the right rows go to each of these.
    """
    days = before + after + 1
    a = left.withColumnRenamed("amount", "lamount").withColumn("dcell", F.explode(_cells(_day("ldate"), before, after)))
    b = right.withColumnRenamed("amount", "ramount").withColumn("dcell", F.floor(_day("rdate") / days))
    keys = ["dcell"]
    if tolerance is not None:
        a = a.withColumn("acell", F.explode(_cells(F.col("lamount"), tolerance, tolerance)))
        b = b.withColumn("acell", F.floor(F.col("ramount") / (2 * tolerance + 1)))
        keys.append("acell")
    met = list(keys)
    if left.count() > CELL:  # else no cell can have more
        hot = a.groupBy(keys).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts")).where("parts > 1")  # combined before it is dealt
        hot = keep(hot)
        a = a.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64("lkey"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        b = b.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        met.append("salt")
    gap = F.datediff("rdate", "ldate")
    pairs = a.join(b, met).where((gap >= -before) & (gap <= after))
    if tolerance is not None:
        pairs = pairs.where(F.abs(F.col("lamount") - F.col("ramount")) <= tolerance)
    return pairs.drop(*met)


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = near.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def groups_of(edges: DataFrame) -> DataFrame:
    """edges (lkey, rkey, ...) plus ``grp``, the smallest lkey of all edges that hang together.

    A left key is linked with the smallest one at each of its right keys, and
    alternating large and small stars go on until each key hangs on the smallest of
    its group; rounds grow with the logarithm of the longest chain.
    """
    edges = keep(edges)
    least = edges.groupBy("rkey").agg(F.min("lkey").alias("b"))
    links = keep(edges.join(least, "rkey").where("b <> lkey").select(F.col("lkey").alias("a"), "b").distinct())
    while not (links.groupBy("a").count().where("count > 1").isEmpty() and links.join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()):
        links = keep(_star(_star(links, True), False))
    roots = links.select(F.col("a").alias("lkey"), F.col("b").alias("root"))
    return edges.join(roots, "lkey", "left").select(*edges.columns, F.coalesce("root", "lkey").alias("grp"))


def _chosen(left: list, right: list, cost: list) -> list[bool]:
    """Which of the edges are taken: most pairs, then least cost; keys are taken in their order, so input order changes nothing.

    Left keys enter one by one along the cheapest augmenting path (Dijkstra on
    reduced costs); each may also stay alone, at a price above all others.
    """
    if len(left) == 1:
        return [True]
    lefts = {k: i for i, k in enumerate(sorted(set(left)))}
    rights = {k: i for i, k in enumerate(sorted(set(right)))}
    costs: list[dict[int, int]] = [{} for _ in lefts]
    for a, b, c in zip(left, right, cost):
        mine = costs[lefts[a]]
        mine[rights[b]] = min(int(c), mine.get(rights[b], int(c)))
    alone = sum(max(mine.values()) for mine in costs) + 1
    for i, mine in enumerate(costs):
        mine[len(rights) + i] = alone
    priced = [sorted(mine.items()) for mine in costs]
    owner: dict[int, int] = {}
    holds: dict[int, int] = {}
    up, down = [0] * len(costs), [0] * (len(rights) + len(costs))  # prices of left and right keys
    for i in range(len(costs)):
        best: dict[int, int] = {}
        asked_by: dict[int, int] = {}
        settled: dict[int, int] = {}
        heap: list[tuple[int, int]] = []
        row, so_far = i, 0
        while True:
            for j, c in priced[row]:
                d = so_far + c - up[row] - down[j]
                if j not in settled and d < best.get(j, d + 1):
                    best[j], asked_by[j] = d, row
                    heapq.heappush(heap, (d, j))
            so_far, end = heapq.heappop(heap)
            while end in settled:
                so_far, end = heapq.heappop(heap)
            if end not in owner:
                break
            settled[end] = so_far
            row = owner[end]
        up[i] += so_far
        for j, d in settled.items():
            down[j] -= so_far - d
            up[owner[j]] += so_far - d
        while True:
            row = asked_by[end]
            owner[end], holds[row], given = row, end, holds.get(row)
            if row == i:
                break
            end = given
    return [owner.get(rights[b]) == lefts[a] for a, b in zip(left, right)]


def _best_assignment(edges: pd.DataFrame) -> pd.DataFrame:
    return edges[_chosen(*(edges[c].tolist() for c in ("lkey", "rkey", "cost")))]


def _group_by_group(batches, names: list[str]):
    """Rows arrive by group; a batch's last group may go on in the next batch."""
    held = None
    for rows in batches:
        rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
        grp = rows["grp"].to_numpy()
        cuts = np.flatnonzero(grp[1:] != grp[:-1]) + 1
        whole = int(cuts[-1]) if len(cuts) else 0
        held = rows.iloc[whole:]
        if whole:
            yield _taken(rows.iloc[:whole], [0, *cuts.tolist()])[names]
    if held is not None and len(held):
        yield _taken(held, [0, len(held)])[names]


def _taken(rows: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
    left, right, cost = (rows[c].tolist() for c in ("lkey", "rkey", "cost"))
    chosen: list[bool] = []
    for a, b in zip(cuts, cuts[1:]):
        chosen += _chosen(left[a:b], right[a:b], cost[a:b])
    return rows[chosen]


def assign(edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """The optimal one-to-one subset of edges (lkey, rkey, cost, ...): most pairs, then least cost.

    Connected groups of up to ``in_task`` edges are solved in a task, many groups in
    each, larger ones by an auction in rounds.
    """
    grouped = keep(groups_of(edges))
    large = keep(grouped.groupBy("grp").count().where(F.col("count") > in_task).select("grp"))
    names = edges.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in edges.schema)
    none_large = large.isEmpty()
    small = grouped if none_large else grouped.join(large, "grp", "left_anti").select(grouped.columns)
    dealt = small.repartition("grp").sortWithinPartitions("grp")
    out = dealt.mapInPandas(lambda batches: _group_by_group(batches, names), schema)
    if none_large:
        return out
    return out.unionByName(auction.assign(grouped.join(large, "grp", "left_semi").select(names)))


def _first_free(item: str, options: list[dict]) -> tuple[int | None, int, tuple | None]:
    return (0, 1, (options[0]["takes"][0],)) if options else (None, 0, None)


def first_come(edges: DataFrame, chunk: int = serial.CHUNK) -> DataFrame:
    """Edges (lkey, rkey, lseq, rseq, score, ...) that a serial choice in order of lseq takes: the best score, then the first rseq."""
    edges = keep(edges)
    place = F.row_number().over(W.partitionBy("lkey").orderBy(F.desc("score"), "rseq"))
    options = edges.select(F.col("lseq").alias("ord"), F.col("lkey").alias("item"), place.alias("place"), F.array("rkey").alias("takes"))
    taken = serial.choose(options, _first_free, "rkey string", chunk=chunk)
    return edges.join(taken.withColumnRenamed("item", "lkey"), ["lkey", "rkey"]).select(edges.columns)


def _smallest_and_tightest(item: str, options: list[dict]) -> tuple[int | None, int, tuple | None]:
    """The first set, unless the next is as small and as tight; that is left for a human."""
    if not options:
        return None, 0, None
    best = (options[0]["size"], options[0]["span"])
    tied = sum((o["size"], o["span"]) == best for o in options)
    return (0, 1, (list(options[0]["takes"]),)) if tied == 1 else (None, tied, None)


def consolidated(lines: DataFrame, batches: DataFrame, window: int, tolerance: int, chunk: int = serial.CHUNK) -> DataFrame:
    """line_no, amount, members, size, span, total of credits that pay two or three batches.

    lines: line_no, value_date, amount; batches: settlement_id, day, net. Sums of two
    batches are made once for all lines and met on the grid of ``band_pairs`` by the
    lines, and by what is left of a line after one batch more.
    """
    batches, lines = keep(batches), keep(lines)
    ones = batches.select(F.col("settlement_id").alias("lkey"), F.col("net").alias("amount"), F.col("day").alias("ldate"))
    others = batches.select(F.col("settlement_id").alias("rkey"), F.col("net").alias("amount"), F.col("day").alias("rdate"))
    twos = band_pairs(ones, others, None, 2 * window, 2 * window).where("lkey < rkey")
    twos = keep(twos.select(F.array("lkey", "rkey").alias("members"), (F.col("lamount") + F.col("ramount")).alias("amount"), F.least("ldate", "rdate").alias("rdate"), F.greatest("ldate", "rdate").alias("final"), F.col("rkey").alias("rkey")))
    asked = lines.select(F.col("line_no").cast("string").alias("lkey"), "line_no", F.col("amount").alias("paid"), "amount", F.col("value_date").alias("ldate"))
    within = F.abs(F.datediff("ldate", "final")) <= window
    pays_two = band_pairs(asked, twos, tolerance, window, window).where(within)
    pays_two = pays_two.select("line_no", F.col("paid").alias("amount"), "members", F.lit(2).alias("size"), F.datediff("final", "rdate").alias("span"), F.col("ramount").alias("total"))
    near = band_pairs(asked, others.withColumnRenamed("rkey", "third"), None, window, window)
    left = near.select("lkey", "line_no", "paid", (F.col("lamount") - F.col("ramount")).alias("amount"), "ldate", "third", F.col("rdate").alias("day"), F.col("ramount").alias("net"))
    pays_three = band_pairs(left, twos, tolerance, window, window).where(within & (F.col("third") > F.col("rkey")))
    span = F.datediff(F.greatest("final", "day"), F.least("rdate", "day"))
    pays_three = pays_three.select("line_no", F.col("paid").alias("amount"), F.concat("members", F.array("third")).alias("members"), F.lit(3).alias("size"), span.alias("span"), (F.col("ramount") + F.col("net")).alias("total"))
    options = keep(pays_two.unionByName(pays_three))
    place = F.row_number().over(W.partitionBy("line_no").orderBy("size", "span", "members"))
    offered = options.select(F.col("line_no").alias("ord"), F.col("line_no").cast("string").alias("item"), place.alias("place"), F.col("members").alias("takes"), "size", "span")
    taken = serial.choose(offered, _smallest_and_tightest, "members array<string>", chunk=chunk)
    return options.join(taken.select(F.col("item").cast("int").alias("line_no"), "members"), ["line_no", "members"]).select(options.columns)
