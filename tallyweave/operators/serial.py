"""Serial choice without a serial loop: all open items decide at once, and what stands is kept.

Items in order each look at their options, best first, and may take one; what an
option takes is gone for later items. In a round the items are cut into ranges of
their order, or of another value that items near each other in what they look at
share, and each task plays its range in order as if no other range took anything. A
decision stands unless something it looked at was taken by an earlier item of another
range, or may still be taken by an earlier item whose own decision does not stand. Standing
decisions are appended to the log, what they took is removed, and the rest is asked
again. The first open item always stands, so this ends; items that take nothing
disturb nobody, so any number of them needs one round.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep, shared_folder

CHUNK = 50_000  # options of a range, about
#: (item, options that are free, best first) -> (index of the one it takes or None, how many it looked at, what goes to the log or None)
Decide = Callable[[str, list[dict]], tuple[int | None, int, tuple | None]]


def _play(decide: Decide, names: list[str], enough: int | None):
    """Rows arrive by order, item and place. Options lost to this range are skipped, unless there may be ``more`` of an item and fewer than ``enough`` are left."""

    def run(batches):
        part, gone, held, out = TaskContext.get().partitionId(), set(), [], []

        def done():
            options = [o for o in held if not gone.intersection(o["takes"])]
            short = enough is not None and len(options) < min(enough, len(held)) and held[0]["more"]
            chosen, looked, log = (None, 0, None) if short else decide(held[0]["item"], options)
            took = [] if chosen is None else list(options[chosen]["takes"])
            gone.update(took)
            # Of what it looked at, also what this range had taken before: that may come back.
            last = held.index(options[looked - 1]) + 1 if 0 < looked < len(options) else len(held)
            seen = {t for o in held[:last] for x in (o["takes"], o["tokens"]) for t in x}
            reach = {t for o in held for t in o["reach"]}
            out.append((held[0]["ord"], held[0]["item"], part, bool(short), took, sorted(seen), sorted(reach), log is not None, *(log or (None,) * len(names))))

        def frame():
            return pd.DataFrame(out, columns=["ord", "item", "part", "again", "took", "seen", "reach", "asked", *names])

        for b in batches:
            for row in b.to_dict("records"):
                if held and held[0]["item"] != row["item"]:
                    done()
                    held = []
                held.append(row)
            if len(out) > 2000:
                yield frame()
                out.clear()
        if held:
            done()
        yield frame()

    return run


def _standing(tried: DataFrame) -> DataFrame:
    """The decisions that no earlier one can upset."""
    seen = keep(tried.select("ord", "item", "part", F.explode("seen").alias("t")))
    reach = tried.select("ord", "item", F.explode("reach").alias("t"))
    # A range takes a name once, so there are no more of these for a name than ranges.
    took = tried.select(F.col("part").alias("by_part"), F.col("ord").alias("by_ord"), F.explode("took").alias("t"))
    upset = seen.join(took, "t").where("by_part <> part and by_ord < ord").select("item")
    shaky = tried.where("again").select("item").unionByName(upset)
    shaky, count = keep(shaky.distinct()), -1
    while (now := shaky.count()) not in (0, count):
        count = now
        open_ = reach.join(shaky, "item", "left_semi").groupBy("t").agg(F.min("ord").alias("open"))
        shaky = keep(shaky.unionByName(seen.join(open_, "t").where("open < ord").select("item")).distinct())
    return tried.join(shaky, "item", "left_anti")


def choose(options: DataFrame, decide: Decide, log_schema: str, refill: Callable[[DataFrame, DataFrame], DataFrame] | None = None, chunk: int = CHUNK, enough: int | None = None) -> DataFrame:
    """The log, a row for each item that ``decide`` gave one for: item and the columns of ``log_schema``.

    ``options``: ord, item, place, takes (names), and what ``decide`` reads; ``ord`` is
    unique for an item and options of an item are tried by ``place``. With ``refill``
    (items that are decided, names that are taken and by which order) -> options, an item
    has further options when some are gone; then ``tokens`` of an option and ``reach`` of
    an item are sets of names such that an item only ever takes options with a token it
    reaches. What a later item has taken already, an earlier one may still look at. Options
    say whether there may be ``more`` of the item; it is asked again with others if fewer
    than ``enough`` are left of those it has. Options with a column ``deal``, the same for
    all of an item, are dealt by its ranges and not by ``ord``.
    """
    spark = options.sparkSession
    names = [x.strip().split(" ")[0] for x in log_schema.split(",")] if "<" not in log_schema else [x.split(" ")[0] for x in log_schema.split(", ")]
    if refill is None:
        options = options.withColumns({"tokens": F.array().cast("array<string>"), "reach": F.col("takes")})
    kind = options.schema["ord"].dataType.simpleString()
    schema = f"ord {kind}, item string, part int, again boolean, took array<string>, seen array<string>, reach array<string>, asked boolean, {log_schema}"
    open_, parts = keep(options), int(spark.conf.get("spark.sql.shuffle.partitions"))

    def play(n: int) -> DataFrame:
        dealt = open_.repartitionByRange(max(1, min(parts, n // chunk)), "deal" if "deal" in open_.columns else "ord").sortWithinPartitions("ord", "item", "place")
        return keep(dealt.mapInPandas(_play(decide, names, enough), schema))

    n = open_.count()
    if refill is None and n < 2 * chunk:
        return play(n).where("asked").select("item", *names)  # one range, so all of it stands
    path = f"{shared_folder(spark)}/tallyweave-recon/{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    log = spark.read.schema(schema)
    while n := open_.count():
        stands = keep(_standing(play(n)))
        stands.write.mode("append").parquet(path)
        taken = stands.select(F.explode("took").alias("t")).distinct()
        if refill is not None:
            open_ = keep(refill(log.parquet(path).select("item"), log.parquet(path).select(F.explode("took").alias("t"), F.col("ord").alias("by"))))
        else:
            rest = open_.join(stands.select("item"), "item", "left_anti")
            dead = rest.select("item", "place", F.explode("takes").alias("t")).join(taken, "t", "left_semi").select("item", "place").distinct()
            open_ = keep(rest.join(dead, ["item", "place"], "left_anti").select(open_.columns))
    return log.parquet(path).where("asked").select("item", *names)
