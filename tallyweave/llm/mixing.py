"""Mixing sources to target weights by temperature, as budgeted block permutations.

A source with share p of all tokens gets weight p**t / sum(p**t). The exponent
t is bisected: down from 1 (natural shares) towards 0 (equal weights) until the
weights reach a target entropy, or until the most repeated source would be read
``max_epochs`` times. The weights are then realised: each source is cut into
blocks by a hash of the id; its budget of tokens pays for whole passes over its
blocks, each pass in a new order, and then for a part of one more pass, block
by block in that order and record by record in the block where it runs out.

Only DataFrame functions are used. A source with a third of all rows is just
many blocks: no window ever holds more than one block's records.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, keep, text_or_empty

MAX_EPOCHS = 4.0
EVENNESS = 0.5  # of the query: how far its entropy lies from that of the natural shares towards equal weights
BLOCK_TOKENS = 64_000  # expected tokens of a block
SLICE_BITS = 12  # the blocks of a source are summed in so many slices (a power of two)
GRID = 16  # exponents tried at once; each round narrows the bracket 15-fold
ROUNDS = 6


def tokens(text_col) -> F.Column:
    """Words of a text, and one more for its end, so that empty texts count."""
    trimmed = F.trim(F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " "))
    # Plain arithmetic, no condition, so that the cleaned text is computed once.
    return (F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "))) + F.least(F.length(trimmed), F.lit(1)) + 1).cast("long")


def _measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest ratio of weight to share) for each exponent, in one pass."""
    logs = F.log("share")
    cols = []
    for i, t in enumerate(exponents):
        power = F.exp(logs * t)
        cols += [F.sum(power).alias(f"z{i}"), F.sum(power * logs).alias(f"l{i}"), F.max(F.exp(logs * (t - 1))).alias(f"m{i}")]
    row = sources.agg(*cols).first()
    return [(math.log(row[f"z{i}"]) - t * row[f"l{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"]) for i, t in enumerate(exponents)]


def exponent(sources: DataFrame, target_entropy: float | None = None, max_epochs: float = MAX_EPOCHS, floor_one: bool = True) -> tuple[float, float]:
    """(t, budget factor). sources: share of each source, adding up to 1.

    The smallest t (flattest weights) within both limits. With ``floor_one``
    the budget grows until no source is read less than once, so epochs compare
    with the least read source; else the budget is the corpus's own size.
    """

    def holds(entropy: float, most: float, least: float) -> bool:
        epochs = most / least if floor_one else most
        return epochs <= max_epochs * (1 + 1e-9) and (target_entropy is None or entropy <= target_entropy)

    def least_ratio(ts: list[float]) -> list[float]:
        logs = F.log("share")
        row = sources.agg(*[F.min(F.exp(logs * (t - 1))).alias(f"n{i}") for i, t in enumerate(ts)], *[F.sum(F.exp(logs * t)).alias(f"z{i}") for i, t in enumerate(ts)]).first()
        return [row[f"n{i}"] / row[f"z{i}"] for i in range(len(ts))]

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        ts = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        fits = [holds(e, m, n) for (e, m), n in zip(_measures(sources, ts), least_ratio(ts))]
        first = next((i for i, ok in enumerate(fits) if ok), GRID - 1)
        low, high = ts[max(0, first - 1)], ts[first]
        if first == 0:
            break
    return high, (1 / least_ratio([high])[0] if floor_one else 1.0)


def mix(docs: DataFrame, target_entropy: float | None = None, evenness: float | None = None, max_epochs: float = MAX_EPOCHS, floor_one: bool = True, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with source, tokens, epoch, block, draw: one per reading of a record.

    A null source is a source of its own. Sorting by (epoch, draw) gives the
    order of the mixture: a pseudo-random permutation of blocks, interleaved
    over sources. ``evenness`` sets the target entropy between that of the natural
    shares (0) and of equal weights (1), whatever the sources are. Ids may be null or repeat; rows alike in id and text are read
    equally often. Texts are counted whole, a null one like an empty one. An
    empty table gives no rows.
    """
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.xxhash64(docs[id_col], text_or_empty(docs[text_col])).alias("id"),  # so that rows with one id are dealt out too
        docs[source_col].cast("string").alias("source"),
        tokens(docs[text_col]).alias("tokens"),
    )
    sources = keep(rows.groupBy("source").agg(F.sum("tokens").alias("all")))  # a row per source
    total = sources.agg(F.sum("all")).first()[0]
    if not total:
        return rows.where("false").select("row", "source", "tokens", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("draw"))
    shares = sources.withColumn("share", F.col("all") / F.lit(float(total)))
    if evenness is not None:
        (natural, _), (flat, _) = _measures(shares, [1.0, 0.0])
        target_entropy = natural + evenness * (flat - natural)
    t, factor = exponent(shares, target_entropy, max_epochs, floor_one)
    z = shares.agg(F.sum(F.pow("share", F.lit(t)))).first()[0]
    plan = shares.select(
        F.col("source").alias("s"),
        F.greatest(F.lit(1), F.ceil(F.col("all") / block_tokens)).alias("blocks"),
        F.round(F.pow("share", F.lit(t)) / z * factor * total).cast("long").alias("budget"),
        F.col("all").alias("one_pass"),
    ).withColumns({"whole": F.floor(F.col("budget") / F.col("one_pass")).cast("int"), "left": F.col("budget") % F.col("one_pass")})
    plan = keep(plan)  # a row per source
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.col("blocks"))
    narrow = keep(rows.select("id", "source", "tokens").join(plan, F.col("source").eqNullSafe(F.col("s"))).select("id", "source", "tokens", place.alias("block"), "whole", "left"))
    order = lambda epoch: F.xxhash64("source", "block", epoch, F.lit(seed))
    turn = order(F.col("whole"))
    # The part of one more pass: blocks in that pass's order while the rest of the budget lasts. Sums go
    # over slices of the order and then inside each, so that no task sums all blocks of a large source.
    blocks = narrow.groupBy("source", "block", "whole", "left").agg(F.sum("tokens").alias("block_tokens")).withColumn("turn", turn)
    blocks = keep(blocks.withColumn("slice", F.shiftright("turn", 64 - SLICE_BITS)))
    earlier = lambda *order: W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    slices = blocks.groupBy("source", "slice").agg(F.sum("block_tokens").alias("n"))
    slices = slices.select(F.col("source").alias("s"), F.col("slice").alias("at"), F.coalesce(F.sum("n").over(earlier("slice").partitionBy("source")), F.lit(0)).alias("slices_before"))
    inside = F.coalesce(F.sum("block_tokens").over(earlier("turn", "block").partitionBy("source", "slice")), F.lit(0))
    summed = blocks.withColumn("inside", inside).join(slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("at"))).withColumn("pays", F.col("left") - F.col("slices_before") - F.col("inside"))
    # In each source the budget runs out inside one block; only there are records ordered.
    edge = keep(summed.where("pays >= 0 and pays < block_tokens").select(F.col("source").alias("edge_source"), F.col("block").alias("edge_block"), F.col("turn").alias("edge_turn"), "pays"))
    # Rows alike in id and text are read together or not at all.
    alike = narrow.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("block") == F.col("edge_block"))).groupBy("source", "id", "pays").agg(F.sum("tokens").alias("tokens"))
    draw = F.xxhash64("id", F.lit(seed + 1))
    run = W.partitionBy("source").orderBy(draw, "id").rowsBetween(W.unboundedPreceding, 0)
    last = alike.withColumns({"run": F.sum("tokens").over(run), "draw": draw}).where("run <= pays").groupBy("source").agg(F.max(F.struct("draw", "id")).alias("last"))
    last = last.select(F.col("source").alias("last_source"), F.col("last.draw").alias("last_draw"), F.col("last.id").alias("last_id"))
    # What is read once more is all that lies before these two places in the order, so a row per source decides it.
    plan = keep(plan.join(edge, F.col("s").eqNullSafe(F.col("edge_source")), "left").join(last, F.col("s").eqNullSafe(F.col("last_source")), "left").select("s", "blocks", "whole", "edge_block", "edge_turn", "last_draw", "last_id"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", place)
    paid = (turn < F.col("edge_turn")) | ((turn == F.col("edge_turn")) & (F.col("block") < F.col("edge_block")))
    part = (F.col("block") == F.col("edge_block")) & ((draw < F.col("last_draw")) | ((draw == F.col("last_draw")) & (F.col("id") <= F.col("last_id"))))
    times = (F.col("whole") + F.when(paid | part, 1).otherwise(0)).cast("int")
    read = joined.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    return read.select("row", "source", "tokens", "epoch", "block", order(F.col("epoch")).alias("draw"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, tokens, epoch, block, draw of every reading in the mixture."""
    return mix(documents(spark, sf_dir), evenness=EVENNESS).select("row.doc_id", "source", "tokens", "epoch", "block", "draw")
