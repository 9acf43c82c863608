"""Shards of near equal bytes by sampled splitters.

A size-weighted sample of keys gives quantile boundaries; records fall into the
ranges between them; a range with too many bytes or rows (a hot key, a run of
empty texts) is subdivided by a hash of the id. Cumulative sizes of these small
ranges, and then of the records inside each, cut the whole order at equal
numbers of bytes. Only DataFrame functions are used.

The law is ``bytes``: a shard's size differs from the mean by at most the
largest record. Equal texts have equal keys, so they lie together except where
a boundary falls among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, keep, text_or_empty

SHARDS = 40
RANGES = 256  # ranges to aim at
PART_BYTES = 1 << 30  # a range with more is subdivided, so parts grow in number with the records
SAMPLE = 8192  # expected number of sampled keys, the bound on what the driver sees
OVERHEAD = 16  # bytes that each record costs besides its text


def splitters(records: DataFrame, total: int, ranges: int = RANGES, sample: int = SAMPLE) -> list[int]:
    """Quantile boundaries of ``key`` by bytes, from a sample of about ``sample`` rows.

    A row is drawn with a chance in proportion to its size (1 for rows larger
    than total/sample); the draw is a hash of the row, so it repeats exactly.
    """
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = F.greatest(F.lit(1.0), F.col("size") * F.lit(sample / max(total, 1)))
    drawn = records.where(draw < F.col("size") * F.lit(sample / max(total, 1))).select("key", weight.alias("weight")).collect()
    drawn.sort(key=lambda r: r["key"])  # about ``sample`` rows
    step, at, out = sum(r["weight"] for r in drawn) / ranges, 0.0, []
    for r in drawn:
        at += r["weight"]
        if step and at >= step * (len(out) + 1) and len(out) < ranges - 1:
            out.append(r["key"])
            while at >= step * (len(out) + 1) and len(out) < ranges - 1:
                out.append(r["key"])
    return sorted(set(out))


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries lie below ``key``: two short searches instead of one long one."""
    if not bounds:
        return F.lit(0)
    width = 16
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda values, x: F.size(F.filter(values, lambda b: b < x))
    lows = F.array(*[F.lit(g[0]) for g in groups])
    table = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    coarse = F.greatest(below(lows, key) - 1, F.lit(0))
    return coarse * width + below(F.element_at(table, coarse + 1), key)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    A null text has size 16 and the checksum of no bytes; null and repeated ids
    are fine (rows are only ordered by them). Ties in the order, rows equal in
    id and text, are interchangeable. An empty table gives no rows.
    """
    records = keep(
        docs.select(
            docs[id_col].cast("long").alias("doc_id"),
            (F.octet_length(text_or_empty(docs[text_col])) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text_or_empty(docs[text_col]).cast("binary")).alias("text_crc32"),
            F.xxhash64(text_or_empty(docs[text_col])).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    n, total = records.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranged = records.withColumn("range", range_of(F.col("key"), splitters(records, total)))
    # Subdivide: parts such that no part has over 1/RANGES of all bytes or rows, nor over PART_BYTES, on average.
    parts = F.broadcast(
        ranged.groupBy("range").agg(
            F.greatest(F.ceil(F.sum("size") * RANGES / F.lit(max(total, 1))), F.ceil(F.count(F.lit(1)) * RANGES / F.lit(max(n, 1))), F.ceil(F.sum("size") / PART_BYTES)).cast("int").alias("parts")
        )
    )  # at most RANGES rows
    divided = ranged.join(parts, "range").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id", "row", F.lit(11)), F.col("parts"))).otherwise(F.lit(0)).cast("int"))
    order = W.orderBy("range", "part").rowsBetween(W.unboundedPreceding, -1)
    starts = F.broadcast(  # at most 4 * RANGES rows and one for each PART_BYTES: 100,000 of four numbers at 100 TB
        divided.groupBy("range", "part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select("range", "part", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(order), F.lit(0)).alias("rows_before"))
    )
    inside = W.partitionBy("range", "part").orderBy("key", "doc_id", "row")
    placed = (
        divided.withColumn("cum", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(starts, ["range", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            # A record belongs where its middle byte falls.
            F.least(F.expr(f"cast((2 * (bytes_before + cum) - size) * {shards} div {2 * max(total, 1)} as int)"), F.lit(shards - 1)).alias("shard"),
            (F.col("rows_before") + F.col("nth") - 1).alias("place"),
        )
    )
    placed = keep(placed)
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row per shard
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(documents(spark, sf_dir))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
