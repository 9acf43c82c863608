"""Exact duplicates by two-pass Bloom filtering.

Pass one folds the hash of every normalised text into a Bloom filter that
also remembers which bits were set by more than one row. Pass two asks, row by
row, whether all bits of a hash were set twice: only such rows can have a copy,
so only they are shuffled and grouped by their full SHA-256. All other rows go
straight through as groups of one.

A filter has a byte limit (``max_filter_mb``), so that it can be broadcast. Where
one would get too full, the hashes are cut into slices of a million rows or fewer
by their own hash. The filters of all slices (2 MB each) are then built by one job
and written as pages, and one more job deals the hashes (never the texts) by slice,
so that a task sorts few rows and holds the filter of one slice at a time; no filter
is broadcast, and the driver takes no part however many slices there are. Slices
with far more rows than others (a hash that repeats millions of times) are dealt to
several tasks, each of which gets the pages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, keep, same_id, shuffle_parts, shuffles_once, small_batches, text_or_empty

MAX_FILTER_MB = 32
PAGE_BITS = 15  # a page of the filter is 32,768 bits, 4 KB
SLICE = 1 << 20  # rows of a slice, where one filter is not enough
IN_SLICE = 1 << 21  # rows of a slice that one task may get
MOST_PARTS = 20_000  # of the shuffle by slice; with more slices, tasks take several one after the other
AT_ONCE = 1 << 22  # bit positions that a task folds into pages at once


def _positions(hashes, bits: int) -> np.ndarray:
    """Two bit positions of each SHA-256, or of each 64-bit key."""
    if isinstance(hashes, np.ndarray) and hashes.dtype.kind == "i":
        x = hashes.view(np.uint64)
        words = np.stack([x, (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17)], axis=1)
    else:
        words = np.frombuffer(b"".join(hashes), dtype="<u8").reshape(-1, 4)[:, :2]
    return words & np.uint64(bits - 1)


def _all_set(filter_bytes: np.ndarray, hashes, bits: int) -> np.ndarray:
    at = _positions(hashes, bits).astype(np.int64)
    return ((filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _values(column):
    return column.to_numpy(zero_copy_only=False) if pa.types.is_int64(column.type) else column.to_pylist()


def _partial_pages(found: list[np.ndarray]):
    at, n = np.unique(np.concatenate(found), return_counts=True)
    page = (at >> np.uint64(PAGE_BITS)).astype(np.int64)
    offset = (at & np.uint64((1 << PAGE_BITS) - 1)).astype("<u2")
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    for some in np.array_split(starts, max(1, len(starts) // 512)):
        ends = [starts[i] if i < len(starts) else len(page) for i in np.searchsorted(starts, some, "right")]
        yield pa.RecordBatch.from_pydict(
            {
                "page": pa.array(page[some], pa.int64()),
                "once": pa.array([offset[a:b][n[a:b] == 1].tobytes() for a, b in zip(some, ends)], pa.binary()),
                "twice": pa.array([offset[a:b][n[a:b] > 1].tobytes() for a, b in zip(some, ends)], pa.binary()),
            }
        )


def _pages_of_partition(bits: int):
    def run(batches):
        found, held = [], 0
        for b in batches:
            if b.num_rows:
                at = _positions(_values(b.column(0)), bits)
                if b.num_columns > 1:  # slices lie one after the other
                    at = at + b.column(1).to_numpy().astype(np.uint64)[:, None] * np.uint64(bits)
                found.append(at.ravel())
                held += at.size
            if held >= AT_ONCE:
                yield from _partial_pages(found)
                found, held = [], 0
        if found:
            yield from _partial_pages(found)

    return run


def _merge_pages(least: int):
    """Rows arrive sorted by page; one page is held at a time."""

    def run(batches):
        current, counts, out = None, None, []

        def done():
            if current is not None and (counts >= least).any():
                out.append((current, np.packbits(counts >= least, bitorder="little").tobytes()))

        def batch():
            return pa.RecordBatch.from_pydict({"page": pa.array([x[0] for x in out], pa.int64()), "bits": pa.array([x[1] for x in out], pa.binary())})

        for b in batches:
            for page, once, twice in zip(*(b.column(i).to_pylist() for i in range(3))):
                if page != current:
                    done()
                    current, counts = page, np.zeros(1 << PAGE_BITS, np.uint8)
                at = np.frombuffer(once, "<u2")
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[np.frombuffer(twice, "<u2")] = 2
            if len(out) >= 1024:
                yield batch()
                out.clear()
        done()
        yield batch()

    return run


def _bits_for(rows: int, max_filter_mb: float) -> int:
    bits = 1 << PAGE_BITS
    while bits < 16 * rows and bits * 2 <= max_filter_mb * (1 << 23):
        bits <<= 1
    return bits


def _pages(hashes: DataFrame, bits: int, least: int) -> DataFrame:
    """page, bits of the filter of ``hashes``: one column, or also the slice; a slice's pages follow those of the one before."""
    partial = hashes.mapInArrow(_pages_of_partition(bits), "page long, once binary, twice binary")
    parts = shuffle_parts(hashes.sparkSession)
    return partial.repartition(parts, "page").sortWithinPartitions("page").mapInArrow(_merge_pages(least), "page long, bits binary")


def repeated_filter(hashes: DataFrame, column: str, rows: int, max_filter_mb: float = MAX_FILTER_MB, least: int = 2) -> np.ndarray:
    """Bits (as bytes, at most ``max_filter_mb``) that at least ``least`` (1 or 2) rows of ``hashes`` set."""
    bits = _bits_for(rows, max_filter_mb)
    merged = _pages(hashes.select(column), bits, least)
    filter_bytes = np.zeros(bits // 8, np.uint8)
    size = (1 << PAGE_BITS) // 8
    with shuffles_once(hashes.sparkSession):
        table = merged.toArrow()
    for page, found in zip(table["page"].to_pylist(), table["bits"].to_pylist()):
        filter_bytes[page * size : (page + 1) * size] = np.frombuffer(found, np.uint8)
    return filter_bytes


def maybe_repeated(spark: SparkSession, filter_bytes: np.ndarray):
    """A column function: may this hash occur more than once?"""
    shared, bits = spark.sparkContext.broadcast(filter_bytes), len(filter_bytes) * 8

    @F.pandas_udf("boolean")
    def test(hashes: pd.Series) -> pd.Series:
        return pd.Series(_all_set(shared.value, hashes.to_numpy(), bits) if len(hashes) else [], dtype=bool)

    return test


def slices_for(rows: int, max_filter_mb: float = MAX_FILTER_MB) -> int:
    """One slice while ``rows`` hashes fit into a filter of this size at 16 bits a hash, else slices of at most SLICE rows."""
    fit = max(1 << PAGE_BITS, int(max_filter_mb * (1 << 23))) // 16
    return 1 if rows <= fit else -(-rows // min(fit, SLICE))


def keep_sliced(hashes: DataFrame, column: str, slices: int) -> DataFrame:
    """``hashes`` written, a column ``slice`` added."""
    return keep(hashes.withColumn("slice", F.pmod(F.xxhash64(column), F.lit(slices)).cast("int")))


def _test_dealt(bits: int, column: int, names: list[str]):
    """Rows (slice, salt, page, bits, own columns) arrive in order, the pages of a slice before its hashes; one filter is held at a time."""
    size = (1 << PAGE_BITS) // 8

    def run(batches):
        current, filter_bytes = None, None
        for b in batches:
            if not b.num_rows:
                continue
            dealt = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy().astype(np.int64)
            starts = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]]).tolist()
            for start, end in zip(starts, [*starts[1:], b.num_rows]):
                if dealt[start] != current:
                    current, filter_bytes = dealt[start], np.zeros(bits // 8, np.uint8)
                own = b.slice(start, end - start)
                n = len(own) - own.column(2).null_count
                for page, found in zip(own.column(2)[:n].to_pylist(), own.column(3)[:n].to_pylist()):
                    at = page % (bits >> PAGE_BITS) * size
                    filter_bytes[at : at + size] = np.frombuffer(found, np.uint8)
                if n < len(own):
                    hashes = own.slice(n)
                    again = _all_set(filter_bytes, _values(hashes.column(4 + column)), bits)
                    yield pa.RecordBatch.from_arrays([*hashes.columns[4:], pa.array(again)], [*names, "again"])

    return run


def split_repeated(sliced: DataFrame, column: str, slices: int, max_filter_mb: float = MAX_FILTER_MB) -> DataFrame:
    """``sliced`` (see ``keep_sliced``) without its slice, plus ``again``: may the row's hash occur more than once?

    With one slice rows stay where they are. With more, two jobs make and ask all filters, whatever the number of slices.
    """
    spark = sliced.sparkSession
    rows = -(-sliced.count() // slices)
    own = sliced.drop("slice")
    if slices == 1:
        return own.withColumn("again", maybe_repeated(spark, repeated_filter(own, column, rows, max_filter_mb))(column))
    bits = _bits_for(rows, max_filter_mb)
    pages = keep(_pages(sliced.select(column, "slice"), bits, 2))
    sizes = sliced.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / IN_SLICE).cast("int").alias("many"))
    large = F.broadcast(keep(sizes.where("many > 1")))  # at most a row for every IN_SLICE hashes, and only of hashes that repeat that often
    salts = F.coalesce("many", F.lit(1))
    names = own.columns
    hashes = sliced.withColumn("nth", F.monotonically_increasing_id()).join(large, "slice", "left")
    hashes = hashes.select("slice", F.pmod("nth", salts).cast("int").alias("salt"), F.lit(None).cast("long").alias("page"), F.lit(None).cast("binary").alias("bits"), *names)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in own.schema]
    of_slice = pages.withColumn("slice", F.expr(f"cast(page div {bits >> PAGE_BITS} as int)")).join(large, "slice", "left")
    of_slice = of_slice.select("slice", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "page", "bits", *nothing)
    dealt = of_slice.unionByName(hashes).repartition(max(shuffle_parts(spark), min(slices, MOST_PARTS)), "slice", "salt")
    dealt = dealt.sortWithinPartitions("slice", "salt", F.col("page").asc_nulls_last())
    return dealt.mapInArrow(_test_dealt(bits, names.index(column), names), own.withColumn("again", F.lit(True)).schema)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: float = MAX_FILTER_MB, slices: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, sha (binary SHA-256).

    Texts are equal when identical after each run of ASCII white space became
    one space; a null text counts as empty. ``keep_id`` is the smallest id of a
    group. Null ids count as the largest: they are kept only where a group has
    no other id. Rows that share both id and text share one decision, so all
    rows with the smallest id stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    normal = F.regexp_replace(text_or_empty(docs[text_col]), SPACE, " ")
    hashed = docs.select(docs[id_col].alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("sha"))
    slices = slices or slices_for(docs.count(), max_filter_mb)
    flagged = keep(split_repeated(keep_sliced(hashed, "sha", slices), "sha", slices, max_filter_mb))
    again = flagged.where("again").select("doc_id", "sha")
    # Written, so that the join deals both its sides anew and a large group can be split.
    groups = keep(again.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    shuffled = again.join(groups.hint("merge"), "sha")
    through = flagged.where("not again").select("sha", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return shuffled.select("sha", "doc_id", "keep_id", "group_size").unionByName(through).withColumn("kept", same_id(F.col("doc_id"), F.col("keep_id")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: float = MAX_FILTER_MB) -> DataFrame:
    """One row of each group of ``exact_groups``, with all its columns.

    Of rows that share the smallest id too, null or not, the first by a hash of
    the text as it is stays.
    Hashes alone go through the slices; those that do repeat make one more filter,
    which the texts pass where they are. Only rows that it picks are shuffled, to
    meet the smallest id of their group. Past some 16 million hashes that repeat
    it fills up and more rows are shuffled; that changes the cost, never the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    normal = F.regexp_replace(text_or_empty(docs[text_col]), SPACE, " ")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), F.unhex(F.sha2(normal, 256)).alias("sha"))
    slices = slices_for(docs.count(), max_filter_mb)
    flagged = split_repeated(keep_sliced(rows.select("id", "sha"), "sha", slices), "sha", slices, max_filter_mb)
    groups = flagged.where("again").groupBy("sha").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = keep(groups.where("group_size > 1"))
    test = maybe_repeated(spark, repeated_filter(groups, "sha", groups.count(), max_filter_mb, least=1))
    again = rows.where(test("sha")).join(groups.hint("merge"), "sha", "left").where(F.col("group_size").isNull() | same_id(F.col("id"), F.col("keep_id")))
    again = again.groupBy("sha").agg(F.min_by("row", F.xxhash64(F.col("row")[text_col])).alias("row"))
    return rows.where(~test("sha")).select("row.*").unionByName(again.select("row.*"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
