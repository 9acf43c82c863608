"""Lines that many documents share, by range-partitioned hashes.

A line is known by two hashes of its key, its document by id and a hash of its text,
and its place. These records, no text, are dealt by ranges of the key's hash and
sorted by key, document and place: the first of each document stream past, and
their number in a key decides about all its lines. What goes back to a document is
a bitmap of its lines, words of 64 bits, of which only those with a dropped line are
kept.

A key that a large share of all lines has would be one range. Such keys are found on
a bounded sample of the records and counted with a combiner; they go nowhere, as all
that their records need is a lookup in that short table. Which keys the sample shows
changes the work and never the result. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, keep, shuffle_parts, text_or_empty

MIN_CHARS, MIN_DOCS = 1, 10
SAMPLE = 200_000  # expected number of sampled records
HOT = 40  # sampled records of a key that is counted apart; so at most SAMPLE / HOT keys are
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOC = ["ord", "th"]
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_records(rows: DataFrame, min_chars: int) -> DataFrame:
    """ord, th, pos, h1, h2 of each line whose key is long enough to be judged."""
    lines = rows.select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(*DOC, "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(*DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))


def dropped_lines(records: DataFrame, min_docs: int) -> DataFrame:
    """ord, th, pos of the records whose key at least ``min_docs`` documents have.

    A document counts by its first record of a key. Rows equal in id and text have equal
    places, so all of theirs are first ones, and each row counts.
    """
    draw = F.pmod(F.xxhash64(*DOC, "pos", F.lit(5)), F.lit(1 << 30))
    sampled = records.where(draw < int(min(1.0, SAMPLE / max(records.count(), 1)) * (1 << 30)))
    hot = F.broadcast(keep(sampled.groupBy(KEY).agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= HOT).select(KEY)))  # SAMPLE / HOT rows
    firsts = F.count_if(F.col("nth") == 1)
    nth = F.rank().over(W.partitionBy(*KEY, *DOC).orderBy("pos"))
    apart = records.join(hot, KEY, "left_semi")
    many = apart.withColumn("nth", nth).groupBy(KEY).agg(firsts.alias("docs")).where(F.col("docs") >= min_docs).select(KEY)
    by_lookup = apart.join(F.broadcast(keep(many)), KEY, "left_semi")  # no more rows than ``hot``
    # A range of the key's hashes holds keys whole, so that both windows take it as it is, in one order.
    dealt = records.join(hot, KEY, "left_anti").repartitionByRange(shuffle_parts(records.sparkSession), *KEY)
    by_range = dealt.withColumn("nth", nth).withColumn("docs", firsts.over(W.partitionBy(KEY))).where(F.col("docs") >= min_docs)
    return by_lookup.select(*DOC, "pos").unionByName(by_range.select(*DOC, "pos"))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """ord, th, words, n_dropped: words are (word, bits) in order; a 0 bit is a dropped line, words of ones are left out."""
    placed = dropped.select(*DOC, F.expr("cast(pos div 64 as int)").alias("word"), F.expr("shiftleft(1L, pos % 64)").alias("bit")).repartition(shuffle_parts(dropped.sparkSession), *DOC)
    words = placed.groupBy(*DOC, "word").agg(F.bit_or("bit").alias("gone"))
    in_order = F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits"))))
    return words.groupBy(DOC).agg(in_order.alias("words"), F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"))


def kept_lines(lines: Column, words: Column) -> Column:
    """The lines whose bit is set; those past the last word stay."""
    before = lambda i: F.coalesce(F.get(words, i - 1)["word"], F.lit(-1))
    bits = lambda x: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(x["bits"], b) == 1)
    flags = F.flatten(F.transform(words, lambda x, i: F.concat(F.array_repeat(F.lit(True), 64 * (x["word"] - before(i) - 1)), bits(x))))
    both = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("flag")), lambda x: x["line"].isNotNull() & F.coalesce(x["flag"], F.lit(True)))
    return F.transform(both, lambda x: x["line"])


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, words (its keep bitmap; null where all lines stay) and kept_text.

    Lines are what stands between line feeds; a null or empty text is one empty line.
    A key of at least ``min_chars`` code points that at least ``min_docs`` documents
    have loses all its lines. Rows that repeat an id, or have none, are documents of
    their own, also where their texts are equal. Texts are read whole, however long.
    An empty table gives no rows; other columns are not looked at.
    """
    text = text_or_empty(docs[text_col])
    rows = docs.select(docs[id_col].cast("long").alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))
    bitmaps = keep(keep_bitmaps(dropped_lines(keep(line_records(rows, min_chars)), min_docs)))
    marks = bitmaps.select(F.col("ord").alias("id"), F.col("th").alias("hash"), "words", "n_dropped")
    marked = rows.join(marks.hint("merge"), F.col("ord").eqNullSafe(F.col("id")) & (F.col("th") == F.col("hash")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(lines, F.col("words")), "\n"))
    return marked.select(F.col("ord").alias("doc_id"), F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "words", kept.alias("kept_text"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH s AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM s
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l
), m AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), d AS (
  SELECT k.*, m.key IS NOT NULL AS dropped FROM k LEFT JOIN m ON k.key = m.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
