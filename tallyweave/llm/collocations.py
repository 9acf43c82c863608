"""Collocations by growing contiguous patterns, prefix by prefix.

Frequent words are counted first. Each of their occurrences is then a pointer into its
piece, projected to the words that follow it (as far as frequent words go, three at
most); equal projections of a task are one with a count. All projections of a prefix
word meet in one bucket, where they are sorted once: a prefix is then a stretch of
rows, its extensions to the right are the stretches inside, and those that are
frequent are grown depth-first.

Buckets grow in number with the corpus and hold a bounded share of it. A word with
more occurrences than that has its projections dealt by the next two words to several
buckets; its pairs are counted in parts, added up afterwards, and its longer phrases are
whole in one bucket. Nothing is collected but the list of such words, which is
shorter than the number of buckets, and a filter of frequent words of at most 16 MB
(where it fills up, more words are projected; the result stays).
"""

from __future__ import annotations

import struct
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, keep, shuffle_parts, small_batches, text_or_empty
from .exact_dedup import _positions, repeated_filter

LEAST, LONGEST = 30, 4
COVERED = 80  # a phrase goes if a longer one around it has these hundredths of its occurrences
FIRST = 2000
MAX_FILTER_MB = 16
BUCKETS, MOST_BUCKETS, IN_BUCKET = 1000, 2_000_000, 500_000
FLUSH_WORDS = 3_000_000
#: ASCII bytes that end a piece become a full stop, which no word holds; tabs become spaces.
_MARKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"." * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_and_stops(text: str) -> list[bytes]:
    """Words with A-Z lower-cased, and a full stop wherever a piece ends."""
    return text.encode().lower().translate(_MARKS).replace(b".", b" . ").split()


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang)


def _hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = _seed(lang)
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


class _Corpus:
    """Texts of one language as numbers: 0 is the end of a piece, words are numbered as they come."""

    def __init__(self) -> None:
        self.number = defaultdict(count(1).__next__)
        self.number[b"."] = 0
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        words = words_and_stops(text)
        words.append(b".")
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def words(self) -> list[bytes]:
        """By number; the first is the full stop."""
        return list(self.number)


def _flushes(batches, most: int = FLUSH_WORDS):
    """Languages and their texts, a bounded number of words at a time."""
    held: dict[str, _Corpus] = {}
    total = 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            corpus = held.setdefault(lang, _Corpus())
            before = corpus.size
            corpus.add(text)
            total += corpus.size - before
            if total >= most:
                yield from held.items()
                held, total = {}, 0
    yield from held.items()


def _count_words(batches):
    for lang, corpus in _flushes(batches):
        words = corpus.words()[1:]
        counts = np.bincount(np.concatenate(corpus.parts), minlength=len(words) + 1)[1:]
        hashes = _hashes(words, lang).view(np.int64)
        for at in range(0, len(words), 100_000):
            part = words[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([w.decode() for w in part], pa.string()), pa.array(hashes[at : at + 100_000]), pa.array(counts[at : at + 100_000].astype(np.int64))], ["lang", "word", "h", "n"])


def _pack(words: list[bytes], windows: np.ndarray, counts: np.ndarray) -> bytes:
    kind = np.uint16 if len(words) < 1 << 16 else np.uint32
    names = b" ".join(words)
    head = struct.pack("<III", len(names), len(counts), kind().itemsize)
    return zstandard.compress(head + names + windows.astype(kind).tobytes() + counts.astype("<u4").tobytes(), 1)


def _unpack(block: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = zstandard.decompress(block)
    names, rows, width = struct.unpack_from("<III", data)
    words = data[12 : 12 + names].split(b" ")
    windows = np.frombuffer(data, f"<u{width}", LONGEST * rows, 12 + names).reshape(LONGEST, rows)
    return words, windows, np.frombuffer(data, "<u4", rows, 12 + names + LONGEST * rows * width)


def _combined(windows: np.ndarray, counts: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Windows (one column a word) in order, equal ones as one; ``first`` sorts before all words."""
    base = np.int64(windows.max(initial=0) + 1)
    a, b = windows[0] * base + windows[1], windows[2] * base + windows[3]
    order = np.lexsort((b, a) if first is None else (b, a, first))
    a, b = a[order], b[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    if first is not None and len(a):
        first = first[order]
        new[1:] |= first[1:] != first[:-1]
    at = np.flatnonzero(new)
    summed = np.add.reduceat(counts[order], at) if len(at) else counts[:0]
    return windows[:, order[at]], summed, None if first is None else first[at]


def _project(filter_bytes, hot, buckets: int):
    """Blocks of projections: lang, bucket, block."""

    def run(batches):
        bits, (hot_hash, hot_parts) = filter_bytes.value, hot.value
        for lang, corpus in _flushes(batches):
            words = corpus.words()
            h = _hashes(words, lang)
            at = _positions(h.view(np.int64), len(bits) * 8).astype(np.int64)
            frequent = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            frequent[0] = False
            parts = np.ones(len(words), np.uint64)
            if len(hot_hash):
                near = np.minimum(np.searchsorted(hot_hash, h), len(hot_hash) - 1)
                parts = np.where(hot_hash[near] == h, hot_parts[near], 1).astype(np.uint64)
            s = np.concatenate([*corpus.parts, np.zeros(LONGEST - 1, np.int32)])
            s = np.where(frequent[s], s, 0)
            w = [s[i : len(s) - LONGEST + 1 + i] for i in range(LONGEST)]
            used = np.flatnonzero((w[0] > 0) & (w[1] > 0))
            w = [x[used].astype(np.int64) for x in w]
            w[3] = np.where(w[2] > 0, w[3], 0)
            after = h[w[1]] ^ (h[w[2]] * _MIX)
            deal = (h[w[0]] ^ ((after ^ (after >> np.uint64(31))) % parts[w[0]] * _MIX)) * _MIX
            bucket = ((deal >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            windows, counts, bucket = _combined(np.stack(w), np.ones(len(bucket), np.int64), bucket)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            ids, blocks = [], []
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]):
                own, inverse = np.unique(np.concatenate([[0], windows[:, i:j].ravel()]), return_inverse=True)
                names = [words[x] + b"." if parts[x] > 1 else words[x] for x in own.tolist()]  # a full stop marks words that are dealt in parts
                ids.append(int(bucket[i]))
                blocks.append(_pack(names, inverse[1:].reshape(LONGEST, -1), counts[i:j]))
                if len(ids) == 500:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], ["lang", "bucket", "block"])
                    ids, blocks = [], []
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(blocks, pa.binary())], ["lang", "bucket", "block"])

    return run


def _grow(least: int):
    """Frequent phrases of each bucket; rows are sorted by (lang, bucket), so one bucket is held at a time."""

    def phrases(blocks: list[bytes]):
        number = defaultdict(count(1).__next__)
        number[b"."] = 0
        windows, counts = [], []
        for block in blocks:
            words, own, n = _unpack(block)
            windows.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words))[own])
            counts.append(n.astype(np.int64))
        words = list(number)
        windows, counts, _ = _combined(np.concatenate(windows, 1), np.concatenate(counts))

        def extend(prefix: list[bytes], a: int, b: int, in_parts: bool):
            depth = len(prefix)
            column = windows[depth, a:b]
            starts = np.flatnonzero(np.r_[True, column[1:] != column[:-1]])
            sums = np.add.reduceat(counts[a:b], starts)
            part = in_parts and depth == 1
            ends = np.r_[starts[1:], len(column)]
            for i in np.flatnonzero((column[starts] > 0) & ((sums >= least) | part)).tolist():
                grown = [*prefix, words[column[starts[i]]].rstrip(b".")]
                yield grown, int(sums[i]), part
                if len(grown) < LONGEST and sums[i] >= least:
                    yield from extend(grown, a + int(starts[i]), a + int(ends[i]), in_parts)

        if len(counts):
            starts = np.flatnonzero(np.r_[True, windows[0, 1:] != windows[0, :-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(counts)]):
                word = words[windows[0, a]]
                yield from extend([word.rstrip(b".")], a, b, word.endswith(b"."))

    def run(batches):
        current, blocks = None, []
        for b in batches:
            for lang, bucket, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (lang, bucket) != current:
                    if blocks:
                        yield from _out(current[0], phrases(blocks))
                    current, blocks = (lang, bucket), []
                blocks.append(block)
        if blocks:
            yield from _out(current[0], phrases(blocks))

    return run


GROWN = "lang string, phrase string, words int, a long, part boolean"


def _out(lang: str, grown):
    rows = list(grown)
    for at in range(0, len(rows), 50_000):
        some = rows[at : at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array([b" ".join(x[0]).decode() for x in some], pa.string()), pa.array([len(x[0]) for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int64()), pa.array([x[2] for x in some], pa.bool_())],
            ["lang", "phrase", "words", "a", "part"],
        )


def frequent_phrases(docs: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(words: lang, word, f, of all words; phrases: lang, phrase, words, a, of 2 to 4 words and at least ``least`` occurrences)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), text_or_empty(docs[text_col]).alias("text"))
    words = keep(texts.mapInArrow(_count_words, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("f")))
    total, kinds = words.agg(F.coalesce(F.sum("f"), F.lit(0)), F.count_if(F.col("f") >= least)).first()
    buckets = min(MOST_BUCKETS, max(BUCKETS, total // IN_BUCKET))
    share = max(least, total // buckets)
    often = sorted((r["h"] % (1 << 64), -(-r["f"] // share)) for r in words.where(F.col("f") > share).select("h", "f").collect())  # fewer than ``buckets``
    hot = (np.array([x[0] for x in often], np.uint64), np.array([x[1] for x in often], np.int64))
    chosen = repeated_filter(words.where(F.col("f") >= least), "h", kinds, MAX_FILTER_MB, least=1)
    send = spark.sparkContext.broadcast
    blocks = texts.mapInArrow(_project(send(chosen), send(hot), buckets), "lang string, bucket int, block binary")
    dealt = blocks.repartition(max(shuffle_parts(spark), buckets // 50), "lang", "bucket").sortWithinPartitions("lang", "bucket")
    grown = keep(dealt.mapInArrow(_grow(least), GROWN))
    in_parts = grown.where("part").groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return words, grown.where("not part").select("lang", "phrase", "words", "a").unionByName(in_parts)


def _cut(column: str, first: Column, words: Column) -> Column:
    return F.array_join(F.slice(F.split(column, " "), first, words), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = FIRST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``top`` phrases of each language.

    Phrases are 2 to 4 words inside a piece, with a >= ``least`` occurrences, overlaps
    included. Of the cuts into l and r the one with the lowest score counts, ties to
    the shortest first part. A phrase inside a longer one with 80 % of its occurrences
    is left out. Ranks go by score, then a, then the phrase's bytes. A null language is
    ``und``; a null text has no words. Each row counts, also where rows repeat. Texts are
    read whole, however long. An empty table gives no rows; other columns, ids included,
    are not looked at. Sums are exact: products are decimals.
    """
    words, phrases = frequent_phrases(docs, least, lang_col, text_col)
    found = keep(phrases)
    counts = keep(found.select("lang", "phrase", F.col("a").alias("f")).unionByName(words.where(F.col("f") >= least).select("lang", F.col("word").alias("phrase"), "f")))
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _cut("phrase", F.lit(1), F.col("k")).alias("one"), _cut("phrase", F.col("k") + 1, F.col("words") - F.col("k")).alias("two"))
    side = lambda part, f: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(f)).hint("merge")
    scored = cuts.join(side("one", "l"), ["lang", "one"]).join(side("two", "r"), ["lang", "two"])
    score = F.expr(f"cast(cast(a as decimal(20, 0)) * {2_000_000} div (cast(l as decimal(20, 0)) + r) as bigint)")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.explode(F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), i -> array_join(slice(split(phrase, ' '), i, s), ' '))))"))
    around = found.where("words > 2").select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.expr(f"coalesce(cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {COVERED}, false)")
    left = best.join(around.hint("merge"), ["lang", "phrase"], "left").where(~covered)
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    ranked = keep(left.withColumn("rank", nth).where(F.col("rank") <= top))
    per_lang = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(per_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, ws FROM (
    SELECT lang, list_filter(regexp_split_to_array(part, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents
    )
  )
), i AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS pos FROM p
), g AS (
  SELECT lang, size, array_to_string(ws[pos:pos + size - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE pos + size - 1 <= len(ws)
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL HAVING size = 1 OR count(*) >= 30
), c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1
), k AS (
  SELECT *, unnest(range(1, size)) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, a, k.k AS k, one.f AS l, two.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (one.f + two.f) AS BIGINT) AS score FROM k
  JOIN f one ON one.lang = k.lang AND one.phrase = array_to_string(ws[1:k.k], ' ')
  JOIN f two ON two.lang = k.lang AND two.phrase = array_to_string(ws[k.k + 1:k.size], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), x AS (
  SELECT lang, a, array_to_string(ws[pos:pos + inner_size - 1], ' ') AS phrase FROM c, (SELECT unnest([2, 3]) AS inner_size), (SELECT unnest([1, 2, 3]) AS pos)
  WHERE inner_size < size AND pos + inner_size - 1 <= size
), d AS (
  SELECT DISTINCT b.lang, b.phrase FROM b JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE 100 * x.a >= 80 * b.a
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang
), t AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE d.phrase IS NULL
)
SELECT t.lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM t JOIN n ON t.lang = n.lang WHERE rank <= 2000
"""
