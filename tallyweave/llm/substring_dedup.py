"""Long repeated passages by recompression.

Words are named by hash. Rounds of recompression then name runs (equal
neighbours) and pairs (a left-class symbol followed by a right-class one); a
name is a hash of what it stands for, so equal substrings get equal interior
symbols in every document and partition, and no dictionary is passed around.

Which interior symbols a window of 50 words has does not depend on its
surroundings: at each level the symbols at its ends that could have grown
across its border are popped. So equal windows share their high-level core, and
with it the anchor, a pair of neighbouring core symbols chosen by hash. Anchors
are a twentieth of the words. Only documents that share an anchor with another
document go on, and only their windows with shared anchors are verified, by 128
bits of two hashes over all 50 words, each against the smallest document that has it.
That document is found with a combiner and joined back, so a window that a third
of all documents hold is neither one group nor one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep, shuffle_parts, small_batches, text_or_empty

WINDOW = 50
ROUNDS = 4
BATCH_WORDS = 200_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S = np.uint64(32)


def mix(a, b):
    """One 64-bit name for a pair of names."""
    x = a * _A + ((b ^ (b >> _S)) * _B)
    x = (x ^ (x >> _S)) * _C
    return x ^ (x >> _S)


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but ASCII white space (0x20, 0x09 to 0x0D)."""
    return text.encode().split()


def names_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def second_names(words: list[bytes]) -> np.ndarray:
    """Names that do not depend on the first ones."""
    return np.fromiter((xxhash.xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))


def window_hashes(names: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash of each ``window`` consecutive names, by doubling."""
    out, done, power, span = None, 0, names, 1
    while True:
        if window & span:
            n = len(names) - done - span + 1
            if n <= 0:
                return np.zeros(0, np.uint64)
            out = power[:n] if out is None else mix(out[:n], power[done : done + n])
            done += span
        if span * 2 > window:
            return out
        power, span = mix(power[:-span], power[span:]), span * 2


def anchors(names: np.ndarray, at: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor key of each window that starts at a position in ``at``."""
    keys = np.zeros(len(at), np.uint64)
    symbols, lo, hi, live = names, at.copy(), at + window, np.arange(len(at))  # cores are [lo, hi)

    def choose(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> None:
        """Of the pairs of neighbours in each core, the one with the smallest name."""
        if not len(rows):
            return
        pairs = mix(symbols[:-1], symbols[1:]) if len(symbols) > 1 else symbols
        size = hi - lo - 1
        best = mix(symbols[lo], np.full(1, level, np.uint64))  # a core of one symbol
        some = size > 0
        best[some] = pairs[lo[some]]
        for k in range(1, int(size.max(initial=0))):
            some = size > k
            best[some] = np.minimum(best[some], pairs[lo[some] + k])
        keys[rows] = mix(best, np.full(1, level, np.uint64))

    for level in range(1, rounds + 1):
        # Runs: the first and the last run of a core may go on outside.
        new = np.r_[True, symbols[1:] != symbols[:-1]]
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        length = np.diff(np.r_[first, len(symbols)])
        next_lo, next_hi = run[lo] + 1, run[hi - 1]
        empty = next_lo >= next_hi
        choose(live[empty], lo[empty], hi[empty], 2 * level - 1)
        live, lo, hi = live[~empty], next_lo[~empty], next_hi[~empty]
        symbols = np.where(length > 1, mix(symbols[first], length.astype(np.uint64) + _B), symbols[first])
        if not len(live):
            return keys
        # Pairs: a right-class symbol at the start, or a left-class one at the end, may pair outside.
        left = ((symbols * _C) >> np.uint64(40 + level)) & np.uint64(1) == 0
        joined = np.zeros(len(symbols), bool)  # this one joins the one before
        joined[1:] = left[:-1] & ~left[1:]
        group = np.cumsum(~joined) - 1
        head = np.flatnonzero(~joined)
        next_lo = group[np.minimum(lo + ~left[lo], len(symbols) - 1)]
        next_hi = group[np.maximum(hi - 1 - left[hi - 1], 0)] + 1
        empty = (lo + ~left[lo] >= hi - left[hi - 1]) | (next_lo >= next_hi)
        choose(live[empty], lo[empty], hi[empty], 2 * level)
        live, lo, hi = live[~empty], next_lo[~empty], next_hi[~empty]
        pair = np.r_[joined[1:], False][head]
        symbols = np.where(pair, mix(symbols[head], symbols[np.minimum(head + 1, len(symbols) - 1)]), symbols[head])
        if not len(live):
            return keys
    choose(live, lo, hi, 2 * rounds + 1)
    return keys


def _in_batches(columns, text_at: int):
    """Rows of a record batch in lists of about BATCH_WORDS words, with their words."""
    some, count = [], 0
    for row in zip(*columns):
        words = words_of(row[text_at])
        some.append((row, words))
        count += len(words)
        if count >= BATCH_WORDS:
            yield some
            some, count = [], 0
    if some:
        yield some


def _windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows in the joined word array, the document of each, and its place there."""
    n = np.maximum(np.array(lengths, np.int64) - WINDOW + 1, 0)
    base = np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return base[doc] + local, doc, local


def _outline(batches):
    """Per document: n_words, a hash of all words, and its distinct anchors."""
    for b in batches:
        for some in _in_batches([b.column(i).to_pylist() for i in range(3)], 2):
            lengths = [len(w) for _, w in some]
            names = names_of([x for _, w in some for x in w])
            at, doc, _ = _windows(lengths)
            key = anchors(names, at).view(np.int64) if len(at) else np.zeros(0, np.int64)
            new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
            key, doc = key[new], doc[new]
            cut = np.searchsorted(doc, np.arange(len(some) + 1))
            yield pa.RecordBatch.from_pydict(
                {
                    "ord": pa.array([r[0] for r, _ in some], pa.int64()),
                    "th": pa.array([r[1] for r, _ in some], pa.int64()),
                    "n_words": pa.array(lengths, pa.int64()),
                    "seq": pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for _, w in some], pa.binary()),
                    "keys": pa.array([np.unique(key[a:z]) for a, z in zip(cut, cut[1:])], pa.list_(pa.int64())),
                }
            )


def _verify_windows(batches):
    """Hashes of the windows whose anchor is shared."""
    for b in batches:
        for some in _in_batches([b.column(i).to_pylist() for i in (0, 1, 2)] + [b.column(3)], 2):
            flat = [x for _, w in some for x in w]
            names = names_of(flat)
            at, doc, local = _windows([len(w) for _, w in some])
            key, hashes, others = anchors(names, at).view(np.int64), window_hashes(names), window_hashes(second_names(flat))
            cut = np.searchsorted(doc, np.arange(len(some) + 1))
            shared = np.zeros(len(at), bool)
            for (row, _), a, z in zip(some, cut, cut[1:]):
                shared[a:z] = np.isin(key[a:z], row[3].values.to_numpy())
            ords, ths = (np.array([r[i] for r, _ in some], np.int64) for i in (0, 1))
            # One row for each window of a document, with all its starts there.
            wh, w2, doc, local = hashes[at[shared]].view(np.int64), others[at[shared]].view(np.int64), doc[shared], local[shared].astype(np.int32)
            order = np.lexsort((w2, wh, doc))
            wh, w2, doc, local = wh[order], w2[order], doc[order], local[order]
            new = np.flatnonzero(np.r_[True, (wh[1:] != wh[:-1]) | (w2[1:] != w2[:-1]) | (doc[1:] != doc[:-1])]) if len(wh) else np.zeros(0, np.int64)
            starts = pa.ListArray.from_arrays(pa.array(np.r_[new, len(wh)].astype(np.int32)), pa.array(local))
            yield pa.RecordBatch.from_arrays([pa.array(wh[new]), pa.array(w2[new]), pa.array(ords[doc[new]]), pa.array(ths[doc[new]]), starts], ["wh", "w2", "ord", "th", "starts"])


def _covers(batches):
    """One row per document: starts and ends of the covered stretches. Rows are sorted by (ord, th)."""
    current, found, out = None, [], []

    def flush():
        if current is not None:
            p = np.unique(np.concatenate(found)).astype(np.int64)
            new = np.flatnonzero(np.r_[True, p[1:] > p[:-1] + WINDOW])
            out.append((*current, np.array([p[new], p[np.r_[new[1:], len(p)] - 1] + WINDOW], "<i8").tobytes()))

    def batch():
        return pa.RecordBatch.from_pydict({"ord": pa.array([x[0] for x in out], pa.int64()), "th": pa.array([x[1] for x in out], pa.int64()), "cover": pa.array([x[2] for x in out], pa.binary())})

    for b in batches:
        if not b.num_rows:
            continue
        o, t = b.column(0).to_numpy(), b.column(1).to_numpy()
        at, values = b.column(2).offsets.to_numpy(), b.column(2).values.to_numpy()
        new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])])
        for doc, th, i, j in zip(o[new].tolist(), t[new].tolist(), new.tolist(), [*new[1:].tolist(), len(o)]):
            if (doc, th) != current:
                flush()
                current, found = (doc, th), []
            found.append(values[at[i] : at[j]])
        if len(out) > 2000:
            yield batch()
            out.clear()
    flush()
    yield batch()


def _apply(with_text: bool):
    def run(batches):
        for b in batches:
            ids, texts, covers, copies = (b.column(i).to_pylist() for i in range(4))
            n, removed, sha, kept_texts = [], [], [], []
            for text, cover, copy in zip(texts, covers, copies):
                words = words_of(text)
                total = len(words)
                if copy:
                    words = []
                elif cover:
                    starts, ends = np.frombuffer(cover, "<i8").reshape(2, -1)
                    words = [w for a, z in zip([0, *ends.tolist()], [*starts.tolist(), total]) for w in words[a:z]]
                kept = b" ".join(words)
                n.append(total)
                removed.append(total - len(words))
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
            out = {"doc_id": b.column(0), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"kept_text": pa.array(kept_texts, pa.string())} if with_text else {}))

    return run


LAST = 9223372036854775807


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for).

    A word goes if a window of 50 words over it also starts in a document with
    a smaller id. A null text has no words. A null id counts as the largest.
    Rows that repeat an id are documents of their own, none smaller than the
    other. Texts under 50 words are never touched. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_parts(spark)
    text = text_or_empty(docs[text_col])
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))
    outline = keep(rows.select("ord", "th", "text").mapInArrow(_outline, "ord long, th long, n_words long, seq binary, keys array<long>"))
    # Of equal word sequences only the first goes on; all words of the others go at once.
    long = outline.where(f"n_words >= {WINDOW}")
    firsts = long.groupBy("seq").agg(F.min("ord").alias("first"))
    judged = keep(long.select("ord", "th", "seq").join(firsts.hint("merge"), "seq").select("ord", "th", (F.col("ord") > F.col("first")).alias("copy")))
    lead = long.select("ord", "th", "keys").join(judged.where("not copy").select("ord", "th").distinct().hint("merge"), ["ord", "th"])
    held = keep(lead.select("ord", "th", F.explode("keys").alias("key")))
    shared = held.groupBy("key").agg(F.min("ord").alias("a"), F.max("ord").alias("z")).where("a < z").select("key")
    by_doc = held.join(shared.hint("merge"), "key").groupBy("ord", "th").agg(F.collect_set("key").alias("keys"))
    by_doc = keep(by_doc)
    text_side = rows.select("ord", "th", "text")
    windows = text_side.join(by_doc.hint("merge"), ["ord", "th"]).select("ord", "th", "text", "keys").mapInArrow(_verify_windows, "wh long, w2 long, ord long, th long, starts array<int>")
    windows = keep(windows)
    first = keep(windows.groupBy("wh", "w2").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").select("wh", "w2", "first"))
    later = windows.join(first.hint("merge"), ["wh", "w2"]).where("ord > first").select("ord", "th", "starts")
    covers = later.repartition(parts, "ord", "th").sortWithinPartitions("ord", "th").mapInArrow(_covers, "ord long, th long, cover binary")
    copies = judged.where("copy").select("ord", "th", F.lit(None).cast("binary").alias("cover"), F.lit(True).alias("copy")).distinct()
    marks = keep(covers.withColumn("copy", F.lit(False)).unionByName(copies))
    marked = rows.join(marks.hint("merge"), ["ord", "th"], "left").select("doc_id", "text", "cover", F.coalesce("copy", F.lit(False)).alias("copy"))
    return marked.mapInArrow(_apply(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
