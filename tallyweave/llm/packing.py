"""Packing along a space-filling curve.

Each document becomes token ids and a hashed vector of its token counts,
projected to a few dimensions by fixed random signs. The Hilbert index of the
quantised projection is its place on the curve. Documents are range-sorted by
that key; laid end to end in this order they are cut every 2048 tokens, so
neighbours on the curve share sequences and only the very last one is padded.

Token ids are made once and written to the shared folder. The sort carries
them along, running totals inside a range partition are kept by the task that
writes it, and only one total per partition is summed up over the partitions.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, documents, keep, shuffle_parts, small_batches, text_or_empty

LENGTH = 2048
END_ID = 1
DIMS, BITS = 4, 8  # a Hilbert key of 32 bits
BUCKETS = 4096  # hashed features
SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoder(path: str):
    """The byte-level BPE of ``byte_bpe_50k.json`` from its rank file: the same ids, five times as fast."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def token_ids(text: str, path: str) -> np.ndarray:
    e = encoder(path)
    ids = e.encode(text, allowed_special="all") if SPECIAL in text else e.encode_ordinary(text)
    return np.array(ids + [END_ID], "<u2" if e.max_token_value < 1 << 16 else "<u4")


@functools.cache
def _projection() -> np.ndarray:
    return np.random.default_rng(2048).choice([-1.0, 1.0], (BUCKETS, DIMS))


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows), by Skilling's transpose algorithm."""
    x = coords.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(docs: list[np.ndarray]) -> np.ndarray:
    """The Hilbert key of each document's token ids."""
    at = np.empty((len(docs), DIMS))
    for i, ids in enumerate(docs):
        vector = np.sqrt(np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS))
        at[i] = vector @ _projection() / np.sqrt(max(1, len(ids)))
    # The projection's scale: about 1 standard deviation for each unit.
    cells = np.clip((np.tanh(at / 2) + 1) * (1 << (BITS - 1)), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells)


def _tokenise(path: str):
    def run(batches):
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                docs = [token_ids(t, path) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "uid": part.column(2),
                        "curve": pa.array(curve_keys(docs), pa.int64()),
                        "doc_tokens": pa.array([len(d) for d in docs], pa.int64()),
                        "ids": pa.array([d.tobytes() for d in docs], pa.binary()),  # 16 bits each where the vocabulary allows
                    }
                )

    return run


TOKENISED = "doc_id long, uid long, curve long, doc_tokens long, ids binary"


def _lay_out(batches):
    """Running totals inside one sorted partition."""
    at = 0
    for b in batches:
        n = b.column("doc_tokens").to_numpy()
        if len(n):
            ends = at + np.cumsum(n)
            yield b.append_column("local", pa.array(ends - n, pa.int64()))
            at = int(ends[-1])


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve long, ids binary"


def _cut(length: int, with_ids: bool):
    """Pieces of documents (doc_id, curve, doc_tokens, ids, at) laid end to end; ``at`` is the place of their first id."""

    def run(batches):
        for b in batches:
            out = []
            for doc_id, curve, total, raw, at in zip(*(b.column(i).to_pylist() for i in range(5))):
                ids = np.frombuffer(raw, f"<u{len(raw) // total}").astype("<u4")
                start = 0
                while start < total:
                    sequence, offset = divmod(at + start, length)
                    n = min(total - start, length - offset)
                    piece = ids[start : start + n].tobytes()
                    out.append((doc_id, start, n, zlib.crc32(piece), total, sequence, offset, curve, piece if with_ids else None))
                    start += n
            names = PIECES.replace(" long", "").replace(" binary", "").split(", ")
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, columns)], names)

    return run


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve, ids.

    ``ids`` (unsigned 32-bit, little-endian) only if asked for. A null or empty
    text is a document of its end id alone. Null and repeated ids are packed row
    by row (a repeated row is a further document). Documents of any length are
    cut as needed; every id lies in exactly one piece. An empty table gives no
    rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = vocabulary or vocabulary_path()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"), F.monotonically_increasing_id().alias("uid"))
    tokenised = keep(rows.mapInArrow(_tokenise(path), TOKENISED))
    parts = shuffle_parts(spark)
    # The unique uid splits a hot key's rows over partitions.
    laid = keep(
        tokenised.repartitionByRange(parts, "curve", "doc_id", "uid")
        .sortWithinPartitions("curve", "doc_id", "uid")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_lay_out, TOKENISED + ", part int, local long")
    )
    discard(tokenised)
    totals = laid.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = F.broadcast(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))  # a row per partition
    placed = laid.join(offsets, "part").select("doc_id", "curve", "doc_tokens", "ids", (F.col("base") + F.col("local")).alias("at"))
    return placed.mapInArrow(_cut(length, with_ids), PIECES)


COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select(*COLUMNS)
