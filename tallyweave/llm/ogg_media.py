"""Documents as Ogg media columns: write pages, verify, reassemble, demultiplex, time.

A payload travels as 576-byte packets of 8-bit samples, dealt in turn to two
logical streams of one physical Ogg file. Reading it back checks the checksum
of every page, rebuilds packets from the lacing values (also where a packet
goes on in the next page), separates the logical streams by serial number,
and merges them again by the timestamps that the granule positions give.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches, text_or_empty

UNIT = 576  # bytes, and so samples, of a packet
RATE = 8000  # samples a second, for timestamps
STREAMS = 2
PACKETS_A_PAGE = 32

_HEAD = struct.Struct("<4sBBqIIIB")  # capture pattern, version, flags, granule, serial, sequence, checksum, segments
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    """The bytes are no valid Ogg file."""


def checksum(data: bytes) -> int:
    """Ogg's CRC: polynomial 0x04c11db7, most significant bit first, no inversion.

    It is zlib's CRC over mirrored bytes, mirrored, with zlib's inversions undone.
    """
    crc = zlib.crc32(data.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def lacing(length: int) -> bytes:
    return b"\xff" * (length // 255) + bytes([length % 255])


def write(payload: bytes, serial: int) -> bytes:
    """An Ogg file of ``payload``, whose length must be a positive multiple of 576."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    blocks = len(payload) // UNIT
    out = []
    for k in range(STREAMS):
        head = b"SMPL8\x00\x00\x00" + struct.pack("<III", RATE, UNIT, k)
        out.append(page(serial + k, 0, 0, _FIRST | (_LAST if blocks <= k else 0), lacing(len(head)), head))
    sequence = [1] * STREAMS
    span = PACKETS_A_PAGE * STREAMS
    for start in range(0, blocks, span):
        for k in range(STREAMS):
            mine = range(start + k, min(start + span, blocks), STREAMS)
            if mine:
                body = b"".join(payload[i * UNIT : (i + 1) * UNIT] for i in mine)
                last = mine[-1] + STREAMS >= blocks
                out.append(page(serial + k, sequence[k], (mine[-1] + 1) * UNIT, _LAST if last else 0, lacing(UNIT) * len(mine), body))
                sequence[k] += 1
    return b"".join(out)


def pages(data: bytes):
    """(flags, granule, serial, sequence, lacing, body) of each page, checksums verified."""
    at, end = 0, len(data)
    while at < end:
        if end - at < _HEAD.size:
            raise OggError(f"short page header at byte {at}")
        magic, version, flags, granule, serial, sequence, crc, count = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        laced = data[at + 27 : at + 27 + count]
        stop = at + 27 + count + sum(laced)
        if len(laced) < count or stop > end:
            raise OggError(f"cut off page at byte {at}")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : stop]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        yield flags, granule, serial, sequence, laced, data[at + 27 + count : stop]
        at = stop


def read(data: bytes) -> dict[int, dict]:
    """Logical streams by serial number: packets, and for each its (granule, page) where it ends.

    The granule position of a page belongs to the last packet that ends in it.
    """
    streams: dict[int, dict] = {}
    for flags, granule, serial, sequence, laced, body in pages(data):
        s = streams.get(serial)
        if bool(flags & _FIRST) != (s is None):
            raise OggError(f"stream {serial} begins twice or not at all")
        if s is None:
            s = streams[serial] = {"packets": [], "ends": [], "part": b"", "pages": 0, "open": False, "last": False}
        if sequence != s["pages"] or s["last"]:
            raise OggError(f"stream {serial}: page {sequence} is out of order")
        if bool(flags & _CONTINUED) != s["open"]:
            raise OggError(f"stream {serial}: page {sequence} doesn't continue its packet")
        at = 0
        for n in laced:
            s["part"] += body[at : at + n]
            at += n
            s["open"] = n == 255
            if n < 255:
                s["packets"].append(s["part"])
                s["ends"].append((granule, sequence))
                s["part"] = b""
        s["pages"], s["last"] = s["pages"] + 1, bool(flags & _LAST)
    for serial, s in streams.items():
        if s["open"] or not s["last"]:
            raise OggError(f"stream {serial} has no end")
    return streams


def decode(data: bytes) -> tuple[bytes, dict]:
    """The payload, and what the container says: pages, packets, streams, samples, seconds."""
    timed, page_count, streams = [], 0, read(data)
    for s in streams.values():
        rate, unit, _ = struct.unpack_from("<III", s["packets"][0], 8)
        page_count += s["pages"]
        ends = s["ends"]
        for i in range(1, len(ends)):
            granule, number = ends[i]
            j = i
            while j + 1 < len(ends) and ends[j + 1][1] == number:
                j += 1
            timed.append((granule - (j - i) * unit * len(streams), s["packets"][i]))
    timed.sort(key=lambda x: x[0])
    step = [b - a for (a, _), (b, _) in zip(timed, timed[1:])]
    if any(x != unit for x in step) or timed[0][0] != unit:
        raise OggError("granule positions leave a gap")
    samples = timed[-1][0]
    return b"".join(p for _, p in timed), {"pages": page_count, "packets": len(timed), "streams": len(streams), "samples": samples, "seconds": samples / rate}


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def describe(data: bytes) -> dict:
    payload = padded(data)
    serial = zlib.crc32(payload) & 0xFFFFFFF0  # from the content, so equal texts make equal files
    media = write(payload, serial)
    back, info = decode(media)
    mean = sum(back) / len(back)
    return {
        "n_bytes": len(data),
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-32:]),
        "media_bytes": len(media),
        "media_sha256": hashlib.sha256(media).hexdigest(),
        "feature": f"streams={info['streams']};pages={info['pages']};packets={info['packets']};samples={info['samples']};ms={info['samples'] * 1000 // RATE};mean={mean:.3f};peak={max(back)}",
    }


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_KINDS = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def _describe_batches(batches):
    for b in batches:
        rows = [describe(str(t).encode()) for t in b.column(1)]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0)} | {k: pa.array([r[k] for r in rows], kind) for k, kind in _KINDS.items()})


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, made in one map-only pass; nothing is shuffled.

    A null text counts as empty and becomes one packet of 255s. Ids may be null
    or repeat; every row is described by itself. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(_describe_batches, SCHEMA)


def _media_batches(batches):
    for b in batches:
        media = [write(payload, zlib.crc32(payload) & 0xFFFFFFF0) for payload in (padded(str(t).encode()) for t in b.column(1))]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "media": pa.array(media, pa.binary())})


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the Ogg file itself, as a binary column."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    return rows.mapInArrow(_media_batches, "doc_id long, media binary")


def _text_batches(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "payload": pa.array([decode(m)[0] for m in b.column(1).to_pylist()], pa.binary())})


def from_media(media: DataFrame) -> DataFrame:
    """doc_id and payload of each Ogg file; a damaged file raises OggError."""
    return media.select("doc_id", "media").mapInArrow(_text_batches, "doc_id long, payload binary")


def op10_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(documents(spark, sf_dir))
