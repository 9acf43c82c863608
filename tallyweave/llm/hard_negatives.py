"""Hard negatives by dual-tree search, exact.

Two trees over vectors of whole numbers, one of the anchors and one of all rows.
A routing tree, fitted on a bounded sample, puts every row in a leaf; rows in the
order of leaves are cut into blocks of a fixed size, and blocks, by sixteens, into
nodes up to one root. A node holds a box, a ball and the labels of its rows, all
taken over its rows and not from the sample.

A search starts at the pair of roots and goes down both trees, a join a level. The
box and the ball bound the inner products between two nodes from both sides; a pair
goes when no anchor of its group can use a score in that interval, or when its labels
rule it out. Pairs of blocks that are left are scored exactly by a matrix product.
What an anchor can still use follows from a bounded set of witnesses, rows which all
anchors are scored against beforehand: the k-th best of them bounds the k-th best of
all from below.

Nothing is collected but the sample. A block is in one row, so tasks hold a pair of
blocks at a time, and a label or a vector that a third of the rows share is many
blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH, keep, shuffle_parts

SAMPLE = 4096  # rows that fit the routing tree; half of them are the witnesses
LEAF = 32  # sampled rows in a leaf of the routing tree
BLOCK, ANCHORS = 1024, 128  # rows in a block of either tree
FAN = 16
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # a negative's score lies between these hundredths of its positive's
LAST = 9223372036854775807
NEVER = -(1 << 62)
BLOCKS = "block long, n int, lo binary, hi binary, mid binary, radius double, labels long, least long, most long, ids binary, rows binary, label binary, vectors binary, want binary"
NODES = "node long, n int, lo binary, hi binary, mid binary, radius double, labels long, least long, most long"


def _table(rows: list[dict], like: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_pydict({name: pa.array([r[name] for r in rows], kinds[kind]) for name, kind in (x.split() for x in like.split(", "))})


def _fit(sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A heap of splits (directions and borders): each halves its part of the sample along its widest direction."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(sample) / LEAF)))))
    ways, borders = np.zeros((1 << depth, sample.shape[1])), np.zeros(1 << depth)

    def split(at: int, part: np.ndarray, left: int) -> None:
        if not left or len(part) < 2:
            return
        centred = part - part.mean(0)
        way = centred[np.argmax((centred**2).sum(1))]
        for _ in range(8):
            way = centred.T @ (centred @ way)
            way = way / (np.linalg.norm(way) or 1)
        along = part @ way
        ways[at], borders[at] = way, np.median(along)
        split(2 * at, part[along <= borders[at]], left - 1)
        split(2 * at + 1, part[along > borders[at]], left - 1)

    split(1, sample, depth)
    return ways, borders


def _routed(tree: tuple[np.ndarray, np.ndarray], width: int):
    ways, borders = tree
    depth = len(borders).bit_length() - 1

    def run(batches):
        for b in batches:
            v = _padded(b.column("vec"), width).astype(float)
            at, along = np.ones(len(v), np.int64), np.zeros(len(v))
            for _ in range(depth):
                along = (v * ways[at]).sum(1)
                at = 2 * at + (along > borders[at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(along)], [*b.schema.names, "leaf", "along"])

    return run


def _padded(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; what a shorter one lacks is 0."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _bits(labels: np.ndarray) -> np.ndarray:
    """One bit of 62 for each label; labels may share one."""
    return np.int64(1) << ((labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % 62


def _blocks(size: int, width: int):
    """Blocks of consecutive rows. ``least`` and ``most`` are filled in for anchors later."""

    def run(batches):
        held, count, nth = [], 0, 0

        def packed(part: pa.Table) -> dict:
            part = part.combine_chunks()
            v = _padded(part.column("vec").combine_chunks(), width)
            mid = v.mean(0)
            label = part.column("label").to_numpy()
            return {
                "block": nth, "n": len(v), "lo": v.min(0).tobytes(), "hi": v.max(0).tobytes(), "mid": mid.tobytes(), "radius": float(np.sqrt(((v - mid) ** 2).sum(1)).max()) * (1 + 1e-9), "labels": int(np.bitwise_or.reduce(_bits(label))), "least": NEVER, "most": -NEVER,
                "ids": part.column("ord").to_numpy().tobytes(), "rows": part.column("row").to_numpy().tobytes(), "label": label.tobytes(), "vectors": v.astype(np.int32).tobytes(), "want": b"",
            }

        for b in batches:
            held.append(b.select(["ord", "row", "label", "vec"]))
            count += b.num_rows
            if count >= size:
                table = pa.Table.from_batches(held)
                for at in range(0, count - size + 1, size):
                    yield _table([packed(table.slice(at, size))], BLOCKS)
                    nth += 1
                held, count = table.slice(count - count % size).to_batches(), count % size
        if count:
            yield _table([packed(pa.Table.from_batches(held))], BLOCKS)

    return run


def _ordered(rows: DataFrame, size: int, width: int, count: int) -> DataFrame:
    """Blocks numbered from 0 in the order of the leaves, written."""
    parts = min(shuffle_parts(rows.sparkSession), max(1, count // (4 * size)))
    dealt = rows.repartitionByRange(parts, "leaf", "along", F.xxhash64("row")).sortWithinPartitions("leaf", "along", F.xxhash64("row"))
    dealt = dealt.coalesce(parts)  # neighbouring ranges, where the session deals more of them
    blocks = keep(dealt.mapInArrow(_blocks(size, width), BLOCKS).withColumn("part", F.spark_partition_id()))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = F.broadcast(blocks.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))  # a row for each range
    return blocks.join(starts, "part").withColumn("block", F.col("block") + F.col("start")).drop("part", "start")


def _parents(width: int):
    def run(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind).reshape(-1, width)
        n, mids = table.column("n").to_numpy(), read("mid", float)
        mid = (mids * n[:, None]).sum(0) / n.sum()
        radius = np.sqrt(((mids - mid) ** 2).sum(1)) + table.column("radius").to_numpy()
        row = {"node": table.column("parent")[0].as_py(), "n": int(min(n.sum(), 2**31 - 1)), "lo": read("lo", np.int64).min(0).tobytes(), "hi": read("hi", np.int64).max(0).tobytes(), "mid": mid.tobytes(), "radius": float(radius.max()) * (1 + 1e-9)}
        row |= {"labels": int(np.bitwise_or.reduce(table.column("labels").to_numpy())), "least": min(table.column("least").to_pylist()), "most": max(table.column("most").to_pylist())}
        return pa.Table.from_batches([_table([row], NODES)])

    return run


def _levels(blocks: DataFrame, width: int) -> list[DataFrame]:
    """Node tables from the blocks up to the root."""
    out = [blocks.select(F.col("block").alias("node"), *NODES.replace(" long", "").replace(" int", "").replace(" binary", "").replace(" double", "").split(", ")[1:])]
    top = blocks.agg(F.max("block")).first()[0] or 0
    while top:
        out.append(keep(out[-1].withColumn("parent", F.expr(f"node div {FAN}")).groupBy("parent").applyInArrow(_parents(width), NODES)))
        top //= FAN
    return out


def _useful(same: bool, width: int, distinct_bits: bool):
    """Pairs of nodes that may hold a pair that some anchor of the group can use."""

    def run(batches):
        for b in batches:
            read = lambda c, kind: np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(-1, width).astype(float)
            num = lambda c: b.column(c).to_numpy()
            al, ah, cl, ch, am, cm = read("a_lo", np.int64), read("a_hi", np.int64), read("c_lo", np.int64), read("c_hi", np.int64), read("a_mid", float), read("c_mid", float)
            corners = np.stack([al * cl, al * ch, ah * cl, ah * ch])
            low, high = corners.min(0).sum(1), corners.max(0).sum(1)
            ar, cr = num("a_radius"), num("c_radius")
            middle, off = (am * cm).sum(1), np.sqrt((am**2).sum(1)) * cr + np.sqrt((cm**2).sum(1)) * ar + ar * cr
            slack = 1 + 1e-9 * (np.abs(middle) + off)
            low, high = np.maximum(low, middle - off - slack), np.minimum(high, middle + off + slack)
            la, lc = num("a_labels"), num("c_labels")
            one = ((la & (la - 1)) == 0) & (la == lc)
            use = (high >= num("a_least")) & (low <= num("a_most")) & ((la & lc) != 0 if same else ~one | (not distinct_bits))
            yield pa.RecordBatch.from_pydict({"a": b.column("a").filter(pa.array(use)), "c": b.column("c").filter(pa.array(use))})

    return run


def traverse(anchors: list[DataFrame], rows: list[DataFrame], same: bool, width: int, distinct_bits: bool) -> DataFrame:
    """Pairs of blocks (a, c) that no bound ruled out. ``distinct_bits``: no two labels share a bit, so one bit is one label."""
    spark = rows[0].sparkSession
    pairs, up_a, up_c = spark.createDataFrame([(0, 0)], "a long, c long"), len(anchors) - 1, len(rows) - 1
    stats = ("lo", "hi", "mid", "radius", "labels")
    while True:
        a = anchors[up_a].select(F.col("node").alias("a"), *[F.col(c).alias(f"a_{c}") for c in (*stats, "least", "most")])
        c = rows[up_c].select(F.col("node").alias("c"), *[F.col(x).alias(f"c_{x}") for x in stats])
        looked = pairs.join(a.hint("merge"), "a").join(c.hint("merge"), "c")
        pairs = keep(looked.mapInArrow(_useful(same, width, distinct_bits), "a long, c long"))
        if not up_a and not up_c:
            return pairs
        down_a, down_c = up_a >= up_c, up_c >= up_a
        for name, level, down in (("a", anchors[up_a - 1] if down_a else None, down_a), ("c", rows[up_c - 1] if down_c else None, down_c)):
            if down:
                children = level.select(F.col("node").alias("child"), F.expr(f"node div {FAN}").alias(name))
                pairs = pairs.join(children.hint("merge"), name).drop(name).withColumnRenamed("child", name)
        up_a, up_c = up_a - down_a, up_c - down_c


def _scores(a: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    return (a.astype(float) @ c.astype(float).T).astype(np.int64) if exact else a.astype(np.int64) @ c.astype(np.int64).T


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Where the first k of each group stand: by score from the top, then by id and row."""
    order = np.lexsort((rows, ids, -score, group))
    starts = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]]) if len(order) else np.zeros(0, np.int64)
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[nth < k]


FOUND = "anchor long, slot int, score long, ord long, row long"


def _leaf_pairs(same: bool, width: int, exact: bool, k: int):
    """Exact scores of pairs of blocks; of each anchor (and positive), the first k that it can use."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                get = lambda c, kind=np.int64: np.frombuffer(b.column(c)[i].as_py(), kind)  # noqa: B023, E731
                score = _scores(get("a_vectors", np.int32).reshape(-1, width), get("c_vectors", np.int32).reshape(-1, width), exact)
                label_a, label_c, row_a, row_c, id_c = get("a_label"), get("c_label"), get("a_rows"), get("c_rows"), get("c_ids")
                want = get("a_want").reshape(len(row_a), -1, 2)
                fits = (label_a[:, None] == label_c) & (row_a[:, None] != row_c) if same else label_a[:, None] != label_c
                for slot in range(want.shape[1]):
                    x, y = np.nonzero(fits & (score >= want[:, slot, :1]) & (score <= want[:, slot, 1:]))
                    best = _first(x, score[x, y], id_c[y], row_c[y], k)
                    x, y = x[best], y[best]
                    if len(x):
                        yield pa.RecordBatch.from_arrays([pa.array(row_a[x]), pa.array(np.full(len(x), slot, np.int32)), pa.array(score[x, y]), pa.array(id_c[y]), pa.array(row_c[y])], ["anchor", "slot", "score", "ord", "row"])

    return run


def _wanted(same: bool, width: int, exact: bool, k: int, witness: tuple[np.ndarray, ...], slots: int):
    """Anchor blocks with the interval of scores that each anchor (and positive) can use.

    Its lower end is the k-th best witness in the interval, or the end of the interval.
    For positives the interval is open; for negatives it follows from ``held``, the scores of the positives.
    """
    vectors, labels, rows = witness

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                v, label, row = np.frombuffer(r["vectors"], np.int32).reshape(-1, width), np.frombuffer(r["label"], np.int64), np.frombuffer(r["rows"], np.int64)
                want = np.full((len(v), slots, 2), [NEVER, -NEVER], np.int64)
                if not same:
                    want[:, :] = [1, 0]  # an anchor with fewer positives: nothing fits
                    at = {x: i for i, x in enumerate(row.tolist())}
                    for x in r.pop("held") or []:
                        want[at[x["anchor"]], x["slot"]] = [-(-LOW * x["score"] // 100), HIGH * x["score"] // 100]
                score = _scores(v, vectors, exact)
                fits = (label[:, None] == labels) & (row[:, None] != rows) if same else label[:, None] != labels
                for slot in range(slots):
                    if len(vectors) >= k:
                        within = np.where(fits & (score >= want[:, slot, :1]) & (score <= want[:, slot, 1:]), score, NEVER)
                        want[:, slot, 0] = np.maximum(want[:, slot, 0], np.partition(within, len(vectors) - k, 1)[:, len(vectors) - k])
                some = want[:, :, 0] <= want[:, :, 1]
                r |= {"want": want.tobytes(), "least": int(want[:, :, 0][some].min()) if some.any() else -NEVER, "most": int(want[:, :, 1][some].max()) if some.any() else NEVER}
                out.append(r)
            yield _table(out, BLOCKS)

    return run


def _places(batches):
    """Which anchors a block holds."""
    for b in batches:
        for block, rows in zip(b.column("block").to_pylist(), b.column("rows").to_pylist()):
            anchors = np.frombuffer(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchors), block)), pa.array(anchors)], ["block", "anchor"])


def _search(anchors: DataFrame, blocks: DataFrame, levels: list[DataFrame], same: bool, width: int, exact: bool, k: int, distinct_bits: bool) -> DataFrame:
    pairs = traverse(_levels(anchors, width), levels, same, width, distinct_bits)
    a = anchors.select(F.col("block").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("rows", "label", "vectors", "want")])
    c = blocks.select(F.col("block").alias("c"), *[F.col(x).alias(f"c_{x}") for x in ("ids", "rows", "label", "vectors")])
    found = pairs.join(a.hint("merge"), "a").join(c.hint("merge"), "c").mapInArrow(_leaf_pairs(same, width, exact, k), FOUND)
    nth = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "ord", "row"))
    return keep(found.withColumn("rank", nth).where(F.col("rank") <= k))


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: id long, label long, vec array<long>; ``is_anchor`` is a condition on
    them. Rows with a null label, vector or component take no part. Scores are inner
    products; higher ones come first, ties by smaller id, null ids last, and rows that
    share an id stand in an order of their own. A positive is one of the anchor's first
    ``positives`` other rows of its label, a negative one of the first ``negatives``
    rows of other labels whose score is 50 to 95 % of the positive's. Rows that repeat
    an id are rows of their own. What a shorter vector lacks counts as 0. An anchor
    without positives or negatives gives no rows; nor does an empty table. Sums of
    products must stay below 2**56, else ValueError. Other columns are not looked at.
    """
    spark = rows.sparkSession
    known = rows.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    known = known.select(F.col("id").alias("given"), F.coalesce("id", F.lit(LAST)).alias("ord"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<bigint>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row"))
    known = keep(known)
    size = F.greatest(F.abs(F.coalesce(F.array_max("vec"), F.lit(0))), F.abs(F.coalesce(F.array_min("vec"), F.lit(0))))
    count, marked, width, most = known.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    width = max(width, 1)
    if width * most**2 >= 1 << 56:
        raise ValueError(f"components up to {most} are too large for exact scores")
    exact = width * most**2 < 1 << 53  # sums of whole numbers below this are exact as doubles
    labels = [r[0] for r in known.select("label").distinct().limit(64).collect()]  # at most 64
    distinct_bits = len(labels) < 64 and len(set(_bits(np.array(labels, np.int64)).tolist())) == len(labels)
    sample = known.orderBy(F.xxhash64("row", F.lit(3))).limit(SAMPLE).select("vec", "label", "row").toArrow().combine_chunks()
    vectors = _padded(sample.column("vec").combine_chunks(), width) if len(sample) else np.zeros((0, width), np.int64)
    half = len(vectors) // 2 + 1
    witness = (vectors[:half], sample.column("label").to_numpy()[:half], sample.column("row").to_numpy()[:half])
    routed = known.mapInArrow(_routed(_fit(vectors.astype(float)), width), "given long, ord long, label long, vec array<long>, anchor boolean, row long, leaf long, along double")
    before = spark.conf.get(BATCH)
    blocks = _ordered(routed, BLOCK, width, count)
    own = _ordered(routed.where("anchor"), ANCHORS, width, marked)
    levels = _levels(blocks, width)
    spark.conf.set(BATCH, "64")  # a row holds a block or two
    try:
        open_ = keep(own.mapInArrow(_wanted(True, width, exact, positives, witness, 1), BLOCKS))
        near = _search(open_, blocks, levels, True, width, exact, positives, distinct_bits)
        held = near.select("anchor", (F.col("rank") - 1).alias("slot"), "score")
        place = known.where("anchor").select(F.col("row").alias("anchor"))
        where = own.select("block", "rows").mapInArrow(_places, "block long, anchor long")
        held = held.join(place, "anchor").join(where.hint("merge"), "anchor").groupBy("block").agg(F.collect_list(F.struct("anchor", "slot", "score")).alias("held"))
        asked = keep(own.join(held.hint("merge"), "block").mapInArrow(_wanted(False, width, exact, negatives, witness, positives), BLOCKS))
        far = _search(asked, blocks, levels, False, width, exact, negatives, distinct_bits)
    finally:
        spark.conf.set(BATCH, before)
    ids = known.select(F.col("row"), F.col("given"))
    named = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"), F.when(F.col("ord") < LAST, F.col("ord")).alias("positive_id"))
    out = far.select("anchor", "slot", "rank", F.col("score").alias("negative_score"), F.when(F.col("ord") < LAST, F.col("ord")).alias("negative_id")).join(named.hint("merge"), ["anchor", "slot"]).join(ids.withColumnRenamed("row", "anchor").hint("merge"), "anchor")
    return out.select(F.col("given").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_vectors(table: DataFrame) -> DataFrame:
    """``embeddings`` as id, label and whole components; every seventh id has a label that is off by one, as noise in the labels."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    return table.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(~odd).select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), whole.alias("vec"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
