"""N-gram Jaccard self-join by signature trees.

A document's set of word shingles is one leaf of a signature tree: a token
bitmap and a size. Inner nodes hold the OR of their bitmaps and the range of
sizes. Two trees are traversed together, and a pair of nodes is dropped when
no pair of sets below it can overlap enough: their sizes are too far apart, or
the bits they share, plus the tokens that share bits, are too few.

The forest's top level is dealt by Spark. Sets with a Jaccard similarity of t
share one of their first n - ceil(t n) + 1 shingles in any common order
(here: rarest first, by a counting sketch), so each such shingle is the root of
a tree over the sets that have it in front; shingles of one set alone are
dropped by Bloom filters, one for each slice of the shingles, before sets are grouped
(with one slice before any shuffle, else shingles are dealt by slice once). Below a
root, sets are sorted by size and cut into blocks of at most BLOCK leaves; tasks traverse pairs of
blocks, so no task holds more than two. Roots with the same sets below them are
searched once.

Round one traverses each block with itself and verifies, for every leaf, its
most promising partners: that joins large groups of near copies into few
components at a linear cost. Round two traverses all pairs of blocks of all
roots under which more than one component is left and verifies every pair of
leaves of different components that the bounds let through. So no link between
components is lost, and no pair inside a known component is looked at again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, documents, keep, shuffle_parts, small_batches, text_or_empty
from .components import components
from .exact_dedup import MAX_FILTER_MB, keep_sliced, maybe_repeated, repeated_filter, slices_for, split_repeated
from .substring_dedup import mix, names_of, window_hashes

BLOCK = 512
FANOUT = 8
SKETCH_BITS = 18
LAST = 9223372036854775807


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; fewer words make one shingle."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone splits
    names = names_of(words)
    if len(names) >= size:
        return np.unique(window_hashes(names, size))
    if not len(names):
        return names
    whole = np.full(1, len(names), np.uint64)
    for i in range(len(names)):
        whole = mix(whole, names[i : i + 1])
    return whole


def bitmap(tokens: np.ndarray, a_token: int = 1) -> np.ndarray:
    """About ``a_token`` bits a token, from 64 to 8192 times that; wider ones fold to narrower."""
    width = a_token * min(8192, max(64, 1 << (3 * len(tokens) // 4).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(tokens & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def _slices(batches, rows: int = 500):
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


_PART = 4096
OUTLINE = "doc_id long, ord long, node long, check long, n long, bits binary, wide binary, part int, counts binary"
MOST_TWINS = 1_000_000  # nodes that different sets share; at 5e10 sets some seventy are expected
WIDE = 8  # bits a token where round two compares all pairs of blocks


def _hash(tokens: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed) - (1 << 63)


def _node(tokens: np.ndarray, twins: frozenset[int] = frozenset()) -> int | None:
    """The name of a set: a hash, or for the few hashes that different sets share a second one."""
    if not len(tokens):
        return None
    name = _hash(tokens, 0)
    return _hash(tokens, 1) if name in twins else name


def _outline(size: int):
    """A row per document without its tokens, and at the end the task's share of the counting sketch."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in _slices(batches):
            sets = [shingles(t, size) for t in part.column(2).to_pylist()]
            if sets:
                counts += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column(0),
                    "ord": part.column(1),
                    "node": pa.array([_node(s) for s in sets], pa.int64()),
                    "check": pa.array([_hash(s, 1) if len(s) else None for s in sets], pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "bits": pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    "wide": pa.array([bitmap(s, WIDE).tobytes() if len(s) else None for s in sets], pa.binary()),
                    "part": none.cast(pa.int32()),
                    "counts": none.cast(pa.binary()),
                }
            )
        if counts.any():
            cut = counts.reshape(-1, _PART)
            null = lambda kind: pa.nulls(len(cut), kind)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": null(pa.int64()),
                    "ord": null(pa.int64()),
                    "node": null(pa.int64()),
                    "check": null(pa.int64()),
                    "n": null(pa.int64()),
                    "bits": null(pa.binary()),
                    "wide": null(pa.binary()),
                    "part": pa.array(range(len(cut)), pa.int32()),
                    "counts": pa.array([c.astype("<u4").tobytes() for c in cut], pa.binary()),
                }
            )

    return run


def _sketch_sum(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, "<u4").astype(np.int64)
    yield pa.RecordBatch.from_pydict({"part": pa.array(list(sums), pa.int32()), "counts": pa.array([np.minimum(s, 2**32 - 1).astype("<u4").tobytes() for s in sums.values()], pa.binary())})


def frequency_sketch(outline: DataFrame) -> np.ndarray:
    """Counts of hashed shingles over all documents: 2**18 numbers, 1 MB at any corpus size."""
    parts = shuffle_parts(outline.sparkSession)
    summed = outline.where("part is not null").select("part", "counts").repartition(parts, "part").mapInArrow(_sketch_sum, "part int, counts binary").toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for part, counts in zip(summed["part"].to_pylist(), summed["counts"].to_pylist()):
        out[part * _PART : (part + 1) * _PART] = np.frombuffer(counts, "<u4")
    return out


def _front(sketch, twins, size: int, num: int, den: int):
    """The rarest-first front of each document's set: key, node, n, index.

    ``index``: the shingle may be the first that the set shares with a set as
    large or larger (then what is left after it still reaches the overlap).
    """

    def run(batches):
        for part in _slices(batches):
            keys, nodes, sizes, index = [], [], [], []
            for text in part.column(0).to_pylist():
                t = shingles(text, size)
                n = len(t)
                if not n:
                    continue
                node, front = _node(t, twins.value), n - -(-num * n // den) + 1
                count = sketch.value[(t >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                if front < n:
                    edge = np.partition(count, front - 1)[front - 1]
                    some = np.flatnonzero(count <= edge)
                    t = t[some[np.lexsort((t[some], count[some]))[:front]]]
                else:
                    t = t[np.lexsort((t, count))]
                index.append((n - np.arange(len(t))) * (num + den) >= 2 * num * n)
                keys.append(t)
                nodes.append(node)
                sizes.append(n)
            times = [len(k) for k in keys]
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(np.repeat(np.array(nodes, np.int64), times)), pa.array(np.repeat(np.array(sizes, np.int64), times)), pa.array(np.concatenate(index) if index else np.zeros(0, bool))],
                ["key", "node", "n", "index"],
            )

    return run


def _tokens(twins, size: int):
    def run(batches):
        for part in _slices(batches):
            sets = [shingles(t, size) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_node(s, twins.value) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["ord", "node", "tokens"])

    return run


class Tree:
    """A signature tree over leaves sorted by size; levels[0] are the leaves, the last is the root."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
        self.levels = [(bits, sizes, sizes, sizes - ones)]  # bitmap, smallest, largest, most tokens that share bits
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))


def _overlap(a, b, i, j) -> np.ndarray:
    """The largest overlap that any two sets below nodes i and j can have."""
    shared = np.empty(len(i), np.int64)
    for s in range(0, len(i), 20_000):
        c = slice(s, s + 20_000)
        shared[c] = np.bitwise_count(a[0][i[c]] & b[0][j[c]]).sum(axis=1)
    return np.minimum(np.minimum(a[2][i], b[2][j]), shared + np.minimum(a[3][i], b[3][j]))


def traverse(a: Tree, b: Tree, num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of leaves (i < j if the trees are the same) that may link, with the bound of their overlap."""
    depth = max(len(a.levels), len(b.levels))
    i = j = np.zeros(1, np.int64)
    bound = np.zeros(1, np.int64)
    for level in range(depth - 1, -1, -1):
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        x, y = a.levels[la], b.levels[lb]
        if level < depth - 1:
            down_a, down_b = level < len(a.levels) - 1, level < len(b.levels) - 1
            steps_a, steps_b = (np.arange(FANOUT if d else 1) for d in (down_a, down_b))
            i = np.repeat((i * (FANOUT if down_a else 1))[:, None] + steps_a, len(steps_b), axis=1).ravel()
            j = np.tile((j * (FANOUT if down_b else 1))[:, None] + steps_b, (1, len(steps_a))).ravel()
            ok = (i < len(x[1])) & (j < len(y[1]))
            if same:
                ok &= i <= j
            i, j = i[ok], j[ok]
        # Sizes: den * smaller >= num * larger must be possible.
        ok = (den * x[2][i] >= num * y[1][j]) & (den * y[2][j] >= num * x[1][i])
        i, j = i[ok], j[ok]
        bound = _overlap(x, y, i, j)
        # den * overlap >= num * (n + m - overlap) for the smallest n and m below.
        ok = (den + num) * bound >= num * (x[1][i] + y[1][j])
        i, j, bound = i[ok], j[ok], bound[ok]
    if same:
        ok = i < j
        i, j, bound = i[ok], j[ok], bound[ok]
    return i, j, bound


def _folded(raws: list[bytes], width: int | None = None) -> np.ndarray:
    width = width or min(map(len, raws))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(r, np.uint8).reshape(-1, width), axis=0) for r in raws]).view("<u8")


def block_pairs(size: np.ndarray, raws: list[bytes], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) of leaves that may link, with the slack of their bound.

    ``left`` and ``right`` are the same leaves (then i is before j) or disjoint.
    Leaves of one bitmap width make a tree; sets that can link have equal or
    neighbouring widths, and fold to the narrower of the two.
    """
    same = left is right
    widths = np.array([len(r) for r in raws])
    out = []
    for wl in np.unique(widths[left]):
        for wr in np.unique(widths[right]):
            if wr not in (wl // 2, wl, wl * 2) or (same and wr < wl):
                continue
            li, ri, w = left[widths[left] == wl], right[widths[right] == wr], min(wl, wr)
            one = Tree(size[li], _folded([raws[k] for k in li], w))
            alike = same and wl == wr
            i, j, bound = traverse(one, one if alike else Tree(size[ri], _folded([raws[k] for k in ri], w)), num, den, alike)
            out.append((li[i], ri[j], bound * (num + den) - num * (size[li[i]] + size[ri[j]])))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (none, none, none)


def _pairs(left, right, roots=None) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    columns = [pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())]
    if roots is None:
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(roots) if roots else np.zeros(0, np.int64), pa.int64())], ["a", "b", "key"])


def _round_one(num: int, den: int):
    """Rows sorted by (key, n, node): key, node, n, bits. Blocks of at most BLOCK leaves of a key."""

    def run(batches):
        key, rows, left, right, roots, found = None, [], [], [], [], 0

        def block():
            if len(rows) < 2:
                return 0
            node = np.array([r[0] for r in rows], np.int64)
            every = np.arange(len(rows))
            i, j, slack = block_pairs(np.array([r[1] for r in rows], np.int64), [r[2] for r in rows], every, every, num, den)
            if not len(i):
                return 0
            for order in (np.lexsort((i, -slack, j)), np.lexsort((i, j))):  # the most promising partner, and the first
                pick = order[np.r_[True, j[order][1:] != j[order][:-1]]]
                left.append(node[i[pick]])
                right.append(node[j[pick]])
                roots.append(np.full(len(pick), key, np.int64))
            return 2 * len(pick)

        for b in batches:
            for k, node, n, bits in zip(*(b.column(c).to_pylist() for c in range(4))):
                if k != key or len(rows) >= BLOCK:
                    found += block()
                    key, rows = k, []
                rows.append((node, n, bits))
            if found > 50_000:
                yield _pairs(left, right, roots)
                left, right, roots, found = [], [], [], 0
        block()
        yield _pairs(left, right, roots)

    return run


def _round_two(num: int, den: int):
    """Rows sorted by (key, i, j, chunk): key, i, j, chunk, node, n, wide, root."""

    def run(batches):
        current, rows, left, right, found = None, [], [], [], 0

        def block():
            if len(rows) < 2:
                return 0
            node, size, root = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 4))
            chunk, every = np.array([r[0] for r in rows]), np.arange(len(rows))
            first = chunk == chunk[0]
            one = every if first.all() else every[first]
            i, j, _ = block_pairs(size, [r[3] for r in rows], one, one if first.all() else every[~first], num, den)
            ok = root[i] != root[j]
            left.append(node[i[ok]])
            right.append(node[j[ok]])
            return int(ok.sum())

        for b in batches:
            for k, bi, bj, *rest in zip(*(b.column(c).to_pylist() for c in range(8))):
                if (k, bi, bj) != current:
                    found += block()
                    current, rows = (k, bi, bj), []
                    if found > 50_000:
                        yield _pairs(left, right)
                        left, right, found = [], [], 0
                rows.append(rest)
        block()
        yield _pairs(left, right)

    return run


def _links(num: int, den: int):
    """Of rows a, b, tokens of a, tokens of b: the pairs that link."""

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, t = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(den * common >= num * (len(s) + len(t) - common))
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def verified(pairs: DataFrame, tokens: DataFrame, num: int, den: int) -> DataFrame:
    left = tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(_links(num, den), "a long, b long")


def distinct_roots(held: DataFrame) -> DataFrame:
    """Of the roots with the same sets below them, whose trees would be the same, one: rows key, node, n.

    A passage shared by some sets is a root for each of its shingles, all over
    these same sets. Members are compared by their number and 128 hashed bits.
    """
    mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    members = held.groupBy("key").agg(F.count(F.lit(1)).alias("c"), mark(0).alias("x"), mark(1).alias("y"))
    first = members.groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")
    return held.join(first.hint("merge"), "key", "left_semi").select("key", "node", "n")


def jaccard_groups(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", max_filter_mb: float = MAX_FILTER_MB) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, leader.

    Two documents link when den * |intersection| >= num * |union|. A component's
    id is the smallest doc_id in it. ``leader`` marks the rows with that id.
    Documents without words (or null texts) link with nothing. A null id counts
    as the largest. Rows that repeat an id are documents of their own. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = shuffle_parts(spark)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("ord"), text_or_empty(docs[text_col]).alias("text"))
    outline = keep(rows.mapInArrow(_outline(shingle), OUTLINE))
    sketch = spark.sparkContext.broadcast(frequency_sketch(outline))
    sets = outline.where("part is null")
    some = sets.where("n > 0")
    # Each distinct set once, with the first document that has it. Sets are told apart by two
    # 64-bit hashes: where sets share the first, they go by the second.
    shared = keep(some.groupBy("node").agg(F.min("check").alias("c0"), F.max("check").alias("c1")).where("c0 < c1").select("node"))
    twins = [r["node"] for r in shared.limit(MOST_TWINS + 1).collect()]
    if len(twins) > MOST_TWINS:
        raise RuntimeError(f"more than {MOST_TWINS} names are shared by different sets")
    if twins:
        renamed = sets.join(F.broadcast(shared.withColumn("twin", F.lit(True))), "node", "left")  # at most MOST_TWINS rows
        sets = keep(renamed.withColumn("node", F.when(F.col("twin"), F.col("check")).otherwise(F.col("node"))).drop("twin"))
        some = sets.where("n > 0")
    twins = spark.sparkContext.broadcast(frozenset(twins))
    by_node = keep(some.groupBy("node").agg(F.min("ord").alias("ord"), F.first("bits").alias("bits"), F.first("wide").alias("wide")))
    fronts = some.agg(F.coalesce(F.sum(F.expr(f"n - ceil({num} * n / {den}) + 1")), F.lit(0)).cast("bigint")).first()[0]
    sets = keep(sets.select("doc_id", "ord", "node", "n"))
    discard(outline)
    slices = slices_for(fronts, max_filter_mb)
    front = keep_sliced(rows.select("text").mapInArrow(_front(sketch, twins, shingle, num, den), "key long, node long, n long, index boolean"), "key", slices)
    listed = split_repeated(front, "key", slices, max_filter_mb).where("again").drop("again").distinct()
    # Under a root, a set stays if some set near enough in size could link with it there: the
    # smaller of the two must hold the shingle in its index. The nearest such sets decide.
    by_size = W.partitionBy("key").orderBy("n")
    up = F.lead("n").over(W.partitionBy("key").orderBy("n", "node"))
    indexed = F.when(F.col("index"), F.col("n"))
    down = F.max(indexed).over(W.partitionBy("key").orderBy("n", "node").rowsBetween(W.unboundedPreceding, -1))
    peer = F.max(indexed).over(by_size.rangeBetween(0, 0))
    peers = F.count(F.lit(1)).over(by_size.rangeBetween(0, 0))
    near_size = lambda small, large: F.coalesce(F.col(small) * den >= F.col(large) * num, F.lit(False))
    held = keep(
        listed.withColumns({"up": up, "down": down, "peer": peer, "peers": peers})
        .where((F.col("index") & near_size("n", "up")) | near_size("down", "n") | ((F.col("peers") > 1) & F.col("peer").isNotNull()))
        .select("key", "node", "n")
    )
    discard(front)
    listed, held = held, keep(distinct_roots(held))
    discard(listed)

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link. Their documents are read again, picked by a Bloom filter and a join; equal nodes are equal sets."""
        nodes = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(by_node.select("node", "ord").hint("merge"), "node"))
        wanted = maybe_repeated(spark, repeated_filter(nodes, "ord", nodes.count(), least=1))
        read = rows.select("ord", "text").where(wanted("ord")).mapInArrow(_tokens(twins, shingle), "ord long, node long, tokens binary")
        tokens = keep(read.join(nodes.hint("merge"), ["ord", "node"]).select("node", "tokens").dropDuplicates(["node"]))
        out = keep(verified(pairs, tokens, num, den))
        discard(tokens)
        return out

    leaves = held.join(by_node.select("node", "bits").hint("merge"), "node").select("key", "node", "n", "bits")
    near = leaves.repartition(parts, "key").sortWithinPartitions("key", "n", "node").mapInArrow(_round_one(num, den), "a long, b long, key long")
    met = keep(near)
    near = keep(met.select("a", "b").distinct())
    links = linked(near)
    roots = keep(components(links))

    rooted = held.join(roots.hint("merge"), "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    # A root whose one block let no pair through has been searched in full.
    unsearched = held.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(f"c > {BLOCK}").select("key")
    mixed = mixed.join(met.select("key").unionByName(unsearched).distinct().hint("merge"), "key")
    open_ = rooted.join(mixed.hint("merge"), "key").withColumn("chunk", F.expr(f"cast((row_number() over (partition by key order by n, node) - 1) div {BLOCK} as int)"))
    open_ = keep(open_)
    discard(held)
    discard(met)
    chunks = open_.groupBy("key", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = chunks.select("key", F.col("chunk").alias("j"), F.col("low").alias("low2"))
    # Blocks whose sizes are too far apart never meet; chunks are in order of size.
    meet = keep(chunks.withColumnRenamed("chunk", "i").join(other.hint("merge"), "key").where(f"i <= j and {den} * high >= {num} * low2").select("key", "i", "j"))
    sides = meet.select("key", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
    blocks = open_.join(sides.hint("merge"), ["key", "chunk"]).join(by_node.select("node", "wide").hint("merge"), "node").select("key", "i", "j", "chunk", "node", "n", "wide", "root")
    far = blocks.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "chunk", "n", "node").mapInArrow(_round_two(num, den), "a long, b long")
    far = keep(far.distinct())
    for done in (open_, meet):
        discard(done)
    more = linked(far)
    # Only links between components are new; they join roots.
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c)).hint("merge")
    over = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = keep(components(over))
    final = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = tops.join(roots.select("node").hint("merge"), "node", "left_anti").select("node", "root")
    final = final.unionByName(alone)

    placed = sets.select("doc_id", "ord", "node", "n").join(final.hint("merge"), "node", "left").select("doc_id", "ord", "n", F.coalesce("root", "node").alias("root"))
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("ord").alias("least"))
    out = placed.join(smallest.hint("merge"), "root", "left").withColumn("least", F.coalesce("least", "ord"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("least") < LAST, F.col("least")).alias("component_id"), (F.col("least") == F.col("ord")).alias("leader"))


def one_of_each(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, that with the smallest id, all columns kept.

    Rows that repeat an id are documents of their own, a null id counts as the
    largest; between equal ids the row's content decides. Where all ids differ
    they name the rows; otherwise rows are numbered in a written copy.
    """
    number = docs[id_col].cast("long")
    if docs.groupBy(number.alias("id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1 or id is null").isEmpty():
        groups = jaccard_groups(docs, shingle, num, den, id_col, text_col)
        dropped = keep(groups.where("not leader").select(F.col("doc_id").alias("__dropped")))
        return docs.join(dropped, number == dropped["__dropped"], "left_anti")
    row = next(name for i in range(len(docs.columns) + 1) if (name := f"__row{i}") not in docs.columns)
    numbered = keep(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = keep(jaccard_groups(numbered, shingle, num, den, row, text_col).select(F.col("doc_id").alias("at"), F.col("component_id").alias("component")))
    hashed = [c for c in docs.columns if docs.schema[c].dataType.typeName() != "map"]
    place = numbered.select(F.col(row).alias("at"), F.struct(numbered[id_col].isNull().alias("none"), numbered[id_col].cast("long").alias("id"), F.xxhash64(*hashed).alias("content"), F.col(row).alias("row")).alias("place"))
    # Written, so that the join deals both its sides anew and a large component can be split.
    first = keep(groups.join(place.hint("merge"), "at").groupBy("component").agg(F.min("place")["row"].alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("component", "first"))
    dropped = keep(groups.join(first.hint("merge"), "component").where("at <> first").select(F.col("at").alias(row)))
    return numbered.join(dropped, row, "left_anti").select(*docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir), shingle=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")
