"""Serial choices, assignment, grid joins and nearest rows against plain loops, also cut into many small ranges."""

import random
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import adjudicate, auction, legs, nearest, solvers


def _days(df, *names):
    return df.withColumns({n: F.expr(f"date_add(date '2026-01-01', {n})") for n in names})


# --- serial choice


@pytest.mark.parametrize("chunk", [1000, 20])
def test_first_come_equals_a_loop(spark, chunk):
    rng = random.Random(chunk)
    rows = [(f"i{i}", f"c{j}", i, j, rng.randrange(4) / 4) for i in range(60) for j in rng.sample(range(40), rng.randrange(1, 5))]
    taken, want = set(), set()
    for i in range(60):
        mine = sorted((-s, j) for _, _, k, j, s in rows if k == i and j not in taken)
        if mine:
            taken.add(mine[0][1])
            want.add((i, mine[0][1]))
    edges = spark.createDataFrame(rows, "lkey string, rkey string, lseq int, rseq int, score double")
    assert {(r["lseq"], r["rseq"]) for r in solvers.first_come(edges, chunk).collect()} == want


def test_many_declines_on_one_candidate_take_one_round(spark, monkeypatch):
    rounds = []
    plain = spark.read.__class__.parquet
    rows = [(f"i{i:05d}", "x", 0, 0, True) for i in range(10_000)]
    edges = spark.createDataFrame(rows, "lkey string, rkey string, diff int, gap int, fits boolean")
    from tallyweave.operators import serial

    stands = serial._standing

    def counted(tried):
        rounds.append(1)
        return stands(tried)

    monkeypatch.setattr(serial, "_standing", counted)
    log = adjudicate.adjudicate(edges, chunk=2500)
    assert log.count() == 10_000 and log.where("verdict = 'declined'").count() == 10_000 and len(rounds) == 1 and plain


@pytest.mark.parametrize("chunk", [1000, 25])
def test_a_judge_in_ranges_equals_a_loop(spark, chunk):
    rng = random.Random(3)
    rows = [(f"i{i:02d}", f"c{j:02d}", rng.randrange(50), 0, rng.random() < 0.7) for i in range(50) for j in rng.sample(range(30), rng.randrange(1, 6))]
    taken, want = set(), {}
    for i in sorted({r[0] for r in rows}):
        mine = sorted((d, g, j, f) for k, j, d, g, f in rows if k == i and j not in taken)[:3]
        if mine and int(i[1:]) % 3 == 0:
            want[i] = ([m[2] for m in mine], None, "declined")
        elif mine:
            want[i] = ([m[2] for m in mine], mine[0][2], "accepted" if mine[0][3] else "rejected_by_arithmetic")
            if mine[0][3]:
                taken.add(mine[0][2])
    edges = spark.createDataFrame(rows, "lkey string, rkey string, diff int, gap int, fits boolean")
    judge = lambda key, offered: None if int(key[1:]) % 3 == 0 else offered[0]
    assert {r["lkey"]: (r["candidates"], r["chose"], r["verdict"]) for r in adjudicate.adjudicate(edges, judge, chunk).collect()} == want


def _three(left, right):
    day = lambda a, b: abs(a - b)
    return {k: sorted((abs(a - b), day(d, e), j) for j, b, e in right)[:3] for k, a, d in left}


def _sides(spark, left, right):
    return _days(spark.createDataFrame(left, "lkey string, amount long, ldate int"), "ldate"), _days(spark.createDataFrame(right, "rkey string, amount long, rdate int"), "rdate")


def test_the_nearest_three_equal_all_pairs(spark):
    rng = random.Random(5)
    amounts = [rng.randrange(-500, 500) * 7 for _ in range(30)] + [10**9, -(10**9)]
    left = [(f"l{i:03d}", rng.choice(amounts) + rng.choice([0, 0, 1, -3]), rng.randrange(30)) for i in range(120)]
    right = [(f"r{i:03d}", rng.choice(amounts), rng.randrange(60)) for i in range(150)] + [(f"s{i:03d}", 77, 5) for i in range(40)]
    got = defaultdict(list)
    for r in nearest.nearest(*_sides(spark, left, right)).orderBy("lkey", "rank").collect():
        got[r["lkey"]].append((r["diff"], r["gap"], r["rkey"]))
    assert got == _three(left, right)
    assert nearest.nearest(*_sides(spark, left, [])).count() == 0
    two = nearest.nearest(*_sides(spark, left[:1], right[:2]))
    assert two.count() == 2  # fewer than three there are


@pytest.mark.parametrize("chunk", [1000, 60])
def test_judging_the_nearest_that_are_free_equals_a_loop(spark, chunk):
    rng = random.Random(8)
    left = [(f"l{i:02d}", rng.randrange(4) * 20_000 + rng.randrange(3000), rng.randrange(9)) for i in range(30)]
    right = [(f"r{i:02d}", rng.randrange(4) * 20_000 + rng.randrange(6000), rng.randrange(9)) for i in range(25)]
    free, want = list(right), {}
    for k, a, d in sorted(left):
        mine = _three([(k, a, d)], free)[k]
        if not mine:
            continue
        declined = int(k[1:]) % 4 == 0
        fits = mine[0][0] <= legs.ADJUDICATION_TOL
        want[k] = ([m[2] for m in mine], "declined" if declined else "accepted" if fits else "rejected_by_arithmetic")
        if fits and not declined:
            free = [r for r in free if r[0] != mine[0][2]]
    judge = lambda key, offered: None if int(key[1:]) % 4 == 0 else offered[0]
    got = adjudicate.adjudicate_nearest(*_sides(spark, left, right), judge, chunk=chunk)
    assert {r["lkey"]: (r["candidates"], r["verdict"]) for r in got.collect()} == want


def test_items_far_apart_in_amount_do_not_disturb_each_other(spark, monkeypatch):
    """Their numbers alternate, so that ranges of numbers would all want the same rows."""
    from tallyweave.operators import serial

    rounds, stands = [], serial._standing
    monkeypatch.setattr(serial, "_standing", lambda tried: rounds.append(1) or stands(tried))
    left = [(f"l{i:02d}", i % 4 * 10**6, 3) for i in range(24)]
    right = [(f"r{i:02d}", i % 4 * 10**6 + i, 3) for i in range(48)]
    got = adjudicate.adjudicate_nearest(*_sides(spark, left, right), adjudicate.take_first, chunk=40)
    assert {r["lkey"]: r["chose"] for r in got.collect()} == {f"l{i:02d}": f"r{i:02d}" for i in range(24)}
    assert len(rounds) == 1


def test_neighbours_above_are_read_once(spark):
    rows = spark.createDataFrame([(0, 5, True, True)], "g int, v long, right boolean, left boolean")
    assert "unboundedfollowing" not in nearest._around(rows, ["g"], "v", 2)._jdf.queryExecution().toString().lower()


@pytest.mark.parametrize("chunk", [1000, 15])
def test_payouts_equal_a_loop(spark, chunk):
    from itertools import combinations

    rng = random.Random(4)
    batches = [(f"s{i:02d}", rng.randrange(12), rng.randrange(1, 12) * 1000) for i in range(24)]
    lines = [(n, rng.randrange(12), sum(b[2] for b in rng.sample(batches, rng.choice([2, 3])))) for n in range(1, 15)]
    open_, want = list(batches), set()
    for n, day, amount in lines:
        pool = [b for b in open_ if abs(b[1] - day) <= 4]
        for size in (2, 3):
            sets = sorted((max(b[1] for b in c) - min(b[1] for b in c), tuple(b[0] for b in c)) for c in combinations(pool, size) if abs(sum(b[2] for b in c) - amount) <= 100)
            if sets:
                if len(sets) == 1 or sets[0][0] < sets[1][0]:
                    want.add((n, sets[0][1]))
                    open_ = [b for b in open_ if b[0] not in sets[0][1]]
                break
    got = solvers.consolidated(
        _days(spark.createDataFrame(lines, "line_no int, value_date int, amount long"), "value_date"), _days(spark.createDataFrame(batches, "settlement_id string, day int, net long"), "day"), 4, 100, chunk
    )
    assert {(r["line_no"], tuple(r["members"])) for r in got.collect()} == want and want


# --- grid join


def test_one_price_over_many_days_makes_few_pairs(spark):
    left = [(f"l{i}", 5000, i) for i in range(2000)]
    right = [(f"r{i}", 5000 + i % 3, i) for i in range(2000)]
    pairs = solvers.band_pairs(*_sides(spark, left, right), 100, 5, 5)
    assert pairs.count() == sum(abs(i - j) <= 5 for i in range(2000) for j in range(max(0, i - 9), min(2000, i + 10)))
    pairs.write.format("noop").mode("overwrite").save()
    a, b = _sides(spark, left, right)
    day = solvers._day
    met = a.withColumn("c", F.explode(solvers._cells(day("ldate"), 5, 5))).join(b.withColumn("c", F.floor(day("rdate") / 11)), "c").count()
    assert met < 3 * pairs.count()  # of the grid alone, before the condition


@pytest.mark.parametrize("before, after", [(5, 5), (0, 45)])
def test_band_join_equals_all_pairs_with_a_hot_cell(spark, monkeypatch, before, after):
    monkeypatch.setattr(solvers, "CELL", 7)
    rng = random.Random(9)
    left = [(f"l{i}", rng.choice([-150, 0, 99, 100, 101, 3000]), rng.randrange(-20, 70)) for i in range(80)]
    right = [(f"r{i}", rng.choice([-50, 0, 1, 200, 201, 3100]), rng.randrange(-20, 70)) for i in range(80)]
    got = solvers.band_pairs(*_sides(spark, left, right), 100, before, after).select("lkey", "rkey").collect()
    assert sorted(map(tuple, got)) == sorted((i, j) for i, a, d in left for j, b, e in right if abs(a - b) <= 100 and -before <= e - d <= after)


# --- auction


def _auctioned(edges, parts):
    """The rounds of ``auction.assign`` on plain lists, with its own bids. edges: (left, right, cost) of numbers."""
    lefts, rights = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    at = {("l", x): i for i, x in enumerate(lefts)} | {("r", x): len(lefts) + i for i, x in enumerate(rights)}
    n = len(at)
    scale, alone = n + 1, len(lefts) * max(e[2] for e in edges) + 1
    rows = [(at["l", x], at["l", x], -alone * scale) for x in lefts] + [(at["r", x], at["r", x], 0) for x in rights]
    rows += [(at["l", x], at["r", y], -c * scale) for x, y, c in edges] + [(at["r", y], at["l", x], 0) for x, y, _ in edges]
    prices, epsilon = {i: 0 for i in range(n)}, max(1, alone * scale // auction.SHRINK)
    while True:
        owner = dict.fromkeys(prices, -1)
        while min(owner.values()) < 0:
            bids = {}
            for p in range(parts):
                mine = [(b, o, w, prices[o], owner[o]) for b, o, w in rows if b % parts == p]
                table = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*mine)], ["bidder", "obj", "worth", "price", "owner"]) if mine else None
                for out in auction._bid(epsilon)(iter([table] if mine else [])):
                    for o, price, who in zip(*(c.to_pylist() for c in out.columns)):
                        bids[o] = max(bids.get(o, (0, 0)), (price, who))
            for o, (price, who) in bids.items():
                prices[o], owner[o] = price, who
        if epsilon == 1:
            break
        epsilon = max(1, epsilon // auction.SHRINK)
    back = {i: x for (_, x), i in at.items()}
    return {(back[owner[at["r", y]]], y) for y in rights if owner[at["r", y]] < len(lefts)}


@pytest.mark.parametrize("parts", [1, 3])
def test_bids_of_one_or_several_tasks_end_at_an_optimum(parts):
    rng = random.Random(parts)
    for _ in range(40):
        edges = [(i, j, rng.randrange(30)) for i in range(5) for j in range(5) if rng.random() < 0.5]
        if not edges:
            continue
        best = solvers._best_assignment(pd.DataFrame(edges, columns=["lkey", "rkey", "cost"]))
        cost = {(i, j): c for i, j, c in edges}
        got = _auctioned(edges, parts)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert (len(got), sum(cost[e] for e in got)) == (len(best), best["cost"].sum())


def test_a_group_too_large_for_one_task_goes_to_the_auction(spark):
    rng = random.Random(7)
    rows = [(f"l{i:03d}", f"r{min(149, max(0, i + rng.randrange(-3, 4))):03d}", rng.randrange(150)) for i in range(160) for _ in range(4)]
    rows = list({(a, b): (a, b, c, 1) for a, b, c in rows}.values()) + [("z", "y", 5, 2), ("z", "x", 6, 2)]
    edges = spark.createDataFrame(rows, "lkey string, rkey string, cost long, part int")
    best = solvers._best_assignment(pd.DataFrame(rows, columns=["lkey", "rkey", "cost", "part"]))
    got = solvers.assign(edges, in_task=100).toPandas()
    assert got["lkey"].is_unique and got["rkey"].is_unique and (len(got), got["cost"].sum()) == (len(best), best["cost"].sum())


def test_groups_that_go_on_in_the_next_batch_are_solved_whole(spark):
    rng = random.Random(11)
    rows = [(f"l{g}_{i}", f"r{g}_{j}", rng.randrange(20), g) for g in range(40) for i in range(3) for j in range(3) if rng.random() < 0.7]
    frame = pd.DataFrame(rows, columns=["lkey", "rkey", "cost", "grp"])
    want = pd.concat([solvers._best_assignment(f) for _, f in frame.groupby("grp")])
    for size in (1, 4, 1000):
        batches = [frame.iloc[i : i + size] for i in range(0, len(frame), size)]
        got = pd.concat(solvers._group_by_group(iter(batches), ["lkey", "rkey", "cost"]))
        assert got.values.tolist() == want[["lkey", "rkey", "cost"]].values.tolist()
    plan = solvers.assign(spark.createDataFrame(rows, "lkey string, rkey string, cost long, part int"))._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan  # no call for each group
