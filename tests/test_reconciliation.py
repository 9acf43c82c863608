import random

import duckdb
import pandas as pd
import pytest

from tallyweave.operators import adjudicate, legs, solvers
from tallyweave.plans import catalog
from tallyweave.sources import exports

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    pd.testing.assert_frame_equal(plain(catalog.QUERIES[name](spark, sf_dir).toPandas()), plain(duck.sql(catalog.ORACLES[name]).df()), check_dtype=False)


def test_assignment_is_optimal_not_greedy(spark):
    edges = spark.createDataFrame([("a", "x", 1), ("a", "y", 5), ("b", "x", 2), ("c", "z", 0)], "lkey string, rkey string, cost long")
    assert {(r["lkey"], r["rkey"]) for r in solvers.assign(edges).collect()} == {("a", "y"), ("b", "x"), ("c", "z")}


def test_assignment_equals_trying_all():
    rng = random.Random(6)

    def best(rows):  # (pairs, -cost) of the best matching
        if not rows:
            return (0, 0)
        (a, b, c), rest = rows[0], rows[1:]
        n, cost = best([r for r in rest if r[0] != a and r[1] != b])
        return max(best(rest), (n + 1, cost - c))

    for _ in range(300):
        rows = [(f"l{i}", f"r{j}", rng.randrange(4)) for i in range(4) for j in range(4) if rng.random() < 0.6]
        rng.shuffle(rows)
        got = solvers._best_assignment(pd.DataFrame(rows, columns=["lkey", "rkey", "cost"])) if rows else pd.DataFrame({"lkey": [], "rkey": [], "cost": []})
        assert got["lkey"].is_unique and got["rkey"].is_unique and (len(got), -sum(got["cost"])) == best(rows)
        if rows:
            again = solvers._best_assignment(pd.DataFrame(sorted(rows), columns=["lkey", "rkey", "cost"]))
            assert set(zip(got["lkey"], got["rkey"])) == set(zip(again["lkey"], again["rkey"]))


def test_a_large_contested_group_is_solved_in_time():
    rng = random.Random(7)
    rows = [(f"l{i:04d}", f"r{j:04d}", rng.randrange(150)) for i in range(1500) for j in rng.sample(range(1500), 12)]
    got = solvers._best_assignment(pd.DataFrame(rows, columns=["lkey", "rkey", "cost"]))
    assert got["lkey"].is_unique and got["rkey"].is_unique and len(got) > 1480


def test_a_chain_of_several_hundred_edges_is_one_group(spark):
    # Each left key may take the right key before it (cost 0) or its own; the first has its own only.
    chain = [(f"l{i:03d}", f"r{j:03d}", i - j, 1) for i in range(150) for j in (i, i - 1) if j >= 0] + [("m", "q", 0, 2), ("m", "s", 0, 2)]
    edges = spark.createDataFrame(chain, "lkey string, rkey string, cost long, part int")
    found = solvers.groups_of(edges).toPandas()
    assert sorted(map(tuple, found[["lkey", "rkey", "cost", "part"]].to_numpy().tolist())) == sorted(chain)
    assert dict(zip(found["part"], found["grp"])) == {1: "l000", 2: "m"} and found["grp"].nunique() == 2
    taken = solvers.assign(edges).where("part = 1").collect()
    assert {(r["lkey"], r["rkey"]) for r in taken} == {(f"l{i:03d}", f"r{i:03d}") for i in range(150)}


def _batches(spark, nets):
    return spark.createDataFrame([(f"s{i}", "2026-07-10", n) for i, n in enumerate(nets)], "settlement_id string, day string, net long").selectExpr("settlement_id", "cast(day as date) as day", "net")


def _line(spark, *amounts):
    return spark.createDataFrame([(i, "2026-07-10", a) for i, a in enumerate(amounts, 1)], "line_no int, value_date string, amount long").selectExpr("line_no", "cast(value_date as date) as value_date", "amount")


def test_a_tie_between_payout_sets_is_refused(spark):
    assert solvers.consolidated(_line(spark, 40000), _batches(spark, [10000, 20000, 30000, 20000]), 4, 100).count() == 0


def test_three_batches_in_one_payout(spark):
    found = solvers.consolidated(_line(spark, 71000), _batches(spark, [10000, 20000, 41000, 90000]), 4, 100).collect()
    assert [sorted(r["members"]) for r in found] == [["s0", "s1", "s2"]]


def test_earlier_lines_take_batches_first(spark):
    found = solvers.consolidated(_line(spark, 30000, 50000), _batches(spark, [10000, 20000, 40000]), 4, 100).collect()
    assert [(r["line_no"], sorted(r["members"])) for r in found] == [(1, ["s0", "s1"])]


def test_first_come(spark):
    edges = spark.createDataFrame([("i1", "x", 1, 1, 0.5), ("i2", "x", 2, 1, 0.9), ("i2", "y", 2, 2, 0.4)], "lkey string, rkey string, lseq int, rseq int, score double")
    assert {(r["lkey"], r["rkey"]) for r in solvers.first_come(edges).collect()} == {("i1", "x"), ("i2", "y")}


def test_bad_rows_are_reported(spark, tmp_path):
    (tmp_path / "bank_statement.csv").write_text("line_no,value_date,narration,ref_no,debit,credit,balance\n1,2026-07-01,NEFT,r,,100.50,100.50\n999,not-a-date,x,r,,abc,1\n2,02/07/2026,FEE,r,20.00,,80.50\n")
    good, bad = exports.bank(spark, str(tmp_path / "bank_statement.csv"))
    assert {(r["line_no"], r["amount_paise"]) for r in good.collect()} == {(1, 10050), (2, -2000)}
    assert [(r["file"], r["reason"]) for r in bad.collect()] == [("bank_statement", "bad date")]


def test_the_judge_is_asked_in_order_and_may_only_pick_what_is_offered_and_fits(spark):
    rows = [("a", "x", 10, True), ("b", "x", 10, True), ("c", "y", 9000, False), ("d", "z", 0, True), ("e", "x", 1, True), ("e", "w", 2, True), ("f", "w", 1, True), ("g", "v", 1, True)]
    edges = spark.createDataFrame([(a, b, d, 0, f) for a, b, d, f in rows], "lkey string, rkey string, diff int, gap int, fits boolean")

    def judge(key, offered):
        return {"d": "nothing", "g": None}.get(key, offered[0])

    log = {r["lkey"]: (r["candidates"], r["verdict"]) for r in adjudicate.adjudicate(edges, judge).collect()}
    # b and f find their candidates taken by a and e, so nobody is asked.
    assert log == {"a": (["x"], "accepted"), "c": (["y"], "rejected_by_arithmetic"), "d": (["z"], "declined"), "e": (["w"], "accepted"), "g": (["v"], "declined")}
    assert adjudicate.adjudicate(edges.where("false"), judge).count() == 0
    assert {r["verdict"]: r["n"] for r in adjudicate.verdicts(adjudicate.adjudicate(edges)).collect()} == {"declined": 8 - 1}


def test_a_judge_serves_in_series_like_a_loop(spark):
    rng = random.Random(2)
    rows = [(f"i{i:02d}", f"c{j:02d}", rng.randrange(50), 0, rng.random() < 0.8) for i in range(40) for j in rng.sample(range(25), rng.randrange(1, 6))]
    taken, want = set(), {}
    for i in sorted({r[0] for r in rows}):
        mine = sorted((d, g, j, f) for k, j, d, g, f in rows if k == i and j not in taken)[:3]
        if mine:
            want[i] = (mine[-1][2], "accepted" if mine[-1][3] else "rejected_by_arithmetic")
            if mine[-1][3]:
                taken.add(mine[-1][2])
    edges = spark.createDataFrame(rows, "lkey string, rkey string, diff int, gap int, fits boolean")
    assert {r["lkey"]: (r["chose"], r["verdict"]) for r in adjudicate.adjudicate(edges, lambda key, offered: offered[-1]).collect()} == want


def test_the_bridge_has_no_residual_and_no_record_is_claimed_twice(spark, sf_dir):
    assert catalog.QUERIES["cash_bridge"](spark, sf_dir).first()["residual"] == 0
    from tallyweave.plans import runs

    m = runs.full(spark, sf_dir)["matches"]
    assert m.count() == m.select("leg", "rkey").distinct().count()
    assert set(legs.MEANING) >= {r["code"] for r in runs.full(spark, sf_dir)["findings"].select("code").distinct().collect()}


def test_scores_cover_every_code_and_every_leg(spark, sf_dir):
    codes = {r["code"]: r["support"] for r in catalog.QUERIES["exception_scores_all"](spark, sf_dir).collect()}
    assert set(codes) == set(legs.MEANING) - {"UNCLASSIFIED"} | {"OVERALL"} and all(n > 0 for n in codes.values())
    assert codes["OVERALL"] == sum(n for c, n in codes.items() if c != "OVERALL")
    links = {r["leg"]: r["support"] for r in catalog.QUERIES["link_scores_all"](spark, sf_dir).collect()}
    assert set(links) == {"erp_to_gateway", "settlement_to_bank", "invoice_to_bank", "OVERALL"} and all(n > 0 for n in links.values())
