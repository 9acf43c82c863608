import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import collocations, hard_negatives, line_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ord int, th string, pos int, words int, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, 1, "x", 2, 3, "k") for i, t, lang in rows], DOCS)


# --- hard negatives


def _mined(rows, anchors, most=5, k=3):
    """Plain search over all pairs. rows: (id, label, vector)."""
    rows = [(i, x, v) for i, x, v in rows if x is not None and v is not None and None not in v]
    dot = lambda v, w: sum(a * b for a, b in zip(v, w))
    place = lambda i: (i is None, i or 0)
    out = []
    for n, (i, x, v) in enumerate(rows):
        if not anchors(i):
            continue
        near = sorted(((-dot(v, w), place(j), j) for m, (j, y, w) in enumerate(rows) if m != n and x == y), key=lambda t: t[:2])[:most]
        for p, _, pid in near:
            far = sorted(((-dot(v, w), place(j), j) for j, y, w in rows if y != x and 50 * -p <= 100 * dot(v, w) <= 95 * -p), key=lambda t: t[:2])[:k]
            out += [(i, pid, r, nid, -p, -s) for r, (s, _, nid) in enumerate(far, 1)]
    return Counter(out)


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "id long, label int, vec array<long>, row string")


def test_hard_negatives_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 100)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = random.Random(1)
    centres = [[rng.randrange(-90, 90) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randrange(4), [c + rng.randrange(-9, 9) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(i, 3, [5, 5, 5, 5, 5, 5]) for i in range(300, 340)]  # one vector many times, ties everywhere
    rows += [(None, 1, centres[0]), (5, 1, centres[0]), (5, 2, centres[0]), (340, None, centres[0]), (341, 1, None), (342, 1, [1, None]), (343, 9, [7]), (345, 1, []), (350, 8, centres[1])]
    got = hard_negatives.mine(_vectors(spark, rows), F.col("id") % 5 == 0).collect()
    assert Counter(map(tuple, got)) == _mined(rows, lambda i: i is not None and i % 5 == 0)


def test_bounds_rule_out_pairs_of_nodes_and_no_result(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 16)
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rng = random.Random(2)
    rows = [(i, i % 3, [(200 if k == i % 4 else 0) + rng.randrange(3) for k in range(16)]) for i in range(640)]
    seen = []
    plain = hard_negatives.traverse

    def traverse(*a):
        pairs = plain(*a)
        seen.append(pairs.count() / (a[0][0].count() * a[1][0].count()))
        return pairs

    monkeypatch.setattr(hard_negatives, "traverse", traverse)
    got = hard_negatives.mine(_vectors(spark, rows), F.col("id") % 5 == 0).collect()
    assert Counter(map(tuple, got)) == _mined(rows, lambda i: i % 5 == 0)
    assert max(seen) < 0.5  # rows around four axes: most pairs of blocks lie at right angles


def test_hard_negatives_of_odd_tables(spark):
    assert hard_negatives.mine(_vectors(spark, []), F.col("id") % 5 == 0).count() == 0
    assert hard_negatives.mine(_vectors(spark, [(0, 1, [1, 2]), (1, 2, [1, 2])]), F.col("id") % 5 == 0).count() == 0  # no positive
    with pytest.raises(ValueError):
        hard_negatives.mine(_vectors(spark, [(0, 1, [1 << 40])]), F.col("id") % 5 == 0)
    large = [(0, 1, [1 << 26, 3]), (1, 1, [1 << 26, 1]), (2, 2, [(1 << 26) * 6 // 10, 5])]  # sums past 2**53 by less than a double can tell
    large += [(3, 2, [(1 << 26) * 6 // 10, 4])]
    assert Counter(map(tuple, hard_negatives.mine(_vectors(spark, large), F.col("id") == 0).collect())) == _mined(large, lambda i: i == 0)


def test_whole_vectors_drops_what_takes_no_part(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 2, [0.5, -0.001]), (7, 9, [1.0, 0.0]), (2, None, [1.0]), (3, 1, None), (4, 1, [None]), (5, 1, [nan]), (6, 1, [-inf])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert {tuple(map(str, r)) for r in hard_negatives.whole_vectors(table).collect()} == {("1", "2", "[128, -1]"), ("7", "0", "[256, 0]")}


# --- lines

BLANK = " \t\n\x0b\x0c\r"


def _lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def _lines_kept(rows, least):
    keys = [[_lower(x.strip(BLANK)) for x in (t or "").split("\n")] for _, t, _ in rows]
    docs = Counter(k for own in keys for k in set(own))
    out = []
    for (i, t, _), own in zip(rows, keys):
        kept = [x for x, k in zip((t or "").split("\n"), own) if not k or docs[k] < least]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("least, hot", [(3, 40), (3, 2), (1, 40), (99, 1)])
def test_lines_equal_plain_counting(spark, monkeypatch, least, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)  # at 2, most shared keys are counted apart
    rng = random.Random(4)
    pool = ["Shared line", "  shared LINE\t", "", " ", "É line", "é line", "ÉA", "Éa", "x", "\x0bx\x0c", " x", "K", "k", "only \\d here"]
    rows = [(i, "\n".join(rng.choices(pool + [f"own {i} {k}" for k in range(9)], k=rng.randrange(1, 8))), "en") for i in range(60)]
    rows += [(90, None, None), (91, "", "en"), (92, "\n", "en"), (93, "\n".join(rng.choices(pool + [f"far {k}" for k in range(400)], k=3000)), "de")]
    rows += [(None, "twice\nx", "en")] * 2 + [(7, "twice\nx", "en"), (7, "other", "en")]
    got = line_dedup.drop_common_lines(frame(spark, rows), min_docs=least)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == _lines_kept(rows, least)


def test_a_keep_bitmap_has_a_bit_for_each_line(spark):
    common = ["stop"] * 3 + ["go"]
    rows = [(i, "\n".join(f"{i} {k}" if k % 70 else "common" for k in range(200)), "en") for i in range(3)] + [(9, "\n".join(common), "en")]
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(frame(spark, rows), min_docs=3).collect()}
    assert got[9]["words"] is None and got[1]["n_dropped"] == 3
    zeros = {64 * w["word"] + b for w in got[1]["words"] for b in range(64) if not w["bits"] >> b & 1}
    assert zeros == {0, 70, 140} and [w["word"] for w in got[1]["words"]] == [0, 1, 2]


def test_lines_of_an_empty_table(spark):
    assert line_dedup.drop_common_lines(frame(spark, [])).count() == 0


def test_a_range_takes_its_windows_without_another_shuffle(spark, sf_dir):
    records = line_dedup.line_records(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as ord", "xxhash64(text) as th", "text"), 1)
    plan = line_dedup.dropped_lines(records, 10)._jdf.queryExecution().executedPlan().toString()
    ranged = plan[plan.index("rangepartitioning") - 2000 : plan.index("rangepartitioning")]
    assert ranged.count("Window") >= 2 and "hashpartitioning" not in ranged[ranged.index("Window") :]


# --- collocations


def _collocated(rows, least, top):
    by_lang = defaultdict(list)
    for _, t, lang in rows:
        by_lang[lang or "und"] += [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", _lower(t or ""))]
    out = []
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, 5) for i in range(len(p) - k + 1))
        n = sum(c for w, c in f.items() if len(w) == 1)
        found = {w: a for w, a in f.items() if len(w) > 1 and a >= least}
        best = {w: min((2_000_000 * a // (f[w[:k]] + f[w[k:]]), k, f[w[:k]], f[w[k:]]) for k in range(1, len(w))) for w, a in found.items()}
        gone = {w[i : i + k] for w, a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 80 * found[w[i : i + k]]}
        left = sorted((w for w in found if w not in gone), key=lambda w: (-best[w][0], -found[w], " ".join(w).encode()))[:top]
        out += [(lang, r, " ".join(w), found[w], best[w][2], best[w][3], n, best[w][0]) for r, w in enumerate(left, 1)]
    return sorted(out)


def _prose():
    rng = random.Random(5)
    vocabulary = ["The", "the", "of", "é", "É", "漢字", "a.b", "new", "york", "x", " ", "it's", "#1"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)) + ["new york city hall"] * rng.randrange(3)) + rng.choice([".", "\t\t", "\n", " ?"]), rng.choice(["en", "fr", None])) for i in range(120)]
    return rows + [(None, None, "de"), (500, "", "en"), (501, " \t", "de"), (1, "go " * 500, "en"), (1, "go " * 500, "en")]


@pytest.mark.parametrize("share", [500_000, 100])
def test_collocations_equal_plain_counting(spark, monkeypatch, share):
    monkeypatch.setattr(collocations, "BUCKETS", 3 if share > 100 else 40)  # the second time frequent words are dealt in parts
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 700)
    rows = _prose()
    got = collocations.collocations(frame(spark, rows), least=9, top=25)
    assert sorted(map(tuple, got.collect())) == _collocated(rows, 9, 25)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None)])).count() == 0


def test_scores_past_64_bits_are_exact(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, big, big)], "a long, l long, r long").selectExpr("cast(cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r) as bigint) as score")
    assert row.first()["score"] == 1_000_000


def test_digests_of_the_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    got = {r["doc_id"]: r for r in line_dedup.op12_line_dedup(spark, sf_dir).collect()}
    for i, lines, dropped, kept in _lines_kept(docs, 10):
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (lines, dropped, hashlib.sha256(kept.encode()).hexdigest())
    assert sorted(map(tuple, collocations.op13_collocations(spark, sf_dir).collect())) == _collocated(docs, 30, 2000)
