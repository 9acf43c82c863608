import random
import re

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["idiot", "worthless", "disgusting"]


def test_stages_keep_the_columns_and_pack_everything(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.keep(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns
        docs = out
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] >= seen[3] <= seen[4]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Clean texts, toxic ones, exact and near copies, nulls and an empty text, and labels of most."""
    rng = random.Random(12)
    parts = ["lo", "mi", "ter", "van", "sun", "po", "hin", "bek", "ral", "dut", "wes", "gol", "kim", "zep", "nav"]
    vocabulary = ["".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows, labels = [], []
    for i in range(500):
        t = text(80)
        if i % 5 == 0:
            words = t.split()
            words[rng.randrange(80)] = INSULTS[i // 5 % 3]
            t = " ".join(words)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    for k, r in enumerate(clean[:40]):
        t = r[1].replace(" ", "  ", 1) if k % 2 else r[1] + " more"  # an exact and a near copy in turn
        rows.append((1000 + k, t, None, None, None))
    rows += [(2000, None, "en", "s0", 0), (2001, "", "en", "s0", 0), (None, text(90), "en", "s1", 0)]
    folder = f"file://{tmp_path_factory.mktemp('planted')}"
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_each_stage_equals_brute_force(spark, planted):
    folder, rows = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, folder))
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    clean = sorted(((r[0], r[1]) for r in rows if not any(w in (r[1] or "").split() for w in INSULTS)), key=order)
    # A learned score: every insult goes, and next to no clean text with them.
    assert set(kept["toxicity"]) <= set(clean) and len(kept["toxicity"]) >= 0.98 * len(clean)
    first = {}
    for i, t in sorted(kept["toxicity"], key=order):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    assert sorted(kept["exact_dedup"], key=order) == sorted(first.values(), key=order)
    left = []
    for i, t in sorted(first.values(), key=order):
        w = (t or "").lower().split()
        s = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
        if not any(s and 100 * len(s & o) >= 80 * len(s | o) for _, _, o in left):  # here every group is a star round its smallest id
            left.append((i, t, s))
    assert sorted(kept["jaccard_join"], key=order) == [x[:2] for x in left]
    assert set(kept["mixing"]) == set(kept["jaccard_join"]) and len(kept["mixing"]) <= 2 * len(left)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert sorted(pieces.groupby("sequence_id")["length"].sum())[-1] <= 2048
    assert all(g.sort_values("offset")["offset"].tolist() == [0, *g.sort_values("offset")["length"].cumsum()][:-1] for _, g in pieces.groupby("sequence_id"))


def test_a_result_that_is_not_read_yet_survives_the_pipeline(spark, sf_dir):
    from tallyweave.llm import registry

    before = registry.QUERIES["op7_sharding"](spark, sf_dir)
    corpus_pipeline.run(spark, sf_dir).count()
    assert before.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_two_runs_on_one_folder_can_both_be_read(spark, planted):
    folder, _ = planted
    first, second = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    assert first.count() == second.count() > 0
