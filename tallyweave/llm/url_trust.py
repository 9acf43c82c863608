"""URL filters by link-graph propagation.

Hosts are nodes. Edges are the absolute links of pages to other hosts, and
each host's ties with its parent domain. Personalised PageRank flows from
trusted hosts along the edges, and distrust from blocked hosts along the
reversed edges (who links to bad hosts is bad). A page that no rule decides is
allowed where its host's trust is at least ``threshold`` times its distrust.

Both walks run together as one DataFrame of (walk, host, score), a join and a
sum per step until it settles, written to the shared folder at each few steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

#: (verdict, rule): a rule is a host and a path prefix.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DAMPING, THRESHOLD = 0.85, 1.0
ROUND, MOST_STEPS = 8, 800  # steps of one written round
FLOOR = 1e-12  # what the scores may be off in total where a tie would keep the walks going
_LINK = r"(?i)href\s*=\s*[\"']?\s*([a-z][a-z0-9+.-]*://[^\"'\s>]+)"


def _lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; ASCII letters lower-cased."""
    return _lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` (with host and path) plus rule and ruled (its verdict); the longest rule wins.

    ``rules`` is a short parameter list; it becomes one expression, tried from
    the longest rule on. No rule: both null.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """src, dst, weight between different hosts: links counted, ties to parent domains as one each way."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col).cast("string"), F.lit("")), F.lit(_LINK), F.lit(1))).alias("link"))
    links = links.select(F.col("host").alias("src"), host_of(F.col("link")).alias("dst"))
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    ties = pages.select("host").distinct().select("host", parent.alias("parent")).where("parent <> ''")
    both = links.unionByName(ties.select(F.col("host").alias("src"), F.col("parent").alias("dst"))).unionByName(ties.select(F.col("parent").alias("src"), F.col("host").alias("dst")))
    return both.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def _sides(score: DataFrame) -> DataFrame:
    """host, trust, distrust of scores by node."""
    at = F.expr("substring(node, instr(node, ' ') + 1)").alias("host")
    return score.groupBy(at).agg(*[F.coalesce(F.sum(F.when(F.substring_index("node", " ", 1) == w, F.col("score"))), F.lit(0.0)).alias(w) for w in ("trust", "distrust")])


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = FLOOR, asked: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """walk, host, score. seeds: walk (trust or distrust), host, seed; each walk's seeds add up to 1.

    A round of r steps shrinks the distance from the end at least damping ** r times, so
    what a round changed bounds what is left to change, over all hosts of both walks and
    so for each. Steps go on until no host in ``asked`` (host) can still change sides:
    its trust and ``threshold`` times its distrust lie further apart than that bound, and
    no host was reached for the first time. Where hosts tie, or nothing is asked, they go
    on until the bound is under ``tolerance``; walks that have not settled after
    MOST_STEPS, which no graph needs at this damping, are an error.
    """
    # One key of walk and host: planning a chain of joins on two keys takes time that doubles with each step.
    name = lambda walk, host: F.concat_ws(" ", walk, host)
    forward = edges.select(name(F.lit("trust"), "src").alias("src"), name(F.lit("trust"), "dst").alias("dst"), "weight")
    backward = edges.select(name(F.lit("distrust"), "dst").alias("src"), name(F.lit("distrust"), "src").alias("dst"), "weight")
    walks = keep(forward.unionByName(backward))
    out = walks.groupBy("src").agg(F.sum("weight").alias("all"))
    walks = keep(walks.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all") * damping).alias("share")))
    seeds = keep(seeds.select(name("walk", "host").alias("node"), F.col("seed").alias("score")))
    base = seeds.select("node", (F.col("score") * (1 - damping)).alias("score"))
    score, left = seeds, damping**ROUND / (1 - damping**ROUND)
    for _ in range(0, MOST_STEPS, ROUND):
        before = score
        for _ in range(ROUND):
            flow = walks.join(score.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), (F.col("share") * F.col("score")).alias("score"))
            score = flow.unionByName(base).groupBy("node").agg(F.sum("score").alias("score"))
        score = keep(score)
        moved = score.unionByName(before.select("node", (-F.col("score")).alias("score"))).groupBy("node").agg(F.sum("score").alias("by"))
        off = moved.agg(F.coalesce(F.sum(F.abs("by")), F.lit(0.0))).first()[0] * left
        settled = off < tolerance
        if not settled and asked is not None and score.count() == before.count():
            bound = off + tolerance
            sure = ((F.col("trust") - bound) >= threshold * (F.col("distrust") + bound)) | ((F.col("trust") + bound) < threshold * (F.col("distrust") - bound))
            settled = _sides(score).where(~sure).join(asked, "host", "left_semi").isEmpty()
        if settled:
            return score.select(F.substring_index("node", " ", 1).alias("walk"), F.expr("substring(node, instr(node, ' ') + 1)").alias("host"), "score")
    raise RuntimeError(f"the walks have not settled after {MOST_STEPS} steps")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without ``://``, has an empty host and path, no rule and
    no scores, so it is allowed. Hosts that no walk reaches have scores of 0.
    Seeds weigh hosts by their pages under allow rules (trust) and under block
    rules (distrust). Rows may repeat and ids may be null; urls and pages are
    read whole, however long; other columns are not looked at. An empty table
    gives no rows.
    """
    url = pages[url_col].cast("string")
    rows = pages.select(pages[id_col].alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), pages[html_col].alias("html"))
    edges = keep(host_edges(rows))  # written, so that pages are read once for the walks
    narrow = keep(ruled(rows.select("page_id", "host", "path"), rules))
    counts = narrow.where("host <> '' and ruled is not null").groupBy(F.when(F.col("ruled") == "allow", "trust").otherwise("distrust").alias("walk"), "host").agg(F.count(F.lit(1)).cast("double").alias("n"))
    totals = F.broadcast(counts.groupBy("walk").agg(F.sum("n").alias("all")))  # two rows
    asked = narrow.where("ruled is null and host <> ''").select("host").distinct()
    scores = propagate(edges, counts.join(totals, "walk").select("walk", "host", (F.col("n") / F.col("all")).alias("seed")), asked=keep(asked), threshold=threshold)
    # Written, so that the join deals both its sides anew and a large host can be split.
    wide = keep(scores.groupBy("host").agg(*[F.sum(F.when(F.col("walk") == w, F.col("score"))).alias(w) for w in ("trust", "distrust")]))
    joined = narrow.join(wide.hint("merge"), "host", "left").withColumns({w: F.coalesce(w, F.lit(0.0)) for w in ("trust", "distrust")})
    method = F.when(F.col("trust") >= threshold * F.col("distrust"), "allow").otherwise("block")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def op8_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
