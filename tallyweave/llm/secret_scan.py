"""Secret scans with an incremental blob ledger.

Every version of every path is content-addressed (SHA-256). The ledger holds,
for each (blob, rule, rule version) scanned so far, the spans found. A run
scans only pairs that the ledger lacks: a blob that many paths share is scanned
once, an unchanged blob never again, and a new rule version only by that rule.
Findings are then joined back to all paths. Only DataFrame functions are used.

A regular expression's spans come from two built-ins: the matches themselves
and the pieces between them, whose lengths add up to positions.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, keep, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str  # a Java regular expression
    group: int = 0  # the group whose length counts
    least: int = 0  # matches with a shorter group are dropped
    base: bool = False
    needs: tuple[str, ...] = ()  # no match without one of these in the lower-cased text


#: In the order in which spans that start together are listed.
RULES = (
    Rule("assign", 1, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, True, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16, True),  # whole runs, so the same as dropping the shorter ones
    # What the method adds to the base rules: private key headers, as any version of a path may hold them.
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("private key-----",)),
)
SPANS = "array<struct<start:int,stop:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """Start and end (code points, end exclusive) of the rule's matches, leftmost and non-overlapping."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    lengths = F.transform(matches, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length) if rule.group else lengths
    steps = F.arrays_zip(gaps, lengths, counted)  # fields 0, 1, 2; one gap more than matches
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x.getField("0")
        stop = start + F.coalesce(x.getField("1"), F.lit(0))
        hit = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(x.getField("2") >= rule.least, F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    none = F.array().cast(SPANS)
    unlikely = F.size(matches) == 0
    if rule.needs:
        low = F.lower(text)
        unlikely = ~functools.reduce(lambda a, b: a | b, [low.contains(x) for x in rule.needs])
    return F.when(unlikely, none).otherwise(F.aggregate(steps, empty, step, lambda acc: acc["found"]))


def address(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """path and blob of every version."""
    return versions.select(versions[id_col].alias("path"), F.unhex(F.sha2(text_or_empty(versions[text_col]), 256)).alias("blob"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, ledger): path and blob of each version; the ledger with what this run added.

    Ledger rows: blob, kind, version, spans. A null text is the empty blob. Ids
    may be null or repeat. Texts are read whole, however long; columns other than
    the id and the text are not looked at. An empty table adds nothing to the ledger.
    """
    paths = keep(address(versions, id_col, text_col))
    # One version stands for each blob; the pick is over hashes and ids, so texts move at most once.
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    texts = versions.select(versions[id_col].alias("path"), text_or_empty(versions[text_col]).alias("text"))
    wanted = [(r.kind, r.version) for r in rules]
    if ledger is None:
        todo = first.withColumn("missing", F.lit(None).cast("array<string>"))
    else:
        known = ledger.where(F.struct("kind", "version").isin([F.struct(F.lit(k), F.lit(v)) for k, v in wanted])).groupBy("blob").agg(F.collect_set("kind").alias("known"))
        kinds = F.array(*[F.lit(k) for k, _ in wanted])
        todo = first.join(known, "blob", "left").withColumn("missing", F.array_except(kinds, F.coalesce("known", F.array().cast("array<string>")))).where(F.size("missing") > 0).drop("known")
    # By path and content, so that rows that share a null or repeated id do not all meet.
    texts = texts.withColumn("sha", F.unhex(F.sha2("text", 256)))
    unseen = texts.join(todo, texts["path"].eqNullSafe(todo["path"]) & (texts["sha"] == todo["blob"]), "inner").select("blob", "missing", "text")
    per_rule = F.array(
        *[
            F.when(F.col("missing").isNull() | F.array_contains("missing", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans")))
            for r in rules
        ]
    )
    added = keep(unseen.select("blob", F.explode(F.filter(per_rule, lambda x: x.isNotNull())).alias("x")).select("blob", "x.*").dropDuplicates(["blob", "kind", "version"]))
    return paths, added if ledger is None else ledger.unionByName(added)


def _listed(rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = F.transform(F.col("spans"), lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, F.col("kind")).alias("rank"), s["stop"].alias("stop"), F.col("kind").alias("kind")))
    return F.array_sort(F.flatten(F.collect_list(one)))


def _joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and ``found`` (array of start, rank, stop, kind in listing order) for all paths."""
    current = ledger.where(F.concat_ws(":", "kind", "version").isin([f"{r.kind}:{r.version}" for r in rules]))
    by_blob = current.groupBy("blob").agg(_listed(rules).alias("found"))
    return paths.join(by_blob.hint("merge"), "blob", "left")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, ledger = scan(documents(spark, sf_dir))
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return findings(paths, ledger).select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans")
    )
