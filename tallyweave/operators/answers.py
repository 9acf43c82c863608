"""Questions over a finished run: ranked facts, definitions, the cash position, and a guard on a model's wording."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money
from ..sources.scratch import keep
from . import evidence, reporting
from .legs import MEANING

# What counts as an id, an amount, a stop word, a question on cash, and a phrase no answer may use.
IDS = r"(?i)\b((?:pay|rfnd|adjs|setl)_[A-Za-z0-9]+|INV-[\w-]+|bank:\d+|[A-Z]{4}[A-Z0-9]\d{10,14})\b"
AMOUNTS = r"\d[\d,]*\.\d{2}"
STOP = (
    "the", "a", "an", "of", "for", "to", "in", "on", "is", "are", "was", "why", "what", "which", "how", "much", "did", "not", "and", "any", "there", "this",
    "that", "with", "does", "do", "we", "our", "my", "it", "has", "have",
)
CASH = ("cash", "position", "bank", "transit", "settled", "balance", "money")
BANNED = r"(?i)\$|\b(total(?:l?ing|s)?|combined|sum of|altogether|adds? up)\b"
NOTHING = "No record of this run answers that question."


def _stems(words: Column) -> Column:
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 4) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, 1, F.length(w) - 1)).otherwise(w)))


def words(text: Column) -> Column:
    """Distinct stemmed words of a record: runs of a to z, a final s dropped from longer ones."""
    return _stems(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)))


def tokens(question: Column) -> Column:
    """The same of a question, without stop words and words of one or two letters."""
    return _stems(F.filter(F.regexp_extract_all(F.lower(question), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*STOP) & (F.length(w) > 2)))


def facts(sources: dict[str, DataFrame], run: dict[str, DataFrame]) -> DataFrame:
    """kind (findings before matches), key, exposure, raw (lower-case text), about (more words), fact (as shown)."""
    found = evidence.explained(run["findings"], sources, run["matches"])
    told = F.array_join(F.transform("evidence", lambda e: e["value"]), " ")
    shown = F.array_join(F.transform(F.slice("evidence", 1, 5), lambda e: F.concat(e["field"], F.lit("="), e["value"])), "; ")
    names = F.create_map(*[F.lit(x) for kv in MEANING.items() for x in kv])
    of_findings = found.select(
        F.lit(0).alias("kind"), "key", F.abs("value_paise").alias("exposure"), F.lower(F.concat_ws(" ", "key", "code", "action", told)).alias("raw"), F.coalesce(names[F.col("code")], F.lit("")).alias("about"),
        F.concat(F.lit("["), "code", F.lit("] "), "key", F.lit(": exposure "), money.indian_format(F.col("value_paise")), F.lit(". "), shown, F.lit(". "), "action").alias("fact"),
    )
    return of_findings.unionByName(match_facts(run["matches"]))


def match_facts(matches: DataFrame) -> DataFrame:
    """The same columns for matches."""
    return matches.select(
        F.lit(1).alias("kind"), F.col("lkey").alias("key"), F.abs("delta_paise").alias("exposure"), F.lower(F.concat_ws(" ", "lkey", "rkey", "leg", "tier")).alias("raw"), F.lit("").alias("about"),
        F.concat(F.lit("[MATCHED "), "tier", F.lit("] "), "lkey", F.lit(" and "), "rkey", F.lit(", confidence "), F.format_string("%.2f", F.col("confidence") / 1000)).alias("fact"),
    )


def ranked(of: DataFrame, question: str, k: int = 6) -> DataFrame:
    """The k best facts: 6 points for each id of the question in the text, 1 for each of its words; equal points by exposure."""
    q = F.lit(question)
    ids = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(IDS), F.lit(1)), F.lower))
    text = F.translate(F.concat_ws(" ", "raw", "about"), "_", " ")
    points = 6 * F.size(F.filter(ids, lambda i: F.contains(F.col("raw"), i))) + F.size(F.array_intersect(tokens(q), words(text)))
    return of.withColumn("score", points).where("score > 0").orderBy(F.desc("score"), F.desc("exposure"), "kind", "key", "fact").limit(k).select("score", "exposure", "kind", "key", "fact")


GRAM, LONG = 5, 8  # no id is shorter than GRAM


def _grams(run: Column, size: int) -> Column:
    return F.when(F.length(run) >= size, F.transform(F.sequence(F.lit(1), F.length(run) - size + 1), lambda i: F.substring(run, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def _best(df: DataFrame, by: list[str], points: list[str], k: int) -> DataFrame:
    """The first k facts of each ``by``, with ``nth``."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(*[F.desc(c) for c in points], F.desc("exposure"), "kind", "key", "fact"))
    return df.withColumn("nth", nth).where(F.col("nth") <= k)


def index(of: DataFrame) -> dict[str, DataFrame]:
    """``facts`` (fid, wid, ...), ``sets`` (wid, words) and ``postings`` (term, fid), written once, postings in order of terms.

    Facts with the same words share a ``wid``. Terms are the runs of LONG characters in
    whatever of a fact may hold an id, and those of GRAM around a separator, which every
    shorter id has; so a lookup of ids reads the postings of their terms and no other fact.
    """
    about = F.array_sort(words(F.translate(F.concat_ws(" ", "raw", "about"), "_", " ")))
    told = keep(of.withColumns({"fid": F.monotonically_increasing_id(), "words": about}))
    sets = keep(told.groupBy("words").agg(F.min("fid").alias("wid")))
    facts_ = keep(told.join(sets, "words").drop("words"))
    runs = F.regexp_extract_all(F.col("raw"), F.lit("[\\w:-]*[_:0-9-][\\w:-]*"), F.lit(0))
    short = F.filter(F.flatten(F.transform(runs, lambda r: _grams(r, GRAM))), lambda g: g.rlike("[_:-]"))
    terms = F.concat(short, F.flatten(F.transform(runs, lambda r: _grams(r, LONG))))
    postings = facts_.select(F.explode(F.array_distinct(terms)).alias("term"), "fid")
    return {"facts": facts_, "sets": sets, "postings": keep(postings.repartitionByRange("term", "fid").sortWithinPartitions("term", "fid"))}


def lookup(indexed: dict[str, DataFrame], questions: DataFrame, k: int = 6) -> DataFrame:
    """The k best facts of each question (q, question), as ``ranked`` has them: q, nth, score, exposure, kind, key, fact.

    Questions with the same words share the facts that are best by words alone: the k best
    of each set of words, and of these the k best of all sets. A fact that is not among
    them and has no id of the question has k better ones, so these and the facts with an
    id are all that can be among a question's k best.
    """
    facts_, sets, postings = (indexed[x] for x in ("facts", "sets", "postings"))
    asked = F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(IDS), F.lit(1)), F.lower))
    told = keep(questions.select("q", F.array_sort(tokens(F.col("question"))).alias("toks"), asked.alias("ids")))
    kinds = keep(told.groupBy("toks").agg(F.min("q").alias("tid")))
    said = kinds.select("tid", F.explode("toks").alias("w")).join(sets.select("wid", F.explode("words").alias("w")), "w").groupBy("tid", "wid").agg(F.count(F.lit(1)).cast("int").alias("said"))
    heads = keep(_best(facts_, ["wid"], [], k).drop("nth", "raw", "about"))
    by_word = _best(said.join(heads, "wid"), ["tid"], ["said"], k).select("tid", "fid")
    by_word = told.join(kinds, "toks").select("q", "tid").join(by_word, "tid").select("q", "fid", F.lit(0).alias("points"))
    of_ids = told.select("q", F.explode("ids").alias("id")).withColumn("term", F.right("id", F.when(F.length("id") >= LONG, LONG).otherwise(GRAM)))
    maybe = of_ids.join(postings, "term").join(facts_.select("fid", "raw"), "fid")
    by_id = maybe.where(F.contains("raw", "id")).select("q", "fid", F.lit(6).alias("points"))
    found = by_word.unionByName(by_id).groupBy("q", "fid").agg(F.sum("points").alias("points")).join(facts_, "fid").join(sets, "wid").join(told.select("q", "toks"), "q")
    scored = found.withColumn("score", (F.col("points") + F.size(F.array_intersect("toks", "words"))).cast("int"))
    return _best(scored, ["q"], ["score"], k).select("q", "nth", "score", "exposure", "kind", "key", "fact")


def definitions(spark: SparkSession, question: str) -> DataFrame:
    """place, code, fact of the codes whose name or meaning shares a word with the question."""
    rows = spark.createDataFrame([(i, c, m) for i, (c, m) in enumerate(MEANING.items())], "place int, code string, meaning string")
    about = words(F.translate(F.concat_ws(" ", "code", "meaning"), "_", " "))
    return rows.where(F.arrays_overlap(tokens(F.lit(question)), about)).select("place", "code", F.concat(F.lit("[DEFINITION] "), "code", F.lit(": "), "meaning").alias("fact"))


def retrieve(sources: dict[str, DataFrame], run: dict[str, DataFrame], question: str, k: int = 6) -> list[str]:
    """Facts, definitions in the slots left, and the cash position where the question is about cash."""
    spark = run["findings"].sparkSession
    out = [r["fact"] for r in ranked(facts(sources, run), question, k).collect()]
    if len(out) < k:
        out += [r["fact"] for r in definitions(spark, question).orderBy("place").limit(k - len(out)).collect()]
    asked = spark.range(1).select(F.arrays_overlap(tokens(F.lit(question)), F.array(*map(F.lit, CASH)))).first()[0]
    if asked:
        shown = [F.concat(F.lit(f"{label} "), money.indian_format(F.col(c))) for c, label in (("settled_net", "net settled"), ("landed", "landed in bank"), ("in_transit", "in transit"), ("open_receivables", "open receivables"), ("unexplained_credits", "unexplained credits"))]
        out.append("[POSITION] " + reporting.position(sources["pg"], run).select(F.concat_ws(", ", *shown)).first()[0])
    return out


def amounts(text: Column) -> Column:
    """Distinct amounts in a text, without grouping commas."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(AMOUNTS), F.lit(0)), lambda a: F.replace(a, F.lit(","))))


def guard(replies: DataFrame) -> DataFrame:
    """Of (reply, facts array): invented amounts, the banned phrase if any, and whether the wording is withheld."""
    new = F.array_except(amounts(F.col("reply")), amounts(F.array_join("facts", " ")))
    phrase = F.nullif(F.regexp_extract("reply", BANNED, 0), F.lit(""))
    return replies.withColumns({"invented": F.array_sort(new), "phrase": phrase}).withColumn("withheld", (F.size("invented") > 0) | F.col("phrase").isNotNull())


def answer(sources: dict[str, DataFrame], run: dict[str, DataFrame], question: str, model: Callable[[str, list[str]], str] | None = None) -> dict:
    """The answer and its facts. A model's wording is shown only if its amounts are in the facts and it sums nothing up."""
    known = retrieve(sources, run, question)
    out = {"question": question, "facts": known, "model_used": bool(known) and model is not None}
    listed = "\n".join(known)
    if not known:
        return out | {"answer": NOTHING}
    if model is None:
        return out | {"answer": listed}
    reply = " ".join(model(question, known).split())
    checked = guard(run["findings"].sparkSession.createDataFrame([(reply, known)], "reply string, facts array<string>")).first()
    if checked["withheld"]:
        told = "The model's wording is withheld; these are the records.\n" + listed
        return out | {"answer": told, "numeric_check": "failed", "invented_amounts": checked["invented"], "rejected_phrase": checked["phrase"]}
    return out | {"answer": reply, "numeric_check": "passed"}


def parse_choice(reply: str, keys: list[str]) -> tuple[str | None, str]:
    """(key, reason) of a reply like ``CHOICE: B`` and ``REASON: ...``, where A is the first key; NONE or anything else is no choice."""
    chosen = re.search(r"(?i)choice\s*[:=]?\s*\(?(none|[a-z])\b", reply)
    reason = re.search(r"(?i)reason\s*[:=]?\s*(.+)", reply)
    letter = chosen.group(1).upper() if chosen else "NONE"
    at = ord(letter) - 65 if letter != "NONE" else len(keys)
    return (keys[at] if 0 <= at < len(keys) else None), (reason.group(1).strip() if reason else "")


def narrate(finding: dict, model: Callable[[dict], str] | None = None) -> str:
    """At most 400 characters on a finding; nothing without a model."""
    return "" if model is None else model(finding)[:400]
