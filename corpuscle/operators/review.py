"""Reviews of results: sequences, comparisons of casts, coverage checks, sampled passages, narrator hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.functions.text import roman_value

# --- fixed values -----------------------------------------------------------
FIRST_PERSON_HINTS = r"(?i)\b(the narrator|first[- ]person|narrated by|recounts (his|her) own|tells (his|her) own story)\b"
SPEECH = "[\"“”«»]"
LOOKS = r"(?i)\b(tall|short|thin|eyes|hair|face|dressed|wore|looked like|appearance)\b"
VOCATIVE = r"[,!]\s+([A-Z][a-z]+)[!?,]"
# ----------------------------------------------------------------------------


def numeral(title: Column) -> Column:
    """The number that a title is or ends with after 'Chapter', in digits or Roman, else null."""
    bare = F.trim(F.regexp_replace(title, r"(?i)^chapter\s+", ""))
    digits = F.expr("cast(null as int)")
    digits = F.when(bare.rlike(r"^\d{1,4}$"), bare.try_cast("int")).otherwise(digits)
    return F.coalesce(digits, F.when(bare.rlike(r"^[IVXLCDM]+$"), roman_value(bare)))


def sequences(titles: DataFrame) -> DataFrame:
    """(doc_id, n, simple): if all titles (doc_id, start, title) are numbers that rise by one to five."""
    order = W.partitionBy("doc_id").orderBy("start")
    rows = titles.withColumn("value", numeral(F.col("title"))).withColumn("step", F.col("value") - F.lag("value").over(order)).withColumn("head", F.row_number().over(order) == 1)
    good = F.col("value").isNotNull() & (F.col("head") | F.coalesce(F.col("step").between(1, 5), F.lit(False)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.every(good).alias("simple"))


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, only_old, only_new, both): aliases (key, alias) of two casts side by side."""
    a = old.groupBy("key").agg(F.collect_set(F.lower("alias")).alias("x"))
    b = new.groupBy("key").agg(F.collect_set(F.lower("alias")).alias("y"))
    none = F.array().cast("array<string>")
    rows = a.join(b, "key", "full").select("key", F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))
    return rows.select("key", F.size(F.array_except("x", "y")).alias("only_old"), F.size(F.array_except("y", "x")).alias("only_new"), F.size(F.array_intersect("x", "y")).alias("both"))


def tag_identities(tags: DataFrame) -> DataFrame:
    """(book, a, b): tags (book, tag) of the form 'A/B', both of two characters or more, as unordered pairs."""
    name = r"([^/\s][^/]*[^/\s])"
    pair = [F.regexp_extract("tag", rf"^\s*{name}\s*/\s*{name}\s*$", k) for k in (1, 2)]
    rows = tags.select("book", pair[0].alias("x"), pair[1].alias("y")).where("x <> '' and lower(x) <> lower(y)")
    return rows.select("book", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def vocatives(docs: DataFrame) -> DataFrame:
    """(doc_id, name, n): the name most often called in a text; ties: the smallest."""
    rows = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(VOCATIVE), 1)).alias("name")).groupBy("doc_id", "name").agg(F.count("*").alias("n"))
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "name")))
    return best.where("k = 1").select("doc_id", "name", "n")


def perspective(summary: Column) -> Column:
    """first by a summary's hints, else third."""
    return F.when(summary.rlike(FIRST_PERSON_HINTS), "first").otherwise("third")


def context_kind(text: Column) -> Column:
    return F.when(text.rlike(SPEECH), "dialogue").when(text.rlike(LOOKS), "description").otherwise("mention")


def missing_readings(entries: DataFrame, often: int = 10, report: int = 20) -> DataFrame:
    """(word, reported): entries (word, flag, n, reading) without a reading that need one, and whether they are reported."""
    needs = (F.col("flag") == "character") | (F.col("n") > often)
    rows = entries.where(needs & (F.coalesce(F.trim("reading"), F.lit("")) == ""))
    return rows.select("word", ((F.col("flag") == "character") | (F.col("n") > report)).alias("reported"))


def quality_report(counts: DataFrame, gate: float = 0.5) -> DataFrame:
    """(overall, agents, weak, passed): weighted confidence of counts (agent, high, medium, low) and whether it opens the gate."""
    total = F.col("high") + F.col("medium") + F.col("low")
    share = F.coalesce(F.try_divide(F.col("high") + 0.6 * F.col("medium") + 0.2 * F.col("low"), total), F.lit(1.0))
    rows = counts.select("agent", share.alias("q"))
    out = rows.agg(F.avg("q").alias("q"), F.count("*").alias("agents"), F.count_if(F.col("q") < gate).alias("weak"))
    return out.select(F.round("q", 6).alias("overall"), "agents", "weak", (F.coalesce("q", F.lit(1.0)) >= gate).alias("passed"))


def one_per_bucket(spans: DataFrame, size: int) -> DataFrame:
    """The first span (doc_id, pos, form) of every bucket of size characters."""
    order = W.partitionBy("doc_id", F.floor(F.col("pos") / size)).orderBy("pos")
    return spans.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def back_matter_start(rows: DataFrame, share: float = 0.55) -> DataFrame:
    """(doc_id, start): the earliest heading (doc_id, start, size) in the last part of a text."""
    return rows.where(F.col("start") >= F.floor(F.col("size") * share)).groupBy("doc_id").agg(F.min("start").alias("start"))
