"""Dialogue: quoted turns, their features, evidence sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.operators.lines import WORD, spans

# --- fixed values -----------------------------------------------------------
SPEECH_VERBS = (
    "said says asked replied answered whispered shouted cried exclaimed murmured muttered called demanded insisted suggested continued "
    "added remarked observed declared announced explained repeated began interrupted protested agreed admitted confessed pleaded groaned "
    "sighed laughed sobbed screamed yelled snapped growled hissed stammered stuttered urged warned promised threatened begged commanded "
    "ordered told inquired wondered mused thought reflected pondered"
).split()
QUOTE = "“[^”]{3,}”|\"[^\"]{3,}\""
ACTIONS = "kills murders attacks saves helps betrays reveals discovers confronts escapes fights poisons manipulates deceives protects threatens".split()
RELATIONS = "husband wife lover mistress friend enemy brother sister mother father daughter son marries loves hates trusts".split()
TRAITS = "cruel kind evil good monster hero manipulative honest deceptive brave cowardly".split()
IDENTITIES = [
    r"([A-Z][a-z]+) is (?:later )?(?:known as|revealed to be) ([A-Z][a-z]+)", r"([A-Z][a-z]+),? (?:aka|also known as|née) ([A-Z][a-z]+)",
    r"([A-Z][a-z]+)'s real name is ([A-Z][a-z]+)",
]
FIRST_PERSON = ("i", "me", "my", "mine", "myself")
# ----------------------------------------------------------------------------


def quotes(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, form): quoted passages of three characters or more."""
    return spans(docs, QUOTE)


def speech_verb(text: Column) -> Column:
    """The first speech verb of a text, or null."""
    return F.get(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(*SPEECH_VERBS)), 0)


def pronoun_gender(text: Column) -> Column:
    """male, female or unknown, by the more frequent pronouns."""
    male = F.regexp_count(text, F.lit(r"(?i)\b(he|him|his)\b"))
    female = F.regexp_count(text, F.lit(r"(?i)\b(she|her|hers)\b"))
    return F.when(male > female, "male").when(female > male, "female").otherwise("unknown")


def turn_features(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with length, place, question, speaker of one and two turns before, continuation."""
    order = W.partitionBy("conv_id").orderBy("turn")
    n = F.count("*").over(W.partitionBy("conv_id"))
    size = F.length("text")
    length = F.when(size < 20, "tiny").when(size < 50, "short").when(size < 150, "medium").when(size < 500, "long").otherwise("huge")
    place = (F.row_number().over(order) - 1) / F.greatest(n - 1, F.lit(1))
    where = F.when(place < 0.25, "start").when(place > 0.75, "end").otherwise("middle")
    return turns.select(
        "conv_id", "turn", length.alias("length"), where.alias("place"), F.col("text").rlike(r"\?\s*$").alias("question"),
        F.lag("role", 1).over(order).alias("before"), F.lag("role", 2).over(order).alias("before_that"),
        F.coalesce(F.lag("role", 1).over(order) == F.col("role"), F.lit(False)).alias("continues"), pronoun_gender(F.col("text")).alias("gender"),
    )


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, k, sentence): parts of a text between sentence ends."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("k", "sentence"))
    return rows.where("sentence <> ''")


def statement_score(sentence: Column) -> Column:
    """0.7, more for action, relation and trait words, at most 1."""
    has = lambda words: F.when(F.lower(sentence).rlike("|".join(words)), 1.0).otherwise(0.0)
    return F.least(F.lit(1.0), F.round(0.7 + 0.15 * has(ACTIONS) + 0.1 * has(RELATIONS) + 0.1 * has(TRAITS), 6))


def identity_statements(docs: DataFrame) -> DataFrame:
    """(doc_id, a, b): names that a text says are one person."""
    out = None
    for pattern in IDENTITIES:
        both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), 1).alias("a"), F.regexp_extract_all("text", F.lit(pattern), 2).alias("b"))
        part = docs.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.a", "x.b").where("lower(a) <> lower(b)")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def narrator_density(docs: DataFrame, sample: int = 5000) -> DataFrame:
    """(doc_id, n, per_thousand, first_person): first-person pronouns of the first characters; over 15 make a first-person text."""
    head = F.substring("text", 1, sample)
    n = F.size(F.filter(F.regexp_extract_all(head, F.lit(f"({WORD})"), 1), lambda w: F.lower(w).isin(*FIRST_PERSON)))
    return docs.select("doc_id", n.alias("n"), F.round(F.coalesce(F.try_divide(1000 * n, F.length(head)), F.lit(0.0)), 6).alias("per_thousand"), (n > 15).alias("first_person"))
