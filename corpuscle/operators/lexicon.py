"""Words that a reader may not know: lexicon filters, proposals and their consolidation.

A lexicon is a table (word); postings are (doc_id, pos, form, word).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.plans.ship import ship

# --- fixed values -----------------------------------------------------------
SUFFIXES = ("ingly", "edly", "ily", "ly", "ing", "ed", "es", "s", "iest", "ier", "est", "er", "y", "less", "ful", "ness", "ment", "tion", "ion")
PREFIXES = ("un", "re", "dis", "in", "im", "pre", "out", "mis", "over", "under")
HOMOGRAPHS = (
    "live tear bow row sow bass content desert entrance invalid minute polish produce project rebel refuse resume separate wound abuse "
    "excuse alternate deliberate duplicate elaborate estimate moderate intimate"
).split()
#: Marks of a language in a word, in order of precedence.
FOREIGN = [
    ("french", r"(eau|eux|oux|ette|ille|ç|œ|ê|è)"), ("german", r"(sch|ß|ü|ö|ä|keit|heit|ung$)"),
    ("spanish", r"(ñ|ción|dad$|ía$|osos?$)"), ("italian", r"(zione|gli|cchi|tti$)"), ("latin", r"(ibus$|orum$|arum$|ium$|ius$)"),
]
#: Flags in order of precedence, and the weight of their priority.
FLAGS = [("character", 3.0), ("homograph", 2.5), ("foreign", 2.0), ("acronym", 1.5), ("proper_noun", 1.2), ("unknown", 1.0)]
URL = r"(https?://|www\.|\.com|\.org|\.net|@)"
# ----------------------------------------------------------------------------


def vocabulary(postings: DataFrame) -> DataFrame:
    """(word, form, n, n_docs): every word with its most frequent form (ties: the smallest)."""
    counts = postings.groupBy("word", "form", "doc_id").agg(F.count("*").alias("k"))  # the one pass over all words
    forms = counts.groupBy("word", "form").agg(F.sum("k").alias("k"))
    first = F.row_number().over(W.partitionBy("word").orderBy(F.desc("k"), "form"))
    named = forms.withColumns({"n": F.sum("k").over(W.partitionBy("word")), "first": first}).where("first = 1").select("word", "form", "n")
    return named.join(counts.groupBy("word").agg(F.countDistinct("doc_id").alias("n_docs")), "word")


def frequent_words(postings: DataFrame, least_docs: int) -> DataFrame:
    """A lexicon from the corpus itself: words of at least least_docs documents."""
    return postings.groupBy("word").agg(F.countDistinct("doc_id").alias("n")).where(F.col("n") >= least_docs).select("word")


def stems_of(word: str) -> list[str]:
    """What a word may be derived from: suffixes off (undoubled, with y or e again), prefixes off before that."""
    out = []
    for base in [word, *(word[len(p) :] for p in PREFIXES if word.startswith(p) and len(word) > len(p) + 3)]:
        if base is not word:
            out.append(base)
        for s in SUFFIXES:
            stem = base[: -len(s)]
            if not base.endswith(s) or len(stem) < 3:
                continue
            out.append(stem)
            if stem[-1] == stem[-2]:
                out.append(stem[:-1])
            if s in ("ily", "ness", "ed", "er", "est"):
                out.append(stem + "y")
            if s in ("ing", "ed", "er", "est", "y"):
                out.append(stem + "e")
    return sorted(set(out))


def stems(words: DataFrame) -> DataFrame:
    """(word, stem): every stem of each word (word), once for each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, s) for w in batch.column(0).to_pylist() for s in stems_of(w)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([s for _, s in pairs], pa.string())], names=["word", "stem"])

    ship(words.sparkSession)
    return words.select("word").distinct().mapInArrow(run, "word string, stem string")


def derived(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The words (word) that are derived from a word of the lexicon."""
    return stems(words).join(lexicon.select(F.col("word").alias("stem")), "stem", "left_semi").select("word").distinct()


def compounds(words: DataFrame, lexicon: DataFrame, least: int = 4) -> DataFrame:
    """(word, left, right): words that are two words of the lexicon written as one, the shortest left part."""
    rows = words.where(F.length("word") >= 2 * least).select("word", F.explode(F.sequence(F.lit(least), F.length("word") - least)).alias("k"))
    rows = rows.select("word", F.substr("word", F.lit(1), F.col("k")).alias("left"), F.substr("word", F.col("k") + 1).alias("right"))
    both = rows.join(lexicon.select(F.col("word").alias("left")), "left", "left_semi").join(lexicon.select(F.col("word").alias("right")), "right", "left_semi")
    return both.groupBy("word").agg(F.min_by(F.struct("left", "right"), F.length("left")).alias("x")).select("word", "x.left", "x.right")


def unknown_words(postings: DataFrame, lexicon: DataFrame, least_length: int = 4) -> DataFrame:
    """(word, form, n, n_docs): words outside the lexicon, not derived from it and no compound of it."""
    words = vocabulary(postings).where(F.length("word") >= least_length).join(lexicon, "word", "left_anti")
    return words.join(derived(words, lexicon), "word", "left_anti").join(compounds(words, lexicon).select("word"), "word", "left_anti")


def foreign(word: Column) -> Column:
    """The first language whose marks a word bears, or null."""
    out = F.lit(None).cast("string")
    for language, pattern in reversed(FOREIGN):
        out = F.when(word.rlike(pattern), F.lit(language)).otherwise(out)
    return out


def acronym(form: Column) -> Column:
    """If a form is two to six capitals or digits, dots aside, with a letter."""
    bare = F.replace(form, F.lit("."), F.lit(""))
    return bare.rlike("^[A-Z0-9]{2,6}$") & bare.rlike("[A-Z]")


def in_url(text: Column, pos: Column, size: Column) -> Column:
    """If the 30 characters about a word look like an address."""
    start = F.greatest(F.lit(0), pos - 30)
    return F.substr(text, start + 1, pos + size + 30 - start).rlike(URL)


def proposals(postings: DataFrame) -> DataFrame:
    """(word, form, doc_id, pos, strategy, flag, confidence): homographs, foreign words and acronyms of the text."""
    word, form = F.col("word"), F.col("form")
    kinds = F.array(
        F.when(word.isin(*HOMOGRAPHS), F.struct(F.lit("homograph").alias("strategy"), F.lit("homograph").alias("flag"), F.lit(0.9).alias("confidence"))),
        F.when(foreign(word).isNotNull() & (F.length(word) >= 4), F.struct(F.concat(F.lit("foreign_"), foreign(word)).alias("strategy"), F.lit("foreign").alias("flag"), F.lit(0.7).alias("confidence"))),
        F.when(acronym(form), F.struct(F.lit("acronym").alias("strategy"), F.lit("acronym").alias("flag"), F.lit(0.6).alias("confidence"))),
    )
    return postings.select("word", "form", "doc_id", "pos", F.explode(F.array_compact(kinds)).alias("p")).select("word", "form", "doc_id", "pos", "p.*")


def consolidated(found: DataFrame) -> DataFrame:
    """(word, id, flag, n, n_docs, first_doc, confidence, priority): proposals of one word as one entry."""
    rank = F.array_position(F.array(*[F.lit(f) for f, _ in FLAGS]), F.col("flag"))
    mentions = found.groupBy("word", "doc_id", "pos").agg(F.min(rank).alias("rank"), F.max("confidence").alias("c"))
    n_strategies = found.groupBy("word").agg(F.countDistinct("strategy").alias("s"))
    rows = mentions.groupBy("word").agg(F.min("rank").alias("rank"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("c").alias("c"))
    weight = F.element_at(F.array(*[F.lit(w) for _, w in FLAGS]), F.col("rank").cast("int"))
    flag = F.element_at(F.array(*[F.lit(f) for f, _ in FLAGS]), F.col("rank").cast("int"))
    confidence = F.least(F.col("c") + F.least(0.1 * (F.col("s") - 1), F.lit(0.2)), F.lit(1.0))
    priority = F.round(weight * (1 + F.log10("n")), 3)
    return rows.join(n_strategies, "word").select("word", F.substring(F.md5("word"), 1, 8).alias("id"), flag.alias("flag"), "n", "n_docs", "first_doc", F.round(confidence, 6).alias("confidence"), priority.alias("priority"))


def examples(mentions: DataFrame, most: int = 3) -> DataFrame:
    """Up to most mentions (word, doc_id, pos) of each word, the first of different documents before others."""
    within = F.row_number().over(W.partitionBy("word", "doc_id").orderBy("pos"))
    rows = mentions.withColumn("_k", within).where(F.col("_k") <= most)
    order = W.partitionBy("word").orderBy("_k", "doc_id", "pos")
    return rows.withColumn("example", F.row_number().over(order)).where(F.col("example") <= most).drop("_k")
