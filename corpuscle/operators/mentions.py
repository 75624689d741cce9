"""Mentions of names in text, similarity of names, folds over positions, tables of contents, segmentation."""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from corpuscle.operators.lines import lines
from corpuscle.plans.ship import ship

# --- fixed values -----------------------------------------------------------
#: Short first names and what they stand for.
NICKNAMES = [
    ("cal", "caleb"), ("cathy", "catherine"), ("kate", "catherine"), ("tom", "thomas"), ("nick", "nicholas"), ("bill", "william"),
    ("bob", "robert"), ("jim", "james"), ("joe", "joseph"), ("mike", "michael"), ("dan", "daniel"), ("sam", "samuel"), ("ben", "benjamin"),
    ("alex", "alexander"), ("beth", "elizabeth"), ("liz", "elizabeth"), ("katie", "katherine"), ("kate", "katherine"), ("meg", "margaret"),
    ("peggy", "margaret"), ("dick", "richard"), ("rick", "richard"), ("ted", "edward"), ("ed", "edward"), ("tony", "anthony"), ("jack", "john"),
]
ELDER = r"(?i)\b(father|mother|elder|senior|old|aged|parent|the late)\b"
YOUNGER = r"(?i)\b(son|daughter|younger|junior|child|infant|boy|girl)\b"
PAST = r"(?i)\b(years ago|long ago|in (his|her) youth|remembered|flashback|had once|back then|formerly)\b"
FIRST_PERSON_SUBJECT = r"(?i)^\s*(\.\.\.)?\s*[\"'“”‘’]?\s*(I|We)\b"
TOC_WORD = r"^(?i:part|chapter|book|volume|prologue|epilogue|foreword|preface|introduction|acknowledge?ments?|dedication|appendix|glossary|index|bibliography|notes|contents|about the author|afterword)\b"
PHYSICAL = "tall short thin fat stout slender eyes hair face hands voice smile beautiful handsome ugly pretty elegant".split()
# ----------------------------------------------------------------------------


@pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two strings, case aside; 0 where one is null or empty."""
    pairs = zip(a, b, strict=True)
    return pd.Series([difflib.SequenceMatcher(None, x.strip().lower(), y.strip().lower()).ratio() if x and y else 0.0 for x, y in pairs], dtype="float64")


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form of Unicode text; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def names_similar(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """If names are equal, one's parts are among the other's, or the ratio reaches the threshold."""
    x, y = F.split(F.lower(a), r"\s+"), F.split(F.lower(b), r"\s+")
    among = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.lower(a) == F.lower(b)) | among | (similarity(a, b) >= threshold)


def nickname(a: Column, b: Column) -> Column:
    """If first names are a known pair or one begins the other with three letters' difference at most."""
    x, y = F.lower(F.element_at(F.split(F.trim(a), r"\s+"), 1)), F.lower(F.element_at(F.split(F.trim(b), r"\s+"), 1))
    pair = F.array(*[F.lit(f"{s}|{t}") for s, t in NICKNAMES])
    known = F.array_contains(pair, F.concat(x, F.lit("|"), y)) | F.array_contains(pair, F.concat(y, F.lit("|"), x))
    return known | ((x.startswith(y) | y.startswith(x)) & (F.abs(F.length(x) - F.length(y)) <= 3))


def handoff_confidence(pairs: DataFrame) -> DataFrame:
    """pairs (name_a, name_b, role_a, chapters_b, gap) with confidence that they are one person."""
    a, b = F.col("name_a"), F.col("name_b")
    alike = similarity(a, b)
    last = F.lower(F.element_at(F.split(a, r"\s+"), -1)) == F.lower(F.element_at(F.split(b, r"\s+"), -1))
    both = (F.size(F.split(a, r"\s+")) > 1) & (F.size(F.split(b, r"\s+")) > 1)
    points = [
        F.when(F.col("role_a").isin("protagonist", "antagonist"), 0.2), F.when(alike > 0.4, 0.15 * alike), F.when(both & last, 0.1), F.when(nickname(a, b), 0.2),
        F.when(F.col("chapters_b") <= 2, 0.1), F.when(F.col("gap") > 1, -0.1), F.when(F.col("chapters_b") > 3, -0.1),
    ]
    total = F.lit(0.4)
    for p in points:
        total = total + F.coalesce(p, F.lit(0.0))
    return pairs.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6))


def boundary_score(toc: Column, ending: Column, beginning: Column, title: Column, proposed: Column) -> Column:
    """How sure a chapter boundary is, from its match with the contents and marks out of ten."""
    edges = (ending + beginning) / 20
    base = F.when(toc > 0.8, toc * 0.6 + edges * 0.3 + title / 10 * 0.1).when(toc > 0, toc * 0.3 + edges * 0.4 + title / 10 * 0.3).otherwise(edges * 0.5 + title / 10 * 0.5)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * 0.7 + proposed * 0.3))


def disambiguated(sentence: Column, full: Column, short: Column) -> Column:
    """Which of two bearers of a name a sentence means: struct(name, confidence, method)."""
    choose = lambda name, confidence, method: F.struct(name.alias("name"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))
    telling = F.array_except(F.split(F.lower(full), r"\s+"), F.split(F.lower(short), r"\s+"))
    named = F.arrays_overlap(telling, F.split(F.lower(sentence), "[^a-zà-ÿ]+"))
    return (
        F.when(sentence.rlike(ELDER), choose(full, 0.95, "relationship")).when(sentence.rlike(YOUNGER), choose(short, 0.95, "relationship"))
        .when(named, choose(full, 0.9, "shape")).when(sentence.rlike(PAST), choose(full, 0.8, "temporal")).otherwise(choose(short, 0.5, "default"))
    )


def physical_score(text: Column) -> Column:
    """How many different words of appearance a text has."""
    return F.size(F.filter(F.array(*map(F.lit, PHYSICAL)), lambda w: F.array_contains(F.split(F.lower(text), "[^a-z]+"), w)))


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, id, alias, pos): names (doc_id, id, alias) in the texts, the longest first, without overlap.

    Case is ignored, spaces match any white space, and a name is bounded by what
    is no letter or digit. Where two members share a spelling the smaller id has it.
    """
    ship(docs.sparkSession)
    lists = names.where("length(trim(alias)) > 1").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("alias", "id"))).alias("names"))
    held = docs.where("text is not null").join(lists, "doc_id").select("doc_id", "text", "names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids: dict[str, tuple[int, str]] = {}
                for n in own:
                    key = " ".join(n["alias"].lower().split())
                    ids[key] = min(ids.get(key, (n["id"], n["alias"])), (n["id"], n["alias"]))
                longest = sorted(ids, key=lambda k: (-len(k), k))
                pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(r"\s+".join(map(re.escape, k.split(" "))) for k in longest) + r")(?![^\W_])", re.IGNORECASE)
                for m in pattern.finditer(text):
                    found = ids.get(" ".join(m[0].lower().split()))
                    if found:
                        out.append((doc, found[0], found[1], m.start()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "id", "alias", "pos"])

    return held.mapInArrow(run, "doc_id long, id long, alias string, pos int")


def ungrounded_aliases(aliases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(book, id, alias): aliases with a part of three letters or more that the book's words (book, word) lack."""
    parts = aliases.select("book", "id", "alias", F.explode(F.filter(F.split(F.lower("alias"), "[^a-zà-ÿ]+"), lambda p: F.length(p) >= 3)).alias("word"))
    return parts.join(vocabulary.select("book", "word").distinct(), ["book", "word"], "left_anti").select("book", "id", "alias").distinct()


def kept_apart(proposals: DataFrame, gap: int) -> DataFrame:
    """proposals (doc_id, pos, score) such that none follows another by less than gap: of two the better stays.

    A fold in order of position, as each decision depends on the one before: one
    document's proposals are sorted and streamed through one task, which holds a
    batch and the last row kept, so their number is not bounded. A null position or
    score comes first and is never far enough, or better.
    """
    rows = proposals.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch])
            kept: list[int] = []
            doc = last = best = None
            for i, (d, pos, score) in enumerate(zip(*(c.to_pylist() for c in table.columns), strict=True)):
                if not kept or d != doc or (pos is not None and last is not None and pos - last >= gap):
                    kept.append(i)
                # Spark's order: NaN is above every number
                elif score is not None and best is not None and (score > best or (score != score and best == best)):
                    kept[-1] = i
                else:
                    continue
                doc, last, best = d, pos, score
            if kept:
                yield from table.take(kept[:-1]).to_batches()
                held = table.take(kept[-1:]).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "pos", "score").mapInArrow(run, rows.schema)


def contents(docs: DataFrame) -> DataFrame:
    """(doc_id, k, title, page, level): entries of a table of contents, up to two lines in a row that are none.

    The table begins after a line 'Contents' in the first 10,000 characters. An
    entry has dotted leaders, a page number, a structural word or a lone numeral;
    'Chapter a: to b' stands for that range.
    """
    line = F.col("line")
    rows = lines(docs.select("doc_id", F.substring("text", 1, 10_000).alias("text")))
    heads = rows.where(line.rlike(r"^\s*(?i:table of contents|contents)\s*$")).groupBy("doc_id").agg(F.min("ln").alias("head"))
    rows = rows.join(heads, "doc_id").where((F.col("ln") > F.col("head")) & (F.trim("line") != ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(line, r"\.{2,}|…+", "  "), r"\s+", " "))
    page = F.try_to_number(F.nullif(F.regexp_extract(bare, r"\s(\d+)$", 1), F.lit("")), F.lit("999999")).cast("int")
    title = F.trim(F.regexp_replace(bare, r"\s\d+$", ""))
    lone = title.rlike("^[IVXLCDM]+$") | (title.rlike(r"^\d{1,3}$") & (F.expr("try_cast(regexp_extract(trim(line), '^([0-9]{1,3})$', 1) as int)") <= 200))
    entry = (line.rlike(r"\.{2,}|…") | page.isNotNull() | title.rlike(TOC_WORD) | F.coalesce(lone, F.lit(False))) & (F.length(title) <= 100) & ((F.length(title) >= 2) | title.rlike("^[IVXLCDM]$"))
    rows = rows.select("doc_id", "ln", title.alias("title"), page.alias("page"), F.when(line.rlike(r"^\s{4,}"), 2).otherwise(1).alias("level"), entry.alias("entry"))
    order = W.partitionBy("doc_id").orderBy("ln")
    twice = ~F.col("entry") & ~F.coalesce(F.lag("entry").over(order), F.lit(True))
    before = F.max(twice.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    kept = rows.withColumn("ended", before).where("ended = 0 and entry")
    first, last = (F.expr(f"try_cast(regexp_extract(title, '(?i)^chapter [ ]*([0-9]+) *: *to ([0-9]+)$', {g}) as int)") for g in (1, 2))
    span = F.when(first.isNotNull() & (first > 0) & (first <= last) & (last - first < 200), F.transform(F.sequence(first, last), lambda n: F.struct(F.concat(F.lit("Chapter "), n.cast("string")).alias("title"), F.when(n == first, F.col("page")).alias("page"))))
    rows = kept.select("doc_id", "ln", "level", F.posexplode(F.coalesce(span, F.array(F.struct("title", "page")))).alias("j", "x"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("ln", "j"))
    return rows.select("doc_id", number.alias("k"), "x.title", "x.page", "level")


def segmented(words: DataFrame, unigrams: DataFrame, most_words: int = 200_000) -> DataFrame:
    """(word, parts): words run together, parted where the product of unigram (word, n) probabilities is greatest.

    The most_words most frequent unigrams are held by every task: a bound on the
    table, not on the words that are parted. Unknown parts cost by their length.
    """
    ship(words.sparkSession)
    rows = unigrams.orderBy(F.desc("n"), "word").limit(most_words).collect()
    table = words.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in rows})

    def part(word: str, counts: dict[str, int], total: float) -> str:
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = []
            for start in range(max(0, end - 24), end):
                n = counts.get(word[start:end])
                cost = math.log(n / total) if n else math.log(10 / total) - 2.3 * (end - start)
                options.append((best[start][0] + cost, start))
            best.append(max(options))
        cuts, end = [], len(word)
        while end:
            cuts.append(word[best[end][1] : end])
            end = best[end][1]
        return " ".join(reversed(cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        total = float(max(1, sum(counts.values())))
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part(w, counts, total) for w in own], pa.string())], names=["word", "parts"])

    return words.where("word is not null").select("word").distinct().mapInArrow(run, "word string, parts string")
