"""Checks and shaping of what a corpus run has found: lines, names, glossary terms, summaries, profiles, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import cast as C
from corpuscle.operators import lines as L
from corpuscle.operators import mentions as M

# ---- fixed values -----------------------------------------------------------
METADATA = (
    "copyright", "published", "edition", "isbn", "all rights", "reserved", "author", "introduction", "foreword", "preface",
    "acknowledgments", "acknowledgements", "dedication", "translator", "editor", "illustrated", "written by", "project gutenberg",
    "ebook", "e-book", "transcriber", "produced by", "cover image", "frontispiece", "title page", "half title", "bibliography",
    "index", "appendix", "glossary", "notes", "about the author", "annotation", "dramatis personae", "the end",
)
GROUPS = (
    "personnel", "perps", "perpetrators", "witnesses", "soldiers", "troops", "men", "women", "children", "villagers", "townsfolk",
    "guards", "crowd", "mob", "company", "platoon", "squad", "battalion", "regiment", "brigade", "crew", "team", "staff", "others",
    "people", "family", "group", "guests", "servants", "officers", "attendees",
)
# -----------------------------------------------------------------------------


def metadata_line(line: Column) -> Column:
    """If a line of a table of contents is about the book and no entry: a word of METADATA, an address, a year, prose, bare numbers."""
    low = F.lower(F.trim(line))
    named = low.rlike("|".join(map(re.escape, METADATA))) | (low.startswith("by ") & (F.length(line) > 5))
    address = low.contains("http") | line.contains("@") | low.contains("www.")
    year = line.rlike(r"\b(19|20)[0-9]{2}\b")
    long = F.length(F.regexp_replace(line, r"\.{2,}|…+", " ")) > 80
    numbers = line.rlike(r"^[\d\s.\-]+$") & (low != "")
    return named | address | year | long | numbers


def title_case_tokens(text: Column) -> Column:
    """If every token with a letter begins with a capital, and there is one."""
    tokens = F.filter(T.words(text), lambda w: w.rlike(r"\p{L}"))
    return (F.size(tokens) > 0) & F.forall(tokens, lambda w: w.rlike(r"^\p{Lu}"))


def ordinary(text: Column, known: Column) -> Column:
    """If every token of letters alone is in an array of ordinary words, and there is one."""
    tokens = F.filter(T.words(F.lower(text)), lambda w: w.rlike(r"^\p{L}+$"))
    return (F.size(tokens) > 0) & F.forall(tokens, lambda w: F.array_contains(known, w))


def group_descriptor(name: Column) -> Column:
    """If a name stands for a group: its last word is a group, or one of three words or more is; leading titles don't count."""
    clean = F.transform(T.words(name), lambda w: F.lower(F.regexp_replace(w, r"^[,.()'\"]+|[,.()'\"]+$", "")))
    core = F.filter(clean, lambda w, i: F.exists(F.slice(clean, 1, i + 1), lambda x: ~x.isin(*C.TITLES, *C.STOPS)))
    return (F.size(core) > 0) & (F.try_element_at(core, F.lit(-1)).isin(*GROUPS) | ((F.size(core) >= 3) & F.exists(core, lambda w: w.isin(*GROUPS))))


def glossary_term(term: Column) -> Column:
    """A headword without a closing parenthesis, or null where it is none: no letter, an address, a sentence, over four words."""
    clean = F.trim(F.regexp_replace(term, r"\s*\([^)]*\)\s*$", ""))
    odd = ~clean.rlike(r"\p{L}") | clean.rlike(r"(?i)https?://|www\.|\.(com|net|org|edu|gov)\b") | clean.rlike(r"\.\s+\S") | (F.size(T.words(clean)) > 4)
    return F.when(~odd, clean)


def glossary_aliases(term: Column) -> Column:
    """The parts of a list with commas if each has one or two words, else the term alone; null for null."""
    parts = F.filter(F.transform(F.split(term, ","), lambda p: F.trim(p)), lambda p: p != "")
    listed = term.contains(",") & (F.size(parts) >= 2) & F.forall(parts, lambda p: F.size(T.words(p)) <= 2)
    return F.when(listed, parts).when(term.isNotNull(), F.array(term))


def by_letter(entries: DataFrame) -> DataFrame:
    """(book, letter, terms) of (book, term): terms in order under their capital, # for what begins with no letter."""
    first = F.upper(F.substring("term", 1, 1))
    letter = F.when(first.rlike(r"^\p{L}"), first).otherwise("#").alias("letter")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("term").alias("k"), "term"))), lambda x: x["term"])
    return entries.groupBy("book", letter).agg(listed.alias("terms"))


def summary_issues(chapters: DataFrame) -> DataFrame:
    """(book, chapter, check, severity) of (book, chapter, n_words, summary, n_events); null counts as empty.

    A summary of under 20 characters is an error, one of under 100 for more than
    2,000 words a warning; more than 1,000 words without a key event are a warning,
    more than 3,000 with one of them a note.
    """
    size = F.length(F.coalesce("summary", F.lit("")))
    bare = (F.length(F.trim(F.coalesce("summary", F.lit("")))) < 20, "summary", "error")
    short = ((F.col("n_words") > 2000) & (size < 100), "summary", "warning")
    none = ((F.col("n_words") > 1000) & (F.coalesce("n_events", F.lit(0)) == 0), "events", "warning")
    few = ((F.col("n_words") > 3000) & (F.col("n_events") == 1), "events", "info")

    def first_of(*rules: tuple[Column, str, str]) -> Column:
        out = F.lit(None).cast("struct<check:string,severity:string>")
        for rule, check, severity in reversed(rules):
            out = F.when(rule, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"))).otherwise(out)
        return out

    found = F.explode(F.filter(F.array(first_of(bare, short), first_of(none, few)), lambda x: x.isNotNull())).alias("x")
    return chapters.select("book", "chapter", found).select("book", "chapter", "x.check", "x.severity")


def single_tones(chapters: DataFrame) -> DataFrame:
    """(book, tone, n) of books of more than five chapters (book, tone) that all have one tone."""
    tones = chapters.groupBy("book").agg(F.count("*").alias("n"), F.min("tone").alias("tone"), F.max("tone").alias("other"), F.count("tone").alias("known"))
    return tones.where("n > 5 and known = n and tone = other").select("book", "tone", "n")


def completeness(summary: Column, personality: Column, voice: Column, n_relations: Column, n_aliases: Column, n_chapters: Column) -> Column:
    """How complete a profile is: a point for each text, half for relations, a fifth an alias, a tenth a chapter."""
    texts = [F.when(F.coalesce(c, F.lit("")) != "", 1.0).otherwise(0.0) for c in (summary, personality, voice)]
    counts = F.coalesce(n_aliases, F.lit(0)) * 0.2 + F.coalesce(n_chapters, F.lit(0)) * 0.1
    return texts[0] + texts[1] + texts[2] + F.when(n_relations > 0, 0.5).otherwise(0.0) + counts


def temperatures(n: Column, low: float = 0.5, high: float = 0.9) -> Column:
    """n values evenly from low to high; the middle for one."""
    spread = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lit(low) + i * (F.lit(high - low) / (n - 1)))
    return F.when(n == 1, F.array(F.lit((low + high) / 2))).when(n > 1, spread).otherwise(F.array().cast("array<double>"))


def lastname_matches(name: Column, lastname: Column, threshold: float = 0.85) -> Column:
    """If the last word of a name is as similar to a last name as the threshold; never with an empty side."""
    last = F.try_element_at(T.words(name), F.lit(-1))
    return F.coalesce((F.trim(name) != "") & (lastname != "") & (M.similarity(last, lastname) >= threshold), F.lit(False))


def packed_sentences(text: str, size: int, overlap: int) -> Iterator[str]:
    """Chunks of whole sentences of about size words; each begins with the last sentences of the one before that reach overlap words."""
    held: list[tuple[str, int]] = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        n = len(sentence.split())
        if held and sum(k for _, k in held) + n > size:
            yield " ".join(s for s, _ in held)
            back, total = len(held), 0
            while back and total < overlap or back == len(held):
                back -= 1
                total += held[back][1]
            held = held[back:]
        held.append((sentence, n))
    yield " ".join(s for s, _ in held)


def sentence_chunks(docs: DataFrame, size: int = 2500, overlap: int = 200) -> DataFrame:
    """(doc_id, chunk, n_words, content) of (doc_id, text): sections between scene breaks, long ones cut between sentences.

    A section of up to a fifth more than size words stays whole where there are
    scene breaks; a text without them is packed into sentences as it is. Empty and
    null texts have no chunks. Texts are independent of each other.
    """
    rows = pa.schema([("doc_id", pa.int64()), ("chunk", pa.int32()), ("n_words", pa.int64()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, breaks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sections, at = [], 0
                for b in sorted(breaks or [], key=lambda b: b["start"]):
                    sections.append(text[at : b["start"]].strip())
                    at = b["end"]
                if at:
                    sections = [s for s in [*sections, text[at:].strip()] if s]
                    chunks = [c for s in sections for c in (packed_sentences(s, size, overlap) if len(s.split()) > size * 1.2 else [s])]
                else:
                    chunks = list(packed_sentences(text, size, overlap)) if text else []
                counts = [len(c.split()) for c in chunks]
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array(counts, pa.int64()), pa.array(chunks, pa.string())], schema=rows)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    breaks = L.scene_breaks(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("breaks"))
    return docs.join(breaks, "doc_id", "left").mapInArrow(run, "doc_id long, chunk int, n_words long, content string")
