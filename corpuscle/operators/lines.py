"""Lines, spans and the structure that hangs on them: breaks, headings, chapters, paragraphs, chunks.

Positions are 0-based, half-open character offsets into the text. Everything is
keyed by doc_id; a null text has no lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.plans.ship import ship

# --- fixed values -----------------------------------------------------------
SCENE_BREAK = r"^\s*[-=*~.]{3,}\s*$|^\s*\*\s*\*\s*\*\s*$"
_NUMBER = "One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten|Eleven|Twelve|Thirteen|Fourteen|Fifteen|Sixteen|Seventeen|Eighteen|Nineteen|Twenty"
#: Headings in order of precedence: kind, pattern, confidence, if it always is a boundary.
HEADINGS = [
    ("chapter", rf"^\s*(?i:chapter)\s+(\d+|[IVXLCivxlc]+|(?i:{_NUMBER}))\b.*$", 0.95, True),
    ("part", rf"^\s*(?i:part)\s+(\d+|[IVXLC]+|(?i:{_NUMBER}))\b.*$", 0.9, True),
    ("roman_centered", r"^\s{10,}[IVXLC]+\s*$", 0.85, True),
    ("roman_period", r"^\s*[IVXLC]+\.\s*$", 0.9, True),
    ("roman", r"^\s*[IVXLC]{2,7}\s*$", 0.7, False),
    ("arabic_centered", r"^\s{10,}\d{1,3}\s*$", 0.75, True),
    ("special", r"^\s*(?i:prologue|epilogue|introduction|preface|foreword|afterword|appendix|acknowledgments|dedication|notes|glossary|interlude|intermezzo)\s*$", 0.95, True),
    ("letter", rf"^\s*(?i:letter)\s+(\d+|[IVXLC]+|(?i:{_NUMBER}))\b.*$", 0.95, True),
    ("book", rf"^\s*(?i:book)\s+(\d+|[IVXLC]+|(?i:{_NUMBER}))\b.*$", 0.95, True),
    ("capitals", r"^\s*[A-Z][A-Z\s]{5,40}\s*$", 0.6, False),
]
#: Words of a page that mark its front or back matter: label, pattern, confidence, side.
MATTER = [
    ("copyright_page", r"(?i)^\s*(copyright|©|copr\.)\s*(\d{4}|by)", 0.95, "front"),
    ("copyright_page", r"(?i)^\s*all\s+rights\s+reserved", 0.95, "front"),
    ("isbn_page", r"(?i)^\s*ISBN[\s:\-]*[\d\-X]{10,}", 0.95, "front"),
    ("table_of_contents", r"(?i)^\s*(table\s+of\s+contents|contents)\s*$", 0.95, "front"),
    ("dedication", r"(?i)^\s*dedication\s*$", 0.85, "front"),
    ("preface", r"(?i)^\s*(preface|foreword|introduction)\s*$", 0.8, "front"),
    ("about_author", r"(?i)^\s*about\s+the\s+author", 0.95, "back"),
    ("also_by", r"(?i)^\s*(also\s+by|other\s+(books?|works?)\s+by)", 0.95, "back"),
    ("reading_guide", r"(?i)^\s*discussion\s+questions", 0.95, "back"),
    ("appendix", r"(?i)^\s*(appendix|appendices)\s*(:|$)", 0.85, "back"),
    ("glossary", r"(?i)^\s*glossary(\s+of\s+.+|\s*:|\s*)$", 0.9, "back"),
    ("index", r"(?i)^\s*index\s*$", 0.9, "back"),
    ("endnotes", r"(?i)^\s*(notes|endnotes|references|bibliography)\s*$", 0.85, "back"),
]
#: Glossary line forms in order of preference: method, pattern, confidence.
GLOSSARY = [
    ("colon", r"^\s*([A-Z][\w\s'-]{1,40}):\s+(.{10,})$", 0.9), ("dash", r"^\s*([A-Z][\w\s'-]{1,40})\s+[-–—]\s+(.{10,})$", 0.85),
    ("bold", r"^\s*\*\*([^*]{2,40})\*\*[:\s]+(.{10,})$", 0.8),
]
#: Rows and characters of the last column in a batch from a worker.
BLOCK, BLOCK_CHARS = 10_000, 1_000_000
WORD = "[A-Za-zÀ-ÖØ-öø-ÿ]+(?:[-'][A-Za-zÀ-ÖØ-öø-ÿ]+)*"
# ----------------------------------------------------------------------------


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ln, off, line): every line with its number from 0 and its offset."""

    def found(text: str) -> Iterator[tuple]:
        at = k = 0
        while True:
            end = text.find("\n", at)
            yield k, at, text[at : end if end >= 0 else len(text)]
            if end < 0:
                return
            k, at = k + 1, end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((doc, *x) for doc, text in _each(batches) for x in found(text))
        return _blocks(rows, ("doc_id", "ln", "off", "line"), (pa.int64(), pa.int32(), pa.int32(), pa.string()))

    return _texts(docs).mapInArrow(run, "doc_id long, ln int, off int, line string")


def spans(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, pos, form): every match of a Python pattern with its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).finditer
        rows = ((doc, m.start(), m[0]) for doc, text in _each(batches) for m in find(text))
        return _blocks(rows, ("doc_id", "pos", "form"), (pa.int64(), pa.int32(), pa.string()))

    return _texts(docs).mapInArrow(run, "doc_id long, pos int, form string")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, text) one by one, so that a worker holds one text as a string beside Arrow's batch."""
    for batch in batches:
        for doc, text in zip(*batch.columns, strict=True):
            yield doc.as_py(), text.as_py()


def _blocks(rows: Iterator[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of BLOCK, however many a text has, or fewer where their last column has over BLOCK_CHARS characters."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if len(held) >= BLOCK or size >= BLOCK_CHARS:
            yield _batch(held, names, kinds)
            held, size = [], 0
    if held:
        yield _batch(held, names, kinds)


def _texts(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _batch(rows: list[tuple], names: tuple[str, ...], kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def scene_breaks(docs: DataFrame) -> DataFrame:
    """(doc_id, ln, start, end): lines that are scene breaks; ln counts from 1."""
    found = lines(docs).where(F.col("line").rlike(SCENE_BREAK))
    return found.select("doc_id", (F.col("ln") + 1).alias("ln"), F.col("off").alias("start"), (F.col("off") + F.length("line")).alias("end"))


def near_break(positions: DataFrame, breaks: DataFrame, threshold: int = 100) -> DataFrame:
    """positions (doc_id, pos) with near: if a break's start or end is nearer than threshold (by cells, not all pairs)."""
    cell = lambda c: F.floor(c / threshold).cast("long")
    edges = breaks.select("doc_id", F.explode(F.array("start", "end")).alias("edge"))
    edges = edges.select("doc_id", "edge", F.explode(F.sequence(cell(F.col("edge")) - 1, cell(F.col("edge")) + 1)).alias("cell"))
    close = positions.withColumn("cell", cell(F.col("pos"))).join(edges, ["doc_id", "cell"]).where(F.abs(F.col("pos") - F.col("edge")) < threshold)
    return positions.join(close.select("doc_id", "pos").distinct().withColumn("near", F.lit(True)), ["doc_id", "pos"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def _first_match(line: Column, rules: list[tuple], value: int) -> Column:
    out = F.lit(None)
    for rule in reversed(rules):
        out = F.when(line.rlike(rule[1]), F.lit(rule[value])).otherwise(out)
    return out


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, start, kind, title, confidence, hard): lines that match a heading form, the first form that fits."""
    line = F.col("line")
    found = lines(docs).where(line.rlike("|".join(r[1] for r in HEADINGS)))
    kinds = [_first_match(line, HEADINGS, i).alias(n) for n, i in (("kind", 0), ("confidence", 2), ("hard", 3))]
    return found.select("doc_id", F.col("off").alias("start"), kinds[0], F.trim(F.regexp_replace(line, r"\s+", " ")).alias("title"), *kinds[1:])


def spaced(found: DataFrame, gap: int = 50) -> DataFrame:
    """Headings without those that begin less than gap after the one before them."""
    order = W.partitionBy("doc_id").orderBy("start")
    return found.withColumn("_before", F.lag("start").over(order)).where(F.col("_before").isNull() | (F.col("start") - F.col("_before") >= gap)).drop("_before")


def chapters(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, idx, title, start, end, words): each heading's text up to the next one, numbered from 1."""
    order = W.partitionBy("doc_id").orderBy("start")
    bounds = found.select("doc_id", "title", "start", F.row_number().over(order).alias("idx"), F.lead("start").over(order).alias("next"))
    bounds = bounds.join(docs.select("doc_id", "text"), "doc_id")  # after the window, which would sort a text for each heading
    bounds = bounds.withColumn("end", F.coalesce("next", F.length("text")))
    body = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return bounds.select("doc_id", "idx", "title", "start", "end", F.size(F.filter(F.split(body, r"\s+"), lambda w: w != "")).alias("words"))


def size_verdicts(parts: DataFrame) -> DataFrame:
    """chapters with a verdict on their size: small (under a fifth of the mean and 500 words), large (over thrice the mean), ok."""
    mean, n = F.avg("words").over(W.partitionBy("doc_id")), F.count("*").over(W.partitionBy("doc_id"))
    small = (n >= 2) & (F.col("words") < 0.2 * mean) & (F.col("words") < 500)
    verdict = F.when(small, "small").when((n >= 2) & (F.col("words") > 3 * mean), "large").otherwise("ok")
    return parts.withColumn("verdict", verdict)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, start, end): runs of lines that aren't blank, numbered from 0."""
    order = W.partitionBy("doc_id").orderBy("ln")
    solid = lines(docs).withColumn("blank", F.trim(F.regexp_replace("line", r"\s", "")) == "")
    indent = F.col("line").rlike(r"^[ \t]{2,}")
    head = ~F.col("blank") & (F.coalesce(F.lag("blank").over(order), F.lit(True)) | indent)
    run = F.sum(head.cast("int")).over(order)
    kept = solid.withColumn("run", run).where(~F.col("blank"))
    found = kept.groupBy("doc_id", "run").agg(F.min("off").alias("start"), F.max(F.col("off") + F.length("line")).alias("end"))
    return found.select("doc_id", (F.col("run") - 1).cast("int").alias("idx"), "start", "end")


def chunks(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, k, start, chunk): windows of size characters that overlap."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size - overlap))
    rows = docs.where("text is not null").select("doc_id", "text", F.posexplode(starts).alias("k", "start"))
    return rows.select("doc_id", "k", "start", F.substr("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


def matter(docs: DataFrame) -> DataFrame:
    """(doc_id, label, side, start, confidence): the first line of each front and back matter label.

    Front matter is looked for in the first tenth (20,000 characters at most),
    back matter in the last 45 per cent.
    """
    line, size = F.col("line"), F.col("size")
    rows = lines(docs).join(docs.select("doc_id", F.length("text").alias("size")), "doc_id")
    out = None
    for side, here in (("front", F.col("off") < F.least(F.floor(size / 10), F.lit(20_000))), ("back", F.col("off") >= F.floor(size * 0.55))):
        rules = [m for m in MATTER if m[3] == side]
        kept = rows.where(here & line.rlike("|".join(f"(?:{r[1]})" for r in rules)))
        part = kept.select("doc_id", _first_match(line, rules, 0).alias("label"), F.lit(side).alias("side"), F.col("off").alias("start"), _first_match(line, rules, 2).alias("confidence"))
        part = part.groupBy("doc_id", "label", "side").agg(F.min("start").alias("start"), F.min_by("confidence", "start").alias("confidence"))
        out = part if out is None else out.unionByName(part)
    return out


def glossary(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, term, definition, method): lines of the first form that at least that many lines of a text have."""
    rows, out = lines(docs), None
    for rank, (method, pattern, _) in enumerate(GLOSSARY):
        part = rows.where(F.col("line").rlike(pattern)).select(
            "doc_id", F.trim(F.regexp_extract("line", pattern, 1)).alias("term"), F.trim(F.regexp_extract("line", pattern, 2)).alias("definition"), F.lit(method).alias("method"), F.lit(rank).alias("rank")
        )
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("doc_id", "rank").count().where(F.col("count") >= least).groupBy("doc_id").agg(F.min("rank").alias("rank"))
    return out.join(best, ["doc_id", "rank"]).drop("rank")


def word_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, ln, k, form, word): the words of each line in order; word is in lower case."""
    rows = lines(docs).select("doc_id", "ln", F.posexplode(F.regexp_extract_all("line", F.lit(f"({WORD})"), 1)).alias("k", "form"))
    return rows.withColumn("word", F.lower("form"))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, form, word): every word with its offset; word is in lower case."""
    return spans(docs, WORD).withColumn("word", F.lower("form"))


def words(docs: DataFrame) -> DataFrame:
    """(doc_id, form, word): every word without its offset, inside the JVM; word is in lower case."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)).alias("form"))
    return rows.withColumn("word", F.lower("form"))


def in_spans(positions: DataFrame, ranges: DataFrame, value: str, default: Column | None = None) -> DataFrame:
    """positions (doc_id, pos, ...) with the value of the span (doc_id, start, end, value) that holds pos.

    Spans of one document don't overlap, so the latest start at or before pos
    decides: an as-of join by one sorted window, linear in both sides.
    """
    at = ranges.select("doc_id", F.col("start").alias("pos"), F.lit(0).alias("_side"), F.struct("end", value).alias("_span"))
    rows = positions.withColumns({"_side": F.lit(1)}).unionByName(at, allowMissingColumns=True)
    order = W.partitionBy("doc_id").orderBy("pos", "_side").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_span", F.last("_span", ignorenulls=True).over(order)).where("_side = 1")
    inside = F.when(F.col("pos") < F.col("_span.end"), F.col(f"_span.{value}"))
    return rows.withColumn(value, F.coalesce(inside, default) if default is not None else inside).drop("_side", "_span")


def word_index(docs: DataFrame, ranges: DataFrame, value: str, default: object = None) -> DataFrame:
    """(doc_id, value, n, first_pos, word): how often and where first each word stands in the spans (doc_id, start, end, value) of a value.

    What postings and in_spans give, counted text by text: the spans go to their text,
    so no word is shuffled or sorted. Spans of one document don't overlap; default is
    the value outside of all. A doc_id is one text; word is in lower case.
    """
    kind = ranges.schema[value].dataType
    held = ranges.where("start is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("start", "end", F.col(value).alias("value")).alias("span"))
    held = held.groupBy("doc_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD).finditer

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc, text, spans in zip(*batch.columns, strict=True):
                    ahead = [(x["start"], x["end"], x["value"]) for x in reversed(spans.as_py() or [])]
                    counts: dict[tuple, list[int]] = {}
                    end, now = None, default
                    for m in find(text.as_py()):
                        pos = m.start()
                        while ahead and ahead[-1][0] <= pos:
                            _, end, now = ahead.pop()
                        inside = end is not None and pos < end and now is not None
                        seen = counts.setdefault((now if inside else default, m[0].lower()), [0, pos])
                        seen[0] += 1
                    key = doc.as_py()
                    yield from ((key, v, n, first, word) for (v, word), (n, first) in counts.items())

        return _blocks(rows(), ("doc_id", value, "n", "first_pos", "word"), (pa.int64(), to_arrow_type(kind), pa.int64(), pa.int32(), pa.string()))

    return _texts(docs).join(held, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id long, `{value}` {kind.simpleString()}, n long, first_pos int, word string")


def islands(ranges: DataFrame, gap: int = 100) -> DataFrame:
    """Spans (doc_id, start, end, label, confidence) merged where they begin at most gap after the ones before; the surest label stays."""
    order = W.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    head = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    runs = ranges.withColumn("head", head).withColumn("run", F.sum("head").over(order.rowsBetween(W.unboundedPreceding, 0)))
    best = F.max_by("label", F.struct("confidence", -F.col("start"), "label"))
    return runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("label"), F.max("confidence").alias("confidence")).drop("run")
