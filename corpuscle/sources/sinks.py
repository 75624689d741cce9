"""Exports: canonical Markdown, narrator guides, HTML reports, JSON artifacts and the stage cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_markdown(docs: DataFrame, chapters: DataFrame) -> DataFrame:
    """(doc_id, markdown): a header of title and author, then each chapter under its title."""
    body = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    parts = chapters.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "start", F.concat(F.lit("## "), "title", F.lit("\n\n"), F.trim(body)).alias("md"))
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "md"))).alias("p"))
    return joined.select("doc_id", F.concat(F.lit("---\ndoc_id: "), F.col("doc_id").cast("string"), F.lit("\n---\n\n"), F.array_join(F.transform("p", lambda x: x["md"]), "\n\n")).alias("markdown"))


def narrator_guide(entries: DataFrame) -> DataFrame:
    """(flag, n, markdown): pronunciation entries (word, flag, n, priority) as a list for each flag, the most frequent first."""
    line = F.concat(F.lit("- "), "word", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("k"), "word", line.alias("line"))))
    rows = entries.groupBy("flag").agg(F.count("*").alias("n"), order.alias("x"))
    return rows.select("flag", "n", F.concat(F.lit("## "), "flag", F.lit("\n"), F.array_join(F.transform("x", lambda e: e["line"]), "\n")).alias("markdown"))


def html_escaped(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(html): a table row for each row, its columns escaped."""
    cells = [F.concat(F.lit("<td>"), html_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return rows.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def chapter_class(title: Column) -> Column:
    """prologue, title_page or main by a chapter's title."""
    low = F.lower(F.trim(title))
    return F.when(low.rlike("^(prologue|preface|introduction|foreword)"), "prologue").when(low.rlike("title page|copyright|dedication|contents"), "title_page").otherwise("main")


def duration_text(seconds: Column) -> Column:
    """Seconds as '2m 34s'."""
    return F.when(seconds < 60, F.concat(F.round(seconds).cast("int").cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds % 60).cast("string"), F.lit("s")))


def save_artifacts(rows: DataFrame, path: str) -> None:
    """Rows as JSON documents without the raw text."""
    rows.drop("raw_text", "text").write.mode("overwrite").json(path)


def save_stage(rows: DataFrame, path: str, stage: str) -> None:
    """Rows (text, ...) into the stage cache under the key of their text."""
    keyed = rows.withColumns({"key": F.substring(F.sha1(F.col("text").cast("binary")), 1, 12), "stage": F.lit(stage)})
    keyed.drop("text").write.mode("append").partitionBy("stage").parquet(path)


def cached(docs: DataFrame, cache: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(documents whose stage is in the cache joined with it, documents that are still to do)."""
    keyed = docs.withColumn("key", F.substring(F.sha1(F.col("text").cast("binary")), 1, 12))
    held = cache.where(F.col("stage") == stage).drop("stage").dropDuplicates(["key"])
    return keyed.join(held, "key"), keyed.join(held.select("key"), "key", "left_anti").select(*docs.columns)
