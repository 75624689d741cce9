"""Registered queries over events, exports and inference, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import lines as L
from corpuscle.operators import scorer
from corpuscle.plans.registry import Registry
from corpuscle.plans.text_queries import BOOKS, LINES, _CHAPTERS, _chapters, books, documents
from corpuscle.sources import sinks
from corpuscle.streaming import live

R = Registry()


def events(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet")


_TIME = "yyyy-MM-dd HH:mm:ss"
R.add(
    "events_windows",
    lambda s, d: live.windowed(events(s, d)).select(F.date_format("start", _TIME).alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
    "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)
R.add(
    "events_sliding",
    lambda s, d: live.sliding(events(s, d)).select(F.date_format("start", _TIME).alias("start"), "n", "users"),
    "SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY 1",
)
R.add(
    "events_sessions",
    lambda s, d: live.sessions(events(s, d)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest")),
    """WITH f AS (SELECT user_id, ts, CASE WHEN coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) THEN 1 ELSE 0 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    g AS (SELECT user_id, sum(head) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f), n AS (SELECT user_id, k, count(*) AS n FROM g GROUP BY 1, 2)
    SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events, max(n) AS longest FROM n GROUP BY 1""",
)
R.add(
    "latest_values",
    lambda s, d: live.latest(events(s, d).select("user_id", "event_type", "ts", "value", "event_id"), ["user_id", "event_type"]).select("user_id", "event_type", "value", "event_id"),
    "SELECT user_id, event_type, first(value ORDER BY ts DESC, value DESC, event_id DESC) AS value, first(event_id ORDER BY ts DESC, value DESC, event_id DESC) AS event_id FROM events GROUP BY 1, 2",
)
R.add(
    "heartbeat_age",
    lambda s, d: events(s, d).select("event_id", (F.unix_timestamp(F.lit("2024-02-01 00:00:00")) - F.unix_timestamp("ts")).alias("age"), live.fresh(F.lit("2024-01-02 00:00:00").cast("timestamp"), F.col("ts")).alias("fresh")),
    "SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts)) AS BIGINT) AS age, epoch(TIMESTAMP '2024-01-02 00:00:00') - floor(epoch(ts)) <= 300 AS fresh FROM events",
)
R.add(
    "stage_progress",
    lambda s, d: live.progress(events(s, d).select(F.concat(F.lit("stage "), (F.col("user_id") % 20).cast("string")).alias("stage"), "ts", (F.col("event_id") % 97).alias("done"), F.lit(97).alias("total"))),
    "SELECT stage, done, 97 AS total, round(done / 97, 6) AS share FROM (SELECT 'stage ' || (user_id % 20) AS stage, first(event_id % 97 ORDER BY ts DESC, event_id % 97 DESC) AS done FROM events GROUP BY 1)",
)
R.add(
    "canonical_markdown",
    lambda s, d: sinks.canonical_markdown(books(s, d), _chapters(s, d)).select("doc_id", F.md5("markdown").alias("digest"), F.length("markdown").alias("n")),
    f"""WITH {BOOKS}, {LINES}, {_CHAPTERS}, m AS (SELECT c.doc_id, E'---\\ndoc_id: ' || c.doc_id || E'\\n---\\n\\n' || string_agg('## ' || title || E'\\n\\n' || trim(substr(text, start + 1, "end" - start)), E'\\n\\n' ORDER BY start) AS x FROM c JOIN books USING (doc_id) GROUP BY 1)
    SELECT doc_id, md5(x) AS digest, CAST(length(x) AS INTEGER) AS n FROM m""",
)
R.add(
    "html_report_rows",
    lambda s, d: sinks.html_rows(_chapters(s, d).select("doc_id", F.concat("title", F.lit(" <&>")).alias("title"), "words"), ["doc_id", "title", "words"]),
    f"""WITH {BOOKS}, {LINES}, {_CHAPTERS} SELECT '<tr><td>' || doc_id || '</td><td>' || title || ' &lt;&amp;&gt;</td><td>' || words || '</td></tr>' AS html FROM c""",
)
R.add(
    "chapter_classes",
    lambda s, d: _chapters(s, d).select("doc_id", "idx", sinks.chapter_class(F.when(F.col("idx") == 1, "Prologue").when(F.col("idx") == 2, "Copyright notice").otherwise(F.col("title"))).alias("class"), sinks.duration_text(F.col("words") * 0.4).alias("duration")),
    f"""WITH {BOOKS}, {LINES}, {_CHAPTERS} SELECT doc_id, idx, CASE idx WHEN 1 THEN 'prologue' WHEN 2 THEN 'title_page' ELSE 'main' END AS class,
    CASE WHEN words * 0.4 < 60 THEN CAST(CAST(round(words * 0.4) AS INTEGER) AS VARCHAR) || 's' ELSE CAST(CAST(floor(words * 0.4 / 60) AS INTEGER) AS VARCHAR) || 'm ' || CAST(CAST(floor(words * 0.4 % 60) AS INTEGER) AS VARCHAR) || 's' END AS duration FROM c""",
)


def _replies(s: SparkSession, d: str) -> DataFrame:
    return scorer.scored(documents(s, d).select(F.col("doc_id").alias("id"), F.col("text").alias("prompt")), scorer.offline)


R.add(
    "scored_replies",
    lambda s, d: _replies(s, d).select("id", F.from_json("reply", "valid boolean, confidence double, words int").alias("x"), "error").select("id", "x.valid", "x.confidence", "error"),
    "SELECT doc_id AS id, length(text) >= 40 AS valid, round(least(1.0, length(text) / 1000), 3)::DOUBLE AS confidence, NULL::VARCHAR AS error FROM documents",
)


def _broken() -> Column:
    return F.concat(F.lit('Sure! ```json\n{id: '), F.col("doc_id").cast("string"), F.lit(', "ok": True, "n": None,}\n``` done'))


R.add(
    "json_repair",
    lambda s, d: documents(s, d).select("doc_id", F.from_json(T.json_candidate(_broken()), "id long, ok boolean, n int").alias("x")).select("doc_id", "x.id", "x.ok", "x.n"),
    "SELECT doc_id, doc_id AS id, true AS ok, NULL::INTEGER AS n FROM documents",
)
R.add(
    "without_thinking",
    lambda s, d: documents(s, d).select("doc_id", F.md5(T.without_thinking(F.concat(F.lit("<think>let me\nsee</think> "), F.col("text"), F.when(F.col("doc_id") % 2 == 0, " <think>and then").otherwise("")))).alias("digest")),
    "SELECT doc_id, md5(trim(text)) AS digest FROM documents",
)
R.add(
    "front_back_matter",
    lambda s, d: L.matter(books(s, d).select("doc_id", F.concat(F.lit("Copyright 1901 by X\nContents\n\n"), "text", F.lit("\nAbout the author\nIndex\n")).alias("text"))),
    None,
)
R.add(
    "merged_regions",
    lambda s, d: L.islands(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_orderkey") * 61 + F.col("l_linenumber")).alias("start"), (F.col("l_orderkey") * 61 + F.col("l_linenumber") + 30 + F.col("l_suppkey") % 90).alias("end"), F.concat(F.lit("r"), (F.col("l_partkey") % 9).cast("string")).alias("label"), (F.col("l_quantity") / 50).alias("confidence"))),
    """WITH x AS (SELECT l_orderkey % 100 AS doc_id, l_orderkey * 61 + l_linenumber AS start, l_orderkey * 61 + l_linenumber + 30 + l_suppkey % 90 AS e, 'r' || (l_partkey % 9) AS label, l_quantity / 50 AS confidence FROM lineitem),
    m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT doc_id, min(start) AS start, max(e) AS "end", first(label ORDER BY confidence DESC, start, label DESC) AS label, max(confidence) AS confidence FROM g GROUP BY doc_id, run""",
)
R.add(
    "glossary_entries",
    lambda s, d: L.glossary(documents(s, d).select("doc_id", F.concat(F.col("text"), F.lit("\nAardvark: a burrowing animal\nBaroque: an ornate style of art\nCadence: a flow of sounds\nDjango - no entry of the first form\n")).alias("text"))).groupBy("term", "definition", "method").agg(F.count("*").alias("n")).where("term in ('Aardvark', 'Baroque', 'Cadence', 'Django')"),
    "SELECT term, definition, 'colon' AS method, (SELECT count(*) FROM documents) AS n FROM (VALUES ('Aardvark', 'a burrowing animal'), ('Baroque', 'an ornate style of art'), ('Cadence', 'a flow of sounds')) AS t(term, definition)",
)
R.add(
    "near_scene_breaks",
    lambda s, d: L.near_break(_chapters(s, d).select("doc_id", F.col("start").alias("pos")), L.scene_breaks(books(s, d))),
    rf"""WITH {BOOKS}, {LINES}, {_CHAPTERS}, breaks AS (SELECT doc_id, off AS s, off + length(line) AS e FROM lines WHERE regexp_matches(line, '^\s*[-=*~.]{{3,}}\s*$|^\s*\*\s*\*\s*\*\s*$'))
    SELECT c.doc_id, c.start AS pos, coalesce(bool_or(abs(c.start - s) < 100 OR abs(c.start - e) < 100), false) AS near FROM c LEFT JOIN breaks USING (doc_id) GROUP BY 1, 2""",
)
