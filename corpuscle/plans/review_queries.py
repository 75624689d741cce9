"""Registered queries that review results, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import dialogue as D
from corpuscle.operators import lines as L
from corpuscle.operators import review as V
from corpuscle.plans.cast_queries import CAST, _pick, cast
from corpuscle.plans.registry import Registry
from corpuscle.plans.text_queries import _CHAPTERS, BOOKS, LINES, _chapters, books, documents

R = Registry()

R.add(
    "simple_sequences",
    lambda s, d: V.sequences(s.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 300 < 150 or l_linenumber < 3").select((F.col("l_orderkey") % 300 * 1000 + F.expr("l_orderkey div 300")).alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("start"), F.when(F.col("l_orderkey") % 7 == 0, _pick(["I", "II", "IV", "IX", "X", "XL"], "l_linenumber")).when(F.col("l_orderkey") % 7 == 1, "Prologue").otherwise(F.concat(F.lit("Chapter "), (F.col("l_linenumber") * 2).cast("string"))).alias("title")).dropDuplicates(["doc_id", "start"])),
    """WITH t AS (SELECT DISTINCT l_orderkey % 300 * 1000 + l_orderkey // 300 AS doc_id, l_orderkey * 10 + l_linenumber AS start, CASE l_orderkey % 7 WHEN 0 THEN [1, 2, 4, 9, 10, 40][1 + l_linenumber % 6] WHEN 1 THEN NULL ELSE l_linenumber * 2 END AS v FROM lineitem WHERE l_orderkey % 300 < 150 OR l_linenumber < 3),
    s AS (SELECT doc_id, v, v - lag(v) OVER w AS step, row_number() OVER w = 1 AS head FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY start)) SELECT doc_id, count(*) AS n, bool_and(v IS NOT NULL AND (head OR coalesce(step BETWEEN 1 AND 5, false))) AS simple FROM s GROUP BY 1""",
)
R.add(
    "cast_comparison",
    lambda s, d: V.compared(s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 400).alias("key"), (F.col("o_orderkey") % 30).cast("string").alias("alias")), s.read.parquet(f"{d}/lineitem.parquet").where("l_partkey % 4 > 0").select((F.col("l_partkey") % 500).alias("key"), (F.col("l_suppkey") % 30).cast("string").alias("alias"))),
    """WITH a AS (SELECT DISTINCT o_custkey % 400 AS key, o_orderkey % 30 AS x FROM orders), b AS (SELECT DISTINCT l_partkey % 500 AS key, l_suppkey % 30 AS x FROM lineitem WHERE l_partkey % 4 > 0)
    SELECT key, CAST(count(*) FILTER (p AND NOT q) AS INTEGER) AS only_old, CAST(count(*) FILTER (q AND NOT p) AS INTEGER) AS only_new, CAST(count(*) FILTER (p AND q) AS INTEGER) AS both
    FROM (SELECT coalesce(a.key, b.key) AS key, a.x IS NOT NULL AS p, b.x IS NOT NULL AS q FROM a FULL JOIN b ON a.key = b.key AND a.x = b.x) GROUP BY 1""",
)
R.add(
    "tag_identities",
    lambda s, d: V.tag_identities(cast(s, d).select("book", F.concat("name", F.when(F.col("id") % 3 == 0, F.concat(F.lit(" / "), _pick(["Zed", "Amy", "Q"], "id div 3"))).otherwise("")).alias("tag"))),
    f"WITH {CAST}, t AS (SELECT book, name AS x, ['Zed', 'Amy', 'Q'][1 + (id // 3) % 3] AS y FROM members WHERE id % 3 = 0) SELECT DISTINCT book, least(x, y) AS a, greatest(x, y) AS b FROM t WHERE length(y) >= 2",
)
_CALLS = ["Stop, Ann! Go, Bob? Yes, Ann, now.", "Oh! Eve! well, Eve, and Carl.", "Nobody calls."]
R.add(
    "vocative_names",
    lambda s, d: V.vocatives(documents(s, d).select("doc_id", _pick(_CALLS, "doc_id").alias("text"))),
    "SELECT doc_id, ['Ann', 'Eve'][1 + doc_id % 3] AS name, 2 AS n FROM documents WHERE doc_id % 3 < 2",
)
R.add(
    "perspectives",
    lambda s, d: documents(s, d).select("doc_id", V.perspective(F.concat(_pick(["A first-person tale. ", "The narrator walks. ", "A man walks. "], "doc_id"), F.col("text"))).alias("perspective"), V.context_kind(F.concat(_pick(["“Go,” he said", "Her eyes were grey", "Ann went"], "doc_id div 2"), F.lit("."))).alias("kind")),
    "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'first' ELSE 'third' END AS perspective, ['dialogue', 'description', 'mention'][1 + (doc_id // 2) % 3] AS kind FROM documents",
)
R.add(
    "missing_readings",
    lambda s, d: V.missing_readings(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("word"), _pick(["character", "foreign", "unknown"], "p_partkey").alias("flag"), (F.col("p_partkey") % 31).alias("n"), F.when(F.col("p_partkey") % 4 == 0, " ").when(F.col("p_partkey") % 4 == 1, "x").alias("reading"))),
    "SELECT p_partkey AS word, p_partkey % 3 = 0 OR p_partkey % 31 > 20 AS reported FROM part WHERE (p_partkey % 3 = 0 OR p_partkey % 31 > 10) AND p_partkey % 4 <> 1",
)
R.add(
    "quality_report",
    lambda s, d: V.quality_report(s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("agent")).agg(*[F.count_if(F.expr(c)).alias(n) for c, n in (("l_quantity > 40", "high"), ("l_quantity > 25 and l_quantity <= 40", "medium"), ("l_quantity <= 25", "low"))])),
    "WITH q AS (SELECT (count(*) FILTER (l_quantity > 40) + 0.6::DOUBLE * count(*) FILTER (l_quantity > 25 AND l_quantity <= 40) + 0.2::DOUBLE * count(*) FILTER (l_quantity <= 25)) / count(*) AS q FROM lineitem GROUP BY l_suppkey) SELECT round(avg(q), 6) AS overall, count(*) AS agents, count(*) FILTER (q < 0.5) AS weak, avg(q) >= 0.5 AS passed FROM q",
)
R.add(
    "dialogue_passages",
    lambda s, d: V.one_per_bucket(D.quotes(documents(s, d).select("doc_id", F.replace(F.replace("text", F.lit(". "), F.lit('" ')), F.lit(", "), F.lit(' "')).alias("text"))), 500).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")),
)
R.add(
    "chapter_openings",
    lambda s, d: V.one_per_bucket(_chapters(s, d).select("doc_id", F.col("start").alias("pos"), F.col("title").alias("form")), 2000),
    f"WITH {BOOKS}, {LINES}, {_CHAPTERS} SELECT doc_id, start AS pos, title AS form FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, start // 2000 ORDER BY start) AS k FROM c) WHERE k = 1",
)
R.add(
    "back_matter_start",
    lambda s, d: V.back_matter_start(_chapters(s, d).join(books(s, d).select("doc_id", F.length("text").alias("size")), "doc_id")),
    f"WITH {BOOKS}, {LINES}, {_CHAPTERS} SELECT c.doc_id, min(start) AS start FROM c JOIN books USING (doc_id) WHERE start >= floor(length(text) * 0.55) GROUP BY 1",
)
R.add(
    "long_lines",
    lambda s, d: L.lines(documents(s, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"), F.round(F.avg(F.length("line")), 6).alias("mean")),
    "SELECT doc_id, count(*) AS n_lines, CAST(max(length(x)) AS INTEGER) AS longest, round(avg(length(x)), 6) AS mean FROM (SELECT doc_id, unnest(string_split(text, E'\\n')) AS x FROM documents) GROUP BY 1",
)
