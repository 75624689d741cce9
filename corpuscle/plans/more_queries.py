"""Further registered queries: mentions, similarity, regions, contents, disambiguation, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import lexicon as X
from corpuscle.operators import lines as L
from corpuscle.operators import mentions as M
from corpuscle.plans.cast_queries import CAST, PRESENCE, _pick, _sql_list, cast, presence
from corpuscle.plans.registry import Registry
from corpuscle.plans.text_queries import _CHAPTERS, BOOKS, LINES, _chapters, books, documents

R = Registry()
WORDS = ["the", "onthe", "thin", "and", "reou", "thst"]

R.add(
    "name_mentions",
    lambda s, d: M.mentions(documents(s, d), s.createDataFrame([(i, w) for i, w in enumerate(["of the", "the", "thin", "and the", "en"])], "id long, alias string").crossJoin(documents(s, d).select("doc_id"))).groupBy("doc_id", "id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos")),
)
R.add(
    "word_boundary_mentions",
    lambda s, d: M.mentions(documents(s, d), documents(s, d).select("doc_id", F.lit(7).cast("long").alias("id"), F.lit("the").alias("alias"))).groupBy("doc_id").agg(F.count("*").alias("n")),
    r"SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w = 'the')) AS n FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'the')",
)
R.add(
    "alias_grounding",
    lambda s, d: M.ungrounded_aliases(cast(s, d).select("book", "id", F.col("name").alias("alias")), s.createDataFrame([("stone",), ("ann",), ("mrs",), ("miss",), ("dora",), ("hale",)], "word string").crossJoin(cast(s, d).select("book").distinct())),
    f"""WITH {CAST} SELECT book, id, name AS alias FROM members WHERE len(list_filter(regexp_split_to_array(lower(name), '[^a-zà-ÿ]+'), lambda p: length(p) >= 3 AND p NOT IN ('stone', 'ann', 'mrs', 'miss', 'dora', 'hale'))) > 0""",
)
R.add(
    "similar_names",
    lambda s, d: cast(s, d).select("book", "id", F.round(M.similarity(F.col("name"), F.lit("Mrs. Dora Hale")), 6).alias("ratio"), M.names_similar(F.col("name"), F.lit("Mrs. Dora Hale")).alias("similar")),
)
R.add(
    "nickname_pairs",
    lambda s, d: cast(s, d).select("id", M.nickname(_pick([a for a, _ in M.NICKNAMES], "id"), _pick([b for _, b in M.NICKNAMES], "id div 2")).alias("nickname")),
    f"""WITH p AS (SELECT c_custkey AS id, {_sql_list([a for a, _ in M.NICKNAMES])}[1 + c_custkey % {len(M.NICKNAMES)}] AS x, {_sql_list([b for _, b in M.NICKNAMES])}[1 + (c_custkey // 2) % {len(M.NICKNAMES)}] AS y FROM customer)
    SELECT id, (x || '|' || y) IN ({", ".join(f"'{a}|{b}'" for a, b in M.NICKNAMES)}) OR (y || '|' || x) IN ({", ".join(f"'{a}|{b}'" for a, b in M.NICKNAMES)}) OR ((starts_with(x, y) OR starts_with(y, x)) AND abs(length(x) - length(y)) <= 3) AS nickname FROM p""",
)
R.add(
    "handoff_confidence",
    lambda s, d: M.handoff_confidence(cast(s, d).select("id", F.col("name").alias("name_a"), _pick(["Dora Hale", "Bob", "Eve Stone"], "id").alias("name_b"), F.when(F.col("id") % 3 == 0, "protagonist").alias("role_a"), (F.col("id") % 6).alias("chapters_b"), (F.col("id") % 4).alias("gap"))).select("id", "confidence"),
)
R.add(
    "boundary_scores",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(M.boundary_score(F.col("l_suppkey") % 11 / 10, F.col("l_orderkey") % 11, F.col("l_partkey") % 11, F.col("l_linenumber") % 11, F.col("l_quantity") / 50), 6).alias("score")).groupBy("l_orderkey").agg(F.round(F.max("score"), 6).alias("best")),
    """SELECT l_orderkey, max(round(least(1.0, greatest(0.0, base * 0.7::DOUBLE + p * 0.3::DOUBLE)), 6)) AS best FROM (SELECT l_orderkey, l_quantity / 50 AS p, CASE WHEN toc > 0.8::DOUBLE THEN toc * 0.6::DOUBLE + e * 0.3::DOUBLE + t * 0.1::DOUBLE WHEN toc > 0 THEN toc * 0.3::DOUBLE + e * 0.4::DOUBLE + t * 0.3::DOUBLE ELSE e * 0.5::DOUBLE + t * 0.5::DOUBLE END AS base
    FROM (SELECT l_orderkey, l_quantity, (l_suppkey % 11) / 10 AS toc, ((l_orderkey % 11) + (l_partkey % 11)) / 20 AS e, (l_linenumber % 11) / 10 AS t FROM lineitem)) GROUP BY 1""",
)


def _sentence() -> Column:
    return _pick(["His father John came.", "The youngest son, John, ran.", "John Donaldson stood.", "John had once been rich, years ago.", "John sat.", "A word."], "doc_id")


_SENTENCES = _sql_list(["His father John came.", "The youngest son, John, ran.", "John Donaldson stood.", "John had once been rich, years ago.", "John sat.", "A word."])
R.add(
    "name_disambiguation",
    lambda s, d: documents(s, d).select("doc_id", M.disambiguated(_sentence(), F.lit("John Donaldson"), F.lit("John")).alias("x")).select("doc_id", "x.name", "x.confidence", "x.method"),
    f"""SELECT doc_id, CASE k WHEN 0 THEN 'John Donaldson' WHEN 1 THEN 'John' WHEN 2 THEN 'John Donaldson' WHEN 3 THEN 'John Donaldson' ELSE 'John' END AS name, CASE k WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
    CASE k WHEN 0 THEN 'relationship' WHEN 1 THEN 'relationship' WHEN 2 THEN 'shape' WHEN 3 THEN 'temporal' ELSE 'default' END AS method FROM (SELECT doc_id, doc_id % 6 AS k, {_SENTENCES}[1 + doc_id % 6] AS sentence FROM documents)""",
)
R.add(
    "kept_apart",
    lambda s, d: M.kept_apart(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 400).alias("doc_id"), (F.col("l_orderkey") * 11 + F.col("l_linenumber") * 3).alias("pos"), F.col("l_quantity").alias("score")), 60),
)
_TOC = "Contents\n\nPart One ..... 1\n    Chapter 1: to 3  5\nII\nA plain line of prose that is no entry\nGlossary 90\nfirst line of the book\nsecond line of the book\nChapter 9 ... 12\n\n"
R.add(
    "toc_parse",
    lambda s, d: M.contents(documents(s, d).select("doc_id", F.concat(F.lit(_TOC), F.col("text")).alias("text"))),
    """SELECT doc_id, CAST(k AS INTEGER) AS k, title, CAST(page AS INTEGER) AS page, CAST(level AS INTEGER) AS level FROM documents, (VALUES (1, 'Part One', 1, 1), (2, 'Chapter 1', 5, 2), (3, 'Chapter 2', NULL, 2), (4, 'Chapter 3', NULL, 2), (5, 'II', NULL, 1), (6, 'Glossary', 90, 1)) AS t(k, title, page, level)""",
)
R.add(
    "in_body",
    lambda s, d: L.in_spans(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 100).alias("doc_id"), (F.col("l_partkey") % 20000).alias("pos")).distinct(), _chapters(s, d).where("idx between 2 and 4").select("doc_id", "start", "end", F.lit(True).alias("body")), "body", F.lit(False)),
    f"""WITH {BOOKS}, {LINES}, {_CHAPTERS}, p AS (SELECT DISTINCT l_orderkey % 100 AS doc_id, l_partkey % 20000 AS pos FROM lineitem) SELECT doc_id, pos, EXISTS (SELECT 1 FROM c WHERE c.doc_id = p.doc_id AND idx BETWEEN 2 AND 4 AND pos >= start AND pos < "end") AS body FROM p""",
)
R.add(
    "clip_chapters",
    lambda s, d: _chapters(s, d).join(books(s, d).select("doc_id", F.floor(F.length("text") * 0.8).cast("int").alias("cut")), "doc_id").where("start < cut").select("doc_id", "idx", "start", F.least("end", "cut").alias("end")),
    f"""WITH {BOOKS}, {LINES}, {_CHAPTERS} SELECT c.doc_id, idx, start, CAST(least("end", floor(length(text) * 0.8)) AS INTEGER) AS "end" FROM c JOIN books USING (doc_id) WHERE start < floor(length(text) * 0.8)""",
)
R.add(
    "url_context",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", X.in_url(F.concat(F.lit("See "), "url", F.lit(" or ask for more of the same kind of thing here today")), F.lit(10), F.lit(5)).alias("near"), X.in_url(F.concat(F.lit("Plain words stand here and no address comes for a while, then "), "url"), F.lit(2), F.lit(5)).alias("far")),
    r"SELECT page_id, regexp_matches(substr('See ' || url || ' or ask for more of the same kind of thing here today', 1, 45), '(https?://|www\.|\.com|\.org|\.net|@)') AS near, regexp_matches(substr('Plain words stand here and no address comes for a while, then ' || url, 1, 37), '(https?://|www\.|\.com|\.org|\.net|@)') AS far FROM pages",
)
R.add(
    "appearance_scores",
    lambda s, d: documents(s, d).select("doc_id", M.physical_score(F.concat(_pick(["tall, thin; eyes", "Hair and FACE", "none"], "doc_id"), F.lit(" "), F.col("text"))).alias("score")),
    f"""SELECT doc_id, CAST(len(list_filter([{", ".join(f"'{w}'" for w in M.PHYSICAL)}], lambda w: list_contains(regexp_split_to_array(lower({_sql_list(['tall, thin; eyes', 'Hair and FACE', 'none'])}[1 + doc_id % 3] || ' ' || text), '[^a-z]+'), w))) AS INTEGER) AS score FROM documents""",
)
R.add(
    "first_person_subject",
    lambda s, d: documents(s, d).select("doc_id", F.concat(_pick(["I ", "... we ", "“I’m ", "He "], "doc_id"), F.col("text")).rlike(M.FIRST_PERSON_SUBJECT).alias("narrator")),
    "SELECT doc_id, doc_id % 4 < 3 AS narrator FROM documents",
)
R.add("nfkc_lengths", lambda s, d: documents(s, d).select("doc_id", F.length(M.nfkc(F.concat(F.lit("ﬁ①"), "text"))).alias("n")), "SELECT doc_id, CAST(length(text) + 3 AS INTEGER) AS n FROM documents")
R.add(
    "segmented_words",
    lambda s, d: M.segmented(s.createDataFrame([("inthehouse",), ("dearsister",), ("ofmywelfare",), ("house",)], "word string"), s.createDataFrame([("in", 900), ("the", 2000), ("house", 50), ("dear", 30), ("sister", 20), ("of", 1500), ("my", 400), ("welfare", 5)], "word string, n long")),
    "SELECT * FROM (VALUES ('inthehouse', 'in the house'), ('dearsister', 'dear sister'), ('ofmywelfare', 'of my welfare'), ('house', 'house')) AS t(word, parts)",
)
R.add(
    "character_chapters",
    lambda s, d: presence(s, d).groupBy("book", "id").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"), F.countDistinct("chapter").alias("n"), F.array_join(F.array_sort(F.collect_set("chapter")), ",").alias("chapters")),
    f"WITH {PRESENCE} SELECT book, id, min(chapter) AS first, max(chapter) AS last, count(*) AS n, string_agg(CAST(chapter AS VARCHAR), ',' ORDER BY chapter) AS chapters FROM presence GROUP BY 1, 2",
)
R.add(
    "tone_histogram",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_orderkey") % 25).alias("book"), F.col("o_orderpriority").alias("tone")).agg(F.count("*").alias("n")),
    "SELECT o_orderkey % 25 AS book, o_orderpriority AS tone, count(*) AS n FROM orders GROUP BY 1, 2",
)
R.add(
    "modal_tone",
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_orderkey") % 25).alias("book"), F.col("o_orderpriority").alias("tone")).agg(F.count("*").alias("n")).groupBy("book").agg(F.max_by("tone", F.struct("n", "tone")).alias("tone")),
    "SELECT book, first(tone ORDER BY n DESC, tone DESC) AS tone FROM (SELECT o_orderkey % 25 AS book, o_orderpriority AS tone, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
)
R.add(
    "passage_windows",
    lambda s, d: documents(s, d).select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(k.alias("k"), F.slice(T.words(F.col("text")), (F.floor(F.size(T.words(F.col("text"))) * k / 3) + 1).cast("int"), F.lit(50)).alias("w")))).alias("x")).select("doc_id", "x.k", F.md5(F.array_join("x.w", " ")).alias("digest")),
    r"SELECT doc_id, CAST(k AS INTEGER) AS k, md5(array_to_string(w[CAST(floor(len(w) * k / 3) AS BIGINT) + 1 : CAST(floor(len(w) * k / 3) AS BIGINT) + 50], ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda q: q <> '') AS w FROM documents), unnest([0, 1, 2]) AS t(k)",
)


def _seeded(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("doc_id", F.md5(F.concat(F.lit("seed:"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h").limit(50).select("doc_id")


R.add("seeded_sample", _seeded, "SELECT doc_id FROM documents ORDER BY md5('seed:' || doc_id) LIMIT 50")
