"""Registered queries over names, casts, relations, graphs, words, dialogue and quality, with SQL for DuckDB.

Casts, relations and votes are derived from the star tables by rules that both
languages share, so that the results are large and not trivial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import cast as C
from corpuscle.operators import dialogue as D
from corpuscle.operators import graph as G
from corpuscle.operators import lexicon as X
from corpuscle.operators import lines as L
from corpuscle.operators import quality as Q
from corpuscle.plans.registry import Registry
from corpuscle.plans.text_queries import documents

R = Registry()

FIRST = ["Ann", "Bob", "Carl", "Dora", "Eve", "Finn", "A.", "The Old", "B."]
LAST = ["Stone", "Rivers", "Hale", "Wood", "Marsh", "Narrator", "Sailors"]
TITLE = ["Mr. ", "Mrs. ", "", "Dr. ", "", "Miss ", ""]
LABELS = ["father", "son", "wife", "husband", "friend", "mentor", "unknown", "daughter", "enemy", "brother", "associated"]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values: list[str], index: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(index) % len(values) + 1).cast("int"))


def cast(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(_pick(TITLE, "c_custkey div 3"), _pick(FIRST, "c_custkey"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit(" "), _pick(LAST, "c_custkey div 7"))).otherwise(""))
    rows = s.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_nationkey").cast("long").alias("book"), F.col("c_custkey").alias("id"), name.alias("name"), (F.col("c_custkey") % 7).alias("mentions"),
        (F.col("c_custkey") % 11 == 0).alias("narrator"), (F.col("c_custkey") % 3 == 0).alias("dialogue"), F.when(F.col("c_custkey") % 5 == 0, "Main").alias("role"), (F.col("c_custkey") % 2).alias("evidence"),
    )
    return rows.withColumn("gender", C.gender_of_title(F.col("name")))


CAST = f"""members AS (SELECT CAST(c_nationkey AS BIGINT) AS book, c_custkey AS id, {_sql_list(TITLE)}[1 + (c_custkey // 3) % {len(TITLE)}] || {_sql_list(FIRST)}[1 + c_custkey % {len(FIRST)}]
  || CASE WHEN c_custkey % 4 > 0 THEN ' ' || {_sql_list(LAST)}[1 + (c_custkey // 7) % {len(LAST)}] ELSE '' END AS name, c_custkey % 7 AS mentions, c_custkey % 11 = 0 AS narrator, c_custkey % 3 = 0 AS dialogue,
  CASE WHEN c_custkey % 5 = 0 THEN 'Main' END AS role, c_custkey % 2 AS evidence FROM customer),
cores AS (SELECT book, id, name, mentions, list_filter(list_transform(regexp_split_to_array(replace(lower(name), '.', ' '), '\\s+'), lambda p: p), lambda p: length(p) > 1 AND p NOT IN ({", ".join(repr(x) for x in C.TITLES + C.STOPS)})) AS core FROM members)"""


def edges(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 25).alias("book"), (F.col("o_custkey") % 60).alias("src"), (F.expr("o_orderkey div 25") % 60).alias("dst"), _pick(LABELS, "o_orderkey div 3").alias("label"))
    return rows.groupBy("book", "src", "dst").agg(F.min("label").alias("label"))


EDGES = f"""edges AS (SELECT o_orderkey % 25 AS book, o_custkey % 60 AS src, (o_orderkey // 25) % 60 AS dst, min({_sql_list(LABELS)}[1 + (o_orderkey // 3) % {len(LABELS)}]) AS label FROM orders GROUP BY 1, 2, 3)"""


def presence(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 25).alias("book"), (F.col("l_partkey") % 40).alias("id"), (F.col("l_suppkey") % 12 + F.col("l_partkey") % 40 % 9).alias("chapter"))
    return rows.where("id * 7 % 11 < 6 or chapter % 3 = 0").distinct()


PRESENCE = "presence AS (SELECT DISTINCT * FROM (SELECT l_orderkey % 25 AS book, l_partkey % 40 AS id, l_suppkey % 12 + l_partkey % 40 % 9 AS chapter FROM lineitem) WHERE id * 7 % 11 < 6 OR chapter % 3 = 0)"


def votes(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("subject"), (F.col("l_quantity") > 17).alias("vote"))


R.add(
    "name_keys",
    lambda s, d: cast(s, d).select("book", "id", C.match_key(F.col("name")).alias("match"), C.surname(F.col("name")).alias("surname"), C.name_flag(F.col("name")).alias("flag"), "gender"),
    f"""WITH {CAST} SELECT book, id, CASE WHEN len(core) > 0 THEN array_to_string(core, ' ') ELSE trim(lower(name)) END AS match, CASE WHEN len(core) > 1 THEN core[len(core)] END AS surname,
    CASE {" ".join(f"WHEN regexp_matches(trim(name), '{p}') THEN '{r}'" for r, p in C.NAME_FLAGS)} END AS flag,
    CASE WHEN regexp_matches(name, '(?i)^(mr\\.?|sir|lord)\\s') THEN 'male' WHEN regexp_matches(name, '(?i)^(mrs\\.?|ms\\.?|miss|lady)\\s') THEN 'female' END AS gender FROM cores""",
)
R.add(
    "ambiguous_names",
    lambda s, d: C.ambiguous_parts(cast(s, d)).select("book", "part", F.size("ids").alias("n"), F.array_join("ids", ",").alias("ids")),
    f"WITH {CAST} SELECT book, part, CAST(count(DISTINCT id) AS INTEGER) AS n, string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS ids FROM (SELECT book, id, unnest(core) AS part FROM cores) GROUP BY 1, 2 HAVING count(DISTINCT id) > 1".replace("string_agg(DISTINCT CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR))", "array_to_string(list_sort(list_distinct(list(id))), ',')"),
)
R.add(
    "word_subset_dedup",
    lambda s, d: C.fragments(cast(s, d)),
    f"""WITH {CAST}, u AS (SELECT book, id, mentions, list_distinct(core) AS core FROM cores WHERE len(core) > 0),
    p AS (SELECT a.book, a.id, b.id AS into_id FROM u a JOIN u b ON a.book = b.book AND a.mentions = b.mentions AND len(a.core) < len(b.core) AND list_has_all(b.core, a.core))
    SELECT book, id, min(into_id) AS "into" FROM p GROUP BY 1, 2 HAVING count(*) = 1""",
)
R.add(
    "initial_dedup",
    lambda s, d: C.initials(cast(s, d)),
    f"""WITH {CAST}, n AS (SELECT book, id, upper(trim(name)[1]) AS letter, lower(regexp_extract(trim(name), '(\\S+)$', 1)) AS last, regexp_matches(trim(name), '^[A-Za-z]\\.\\s') AS short FROM members),
    f AS (SELECT book, letter, last, min(id) AS "into" FROM n WHERE NOT short GROUP BY 1, 2, 3) SELECT n.book, n.id, f."into" FROM n JOIN f USING (book, letter, last) WHERE short""",
)
R.add(
    "first_name_dedup",
    lambda s, d: C.same_first_names(cast(s, d)),
    f"""WITH {CAST} SELECT book, split_part(lower(trim(name)), ' ', 1) AS first, first(id ORDER BY mentions DESC, id) AS id, count(*) AS n, CAST(sum(mentions) AS BIGINT) AS mentions FROM members WHERE trim(name) LIKE '% %' GROUP BY 1, 2 HAVING count(*) > 1""",
)
R.add(
    "grounding_gate",
    lambda s, d: C.grounded(cast(s, d), s.read.parquet(f"{d}/orders.parquet").select(F.lit(0).alias("z"), F.col("o_custkey").alias("id"), F.lit(1).alias("n")).join(cast(s, d).select("book", "id"), "id").select("book", "id", F.lit("x").alias("alias"), "n"), 10).select("book", "id", "hits", "grounded", "confidence"),
    f"WITH {CAST} SELECT book, id, coalesce(n, 0) AS hits, coalesce(n, 0) >= 10 AS grounded, CASE WHEN coalesce(n, 0) >= 10 THEN 'high' ELSE 'low' END AS confidence FROM members LEFT JOIN (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) USING (id)",
)
R.add(
    "background_partition",
    lambda s, d: cast(s, d).select("book", "id", C.background().alias("background")),
    f"WITH {CAST} SELECT book, id, NOT narrator AND NOT dialogue AND coalesce(lower(role), '') NOT IN ('protagonist', 'antagonist', 'main') AND mentions < 6 AND evidence = 0 AS background FROM members",
)
_REV = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in C.REVERSES.items()) + "}"
_SYM, _VAGUE = ", ".join(f"'{x}'" for x in C.SYMMETRIC), ", ".join(f"'{x}'" for x in C.VAGUE)
R.add(
    "relation_reverses",
    lambda s, d: C.with_reverses(edges(s, d)),
    f"""WITH {EDGES}, b AS (SELECT book, dst AS src, src AS dst, coalesce({_REV}[lower(label)], CASE WHEN lower(label) IN ({_SYM}) THEN lower(label) END) AS label FROM edges),
    a AS (SELECT *, CASE WHEN lower(label) IN ({_VAGUE}) THEN 2 ELSE 0 END AS r FROM edges UNION ALL SELECT *, 1 AS r FROM b WHERE label IS NOT NULL)
    SELECT book, src, dst, first(label ORDER BY r, label) AS label FROM a GROUP BY 1, 2, 3""",
)
R.add(
    "contradictory_relations",
    lambda s, d: C.without_contradictions(edges(s, d)),
    f"""WITH {EDGES}, k AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b FROM edges), bad AS (SELECT book, label, a, b FROM k WHERE lower(label) NOT IN ({_SYM}) GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
    SELECT book, src, dst, label FROM k ANTI JOIN bad USING (book, label, a, b)""",
)
R.add(
    "orphan_relations",
    lambda s, d: C.without_orphans(edges(s, d), cast(s, d).where("id < 60")),
    f"WITH {CAST}, {EDGES}, i AS (SELECT DISTINCT book, id FROM members WHERE id < 60) SELECT book, src, dst, label FROM edges WHERE src <> dst AND EXISTS (SELECT 1 FROM i WHERE i.book = edges.book AND i.id = src) AND EXISTS (SELECT 1 FROM i WHERE i.book = edges.book AND i.id = dst)",
)
R.add(
    "one_spouse",
    lambda s, d: C.one_spouse(edges(s, d), edges(s, d).select("book", "src", "dst", ((F.col("src") * 7 + F.col("dst") * 3) % 10).alias("weight"))),
    f"""WITH {EDGES}, s AS (SELECT *, lower(label) IN ('husband', 'wife', 'spouse') AS sp FROM edges), r AS (SELECT *, row_number() OVER (PARTITION BY book, src ORDER BY (src * 7 + dst * 3) % 10 DESC, dst) AS k FROM s WHERE sp)
    SELECT book, src, dst, label FROM s WHERE NOT sp UNION ALL SELECT book, src, dst, label FROM r WHERE k = 1""",
)
_MALE = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in C.GENDERED.items()) + "}"
_FEMALE = "MAP {" + ", ".join(f"'{b}': '{a}'" for a, b in C.GENDERED.items()) + "}"
R.add(
    "gender_consistency",
    lambda s, d: C.gender_consistent(edges(s, d), cast(s, d)),
    f"""WITH {CAST}, {EDGES}, g AS (SELECT book, id AS src, CASE WHEN regexp_matches(name, '(?i)^(mr\\.?|sir|lord)\\s') THEN 'male' WHEN regexp_matches(name, '(?i)^(mrs\\.?|ms\\.?|miss|lady)\\s') THEN 'female' END AS gender FROM members)
    SELECT book, src, dst, coalesce(CASE gender WHEN 'female' THEN {_MALE}[lower(label)] WHEN 'male' THEN {_FEMALE}[lower(label)] END, label) AS label FROM edges LEFT JOIN g USING (book, src)""",
)
R.add(
    "spousal_triangles",
    lambda s, d: C.spousal_triangles(edges(s, d)),
    f"""WITH {EDGES}, ch AS (SELECT * FROM edges WHERE label IN ('son', 'daughter')), sp AS (SELECT * FROM edges WHERE label IN ('husband', 'wife', 'spouse')),
    n AS (SELECT ch.book, ch.src, sp.dst, min(ch.label) AS label FROM ch JOIN sp ON ch.book = sp.book AND ch.dst = sp.src WHERE ch.src <> sp.dst GROUP BY 1, 2, 3),
    m AS (SELECT * FROM n ANTI JOIN ch USING (book, src, dst)) SELECT book, src, dst, label FROM edges ANTI JOIN m USING (book, src, dst) UNION ALL SELECT book, src, dst, label FROM m""",
)
R.add("vague_relations", lambda s, d: C.vague_dropped(edges(s, d)), f"WITH {EDGES} SELECT book, src, dst, label FROM edges WHERE lower(trim(label)) NOT IN ({_VAGUE})")
R.add(
    "cooccurrence_band",
    lambda s, d: C.near_pairs(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 25).alias("book"), (F.col("l_suppkey") % 20).alias("id"), F.expr("l_orderkey * 13 + l_linenumber * 7").alias("pos")), 40),
    """WITH m AS (SELECT l_orderkey % 25 AS book, l_suppkey % 20 AS id, l_orderkey * 13 + l_linenumber * 7 AS pos FROM lineitem)
    SELECT a.book, least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, count(*) AS n FROM m a JOIN m b ON a.book = b.book AND a.id <> b.id AND b.pos - a.pos BETWEEN 0 AND 40 AND (b.pos > a.pos OR a.id < b.id) GROUP BY 1, 2, 3""",
)
R.add("cooccurrence_shared", lambda s, d: C.shared_chapters(presence(s, d), 4), f"WITH {PRESENCE} SELECT a.book, a.id AS a, b.id AS b, count(*) AS n FROM presence a JOIN presence b ON a.book = b.book AND a.chapter = b.chapter AND a.id < b.id GROUP BY 1, 2, 3 HAVING count(*) >= 4")
R.add(
    "handoffs",
    lambda s, d: C.handoffs(presence(s, d).where("(id % 2 = 0 and chapter <= 9) or (id % 2 = 1 and chapter >= 9)")),
    f"""WITH {PRESENCE}, s AS (SELECT book, id, min(chapter) AS f, max(chapter) AS l, list(DISTINCT chapter) AS a FROM presence WHERE (id % 2 = 0 AND chapter <= 9) OR (id % 2 = 1 AND chapter >= 9) GROUP BY 1, 2)
    SELECT a.book, a.id AS a, b.id AS b, b.f - a.l AS gap FROM s a JOIN s b ON a.book = b.book AND a.id <> b.id AND b.f - a.l BETWEEN 0 AND 2 AND len(list_intersect(a.a, b.a)) <= 1 AND (len(b.a) <= 5 OR len(b.a) < len(a.a))""",
)


def _passages(s: SparkSession, d: str) -> DataFrame:
    """Of lines at one position the first in the table has the score, whatever the partitions: what any_value takes."""
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_orderkey") % 25).alias("book"), (F.col("l_suppkey") % 20).alias("id"), (F.col("l_orderkey") % 30 + 1).alias("chapter"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("score"), F.when(F.col("l_quantity").isNotNull(), place).alias("place"),
    )
    return rows.groupBy("book", "id", "chapter", "pos").agg(F.min_by("score", "place").alias("score"))


R.add(
    "passages_topk",
    lambda s, d: C.top_per_chapter_third(_passages(s, d), 9).select("book", "id", "chapter", "pos", "third", "rank"),
    """WITH p AS (SELECT l_orderkey % 25 AS book, l_suppkey % 20 AS id, l_orderkey % 30 + 1 AS chapter, l_orderkey * 10 + l_linenumber AS pos, any_value(l_quantity) AS score FROM lineitem GROUP BY 1, 2, 3, 4),
    t AS (SELECT *, CAST(least(2, floor((chapter - 1) * 3 / max(chapter) OVER (PARTITION BY book))) AS INTEGER) AS third FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY book, id, third ORDER BY score DESC, pos) AS rank FROM t)
    SELECT book, id, chapter, pos, third, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)


def _graph(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b"))


_CC = """e AS (SELECT o_custkey AS a, o_orderkey % 1500 AS b FROM orders), x AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
  c AS (SELECT a AS id, a AS c FROM x UNION SELECT x.b AS id, c.c FROM c JOIN x ON x.a = c.id), cc AS (SELECT id, min(c) AS component FROM c GROUP BY 1)"""
R.add("identity_components", lambda s, d: G.components(_graph(s, d)), f"WITH RECURSIVE {_CC} SELECT id, component FROM cc")
R.add(
    "weighted_edges",
    lambda s, d: G.weighted(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1500).alias("b"), _pick([*G.WEIGHTS, "other"], "o_orderkey").alias("kind"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.25)).alias("weight")), s.read.parquet(f"{d}/customer.parquet").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))),
    f"""WITH n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), o AS (SELECT o_custkey AS a, o_orderkey % 1500 AS b, {_sql_list([*G.WEIGHTS, 'other'])}[1 + o_orderkey % {len(G.WEIGHTS) + 1}] AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 0.25::DOUBLE END AS w FROM orders)
    SELECT a, b, kind, coalesce(w, MAP {{{", ".join(f"'{k}': {v}::DOUBLE" for k, v in G.WEIGHTS.items())}}}[kind], 0.5::DOUBLE) AS weight FROM o WHERE a <> b AND a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)""",
)
R.add("constraint_split", lambda s, d: G.split_by_constraints(G.components(_graph(s, d)), _graph(s, d).where("(a + b) % 5 = 0 and a <> b")))
R.add(
    "soft_constraints",
    lambda s, d: G.soft_splits(s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 100).alias("a"), (F.col("o_orderkey") % 100).alias("b"), (F.col("o_orderkey") % 4).alias("weight"), (F.col("o_custkey") % 5).alias("strength"))),
    "SELECT least(a, b) AS a, greatest(a, b) AS b, sum(s) > sum(w) AS split FROM (SELECT o_custkey % 100 AS a, o_orderkey % 100 AS b, o_orderkey % 4 AS w, o_custkey % 5 AS s FROM orders) GROUP BY 1, 2",
)

# --- words -------------------------------------------------------------------
_W = L.WORD.replace("'", "''")
POSTED = f"post AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_W}')) AS form FROM documents), pw AS (SELECT doc_id, form, lower(form) AS word FROM post)"
LEXICON = f"{POSTED}, lex AS (SELECT word FROM pw GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20)"


def _lexicon(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = L.words(documents(s, d))
    return p, X.frequent_words(p, 20)


R.add(
    "vocabulary_forms",
    lambda s, d: X.vocabulary(L.words(documents(s, d))),
    f"WITH {POSTED}, k AS (SELECT word, form, count(*) AS k FROM pw GROUP BY 1, 2), n AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM pw GROUP BY 1) SELECT word, first(form ORDER BY k DESC, form) AS form, any_value(n) AS n, any_value(n_docs) AS n_docs FROM k JOIN n USING (word) GROUP BY word",
)
R.add(
    "closed_compounds",
    lambda s, d: X.compounds(*_vocabulary(s, d)),
    f"""WITH {LEXICON}, v AS (SELECT DISTINCT word FROM pw WHERE length(word) >= 8), p AS (SELECT word, unnest(generate_series(4, length(word) - 4)) AS k FROM v),
    h AS (SELECT word, k, word[1:k] AS l, word[k + 1:] AS r FROM p) SELECT word, first(l ORDER BY k) AS left, first(r ORDER BY k) AS right FROM h WHERE l IN (SELECT word FROM lex) AND r IN (SELECT word FROM lex) GROUP BY word""".replace(" AS left,", ' AS "left",').replace(" AS right ", ' AS "right" '),
)


def _vocabulary(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, lexicon = _lexicon(s, d)
    return p.select("word").distinct(), lexicon


R.add("derivations", lambda s, d: X.derived(*_vocabulary(s, d)))
R.add("oov_words", lambda s, d: X.unknown_words(*_lexicon(s, d)))
_HOMOGRAPHS = ", ".join(f"'{w}'" for w in X.HOMOGRAPHS)
_FOREIGN = "CASE " + " ".join(f"WHEN regexp_matches(word, '{p}') THEN '{n}'" for n, p in X.FOREIGN) + " END"
R.add(
    "foreign_words",
    lambda s, d: L.words(documents(s, d)).where("length(word) >= 4").withColumn("language", X.foreign(F.col("word"))).where("language is not null").groupBy("word", "language").agg(F.count("*").alias("n")),
    f"WITH {POSTED} SELECT * FROM (SELECT word, {_FOREIGN} AS language, count(*) AS n FROM pw WHERE length(word) >= 4 GROUP BY 1) WHERE language IS NOT NULL",
)
R.add(
    "acronyms",
    lambda s, d: L.postings(documents(s, d)).select("doc_id", F.when(F.col("pos") % 3 == 0, F.upper("form")).otherwise(F.col("form")).alias("form")).where(X.acronym(F.col("form"))).groupBy("form").agg(F.countDistinct("doc_id").alias("n_docs")),
    None,
)
R.add(
    "homographs",
    lambda s, d: L.words(documents(s, d)).select("doc_id", F.when(F.length("word") == 5, F.lit("minute")).otherwise(F.col("word")).alias("word")).where(F.col("word").isin(*X.HOMOGRAPHS)).groupBy("doc_id", "word").agg(F.count("*").alias("n")),
    f"WITH {POSTED} SELECT doc_id, w AS word, count(*) AS n FROM (SELECT doc_id, CASE WHEN length(word) = 5 THEN 'minute' ELSE word END AS w FROM pw) WHERE w IN ({_HOMOGRAPHS}) GROUP BY 1, 2",
)
R.add("pron_consolidate", lambda s, d: X.consolidated(X.proposals(L.postings(documents(s, d)))))
R.add("pron_examples", lambda s, d: X.examples(X.proposals(L.postings(documents(s, d))).select("word", "doc_id", "pos").distinct()))

# --- dialogue ----------------------------------------------------------------
_TURNS = lambda s, d: s.read.parquet(f"{d}/conversations.parquet")
R.add(
    "dialogue_features",
    lambda s, d: D.turn_features(_TURNS(s, d)),
    r"""SELECT conv_id, turn, CASE WHEN length(text) < 20 THEN 'tiny' WHEN length(text) < 50 THEN 'short' WHEN length(text) < 150 THEN 'medium' WHEN length(text) < 500 THEN 'long' ELSE 'huge' END AS length,
    CASE WHEN p < 0.25 THEN 'start' WHEN p > 0.75 THEN 'end' ELSE 'middle' END AS place, regexp_matches(text, '\?\s*$') AS question, before, before_that, coalesce(before = role, false) AS continues,
    CASE WHEN m > f THEN 'male' WHEN f > m THEN 'female' ELSE 'unknown' END AS gender FROM (SELECT *, (row_number() OVER w - 1) / greatest(count(*) OVER (PARTITION BY conv_id) - 1, 1) AS p, lag(role, 1) OVER w AS before, lag(role, 2) OVER w AS before_that,
    len(regexp_extract_all(text, '(?i)\b(he|him|his)\b')) AS m, len(regexp_extract_all(text, '(?i)\b(she|her|hers)\b')) AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
)


def _said() -> Column:
    return F.concat(F.col("text"), F.lit(' "And then," he '), _pick(D.SPEECH_VERBS, "doc_id"), F.lit(". \"Why not?\" asked Ann."))


R.add(
    "dialogue_turns",
    lambda s, d: D.quotes(documents(s, d).select("doc_id", _said().alias("text"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("form")).alias("size"), F.min("pos").alias("first_pos")),
    f"""WITH t AS (SELECT doc_id, text || ' "And then," he ' || {_sql_list(D.SPEECH_VERBS)}[1 + doc_id % {len(D.SPEECH_VERBS)}] || '. "Why not?" asked Ann.' AS text FROM documents), q AS (SELECT doc_id, text, regexp_extract_all(text, '“[^”]{{3,}}”|"[^"]{{3,}}"') AS a FROM t)
    SELECT doc_id, len(a) AS n, CAST(list_sum(list_transform(a, lambda x: length(x))) AS BIGINT) AS size, CAST(instr(text, a[1]) - 1 AS INTEGER) AS first_pos FROM q WHERE len(a) > 0""",
)
R.add(
    "speech_verbs",
    lambda s, d: documents(s, d).select("doc_id", D.speech_verb(F.concat(F.lit('"Go," she '), _pick(D.SPEECH_VERBS, "doc_id * 7"), F.lit(" and "), F.col("text"))).alias("verb")),
    f"SELECT doc_id, {_sql_list(D.SPEECH_VERBS)}[1 + (doc_id * 7) % {len(D.SPEECH_VERBS)}] AS verb FROM documents",
)
R.add(
    "evidence_sentences",
    lambda s, d: D.sentences(documents(s, d)).select("doc_id", "k", D.statement_score(F.concat("sentence", F.when(F.col("k") % 3 == 0, " helps his brother, a cruel man").otherwise(""))).alias("score")),
    None,
)


def _identity() -> Column:
    return F.concat(F.lit("Ann is later known as Eve. Bob, aka Carl, ran. Dora's real name is Dora. "), F.col("text"))


R.add("identity_statements", lambda s, d: D.identity_statements(documents(s, d).select("doc_id", _identity().alias("text"))))
R.add(
    "narrator_density",
    lambda s, d: D.narrator_density(documents(s, d).select("doc_id", F.replace(F.col("text"), F.lit(" a "), F.lit(" I ")).alias("text"))),
    r"""SELECT doc_id, CAST(n AS INTEGER) AS n, round(coalesce(1000 * n / nullif(length(h), 0), 0), 6) AS per_thousand, n > 15 AS first_person FROM (SELECT doc_id, h, len(list_filter(regexp_extract_all(h, '"""
    + _W
    + """'), lambda w: lower(w) IN ('i', 'me', 'my', 'mine', 'myself'))) AS n FROM (SELECT doc_id, substr(replace(text, ' a ', ' I '), 1, 5000) AS h FROM documents))""",
)

# --- votes, scores, metrics ----------------------------------------------------
_VOTES = "v AS (SELECT l_returnflag AS kind, l_orderkey AS subject, l_quantity > 17 AS vote FROM lineitem), t AS (SELECT kind, subject, count(*) FILTER (vote) AS yes, count(*) AS total FROM v GROUP BY 1, 2)"
R.add("boundary_votes", lambda s, d: Q.tallied(votes(s, d)), f"WITH {_VOTES} SELECT *, yes / total >= 0.67 AS accepted FROM t")
R.add("vote_tally", lambda s, d: Q.vote_log(votes(s, d)), f"WITH {_VOTES} SELECT kind, count(*) AS n, count(*) FILTER (yes / total >= 0.67) AS accepted, count(*) FILTER (NOT yes / total >= 0.67) AS rejected FROM t GROUP BY 1")
R.add(
    "summary_merge_votes",
    lambda s, d: Q.merged_events(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 500).alias("subject"), (F.col("l_orderkey") % 5).alias("voter"), F.concat(F.lit(" Event "), (F.col("l_partkey") % 30).cast("string")).alias("event"))),
    """WITH x AS (SELECT l_orderkey % 500 AS subject, l_orderkey % 5 AS voter, 'event ' || (l_partkey % 30) AS event FROM lineitem), v AS (SELECT subject, count(DISTINCT voter) AS voters FROM x GROUP BY 1)
    SELECT subject, event, count(DISTINCT voter) AS n FROM x JOIN v USING (subject) GROUP BY subject, event, voters HAVING count(DISTINCT voter) >= greatest(1, floor(voters * 0.67))""",
)


def _proposals(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 200).alias("doc_id"), (F.col("l_orderkey") * 37 + F.col("l_linenumber")).alias("pos"), F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("title"), F.element_at(F.array(F.lit(1.0), F.lit(0.9), F.lit(0.7)), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("weight"), (F.col("l_quantity") / 50).alias("score"), (F.col("l_quantity") > 48).alias("hard"))


_CLUSTERS = """p AS (SELECT l_orderkey % 200 AS doc_id, l_orderkey * 37 + l_linenumber AS pos, 'T' || l_partkey AS title, [1.0, 0.9, 0.7][1 + l_suppkey % 3]::DOUBLE AS weight, l_quantity / 50 AS score, l_quantity > 48 AS hard FROM lineitem),
h AS (SELECT *, CASE WHEN coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos, title), 201) > 200 THEN 1 ELSE 0 END AS head FROM p), r AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos, title ROWS UNBOUNDED PRECEDING) AS cluster FROM h),
k AS (SELECT doc_id, CAST(cluster AS BIGINT) AS cluster, CAST(floor(avg(pos)) AS BIGINT) AS position, first(title ORDER BY score DESC, title DESC) AS title, round(sum(score * weight) / sum(weight) + 1e-9, 4) AS score, bool_or(hard) AS hard FROM r GROUP BY 1, 2)"""
R.add("boundary_clusters", lambda s, d: Q.clusters(_proposals(s, d)), f"WITH {_CLUSTERS} SELECT * FROM k")
R.add("boundary_select", lambda s, d: Q.selected(Q.clusters(_proposals(s, d))).select("doc_id", "cluster", "tier"), f"WITH {_CLUSTERS} SELECT doc_id, cluster, CASE WHEN hard OR score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'low' ELSE 'rejected' END AS tier FROM k")
R.add("toc_topn", lambda s, d: Q.first_n(Q.clusters(_proposals(s, d)), 12).select("doc_id", "cluster", "position"), f"WITH {_CLUSTERS} SELECT doc_id, cluster, position FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hard DESC, score DESC, position) AS k FROM k) WHERE k <= 12")
R.add(
    "golden_score",
    lambda s, d: Q.golden_score(cast(s, d).select("book", F.col("id").alias("key")).where("key % 3 > 0"), cast(s, d).select("book", F.col("id").alias("key")).where("key % 4 > 0")),
    """WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS book, count(*) FILTER (c_custkey % 3 > 0 AND c_custkey % 4 > 0) AS matched, count(*) FILTER (c_custkey % 3 > 0) AS n_predicted, count(*) FILTER (c_custkey % 4 > 0) AS n_truth FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 4 > 0 GROUP BY 1)
    SELECT *, round(coalesce(matched / nullif(n_predicted, 0), 0), 6) AS precision, round(coalesce(matched / nullif(n_truth, 0), 0), 6) AS recall, round(coalesce(2 * (matched / n_predicted) * (matched / n_truth) / nullif(matched / n_predicted + matched / n_truth, 0), 0), 6) AS f1 FROM s""",
)
R.add(
    "quality_score",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("agent")).agg(*[F.count_if(F.expr(c)).alias(n) for c, n in (("l_quantity > 30", "h"), ("l_quantity > 10 and l_quantity <= 30", "m"), ("l_quantity <= 10", "l"))]).select("agent", F.round(Q.quality(F.col("h"), F.col("m"), F.col("l")), 6).alias("quality")),
    "SELECT l_suppkey AS agent, round((count(*) FILTER (l_quantity > 30) + 0.6::DOUBLE * count(*) FILTER (l_quantity > 10 AND l_quantity <= 30) + 0.2::DOUBLE * count(*) FILTER (l_quantity <= 10)) / count(*), 6) AS quality FROM lineitem GROUP BY 1",
)
R.add(
    "stage_metrics_rollup",
    lambda s, d: Q.stage_report(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("stage"), F.lit(1).alias("items"), F.col("value").alias("seconds"))).withColumn("stage", F.coalesce("stage", F.lit("all"))).select("stage", "items", F.round("seconds", 2).alias("seconds"), F.round("per_second", 4).alias("per_second"), F.round("share", 4).alias("share")),
    "SELECT coalesce(event_type, 'all') AS stage, count(*) AS items, round(sum(value), 2) AS seconds, round(count(*) / sum(value), 4) AS per_second, round(100 * sum(value) / (SELECT sum(value) FROM events), 4) AS share FROM events GROUP BY ROLLUP (event_type)",
)
R.add(
    "token_cost",
    lambda s, d: Q.costs(s.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("s"), (F.col("l_suppkey") % 9).cast("string")).alias("stage"), F.when(F.col("l_suppkey") % 9 > 6, "none").otherwise(F.col("l_returnflag")).alias("model"), (F.col("l_quantity") * 100).alias("tokens_in"), (F.col("l_quantity") * 10).alias("tokens_out")), s.createDataFrame([("A", 2.5, 10.0), ("N", 1.0, 4.0)], "model string, price_in double, price_out double")),
    "SELECT 's' || (l_suppkey % 9) AS stage, round(sum(CASE WHEN l_suppkey % 9 > 6 THEN NULL WHEN l_returnflag = 'A' THEN (l_quantity * 250 + l_quantity * 100) WHEN l_returnflag = 'N' THEN (l_quantity * 100 + l_quantity * 40) END / 1e6::DOUBLE), 6) AS cost FROM lineitem GROUP BY 1",
)
R.add(
    "eta_medians",
    lambda s, d: Q.recent_median(s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("stage"), F.col("event_id").alias("run"), F.col("value").alias("seconds"))),
    "SELECT event_type AS stage, round(median(value), 6) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS k FROM events) WHERE k <= 10 GROUP BY 1",
)
R.add(
    "lint_rules",
    lambda s, d: Q.lint(cast(s, d), edges(s, d), cast(s, d).select("book", F.lit("stone").alias("word")).distinct()),
    f"""WITH {CAST}, {EDGES} SELECT book, 'C1' AS rule, lower(name) AS subject FROM members GROUP BY 1, lower(name) HAVING count(*) > 1
    UNION SELECT book, 'C3', lower(name) FROM members WHERE len(list_filter(regexp_split_to_array(lower(name), '[^a-z]+'), lambda w: length(w) >= 3)) > 0 AND NOT list_contains(regexp_split_to_array(lower(name), '[^a-z]+'), 'stone')
    UNION SELECT book, 'C5', CAST(src AS VARCHAR) FROM edges WHERE src = dst UNION SELECT book, 'C5', CAST(dst AS VARCHAR) FROM edges WHERE (book, dst) NOT IN (SELECT (book, id) FROM members) UNION SELECT book, 'C6', lower(name) FROM members WHERE mentions = 0""",
)
R.add(
    "score_matrix_pivot",
    lambda s, d: Q.score_matrix(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 50).alias("subject"), F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("score")), ["A", "N", "R"]),
    """SELECT l_suppkey % 50 AS subject, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS "A", round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6) AS "N", round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS "R" FROM lineitem GROUP BY 1""",
)
R.add(
    "confidence_bucket",
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") / 50 >= 0.8, "high").when(F.col("l_quantity") / 50 >= 0.5, "medium").otherwise("low").alias("confidence")).groupBy("l_orderkey", "confidence").agg(F.count("*").alias("n")),
    "SELECT l_orderkey, CASE WHEN l_quantity / 50 >= 0.8 THEN 'high' WHEN l_quantity / 50 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
R.add(
    "stage_cache_keys",
    lambda s, d: documents(s, d).select("doc_id", F.substring(F.sha1(F.col("text").cast("binary")), 1, 12).alias("key"), F.substring(F.md5("text"), 1, 8).alias("id")),
    "SELECT doc_id, substr(sha1(text), 1, 12) AS key, substr(md5(text), 1, 8) AS id FROM documents",
)
