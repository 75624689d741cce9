"""Registered queries over correction and evidence rules, with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.operators import cast as C
from corpuscle.operators import rules as U
from corpuscle.plans.cast_queries import CAST, EDGES, PRESENCE, _pick, _sql_list, cast, edges, presence
from corpuscle.plans.registry import Registry
from corpuscle.plans.text_queries import BOOKS, books, documents
from corpuscle.sources import sinks

R = Registry()
_GENDER = "CASE WHEN regexp_matches(name, '(?i)^(mr\\.?|sir|lord)\\s') THEN 'male' WHEN regexp_matches(name, '(?i)^(mrs\\.?|ms\\.?|miss|lady)\\s') THEN 'female' END"
SAID = ["He loves her and his father knew.", "Her rival came.", "An enemy at the gate.", "The neighbour spoke.", "Old friends met.", "She marries him.", "His father slept.", "His sister wept.", "It rained."]
MEANT = ["romantic", "rival", "enemy", "neighbor", "friend", "spouse", "father", "sister", None]


def _said() -> Column:
    return _pick(SAID, "doc_id")


R.add(
    "stated_relations",
    lambda s, d: documents(s, d).select("doc_id", U.stated_relation(_said()).alias("relation")),
    f"SELECT doc_id, nullif({_sql_list([m or '' for m in MEANT])}[1 + doc_id % {len(MEANT)}], '') AS relation FROM documents",
)
R.add(
    "semantic_conflicts",
    lambda s, d: documents(s, d).select("doc_id", U.being(_pick(["the monster", "the old man", "the red house", "Ann"], "doc_id")).alias("a"), U.being(_pick(["The Creature", "a captain", "his ring"], "doc_id")).alias("b")).where("a <> b"),
    "SELECT doc_id, a, b FROM (SELECT doc_id, ['creature', 'human', 'object', NULL][1 + doc_id % 4] AS a, ['creature', 'human', 'object'][1 + doc_id % 3] AS b FROM documents) WHERE a <> b",
)
R.add(
    "chapter_conventions",
    lambda s, d: books(s, d).select("doc_id", U.conventions(F.col("text")).alias("c")).select("doc_id", F.array_join("c", ",").alias("conventions"), F.round(U.profile_confidence(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.size("c")), 6).alias("confidence")),
    f"""WITH {BOOKS} SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(h, '(?m)^Chapter \\d+') THEN 'numbered' END, CASE WHEN regexp_matches(h, '(?m)^CHAPTER ') THEN 'capitals' END, CASE WHEN regexp_matches(h, '(?m)^[IVXLC]+\\.?$') THEN 'roman' END,
    CASE WHEN regexp_matches(h, '(?m)^\\s*\\*\\s*\\*\\s*\\*\\s*$') THEN 'breaks' END, CASE WHEN regexp_matches(h, '(?m)^PART ') THEN 'parts' END) AS conventions, round(0.6 + CASE WHEN doc_id % 2 = 0 THEN 0.3 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS confidence
    FROM (SELECT doc_id, substr(text, 1, 50000) AS h FROM books)""",
)


def _parents(s: SparkSession, d: str) -> DataFrame:
    return edges(s, d).withColumn("label", F.when((F.col("src") + F.col("dst")) % 3 == 0, "father").otherwise(F.col("label")))


_PARENTS = f"{EDGES}, pe AS (SELECT book, src, dst, CASE WHEN (src + dst) % 3 = 0 THEN 'father' ELSE label END AS label FROM edges)"
R.add(
    "mutual_parents",
    lambda s, d: U.mutual_parents(_parents(s, d), cast(s, d)),
    f"""WITH {CAST}, {_PARENTS}, n AS (SELECT book, id, CASE WHEN len(core) > 1 THEN core[len(core)] END AS s FROM cores), b AS (SELECT book, dst AS src, src AS dst FROM pe WHERE label IN ('father', 'mother', 'parent'))
    SELECT e.book, e.src, e.dst, CASE WHEN b.src IS NOT NULL AND label IN ('father', 'mother', 'parent') THEN CASE WHEN n1.s = n2.s THEN 'sibling' ELSE 'associated' END ELSE label END AS label
    FROM pe e LEFT JOIN b ON b.book = e.book AND b.src = e.src AND b.dst = e.dst LEFT JOIN n n1 ON n1.book = e.book AND n1.id = e.src LEFT JOIN n n2 ON n2.book = e.book AND n2.id = e.dst""",
)
R.add(
    "same_person_labels",
    lambda s, d: U.same_person_unknown(edges(s, d).withColumn("label", F.when(F.col("src") % 4 == 0, F.concat("label", F.lit(" (same person)"))).otherwise(F.col("label")))),
    f"WITH {EDGES} SELECT book, src, dst, CASE WHEN src % 4 = 0 THEN 'unknown' ELSE label END AS label FROM edges",
)
R.add(
    "unfounded_labels",
    lambda s, d: U.supported(edges(s, d), C.shared_chapters(presence(s, d), 5).select("book", "a", "b"), ("friend", "wife", "husband")),
    f"""WITH {EDGES}, {PRESENCE}, p AS (SELECT a.book, a.id AS a, b.id AS b FROM presence a JOIN presence b ON a.book = b.book AND a.chapter = b.chapter AND a.id < b.id GROUP BY 1, 2, 3 HAVING count(*) >= 5)
    SELECT e.book, src, dst, CASE WHEN label IN ('friend', 'wife', 'husband') AND p.a IS NULL THEN 'associated' ELSE label END AS label FROM edges e LEFT JOIN p ON p.book = e.book AND p.a = least(src, dst) AND p.b = greatest(src, dst)""",
)
R.add(
    "inverse_consistency",
    lambda s, d: U.inverse_consistent(edges(s, d), cast(s, d)),
    f"""WITH {CAST}, {EDGES}, g AS (SELECT book, id, {_GENDER} AS gender FROM members), c AS (SELECT book, dst AS src, src AS dst FROM edges WHERE label IN ('son', 'daughter', 'child'))
    SELECT e.book, e.src, e.dst, CASE WHEN c.src IS NOT NULL AND label NOT IN ('father', 'mother', 'parent', 'son', 'daughter', 'child') THEN CASE gender WHEN 'male' THEN 'father' WHEN 'female' THEN 'mother' ELSE 'parent' END ELSE label END AS label
    FROM edges e LEFT JOIN c ON c.book = e.book AND c.src = e.src AND c.dst = e.dst LEFT JOIN g ON g.book = e.book AND g.id = e.src""",
)
R.add(
    "dominant_roles",
    lambda s, d: U.dominant_role(edges(s, d)),
    f"WITH {EDGES} SELECT book, id, label FROM (SELECT book, src AS id, label, row_number() OVER (PARTITION BY book, src ORDER BY count(*) DESC, label) AS k FROM edges GROUP BY book, src, label HAVING count(*) >= 2) WHERE k = 1",
)
R.add(
    "parenthetical_kin",
    lambda s, d: cast(s, d).select("id", U.parenthetical(F.concat("name", F.when(F.col("id") % 3 == 0, " (his Mother)").when(F.col("id") % 3 == 1, "(the son)").otherwise(" (nobody)"))).alias("x")).where("x is not null").select("id", "x.base", "x.kin"),
    f"WITH {CAST} SELECT id, name AS base, CASE id % 3 WHEN 0 THEN 'mother' ELSE 'son' END AS kin FROM members WHERE id % 3 < 2",
)


def _aliases(s: SparkSession, d: str) -> DataFrame:
    return cast(s, d).select("book", "id", F.regexp_replace("name", r"^\w+\.? ", "").alias("alias"))


R.add(
    "alias_conflicts",
    lambda s, d: U.alias_conflicts(cast(s, d), _aliases(s, d)),
    f"""WITH {CAST}, a AS (SELECT book, id, lower(trim(regexp_replace(name, '^\\w+\\.? ', ''))) AS n FROM members), h AS (SELECT m.book, a.id AS a, m.id AS b, x.mentions AS ma, m.mentions AS mb FROM a JOIN members m ON m.book = a.book AND lower(trim(m.name)) = a.n AND m.id <> a.id JOIN members x ON x.book = a.book AND x.id = a.id),
    k AS (SELECT *, CASE WHEN ma > mb OR (ma = mb AND a < b) THEN a ELSE b END AS keep FROM h) SELECT book, CASE WHEN keep = a THEN b ELSE a END AS id, min(keep) AS "into" FROM k GROUP BY 1, 2""",
)
R.add(
    "name_containment",
    lambda s, d: U.containment(cast(s, d)),
    f"""WITH {CAST}, u AS (SELECT book, id, list_distinct(core) AS core, core AS raw FROM cores WHERE len(core) > 0), p AS (SELECT a.book, a.id AS a, b.id AS b, array_to_string(b.raw, ' ') AS large FROM u a JOIN u b ON a.book = b.book AND len(a.core) < len(b.core) AND list_has_all(b.core, a.core)),
    n AS (SELECT book, a, count(DISTINCT large) AS n FROM p GROUP BY 1, 2) SELECT p.book, p.a, p.b, CASE WHEN n > 1 THEN 'ambiguous_surname' ELSE 'name_containment' END AS kind FROM p JOIN n USING (book, a)""",
)
R.add(
    "shared_aliases",
    lambda s, d: U.shared_aliases(_aliases(s, d)),
    f"""WITH {CAST}, a AS (SELECT DISTINCT book, id, lower(trim(regexp_replace(name, '^\\w+\\.? ', ''))) AS n FROM members), f AS (SELECT book, n, min(id) AS a FROM a GROUP BY 1, 2) SELECT DISTINCT a.book, f.a, a.id AS b FROM a JOIN f USING (book, n) WHERE a.id <> f.a""",
)
R.add(
    "canonical_renames",
    lambda s, d: U.renamed(cast(s, d), s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 25).cast("long").alias("book"), (F.col("l_partkey") % 300).alias("id"), F.when(F.col("l_linenumber") == 1, "A").when(F.col("l_linenumber") <= 3, "The B").otherwise("C").alias("alias")).groupBy("book", "id", "alias").agg(F.count("*").alias("n")).withColumn("canonical", F.col("alias") == "A"), 5, 5),
    f"""WITH {CAST}, k AS (SELECT CAST(l_suppkey % 25 AS BIGINT) AS book, l_partkey % 300 AS id, CASE WHEN l_linenumber = 1 THEN 'A' WHEN l_linenumber <= 3 THEN 'The B' ELSE 'C' END AS alias, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    r AS (SELECT k.book, k.id, k.alias, row_number() OVER (PARTITION BY k.book, k.id ORDER BY contains(k.alias, ' ') DESC, k.n DESC, k.alias) AS r FROM k JOIN k o ON o.book = k.book AND o.id = k.id AND o.alias = 'A' WHERE k.alias <> 'A' AND o.n < 5 AND k.n >= 5 AND k.n > 3 * o.n)
    SELECT book, id, alias FROM r WHERE r = 1 AND (book, id) IN (SELECT (book, id) FROM members)""",
)
R.add(
    "upserted_pairs",
    lambda s, d: U.upserted_pairs(s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 90).alias("a"), (F.col("o_orderkey") % 90).alias("b"), (F.col("o_orderkey") % 7 / 7).alias("confidence")), s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 90).alias("a"), (F.col("l_partkey") % 90).alias("b"), (F.col("l_quantity") / 50).alias("confidence"))),
    "SELECT least(a, b) AS a, greatest(a, b) AS b, max(c) AS confidence FROM (SELECT o_custkey % 90 AS a, o_orderkey % 90 AS b, (o_orderkey % 7) / 7 AS c FROM orders UNION ALL SELECT l_suppkey % 90, l_partkey % 90, l_quantity / 50 FROM lineitem) GROUP BY 1, 2",
)
R.add(
    "chapter_flags",
    lambda s, d: U.chapter_flags(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") % 500).alias("book"), (F.col("l_partkey") % 60).alias("id"), (F.col("l_suppkey") % 4).alias("chapter"), (F.col("l_quantity") / 50).alias("confidence"), (F.col("l_linenumber") > 3).alias("active"))),
    """WITH r AS (SELECT l_orderkey % 500 AS book, l_partkey % 60 AS id, count(DISTINCT l_suppkey % 4) AS n, max(l_quantity / 50) AS c, count(*) FILTER (l_linenumber > 3) AS act, count(*) FILTER (l_linenumber <= 3) AS men FROM lineitem GROUP BY 1, 2)
    SELECT book, id, 'once_only' AS flag FROM r WHERE n = 1 AND c < 0.7 UNION ALL SELECT book, id, 'never_active' FROM r WHERE men >= 2 AND act = 0""",
)
R.add(
    "uncovered_characters",
    lambda s, d: U.uncovered(cast(s, d), cast(s, d).select("book", _pick(["stone", "hale", "eve"], "book").alias("word")).distinct()),
    f"""WITH {CAST} SELECT book, id FROM cores WHERE len(core) > 1 AND NOT list_contains(core, ['stone', 'hale', 'eve'][1 + book % 3])""",
)
R.add(
    "age_words",
    lambda s, d: documents(s, d).select("doc_id", U.age_word(F.concat(_pick(["Ann, 34, sat. ", "An elderly Ann. ", "Ann sat. "], "doc_id"), F.lit("x" * 400), F.lit(" young")), F.lit(3)).alias("age")),
    "SELECT doc_id, ['34', 'elderly', NULL][1 + doc_id % 3] AS age FROM documents",
)
R.add(
    "narrator_guide",
    lambda s, d: sinks.narrator_guide(s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("word"), F.concat(F.lit("f"), (F.col("p_partkey") % 5).cast("string")).alias("flag"), (F.col("p_partkey") % 13).alias("n"), (F.col("p_partkey") % 17).alias("priority"))).select("flag", "n", F.md5("markdown").alias("digest")),
    """SELECT 'f' || (p_partkey % 5) AS flag, count(*) AS n, md5('## ' || 'f' || (p_partkey % 5) || E'\\n' || string_agg('- w' || p_partkey || ' (' || (p_partkey % 13) || ')', E'\\n' ORDER BY p_partkey % 17 DESC, 'w' || p_partkey)) AS digest FROM part GROUP BY p_partkey % 5""",
)
