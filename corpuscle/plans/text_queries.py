"""Registered queries over text: cleaning, structure, positions. Each has SQL for DuckDB beside it.

The test tables hold hardly any headings, breaks or damage, so the queries set
such marks into the texts first, by the same rule in both languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import lines as L
from corpuscle.plans.registry import Registry

R = Registry()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): ten documents each as a book with chapter headings and scene breaks between them."""
    part = F.concat(F.lit("CHAPTER "), (F.col("doc_id") % 10 + 1).cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n\n* * *\n\n"))
    rows = documents(spark, sf_dir).groupBy(F.expr("doc_id div 10").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("d"), part.alias("t")))).alias("parts"))
    return rows.select("doc_id", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("text"))


BOOKS = r"""books AS (SELECT doc_id // 10 AS doc_id, string_agg('CHAPTER ' || (doc_id % 10 + 1) || E'\n\n' || coalesce(text, '') || E'\n\n* * *\n\n', '' ORDER BY doc_id) AS text
  FROM documents GROUP BY 1)"""
LINES = r"""ls AS (SELECT doc_id, string_split(text, E'\n') AS a FROM books),
ln AS (SELECT doc_id, CAST(unnest(generate_series(0, len(a) - 1)) AS INTEGER) AS ln, unnest(a) AS line FROM ls),
lines AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS off FROM ln)"""


def _by_text(expression: Column, spark: SparkSession, sf_dir: str, damage: Column | None = None) -> DataFrame:
    """(doc_id, out, n_before) of an expression over the column t."""
    t = F.col("text") if damage is None else damage
    rows = documents(spark, sf_dir).select("doc_id", t.alias("t"))
    return rows.select("doc_id", F.md5(expression).alias("out"), F.length("t").alias("n_before"), F.length(expression).alias("n_after"))


def _sql(out: str, damage: str = "text") -> str:
    return f"SELECT doc_id, md5({out}) AS \"out\", CAST(length(t) AS INTEGER) AS n_before, CAST(length({out}) AS INTEGER) AS n_after FROM (SELECT doc_id, {damage} AS t FROM documents)"


def _spaced() -> Column:
    return F.replace(F.replace(F.col("text"), F.lit(", "), F.lit(",  \t")), F.lit(". "), F.lit(". \r\n\r\n\n\n  "))


R.add(
    "word_frequency",
    lambda s, d: L.words(documents(s, d)).groupBy("word", "doc_id").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")),
    f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{L.WORD.replace(chr(39), chr(39) * 2)}'))) AS word FROM documents) GROUP BY 1",
)
R.add(
    "doc_word_counts",
    lambda s, d: documents(s, d).select("doc_id", T.word_count(F.col("text")).alias("n_words"), F.length("text").alias("n_characters")),
    r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INTEGER) AS n_words, CAST(length(text) AS INTEGER) AS n_characters FROM documents",
)
R.add(
    "normalize_text",
    lambda s, d: _by_text(T.normalized(F.col("t")), s, d, _spaced()),
    _sql(
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', E'\n', 'g'), '\n{3,}', E'\n\n', 'g'), '[ \t]+\n', E'\n', 'g'), '[ \t]+$', '', 'g'), '([^ \t\n])[ \t]+', '\1 ', 'g'), '^\s+|\s+$', '', 'g')",
        r"replace(replace(text, ', ', E',  \t'), '. ', E'. \r\n\r\n\n\n  ')",
    ),
)
R.add(
    "clean_title",
    lambda s, d: documents(s, d).select("doc_id", T.clean_title(F.concat(F.lit("\ufeff "), F.substring("text", 1, 30), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".epub"))).alias("title")),
    r"SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(' ' || substr(text, 1, 30) || CASE WHEN doc_id % 2 = 0 THEN '.PDF' ELSE '.epub' END, '(?i)\.(pdf|docx|epub|txt)$', ''), '\s+', ' ', 'g')), '') AS title FROM documents",
)


def _marked() -> Column:
    return F.concat(F.lit("Licence text\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), F.col("text"), F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nMore licence"))


R.add(
    "strip_boilerplate",
    lambda s, d: _by_text(T.without_boilerplate(F.col("t")), s, d, _marked()),
    _sql(
        r"regexp_replace(regexp_replace(t, '(?is)\*\*\*\s*END\s+OF\s+(THE\s+)?PROJECT\s+GUTENBERG\s+EBOOK.*?\*\*\*.*$', ''), '(?is)^.*?\*\*\*\s*START\s+OF\s+(THE\s+)?PROJECT\s+GUTENBERG\s+EBOOK[^\n]*?\*\*\*', '')",
        r"E'Licence text\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n' || text || E'\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nMore licence'",
    ),
)
R.add(
    "refine_characters",
    lambda s, d: _by_text(T.plain_characters(F.col("t")), s, d, F.concat(F.replace(F.col("text"), F.lit(", "), F.lit(",\u00a0")), F.lit("\x07 a\u2013b"))),
    _sql(r"regexp_replace(translate(t, chr(160) || chr(8239) || chr(8199) || chr(8201) || chr(8202) || chr(8208) || chr(8209) || chr(8210) || chr(8211), '     ----'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')", "replace(text, ', ', ',' || chr(160)) || chr(7) || ' a' || chr(8211) || 'b'"),
)
R.add(
    "dehyphenate",
    lambda s, d: _by_text(T.dehyphenated(F.col("t")), s, d, F.regexp_replace("text", r" ([a-z]{3})([a-z]{3}) ", " $1-\n$2 ")),
    _sql(r"regexp_replace(t, '\b([a-zA-Z]{2,})-\s*\n\s*([a-zA-Z]{2,})\b', '\1\2', 'g')", r"regexp_replace(text, ' ([a-z]{3})([a-z]{3}) ', E' \\1-\n\\2 ', 'g')"),
)
R.add(
    "rejoin_split_words",
    lambda s, d: _by_text(T.rejoined(F.col("t")), s, d, F.regexp_replace("text", r" ([a-z]{3})([a-z]{3}) ", " $1\n$2 ")),
    _sql(r"regexp_replace(t, '\b([A-Z]?[a-z]{2,})\n[ \t]*([a-z]{2,})\b', '\1\2', 'g')", r"regexp_replace(text, ' ([a-z]{3})([a-z]{3}) ', E' \\1\n\\2 ', 'g')"),
)


def _replaced(source: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        source = f"replace({source}, '{a}', '{b}')"
    return source


_FORMS = [(form(a), form(b)) for a, b in T.SUBSTITUTIONS.items() for form in (str.lower, str.capitalize, str.upper)]
R.add(
    "ocr_substitutions",
    lambda s, d: _by_text(T.substituted(F.col("t")), s, d, F.replace(F.replace(F.col("text"), F.lit("the"), F.lit("tlie")), F.lit("With"), F.lit("Witli"))),
    "SELECT doc_id, md5(o) AS \"out\", CAST(length(t) AS INTEGER) AS n_before, CAST(length(o) AS INTEGER) AS n_after FROM (SELECT doc_id, t, list_reduce(list_prepend({'a': '', 'b': t}, ["
    + ", ".join(f"{{'a': '{a}', 'b': '{b}'}}" for a, b in _FORMS)
    + "]), lambda x, y: {'a': '', 'b': replace(x.b, y.a, y.b)}).b AS o FROM (SELECT doc_id, replace(replace(text, 'the', 'tlie'), 'With', 'Witli') AS t FROM documents))",
)
R.add(
    "ocr_romans",
    lambda s, d: documents(s, d).select("doc_id", F.element_at(F.array(*map(F.lit, T.ROMAN_ERRORS)), (F.col("doc_id") % len(T.ROMAN_ERRORS) + 1).cast("int")).alias("wrong")).select("doc_id", T.romans_repaired(F.concat(F.lit("Chapter "), "wrong")).alias("heading"), T.romans_repaired(F.concat(F.lit("He said "), "wrong")).alias("prose")),
    "SELECT doc_id, 'Chapter ' || r[1 + doc_id % len(r)] AS heading, 'He said ' || w[1 + doc_id % len(w)] AS prose FROM documents, (SELECT ["
    + ", ".join(f"'{k}'" for k in T.ROMAN_ERRORS) + "] AS w, [" + ", ".join(f"'{v}'" for v in T.ROMAN_ERRORS.values()) + "] AS r)",
)
R.add(
    "ligatures",
    lambda s, d: _by_text(T.ligatures_joined(F.col("t")), s, d, F.replace(F.replace(F.col("text"), F.lit("ea"), F.lit("f i")), F.lit("ou"), F.lit("f l"))),
    _sql(
        r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\bf\s+f\s+i', 'ffi', 'g'), '\bf\s+f\s+l', 'ffl', 'g'), '([a-z]{2,})f\s+i([a-z])', '\1fi\2', 'g'), '([a-z]{2,})f\s+l([a-z])', '\1fl\2', 'g'), '([a-z]{2,})f\s+f([a-z])', '\1ff\2', 'g')",
        "replace(replace(text, 'ea', 'f i'), 'ou', 'f l')",
    ),
)
R.add(
    "glyphs",
    lambda s, d: _by_text(T.glyphs_spelled(F.col("t")), s, d, F.concat(F.replace(F.col("text"), F.lit("th"), F.lit("\ufb01")), F.lit("\n 12 \nx"))),
    _sql(r"regexp_replace(replace(replace(replace(replace(replace(t, chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'), '(?m)^[ \t]*\d+[ \t]*$\n?', '', 'g')", r"replace(text, 'th', chr(64257)) || E'\n 12 \nx'"),
)
R.add(
    "short_concatenations",
    lambda s, d: documents(s, d).select("doc_id", F.element_at(F.array(*map(F.lit, T.CONCATENATIONS)), (F.col("doc_id") % len(T.CONCATENATIONS) + 1).cast("int")).alias("word")).select("doc_id", T.concatenation_split(F.col("word")).alias("exact"), T.concatenation_split(F.initcap("word")).alias("title")),
    "SELECT doc_id, m[w] AS exact, coalesce(m[upper(w[1]) || lower(w[2:])], upper(m[lower(w)][1]) || m[lower(w)][2:]) AS title FROM (SELECT doc_id, m, k[1 + doc_id % len(k)] AS w FROM documents, (SELECT MAP {"
    + ", ".join(f"'{k}': '{v}'" for k, v in T.CONCATENATIONS.items()) + "} AS m, [" + ", ".join(f"'{k}'" for k in T.CONCATENATIONS) + "] AS k))",
)
_KNOWN = "|".join(sorted((w for w in T.COMMON if 2 <= len(w) <= 7), key=len, reverse=True))
R.add(
    "spacing_gate",
    lambda s, d: documents(s, d).select("doc_id", T.needs_spacing(F.when(F.col("doc_id") % 2 == 0, F.replace(F.col("text"), F.lit(" th"), F.lit("Th"))).otherwise(F.lit("it is so. it was up. she is ill")), 10_000).alias("needed")),
    rf"""SELECT doc_id, coalesce(len(list_filter(w, lambda x: regexp_matches(x, '[a-z][A-Z]') OR (length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 8 AND (
      regexp_matches(lower(regexp_replace(x, '[^A-Za-z]', '', 'g')), '^({_KNOWN})[a-z]{{3,}}') OR regexp_matches(regexp_replace(x, '[^A-Za-z]', '', 'g'), '[a-z][A-Z]')
      OR regexp_matches(lower(regexp_replace(x, '[^A-Za-z]', '', 'g')), '[a-z](of|my)[a-z]'))))) / nullif(len(w), 0) > 0.05, false) AS needed
      FROM (SELECT doc_id, list_filter(regexp_split_to_array(substr(CASE WHEN doc_id % 2 = 0 THEN replace(text, ' th', 'Th') ELSE 'it is so. it was up. she is ill' END, 1, 10000), '\s+'), lambda q: q <> '') AS w FROM documents)""",
)
R.add(
    "html_to_text",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(T.html_text(F.col("html"))).alias("out"), F.length(T.html_text(F.col("html"))).alias("n")),
    r"""SELECT page_id, md5(x) AS "out", CAST(length(x) AS INTEGER) AS n FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<(script|style|nav)\b[^>]*>.*?</(script|style|nav)>', '', 'g'), '(?i)<(br|/p|/div|/h[1-6]|/blockquote|/li)\b[^>]*>', E'\n', 'g'), '(?s)<[^>]+>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t]*\n\s*', E'\n', 'g')) AS x FROM pages)""",
)
R.add(
    "repeating_lines",
    lambda s, d: L.lines(documents(s, d)).where("length(trim(line)) > 3").groupBy(F.trim("line").alias("line")).agg(F.countDistinct("doc_id").alias("n_docs")).where("n_docs >= 3"),
    r"SELECT trim(line) AS line, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line FROM documents) WHERE length(trim(line)) > 3 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3",
)
R.add(
    "scene_breaks",
    lambda s, d: L.scene_breaks(books(s, d)),
    rf"""WITH {BOOKS}, {LINES} SELECT doc_id, CAST(ln + 1 AS INTEGER) AS ln, off AS start, CAST(off + length(line) AS INTEGER) AS "end" FROM lines WHERE regexp_matches(line, '^\s*[-=*~.]{{3,}}\s*$|^\s*\*\s*\*\s*\*\s*$')""",
)
_HEADS = rf"""h AS (SELECT doc_id, off AS start, trim(regexp_replace(line, '\s+', ' ', 'g')) AS title FROM lines WHERE regexp_matches(line, '^\s*(?i:chapter)\s+(\d+|[IVXLCivxlc]+|(?i:{L._NUMBER}))\b.*$'))"""
R.add(
    "chapter_markers",
    lambda s, d: L.headings(books(s, d)).where("kind = 'chapter'").select("doc_id", "start", "title", "confidence", "hard"),
    f"WITH {BOOKS}, {LINES}, {_HEADS} SELECT doc_id, start, title, CAST(0.95 AS DOUBLE) AS confidence, true AS hard FROM h",
)
_CHAPTERS = rf"""{_HEADS}, b AS (SELECT h.doc_id, title, start, row_number() OVER w AS idx, coalesce(lead(start) OVER w, length(text)) AS e, text FROM h JOIN books USING (doc_id) WINDOW w AS (PARTITION BY h.doc_id ORDER BY start)),
c AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, title, start, CAST(e AS INTEGER) AS "end", CAST(len(list_filter(regexp_split_to_array(substr(text, start + 1, e - start), '\s+'), lambda w: w <> '')) AS INTEGER) AS words FROM b)"""


def _chapters(s: SparkSession, d: str) -> DataFrame:
    held = books(s, d)
    return L.chapters(held, L.spaced(L.headings(held).where("kind = 'chapter'"), 1))


R.add("chapter_bounds", _chapters, f'WITH {BOOKS}, {LINES}, {_CHAPTERS} SELECT doc_id, idx, title, start, "end", words FROM c')
R.add(
    "chapter_sizes",
    lambda s, d: L.size_verdicts(_chapters(s, d)).select("doc_id", "idx", "words", "verdict"),
    f"""WITH {BOOKS}, {LINES}, {_CHAPTERS} SELECT doc_id, idx, words, CASE WHEN n >= 2 AND words < 0.2 * m AND words < 500 THEN 'small' WHEN n >= 2 AND words > 3 * m THEN 'large' ELSE 'ok' END AS verdict
      FROM (SELECT *, avg(words) OVER (PARTITION BY doc_id) AS m, count(*) OVER (PARTITION BY doc_id) AS n FROM c)""",
)
R.add(
    "chapter_durations",
    lambda s, d: _chapters(s, d).select("doc_id", "idx", F.round(F.col("words") / 150, 6).alias("minutes")),
    f"WITH {BOOKS}, {LINES}, {_CHAPTERS} SELECT doc_id, idx, round(words / 150, 6) AS minutes FROM c",
)
R.add(
    "paragraphs",
    lambda s, d: L.paragraphs(books(s, d)),
    rf"""WITH {BOOKS}, {LINES}, f AS (SELECT *, regexp_matches(line, '^\s*$') AS blank FROM lines),
      g AS (SELECT *, sum(CASE WHEN NOT blank AND (coalesce(lag_blank, true) OR regexp_matches(line, '^[ \t]{{2,}}')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY ln) AS lag_blank FROM f))
      SELECT doc_id, CAST(run - 1 AS INTEGER) AS idx, min(off) AS start, CAST(max(off + length(line)) AS INTEGER) AS "end" FROM g WHERE NOT blank GROUP BY doc_id, run""",
)
R.add(
    "text_chunks",
    lambda s, d: L.chunks(documents(s, d), 2000, 200).select("doc_id", "k", "start", F.md5("chunk").alias("digest")),
    "SELECT doc_id, CAST(k AS INTEGER) AS k, CAST(1800 * k AS INTEGER) AS start, md5(substr(text, CAST(1800 * k + 1 AS BIGINT), 2000)) AS digest FROM documents, unnest(generate_series(0, greatest(length(text) - 1, 0) // 1800)) AS t(k)",
)
R.add(
    "roman_to_int",
    lambda s, d: documents(s, d).select("doc_id", F.regexp_replace("text", "[^IVXLCDMivxlcdm]", "").alias("x")).select("doc_id", T.roman_value(F.substring("x", 1, 6)).alias("value")),
    """SELECT doc_id, CAST(coalesce(list_sum(list_transform(generate_series(1, len(v)), lambda i: CASE WHEN i < len(v) AND v[i] < v[i + 1] THEN -v[i] ELSE v[i] END)), 0) AS INTEGER) AS value FROM (SELECT doc_id,
      list_transform(string_split(upper(substr(regexp_replace(text, '[^IVXLCDMivxlcdm]', '', 'g'), 1, 6)), ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END) AS v FROM documents)""",
)
_WORD = L.WORD.replace("'", "''")
_POSTED = rf"""q AS (SELECT doc_id, unnest(a) AS form, unnest(generate_series(1, len(a))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({_WORD})', E'\x01\\1\x01', 'g'), E'\x01') AS a FROM books)),
qq AS (SELECT doc_id, i, form, sum(length(form)) OVER (PARTITION BY doc_id ORDER BY i) - length(form) AS pos FROM q),
post AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, form, lower(form) AS word FROM qq WHERE i % 2 = 0)"""


R.add(
    "postings_by_chapter",
    lambda s, d: L.word_index(books(s, d), _chapters(s, d), "idx", 1).groupBy("doc_id", "idx").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"), F.min("first_pos").alias("first_pos")),
    f"""WITH {BOOKS}, {LINES}, {_CHAPTERS}, {_POSTED} SELECT post.doc_id, coalesce(c.idx, 1) AS idx, count(*) AS n, count(DISTINCT word) AS n_distinct, min(pos) AS first_pos
      FROM post LEFT JOIN c ON c.doc_id = post.doc_id AND pos >= c.start AND pos < c."end" GROUP BY 1, 2""",
)
R.add(
    "context_window",
    lambda s, d: L.postings(documents(s, d)).groupBy("doc_id").agg(F.max("pos").alias("pos")).join(documents(s, d), "doc_id").select("doc_id", "pos", T.context(F.col("text"), F.expr("pos div 2"), F.lit(5)).alias("context")),
    rf"""WITH q AS (SELECT doc_id, unnest(a) AS form, unnest(generate_series(1, len(a))) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({_WORD})', E'\x01\\1\x01', 'g'), E'\x01') AS a FROM documents)),
      z AS (SELECT doc_id, i, sum(length(form)) OVER (PARTITION BY doc_id ORDER BY i) - length(form) AS pos FROM q),
      w AS (SELECT z.doc_id, any_value(text) AS text, max(pos) AS pos FROM z JOIN documents USING (doc_id) WHERE i % 2 = 0 GROUP BY 1)
      SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos // 2 > 100 THEN '...' ELSE '' END || trim(regexp_replace(substr(text, CAST(greatest(pos // 2 - 100, 0) + 1 AS BIGINT), CAST(least(length(text), pos // 2 + 105) - greatest(pos // 2 - 100, 0) AS BIGINT)), '\s+', ' ', 'g'))
      || CASE WHEN pos // 2 + 105 < length(text) THEN '...' ELSE '' END AS context FROM w""",
)
