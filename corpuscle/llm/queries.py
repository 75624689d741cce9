"""The registered queries of this subpackage, opN_<name>, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import bpe, decontamination, flac, language, paragraphs, prefix_free, superminhash, url_filters, warc
from corpuscle.llm._spark import Tables
from corpuscle.llm.token_store import TokenStore


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written to archives and read back."""
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a FLAC stream in a written table, read back and decoded for sizes, digests and features."""
    options = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
    return flac.features(Tables(spark, "media").write(flac.to_media(_documents(spark, sf_dir)), "media", **options))


def op5_content_addressed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and checksum of every document in the token store, read back from its files."""
    store = TokenStore(spark, Tables(spark, "tokens").root).write(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)
    return store.documents()


def op9_temporal_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the dated list entries that are active at its fetch date."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(date'2024-01-01', cast(page_id * 7 % 365 as int))"))
    out = url_filters.judged(captures, dated_lists(captures))
    return out.withColumns({c: F.col(c).cast("date").cast("string") for c in ("fetched", "valid_from")})


def dated_lists(captures: DataFrame) -> DataFrame:
    """Entries (list, pattern, action, dated) for the hosts and last two labels that occur: four versions each."""
    host = url_filters.host_of(F.col("url"))
    named = captures.select(F.explode(F.array(host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))).alias("pattern")).where("pattern <> ''").distinct()
    versions = named.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    seeded = versions.withColumn("m", F.md5(F.concat("pattern", F.lit(":"), F.col("k").cast("string"))))
    return seeded.selectExpr(
        "case when ascii(substr(m, 3, 1)) % 2 = 0 then 'ads' else 'adult' end as list", "pattern",
        "case ascii(substr(m, 2, 1)) % 3 when 0 then 'block' when 1 then 'allow' else 'drop' end as action",
        "date_add(date'2024-01-01', 90 * k + ascii(substr(m, 1, 1)) % 80) as dated",
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and calibrated score of every document."""
    return language.identify(_documents(spark, sf_dir))


def op3_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.digests(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op6_superminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85 or more."""
    return superminhash.near_duplicates(_documents(spark, sf_dir), n=3, percent=85)


def op7_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without 100-byte strings that start earlier."""
    return prefix_free.deduplicated(_documents(spark, sf_dir), length=100, digest=True)


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with repeated passages cut from its text, and where their kept occurrences are."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return paragraphs.deduplicated(docs, percent=80, n=5)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item whose words align."""
    return decontamination.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS c FROM n UNION SELECT e.b AS a, r.c FROM r JOIN e ON e.a = r.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""

OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM d, unnest(generate_series(0, CAST(length(x) // 2 - 100 AS BIGINT))) AS t(p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w),
m AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM r WHERE k > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
c AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY 1, 2),
n AS (SELECT c.doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY c.doc_id ORDER BY a) AS before FROM c),
k AS (SELECT n.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept,
  sum(b - a) AS removed, count(*) AS spans FROM n JOIN d USING (doc_id) GROUP BY n.doc_id)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS keeper FROM d),
b AS (SELECT page_id, array_to_string(list_transform(generate_series(1, 40), lambda q: substr(
    '0000000100100011010001010110011110001001101010111100110111101111',
    CAST(4 * instr('0123456789abcdef', substr(h, q, 1)) - 3 AS BIGINT), 4)), '') AS bits FROM d),
c AS (SELECT page_id, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform([0, 1, 2, 3, 4], lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS BIGINT) * [16, 8, 4, 2, 1][j + 1])) AS BIGINT), 1)), '') AS digest FROM b)
SELECT k.page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN k.page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k.page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM k JOIN c USING (page_id)
"""

OP9_SQL = r"""
WITH c AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id * 7 % 365 AS INTEGER) AS fetched,
    coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host FROM pages),
n AS (SELECT host AS pattern FROM c UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM c),
v AS (SELECT pattern, k, md5(pattern || ':' || k) AS m FROM n, unnest([0, 1, 2, 3]) AS t(k) WHERE pattern <> ''),
e AS (SELECT CASE WHEN ascii(substr(m, 3, 1)) % 2 = 0 THEN 'ads' ELSE 'adult' END AS list, pattern,
    CASE ascii(substr(m, 2, 1)) % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'drop' END AS action,
    DATE '2024-01-01' + (90 * k + ascii(substr(m, 1, 1)) % 80) AS valid_from FROM v),
u AS (SELECT list, pattern, valid_from, max(action) AS action FROM e GROUP BY 1, 2, 3),
i AS (SELECT *, lead(valid_from) OVER (PARTITION BY list, pattern ORDER BY valid_from) AS valid_to FROM u),
k AS (SELECT page_id, host, fetched, url, unnest(list_distinct(list_concat(
    list_transform(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1)), lambda x: array_to_string(string_split(host, '.')[x:], '.')),
    CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) <> ''
      THEN [host || '/' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1)] ELSE [] END))) AS pattern FROM c WHERE host <> ''),
m AS (SELECT k.page_id, k.url, k.fetched, i.*, row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched
      ORDER BY length(i.pattern) DESC, valid_from DESC, list DESC, action DESC) AS r,
    count(*) OVER (PARTITION BY k.page_id, k.url, k.fetched) AS n FROM k JOIN i ON i.pattern = k.pattern
    AND i.action <> 'drop' AND i.valid_from <= k.fetched AND (i.valid_to IS NULL OR k.fetched < i.valid_to))
SELECT c.page_id, c.host, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(m.action, 'keep') AS verdict, m.pattern, m.list, CAST(m.valid_from AS VARCHAR) AS valid_from, coalesce(m.n, 0) AS n_active
FROM c LEFT JOIN m ON m.page_id = c.page_id AND m.url = c.url AND m.fetched = c.fetched AND m.r = 1
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_archives": op1_warc_archives,
    "op2_language_id": op2_language_id,
    "op3_bpe_pair_index": op3_bpe_pair_index,
    "op4_flac_media": op4_flac_media,
    "op5_content_addressed_tokens": op5_content_addressed_tokens,
    "op6_superminhash_near_dedup": op6_superminhash_near_dedup,
    "op7_prefix_free_dedup": op7_prefix_free_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_temporal_url_filters": op9_temporal_url_filters,
    "op10_paragraph_dedup": op10_paragraph_dedup,
}
SQL: dict[str, str] = {
    "op1_warc_archives": OP1_SQL,
    "op6_superminhash_near_dedup": OP6_SQL,
    "op7_prefix_free_dedup": OP7_SQL,
    "op9_temporal_url_filters": OP9_SQL,
}
