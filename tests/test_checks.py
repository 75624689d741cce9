"""Checks and wording by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import display as D
from corpuscle.functions import text as T
from corpuscle.operators import checks as K


def values(spark, rows, rule, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(rule(F.col("x"))).collect()]


def test_headings_are_repaired_and_prose_is_not(spark):
    lines = ["Chapter Il", "  Il", "              TI", "He played the part well and paid 11 pounds; the letter said Il was gone", "part ITI", None]
    got = values(spark, lines, T.romans_repaired)
    assert got == ["Chapter II", "  II", "              II", lines[3], "part III", None]


def test_wording(spark):
    assert values(spark, ["2026-01-11T15:23:00", "soon", None], D.moment) == ["Jan 11, 2026 at 3:23 PM", "soon", ""]
    assert values(spark, [None, 0.0, 0.0042, 1.5], D.cost, "x double") == ["Unknown", "Free", "$0.0042", "$1.50"]
    assert values(spark, [None, "a" * 6], lambda c: D.truncated(c, 5)) == ["", "aaaaa..."]
    got = spark.range(1).select(D.redacted(F.expr("map('Authorization', 'Bearer secret', 'api-key', 'short', 'Accept', 'x')")).alias("m"), D.redacted(F.lit(None).cast("map<string,string>")).alias("n")).first()
    assert got["m"] == {"Authorization": "Bear*********", "api-key": "****", "Accept": "x"} and got["n"] == {}


def test_numbers_are_rounded_by_their_exact_value(spark):
    import random

    rng = random.Random(1)
    rows = [0.01855, 0.05565, 0.03125, 0.09375, 0.125, 2.675, 1.005, -0.00001, -0.03125, 0.00005, 9.99995, 0.99999, 123456.785, 1e11 + 0.125, 4503599627.12345]
    rows += [k * 0.00000371 for k in range(5_000, 1_200_000, 10_000)] + [rng.randrange(10**9) / 10**5 for _ in range(500)] + [rng.random() * 10 ** rng.randrange(-6, 9) for _ in range(500)]
    for digits in (2, 4):
        assert values(spark, rows, lambda c, n=digits: D.fixed(c, n), "x double") == [f"{x:.{digits}f}" for x in rows]


def test_costs_of_large_keys_equal_sql(spark, tmp_path):
    import duckdb

    from corpuscle.plans import catalog
    from tests.oracle import compare

    rows = spark.range(2_000).selectExpr("id as l_orderkey", "int(id % 7 + 1) as l_linenumber", "id * 1000 as l_partkey")
    rows.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert compare(catalog.QUERIES["display_costs"](spark, str(tmp_path)), con, catalog.SQL["display_costs"]) == 2_000


def test_names_and_terms(spark):
    assert values(spark, ["The Guards", "Staff Sergeant Ned", "Alpha Company RTO", "Company RTO", "", "the old"], K.group_descriptor) == [True, False, True, False, False, False]
    assert values(spark, ["New York", "mi chica", "12", "Hue 3"], K.title_case_tokens) == [True, False, False, True]
    assert values(spark, ["RTO (radio)", "a. b c", "one two three four five", "www.x.org", "12"], K.glossary_term) == ["RTO", None, None, None, None]
    assert values(spark, ["1-oh, 2-oh", "a, b c d", "x"], K.glossary_aliases) == [["1-oh", "2-oh"], ["a, b c d"], ["x"]]
    assert values(spark, ["Ann Hale", "Hall", "", None], lambda c: K.lastname_matches(c, F.lit("Hale"))) == [True, False, False, False]


@pytest.mark.parametrize(("size", "overlap"), [(6, 2), (6, 0), (3, 3)])
def test_sentences_are_packed(size, overlap):
    text = "One two three. Four five! Six? Seven eight nine ten. Eleven."
    chunks = list(K.packed_sentences(text, size, overlap))
    assert chunks[0].startswith("One") and chunks[-1].endswith("Eleven.")
    for a, b in zip(chunks, chunks[1:], strict=False):
        first = b.split(". ")[0].split("! ")[0].split("? ")[0].rstrip(".!?")
        assert first in a  # a chunk begins with the end of the one before
    assert list(K.packed_sentences("One. Two three. Four.", 3, 1)) == ["One. Two three.", "Two three. Four."]


def test_sections_and_long_sections(spark):
    rows = [(1, "One two.\n***\nThree four."), (2, " ".join(["Word word."] * 10)), (3, None), (4, "")]
    out = K.sentence_chunks(spark.createDataFrame(rows, "doc_id long, text string"), 8, 2).orderBy("doc_id", "chunk").collect()
    assert [(r["doc_id"], r["content"]) for r in out if r["doc_id"] == 1] == [(1, "One two."), (1, "Three four.")]
    assert [r["n_words"] for r in out if r["doc_id"] == 2] == [8, 8, 8] and {r["doc_id"] for r in out} == {1, 2}
