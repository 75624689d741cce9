"""Text repair, structure and words on hand-made inputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import lexicon, lines


def one(spark, function, value):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    ("function", "value", "wanted"),
    [
        (T.dehyphenated, "This is an exam-\nple of text", "This is an example of text"),
        (T.dehyphenated, "Henry Cler-\nval came", "Henry Clerval came"),
        (T.dehyphenated, "a-\nb", "a-\nb"),
        (T.rejoined, "Cler\nval", "Clerval"),
        (T.ligatures_joined, "of imaginary of f ice", "of imaginary offfice".replace("offfice", "of f ice")),
        (T.ligatures_joined, "the sheaf f lew", "the sheaf flew".replace("sheaf flew", "sheaf f lew")),
        (T.substituted, "Tlie cat witli tlie hat", "The cat with the hat"),
        (T.romans_repaired, "Chapter ITI", "Chapter III"),
        (T.romans_repaired, "He said IT was", "He said IT was"),
        (T.normalized, "a\r\n\r\n\r\n\r\nb  c \n", "a\n\nb c"),
        (T.clean_title, "﻿ My  Book.PDF", "My Book"),
        (T.roman_value, "XIV", 14),
        (T.roman_value, "MCMXC", 1990),
        (T.concatenation_split, "Inthe", "In the"),
        (T.concatenation_split, "cat", None),
        (T.normalized_name, "“Wilson’s", "Wilson"),
        (T.without_thinking, "<think>x</think>yes", "yes"),
        (T.valid_ipa, "ˈhɛl.oʊ", True),
        (T.valid_ipa, "日", False),
        (T.normalized, None, None),
        (T.normalized, "", ""),
    ],
)
def test_expression(spark, function, value, wanted):
    assert one(spark, function, value) == wanted


@pytest.mark.parametrize("mark", ["---", "***", "* * *", "===", "~~~", "...."])
def test_scene_break_forms(spark, mark):
    docs = spark.createDataFrame([(1, f"Before\n{mark}\nAfter"), (2, "prose -- with a dash"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in lines.scene_breaks(docs).collect()] == [(1, 2, 7, 7 + len(mark))]


def test_postings_and_positions(spark):
    text = "The quick brown fox jumps over the lazy dog. The fox was quick."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = lines.postings(docs).collect()
    assert {r["word"] for r in rows} == {"the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "was"}
    assert all(text[r["pos"] : r["pos"] + len(r["form"])] == r["form"] for r in rows)


def test_spans_hold_positions(spark):
    positions = spark.createDataFrame([(1, 0), (1, 5), (1, 9), (1, 20), (2, 3)], "doc_id long, pos int")
    ranges = spark.createDataFrame([(1, 5, 9, 1), (1, 9, 12, 2)], "doc_id long, start int, end int, idx int")
    got = {(r["doc_id"], r["pos"]): r["idx"] for r in lines.in_spans(positions, ranges, "idx").collect()}
    assert got == {(1, 0): None, (1, 5): 1, (1, 9): 2, (1, 20): None, (2, 3): None}


@pytest.mark.parametrize(("word", "stem"), [("jingled", "jingle"), ("familiarly", "familiar"), ("unsheathing", "sheathe"), ("happily", "happy"), ("running", "run")])
def test_stems(word, stem):
    assert stem in lexicon.stems_of(word)


def test_glossary_takes_the_first_form_with_three_lines(spark):
    text = "Aardvark: a burrowing animal\nBaroque: an ornate style\nCadence: a flow of sounds\nDjango: a jazz guitarist"
    docs = spark.createDataFrame([(1, text), (2, "Only: one entry of this kind")], "doc_id long, text string")
    rows = lines.glossary(docs).collect()
    assert sorted(r["term"] for r in rows) == ["Aardvark", "Baroque", "Cadence", "Django"] and {r["method"] for r in rows} == {"colon"}


def test_lines_and_spans_hold_one_block(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    class Run:
        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    monkeypatch.setattr(lines, "_texts", lambda docs: Run())
    text = "several words\n" * 20_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([text] * 20)], names=["doc_id", "text"])
    for run, last, n in ((lines.lines(None), "line", 20_001), (lines.spans(None, lines.WORD), "form", 40_000)):
        tracemalloc.start()
        sizes = [(out.num_rows, out.column(last).to_pylist() and max(map(len, out.column(last).to_pylist()))) for out in run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(k for k, _ in sizes) == 20 * n and max(k for k, _ in sizes) <= lines.BLOCK and peak < 20e6


def test_word_index_equals_postings_in_spans(spark):
    docs = spark.createDataFrame([(1, "before One two one, TWO after-word é"), (2, "no span here, no"), (3, None), (4, "")], "doc_id long, text string")
    ranges = spark.createDataFrame([(1, 16, 24, 8), (1, 7, 11, 7), (1, 26, None, 9), (5, 0, 9, 1), (1, 11, 16, None)], "doc_id long, start int, end int, idx int")
    found = lines.in_spans(lines.postings(docs), ranges, "idx", F.lit(7)).groupBy("doc_id", "idx", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    got = lines.word_index(docs, ranges, "idx", 7)
    columns = ["doc_id", "idx", "word", "n", "first_pos"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, found.select(columns).collect())) and got.count() == 9


def test_postings_by_chapter_shuffles_no_words(spark):
    from corpuscle.plans import catalog

    plan = catalog.QUERIES["postings_by_chapter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "word" in x] and "last(_span" not in plan


def test_kept_apart_replaces_by_the_better(spark):
    from corpuscle.operators import mentions

    rows = [(1, 0, 0.5), (1, 40, 0.9), (1, 80, 0.1), (1, 150, 0.2), (2, 5, 0.3)]
    got = sorted(tuple(r) for r in mentions.kept_apart(spark.createDataFrame(rows, "doc_id long, pos long, score double"), 60).collect())
    assert got == [(1, 40, 0.9), (1, 150, 0.2), (2, 5, 0.3)]


def test_kept_apart_is_linear_in_a_document(spark):
    import time

    from corpuscle.operators import mentions

    rows = spark.range(300_000).selectExpr("1L as doc_id", "id * 40 as pos", "double(id % 2) as score")
    began = time.monotonic()
    got = mentions.kept_apart(rows, 60).selectExpr("count(*) n", "min(pos) lo", "max(pos) hi", "sum(score) s", "count(distinct pos) d").first()
    assert tuple(got) == (150_000, 40, 299_999 * 40, 150_000.0, 150_000) and time.monotonic() - began < 60


def test_kept_apart_orders_null_and_nan_as_spark(spark):
    from corpuscle.operators import mentions

    rows = [(1, None, 0.5), (1, 10, 0.4), (1, 20, 0.6), (1, 90, None), (1, 100, 0.9), (2, 0, 1.0), (2, 30, float("nan")), (2, 50, 2.0), (None, 1, 0.1), (None, 100, 0.1)]
    got = {str(tuple(r)) for r in mentions.kept_apart(spark.createDataFrame(rows, "doc_id long, pos long, score double"), 60).collect()}
    assert got == {"(1, 20, 0.6)", "(1, 90, None)", "(2, 30, nan)", "(None, 1, 0.1)", "(None, 100, 0.1)"}


def test_mentions_take_the_longest_name(spark):
    from corpuscle.operators import mentions

    docs = spark.createDataFrame([(1, "Mr. Wilson met George\nWilson; Wilsons are not him. GEORGE!"), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([(1, 1, "George Wilson"), (1, 2, "Wilson"), (1, 3, "George"), (1, 4, ""), (2, 1, "x")], "doc_id long, id long, alias string")
    assert sorted((r["pos"], r["id"]) for r in mentions.mentions(docs, names).collect()) == [(4, 2), (15, 1), (51, 3)]


def test_similarity_is_that_of_matching_blocks(spark):
    from corpuscle.operators import mentions

    row = spark.createDataFrame([("Jay Gatsby", "Gatsby", None)], "a string, b string, c string").select(mentions.similarity("a", "b").alias("x"), mentions.similarity("a", "c").alias("y")).first()
    assert abs(row["x"] - 0.75) < 1e-9 and row["y"] == 0.0
