"""Correction rules on hand-made relations and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.operators import mentions, rules


def edges(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "book long, src long, dst long, label string")


def cast(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "book long, id long, name string, mentions long, gender string")


def found(df):
    return sorted((r["src"], r["dst"], r["label"]) for r in df.collect())


def test_mutual_parents_share_a_surname_or_not(spark):
    people = cast(spark, [(1, "Ann Stone", 1, None), (2, "Bob Stone", 1, None), (3, "Carl Hale", 1, None), (4, None, 1, None)])
    out = rules.mutual_parents(edges(spark, [(1, 2, "mother"), (2, 1, "father"), (1, 3, "mother"), (3, 1, "father"), (2, 3, "father"), (1, 4, "parent"), (4, 1, "parent")]), people)
    assert found(out) == [(1, 2, "sibling"), (1, 3, "associated"), (1, 4, "associated"), (2, 1, "sibling"), (2, 3, "father"), (3, 1, "associated"), (4, 1, "associated")]


def test_inverse_of_a_child(spark):
    people = cast(spark, [(1, "Mr. A", 1, "male"), (2, "B", 1, None)])
    out = rules.inverse_consistent(edges(spark, [(2, 1, "son"), (1, 2, "friend"), (3, 2, "daughter"), (2, 3, "mother")]), people)
    assert found(out) == [(1, 2, "father"), (2, 1, "son"), (2, 3, "mother"), (3, 2, "daughter")]


def test_support_counts_in_either_order(spark):
    proof = spark.createDataFrame([(1, 2, 1)], "book long, a long, b long")
    out = rules.supported(edges(spark, [(1, 2, "friend"), (2, 1, "friend"), (1, 3, "friend"), (1, 4, "rival")]), proof, ("friend",))
    assert found(out) == [(1, 2, "friend"), (1, 3, "associated"), (1, 4, "rival"), (2, 1, "friend")]


def test_containment_in_several_is_ambiguous(spark):
    people = cast(spark, [(1, "Wilson", 1, None), (2, "George Wilson", 1, None), (3, "Myrtle Wilson", 1, None), (4, "Jay", 1, None), (5, "Jay Gatsby", 1, None), (6, "Mr.", 1, None)])
    got = sorted((r["a"], r["b"], r["kind"]) for r in rules.containment(people).collect())
    assert got == [(1, 2, "ambiguous_surname"), (1, 3, "ambiguous_surname"), (4, 5, "name_containment")]


def test_containment_pairs_every_member_in_blocks(spark):
    names = ["Wilson", "George Wilson", "Myrtle Wilson", "Jay", "Jay Gatsby", "George George Wilson Jay", "Mr."]
    rows = [(i, names[i * i % 7], 1, None) for i in range(60)] + [(1, "Gatsby", 1, None), (1, "Gatsby", 1, None), (None, "Jay", 1, None), (None, "Jay Gatsby", 1, None)]
    own = [(i, tuple(dict.fromkeys(w for w in n.lower().split() if w != "mr."))) for i, n, _, _ in rows]
    pairs = [(a, b, y) for a, x in own for b, y in own if a is not None and x and len(x) < len(y) and set(x) <= set(y)]
    held = {a: len({y for c, _, y in pairs if c == a}) for a, _, _ in pairs}
    want = sorted((a, str(b), "ambiguous_surname" if held[a] > 1 else "name_containment") for a, b, _ in pairs)
    people = cast(spark, rows)
    for block in (1, 3, 256):
        assert sorted((r["a"], str(r["b"]), r["kind"]) for r in rules.containment(people, block).collect()) == want


def test_containment_makes_many_pairs_fast(spark):
    import time

    people = spark.range(34_000).selectExpr("1L as book", "id", "if(id < 4000, 'Wilson', concat(if(id % 2 = 0, 'George', 'Myrtle'), ' Wilson')) as name")
    began = time.monotonic()
    assert rules.containment(people).selectExpr("count(*) n", "count_if(kind = 'ambiguous_surname') m", "sum(a) a", "sum(b) b").first() == (120_000_000, 120_000_000, 30_000 * sum(range(4000)), 4000 * sum(range(4000, 34_000)))
    assert time.monotonic() - began < 60


def test_alias_conflict_goes_to_the_more_mentioned(spark):
    people = cast(spark, [(1, "Ann", 5, None), (2, "The Lady", 9, None), (3, "Eve", 1, None)])
    aliases = spark.createDataFrame([(1, 1, "the lady"), (1, 3, "Eve")], "book long, id long, alias string")
    assert [tuple(r) for r in rules.alias_conflicts(people, aliases).collect()] == [(1, 1, 2)]


def test_parenthetical_kin(spark):
    rows = spark.createDataFrame([("Ann (his Mother)",), ("Ann",), (None,)], "n string").select(rules.parenthetical(F.col("n")).alias("x")).collect()
    assert [r["x"] and tuple(r["x"]) for r in rows] == [("Ann", "mother"), None, None]


def test_contents_stop_after_two_lines_that_are_none(spark):
    text = "Contents\nChapter 1 ... 3\nprose without any sign of it\nChapter 2 ... 9\nprose one\nprose two\nChapter 3 ... 12\n"
    docs = spark.createDataFrame([(1, text), (2, "no table here"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in mentions.contents(docs).orderBy("k").collect()] == [(1, 1, "Chapter 1", 3, 1), (1, 2, "Chapter 2", 9, 1)]


def test_empty_tables(spark):
    none = edges(spark, [])
    people = cast(spark, [])
    for out in (rules.mutual_parents(none, people), rules.inverse_consistent(none, people), rules.dominant_role(none), rules.containment(people)):
        assert out.count() == 0
