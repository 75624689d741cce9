"""Casts, relations, graphs, votes and sources on hand-made inputs."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import cast as C
from corpuscle.operators import graph as G
from corpuscle.operators import quality as Q
from corpuscle.operators import scorer
from corpuscle.sources import readers, sinks
from corpuscle.streaming import live


def edges(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "book long, src long, dst long, label string")


def found(df):
    return sorted((r["src"], r["dst"], r["label"]) for r in df.collect())


def test_reverses_fill_what_is_missing_or_vague(spark):
    out = C.with_reverses(edges(spark, [(1, 2, "father"), (3, 4, "friend"), (4, 3, "unknown"), (5, 6, "odd")]))
    assert found(out) == [(1, 2, "father"), (2, 1, "son"), (3, 4, "friend"), (4, 3, "friend"), (5, 6, "odd")]


def test_contradictions_go_both_ways(spark):
    out = C.without_contradictions(edges(spark, [(1, 2, "father"), (2, 1, "father"), (3, 4, "friend"), (4, 3, "friend")]))
    assert found(out) == [(3, 4, "friend"), (4, 3, "friend")]


def test_one_spouse(spark):
    weights = spark.createDataFrame([(1, 1, 3, 9)], "book long, src long, dst long, weight long")
    assert found(C.one_spouse(edges(spark, [(1, 2, "wife"), (1, 3, "wife"), (1, 4, "friend")]), weights)) == [(1, 3, "wife"), (1, 4, "friend")]


def test_near_pairs_equals_brute_force(spark):
    marks = [(1, i % 5, (i * 37) % 400) for i in range(60)]
    got = {(r["a"], r["b"]): r["n"] for r in C.near_pairs(spark.createDataFrame(marks, "book long, id long, pos long"), 25).collect()}
    want: dict = {}
    for i, (_, a, p) in enumerate(marks):
        for _, b, q in marks[:i]:
            if a != b and abs(p - q) <= 25:
                want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + 1
    assert got == want


def test_components_and_hard_constraints(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (4, 4)], "a long, b long")
    groups = G.components(pairs)
    assert {r["id"]: r["component"] for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    split = G.split_by_constraints(groups, spark.createDataFrame([(1, 3)], "a long, b long"))
    part = {r["id"]: r["part"] for r in split.collect()}
    assert part[1] == part[2] != part[3] and part[7] == part[8] == part[9] == 0


def test_constraint_split_reads_every_order(spark):
    from corpuscle.plans import catalog

    d = "/root/testdata/sf0.001"
    pairs = [(r[0], r[1] % 1500) for r in spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey").collect()]
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    got = {r["id"]: (r["component"], r["part"]) for r in catalog.QUERIES["constraint_split"](spark, d).collect()}
    assert {i: c for i, (c, _) in got.items()} == {i: top(i) for i in list(up)}
    assert all(got[a] != got[b] for a, b in pairs if a != b and (a + b) % 5 == 0)


def test_long_path_settles(spark):
    groups = G.components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"))
    assert [r[0] for r in groups.select("component").distinct().collect()] == [0]


def test_golden_score(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], "book long, key string")
    t = spark.createDataFrame([(1, "a"), (1, "c"), (3, "y")], "book long, key string")
    got = {r["book"]: (r["matched"], r["precision"], r["recall"], r["f1"]) for r in Q.golden_score(p, t).collect()}
    assert got == {1: (1, 0.5, 0.5, 0.5), 2: (0, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("MY TITLE\nby Ann Stone\n\nIt was café time.".encode("cp1252"))
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<package xmlns="x" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Tale</dc:title></metadata><manifest><item id="i" href="c.xhtml"/></manifest><spine><itemref idref="i"/></spine></package>')
        z.writestr("o/c.xhtml", "<html><style>x</style><h1>One</h1><p>Hello &amp; bye</p></html>")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.zip").write_bytes(b"other")
    rows = {r["format"]: r for r in readers.read_manuscripts(spark, str(tmp_path)).collect()}
    assert set(rows) == {"txt", "epub", "docx", "pdf"}
    assert rows["txt"]["title"] == "My Title" and rows["txt"]["author"] == "Ann Stone" and "café" in rows["txt"]["text"] and rows["txt"]["warnings"]
    assert rows["epub"]["title"] == "Tale" and rows["epub"]["text"] == "One\n\nHello & bye"
    assert rows["docx"]["text"] is None and rows["pdf"]["warnings"] == ["no PDF reader was given"]


def test_stage_cache(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    sinks.save_stage(docs.where("doc_id = 1").select("text", F.lit(5).alias("n")), str(tmp_path / "cache"), "count")
    hit, todo = sinks.cached(docs, spark.read.parquet(str(tmp_path / "cache")), "count")
    assert [r["n"] for r in hit.collect()] == [5] and [r["doc_id"] for r in todo.collect()] == [2]


def test_scorer_keeps_errors_as_data(spark):
    def broken(texts):
        raise ValueError("no model")

    prompts = spark.createDataFrame([(1, "x")], "id long, prompt string")
    row = scorer.scored(prompts, broken, tries=2, pause=0.0).first()
    assert row["reply"] is None and row["error"] == "ValueError: no model"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = live.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").outputMode("complete").queryName("live_windows").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("live_windows")) == key(live.windowed(events))


@pytest.mark.parametrize("larger", ["a", "b"])
def test_passages_score_by_the_first_line_of_a_position(spark, tmp_path, larger):
    import os

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from corpuscle.plans import catalog
    from tests.oracle import compare

    # Spark reads the larger file first, be it first in the table or not
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    orders = list(range(0, 7500, 25))
    for name, factor in (("a", 7), ("b", 11)):
        columns = {"l_orderkey": pa.array(orders, pa.int64()), "l_suppkey": pa.array([1] * len(orders), pa.int64()), "l_linenumber": pa.array([1] * len(orders), pa.int32())}
        columns |= {"l_quantity": pa.array([o * factor % 53 for o in orders], pa.float64()), "l_comment": pa.array([os.urandom(1000).hex() if name == larger else "" for _ in orders])}
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"create view lineitem as select * from read_parquet(['{folder}/a.parquet', '{folder}/b.parquet'])")
    assert compare(catalog.QUERIES["passages_topk"](spark, str(tmp_path)), con, catalog.SQL["passages_topk"]) == 9
