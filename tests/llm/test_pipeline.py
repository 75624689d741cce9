"""The corpus pipeline: stages, what they keep, and planted cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(1)
    vocabulary = {"en": ["the", "and", "thing", "water", "house", "with"], "fr": ["les", "une", "être", "maison", "avec", "où"]}
    text = lambda g, n=160: " ".join(rng.choice(vocabulary[g]) + rng.choice(["", "s", "ed", "ment", "ique"]) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "fr"), "en" if i % 2 else "fr") for i in range(80)]
    base = rows[3][1].split()
    near = [*base[:80], "altered", *base[81:]]
    passage, item = text("en", 70), text("en", 40)
    rows += [(100, rows[5][1], "en"), (101, " ".join(near), "en"), (102, "1234 !!! $$$", "en"), (103, None, "en")]
    rows += [(110, f"{text('en', 60)} {passage} {text('en', 60)}", "en"), (111, f"{text('en', 60)} {passage} {text('en', 60)}", "en"), (120, f"{text('en', 90)} {item} {text('en', 60)}", "en")]
    at = tmp_path_factory.mktemp("planted")
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict((i, t) for i, t, _ in rows), passage


def test_stages_take_effect(spark, planted):
    sf_dir, texts, passage = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "substring_dedup":
            now = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
            assert passage in now[110][0] and passage not in now[111][0]
            assert all(n == len(t) for t, n in now.values())
            assert all(now[i][0] == texts[i] for i in range(80))
    clean = set(range(80))
    assert kept["language_id"] == clean | {100, 101, 110, 111, 120}
    assert kept["near_dedup"] == clean | {110, 111, 120}
    assert kept["substring_dedup"] == clean | {110, 111, 120}
    assert kept["benchmark_decontamination"] == clean | {110, 111}
    assert kept["bpe_encoding"] == clean | {110, 111}


def test_run_gives_tokens(spark, planted):
    out = corpus_pipeline.run(spark, planted[0])
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0 and out.count() == 82
