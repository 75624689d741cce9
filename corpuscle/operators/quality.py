"""Votes, scores, lint rules, metrics and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tallied(votes: DataFrame, threshold: float = 0.67) -> DataFrame:
    """(kind, subject, yes, total, accepted): votes (kind, subject, vote) against a threshold."""
    rows = votes.groupBy("kind", "subject").agg(F.count_if("vote").alias("yes"), F.count("*").alias("total"))
    return rows.withColumn("accepted", F.col("yes") / F.col("total") >= threshold)


def vote_log(votes: DataFrame, threshold: float = 0.67) -> DataFrame:
    """(kind, n, accepted, rejected): how many subjects of each kind were accepted."""
    return tallied(votes, threshold).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"))


def merged_events(lists: DataFrame, share: float = 0.67) -> DataFrame:
    """(subject, event, n): events (subject, voter, event) named by at least that share of a subject's voters."""
    voters = lists.groupBy("subject").agg(F.countDistinct("voter").alias("voters"))
    rows = lists.groupBy("subject", F.lower(F.trim("event")).alias("event")).agg(F.countDistinct("voter").alias("n"))
    return rows.join(voters, "subject").where(F.col("n") >= F.greatest(F.lit(1), F.floor(F.col("voters") * share))).select("subject", "event", "n")


def clusters(proposals: DataFrame, gap: int = 200) -> DataFrame:
    """(doc_id, cluster, position, title, score, hard): proposals (doc_id, pos, title, weight, score, hard) grouped where gaps are small.

    The score is the weighted mean, the title that of greatest score.
    """
    order = W.partitionBy("doc_id").orderBy("pos", "title")
    head = F.when(F.coalesce(F.col("pos") - F.lag("pos").over(order), F.lit(gap + 1)) > gap, 1).otherwise(0)
    runs = proposals.withColumn("head", head).withColumn("cluster", F.sum("head").over(order))
    score = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    return runs.groupBy("doc_id", "cluster").agg(F.floor(F.avg("pos")).cast("long").alias("position"), F.max_by("title", F.struct("score", "title")).alias("title"), F.round(score + 1e-9, 4).alias("score"), F.bool_or("hard").alias("hard"))


def selected(boundaries: DataFrame) -> DataFrame:
    """boundaries with tier: high from 0.7 or hard, low from 0.4, else rejected."""
    return boundaries.withColumn("tier", F.when(F.col("hard") | (F.col("score") >= 0.7), "high").when(F.col("score") >= 0.4, "low").otherwise("rejected"))


def first_n(boundaries: DataFrame, n: int) -> DataFrame:
    """The n boundaries of each document that count most, hard ones first, then by score, then by place."""
    order = W.partitionBy("doc_id").orderBy(F.desc("hard"), F.desc("score"), "position")
    return boundaries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def golden_score(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(book, matched, n_predicted, n_truth, precision, recall, f1) of keys (book, key)."""
    p, t = predicted.select("book", "key").distinct(), truth.select("book", "key").distinct()
    rows = p.withColumn("p", F.lit(1)).join(t.withColumn("t", F.lit(1)), ["book", "key"], "full")
    sums = rows.groupBy("book").agg(F.count_if((F.col("p") == 1) & (F.col("t") == 1)).alias("matched"), F.count("p").alias("n_predicted"), F.count("t").alias("n_truth"))
    precision, recall = F.coalesce(F.try_divide("matched", "n_predicted"), F.lit(0.0)), F.coalesce(F.try_divide("matched", "n_truth"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sums.select("book", "matched", "n_predicted", "n_truth", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def quality(high, medium, low):
    """The weighted share 1 / 0.6 / 0.2 of three confidence counts, 1 where there is none."""
    return F.coalesce(F.try_divide(high + 0.6 * medium + 0.2 * low, high + medium + low), F.lit(1.0))


def stage_report(runs: DataFrame) -> DataFrame:
    """(stage, items, seconds, per_second, share): totals of runs (stage, items, seconds) with a row for all (stage null)."""
    rows = runs.rollup("stage").agg(F.sum("items").alias("items"), F.sum("seconds").alias("seconds"))
    whole = runs.agg(F.sum("seconds").alias("whole"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    return rows.select("stage", "items", F.round("seconds", 6).alias("seconds"), F.round(F.coalesce(F.try_divide("items", "seconds"), F.lit(0.0)), 6).alias("per_second"), F.round(F.coalesce(F.try_divide(100 * F.col("seconds"), F.col("whole")), F.lit(0.0)), 6).alias("share"))


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(stage, cost): usage (stage, model, tokens_in, tokens_out) by prices a million tokens; null where no model has a price."""
    joined = usage.join(prices, "model", "left")
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    return joined.groupBy("stage").agg(F.round(F.sum(cost), 6).alias("cost"))


def recent_median(history: DataFrame, keep: int = 10) -> DataFrame:
    """(stage, seconds): the median of the last runs (stage, run, seconds) of each stage."""
    order = W.partitionBy("stage").orderBy(F.desc("run"))
    kept = history.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return kept.groupBy("stage").agg(F.round(F.median("seconds"), 6).alias("seconds"))


def lint(cast: DataFrame, edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(book, rule, subject): duplicate names, names without a word in the text, self and orphan relations, unmentioned members."""
    twice = cast.groupBy("book", F.lower("name").alias("subject")).count().where("count > 1").select("book", F.lit("C1").alias("rule"), "subject")
    parts = cast.select("book", "name", F.explode(F.filter(F.split(F.lower("name"), "[^a-z]+"), lambda w: F.length(w) >= 3)).alias("word"))
    met = parts.join(vocabulary.select("book", "word").distinct(), ["book", "word"], "left_semi").select("book", "name").distinct()
    absent = parts.select("book", "name").distinct().join(met, ["book", "name"], "left_anti").select("book", F.lit("C3").alias("rule"), F.lower("name").alias("subject"))
    ids = cast.select("book", F.col("id").alias("dst")).distinct()
    itself = edges.where("src = dst").select("book", F.lit("C5").alias("rule"), F.col("src").cast("string").alias("subject"))
    orphan = edges.join(ids, ["book", "dst"], "left_anti").select("book", F.lit("C5").alias("rule"), F.col("dst").cast("string").alias("subject"))
    silent = cast.where("mentions = 0").select("book", F.lit("C6").alias("rule"), F.lower("name").alias("subject"))
    return twice.unionByName(absent).unionByName(itself).unionByName(orphan).unionByName(silent).distinct()


def score_matrix(scores: DataFrame, categories: list[str]) -> DataFrame:
    """A row for each text with its mean score in every category."""
    return scores.groupBy("subject").pivot("category", categories).agg(F.round(F.avg("score"), 6))
