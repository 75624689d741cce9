"""URL filters with dated lists: validity intervals and an as-of join, in SQL functions alone.

A list entry (list, pattern, action, dated) holds from its instant until the next
entry of the same list and pattern; a date stands for its first instant. A capture
is met with the entries that are active at the instant of its fetch, through the patterns that its URL can match: its host,
the parent domains of the host, and host/first path segment. Intervals are dealt
out over time cells, so that a pattern with a long history meets a capture in
one cell only; a host with very many captures is left to the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without a final dot, '' where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def patterns_of(url: Column, host: Column) -> Column:
    """What entries of a URL may be named: the host, its parent domains of two labels or more, host/segment."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    path = F.when(segment != "", F.array(F.concat(host, F.lit("/"), segment))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parents, path))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, valid_from, valid_to): valid_to is null for the last entry.

    Of entries of one list, pattern and instant the one of greatest action holds.
    Rows with a null list, pattern, action or date are no entries.
    """
    entries = entries.select("list", F.lower("pattern").alias("pattern"), "action", F.col("dated").cast("timestamp").alias("valid_from")).dropna()
    entries = entries.groupBy("list", "pattern", "valid_from").agg(F.max("action").alias("action"))
    order = W.partitionBy("list", "pattern").orderBy("valid_from")
    return entries.withColumn("valid_to", F.lead("valid_from").over(order))


def judged(captures: DataFrame, entries: DataFrame, cell_days: int = 64) -> DataFrame:
    """A row for each capture (page_id, url, fetched): page_id, host, fetched, verdict, pattern, list, valid_from, n_active.

    The verdict is that of the active entry of longest pattern (ties: the latest
    valid_from, then the greatest list, then the greatest action); entries whose
    action is 'drop' end the one before and are not active. Without an active
    entry, with a null url or without a fetch time the verdict is 'keep' and the
    entry's columns are null. Captures that repeat a page_id, url and time are
    looked up once and each give a row. fetched and valid_from are timestamps.
    Columns of either table beyond these are ignored.
    """
    captures = captures.select("page_id", "url", F.col("fetched").cast("timestamp").alias("fetched")).withColumn("host", host_of(F.col("url")))
    cell = lambda c: F.floor(F.unix_timestamp(c) / (86_400 * cell_days))
    keyed = captures.where("host <> '' and fetched is not null").distinct().withColumn("pattern", F.explode(patterns_of(F.col("url"), F.col("host"))))
    keyed = keyed.withColumn("cell", cell(F.col("fetched")))
    horizon = captures.agg(F.max("fetched").alias("horizon"))
    active = intervals(entries).where("action <> 'drop'").crossJoin(F.broadcast(horizon)).where("valid_from <= horizon")  # one row
    until = F.least(F.coalesce("valid_to", "horizon"), F.col("horizon"))
    active = active.withColumn("cell", F.explode(F.sequence(cell(F.col("valid_from")), cell(until)))).drop("horizon")
    met = keyed.join(active, ["pattern", "cell"]).where("valid_from <= fetched and (valid_to is null or fetched < valid_to)")
    best = F.max(F.struct(F.length("pattern").alias("n"), "valid_from", "list", "action", "pattern")).alias("b")
    found = met.groupBy("page_id", "url", "host", "fetched").agg(best, F.count("*").alias("n_active"))
    found = found.select(
        F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched").alias("_t"), F.col("b.action").alias("verdict"),
        F.col("b.pattern").alias("pattern"), F.col("b.list").alias("list"), F.col("b.valid_from").alias("valid_from"), "n_active",
    )
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in (("page_id", "_p"), ("url", "_u"), ("fetched", "_t"))]
    out = captures.join(found, same[0] & same[1] & same[2], "left")
    verdict, n_active = F.coalesce("verdict", F.lit("keep")).alias("verdict"), F.coalesce("n_active", F.lit(0)).alias("n_active")
    return out.select("page_id", "host", "fetched", verdict, "pattern", "list", "valid_from", n_active)
