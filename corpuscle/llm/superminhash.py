"""SuperMinHash near-duplicate detection over word shingles.

Signatures follow the SuperMinHash scheme: every element owns a random
permutation of the registers and a random fraction per step, so that at step j
it offers ``j + fraction`` to its j-th register. A document stops after the
first step that cannot lower any register. Signatures are banded, colliding
documents are verified on their full shingle sets, and the verified links are
grouped by union-find in the distributed form of star contraction.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.llm import _arrays as A
from corpuscle.llm._spark import Tables, components

U64 = np.uint64
EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def _draw(h: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element at step j: the register offer (step and fraction) and the swap index."""
    x = A.mix(h + U64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    offer = (U64(j) << U64(32)) | (x >> U64(32))
    k = j + (((x & U64(0xFFFFFFFF)) * U64(m - j)) >> U64(32)).astype(np.int64)
    return offer, k


def signatures(values: np.ndarray, ptr: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash registers, (rows, m) uint64, of the distinct values of each CSR row."""
    rows = len(ptr) - 1
    sig = np.full((rows, m), EMPTY, dtype=np.uint64)
    flat = sig.reshape(-1)
    h, row = A.mix(values), A.row_of(ptr)
    swaps: list[np.ndarray] = []
    perm: np.ndarray | None = None
    for j in range(m):
        if not len(h):
            break
        offer, k = _draw(h, j, m)
        if perm is None and j >= 4:  # few elements are left; replay their swaps into a table
            perm = np.tile(np.arange(m, dtype=np.int16), (len(h), 1))
            at = np.arange(len(h))
            for i, old in enumerate(swaps):
                perm[at, i], perm[at, old] = perm[at, old], perm[at, i].copy()
        if perm is None:
            register = k.copy()
            for i in range(j - 1, -1, -1):
                register = np.where(register == swaps[i], i, register)
            swaps.append(k)
        else:
            at = np.arange(len(h))
            register = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
            perm[at, j] = register
        np.minimum.at(flat, row * m + register, offer)
        worst = sig.max(axis=1) >> U64(32)
        keep = worst[row] > U64(j)
        if not keep.all():
            h, row = h[keep], row[keep]
            swaps = [x[keep] for x in swaps]
            perm = perm[keep] if perm is not None else None
    return sig


def banding(threshold: float, miss: float = 1e-6, rows: int = 6) -> tuple[int, int]:
    """(bands, rows) by which a pair at the threshold is missed at most with that probability."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)), rows


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each row and band."""
    out = np.zeros((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        for r in range(rows):
            out[:, b] = A.mix(out[:, b] + sig[:, b * rows + r] + U64(b + 1))
    return out


def _sets(column: pa.Array, n: int, block_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offs in A.blocks(column, block_bytes):
        words, ptr = A.word_hashes(data, offs)
        yield i, j, *A.distinct(*A.shingles(words, ptr, n))


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[ptr[1:]] - total[ptr[:-1]]


SIGNATURE_SCHEMA = "doc_id long, n_shingles long, set_lo long, set_hi long, bands array<long>"


def signature_table(docs: DataFrame, n: int, bands: int, rows: int, block_bytes: int = 1 << 20) -> DataFrame:
    """Of each row of (doc_id, text): size and 128-bit digest of its shingle set, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, ptr in _sets(batch.column(1), n, block_bytes):
                keys = band_keys(signatures(values, ptr, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(np.diff(ptr)),
                        pa.array(A.signed(_sums(A.mix(values ^ U64(0xA5A5A5A5A5A5A5A5)), ptr))),
                        pa.array(A.signed(_sums(A.mix(values ^ U64(0x0F0F0F0F33CC55AA)), ptr))),
                        A.list_column(A.signed(keys.reshape(-1)), np.arange(j - i + 1) * bands, pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "set_lo", "set_hi", "bands"],
                )
        A.release()

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURE_SCHEMA)


def set_table(docs: DataFrame, n: int, block_bytes: int = 1 << 20) -> DataFrame:
    """(id, shingles): the full distinct shingle set of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, ptr in _sets(batch.column(1), n, block_bytes):
                ids = batch.column(0).slice(i, j - i).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, A.list_column(A.signed(values), ptr, pa.int64())], names=["id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_both, n_a, n_b) of pairs (a, b), counted on the full sets inside the JVM."""
    both = F.size(F.array_intersect("sa", "sb")).cast("long").alias("n_both")
    return _with_sets(pairs, sets).select("a", "b", both, F.size("sa").cast("long").alias("n_a"), F.size("sb").cast("long").alias("n_b"))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b")


def grouped(tables: Tables, items: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(id, component) of every linked item; items not listed are alone.

    items: (id, n_shingles, bands), one row for each distinct set; sets_of gives
    (id, shingles) of a table of ids. Every item is compared with the best
    connected item (the centre) of each of its buckets. That leaves pairs of one
    centre of which at least one, x, isn't linked with it. With A the shingles of
    the centre that an item lacks and B those that it has beyond the centre, x and
    y can be linked only if their differences share at least
    ``need = deficit(x) + (1 - f) |A_y| + f |B_y|`` elements, f = percent / (100 +
    percent), where deficit(x) > 0 is what x lacks for a link with the centre. So
    a shared element must be among any ``|D_y| - need + 1`` elements of y's
    difference, and x and y meet in a join on those, the least shared ones first.
    Before that, items that aren't linked with their centre are compared with a
    second centre, the best connected of them in a bucket: items that are near each
    other without being near the centre are one component by then, and elements that
    only items of one component have need no join. No bucket is expanded into its
    pairs, and no possible link of one is left out.
    """
    f, cut = percent / (100 + percent), 1 - percent / 100
    spread = items.select("id", F.explode("bands").alias("key"))
    # a table that is joined on a key of unbounded groups is written first: between plain
    # exchanges a join of a hot key can be split, above an aggregation it can not
    counts = tables.write(spread.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "counts")
    members = tables.write(spread.join(counts, "key"), "members")
    tied = members.join(members.groupBy("id").agg(F.sum("size").alias("links")), "id")
    best = F.max_by("id", F.struct("links", -F.col("id"))).alias("b")
    centre = tables.write(tied.groupBy("key").agg(best), "centres")
    tables.drop("counts")
    stars = tables.write(members.select("key", F.col("id").alias("a")).join(centre, "key").where("a <> b").select("a", "b").distinct(), "stars")
    ends = stars.select(F.col("a").alias("id")).union(stars.select("b")).distinct()
    sets = tables.write(sets_of(ends), "sets")

    link = f"100 * n_both >= {percent} * (n_a + n_b - n_both)"
    checked = tables.write(verified(stars, sets), "checked")
    loose = tables.write(checked.where(f"not ({link})").select(F.col("a").alias("id")).distinct(), "loose")
    some = tables.write(members.join(loose, "id"), "loose-members")
    tied = some.join(some.groupBy("id").agg(F.sum("size").alias("links")), "id")
    centre = tables.write(tied.groupBy("key").agg(best, F.count("*").alias("n")).where("n > 1").drop("n"), "second-centres")
    again = some.select("key", F.col("id").alias("a")).join(centre, "key").where("a <> b").select("a", "b").distinct()
    again = again.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    edges = checked.unionByName(tables.write(verified(again, sets), "checked-again")).where(link).select("a", "b")
    groups = components(tables, edges, "cc0-")

    # members of a centre that can be linked with another member of it: distances differ by cut at most
    near = checked.withColumn("d", 1 - F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")))
    near = near.withColumns({"cell": F.floor(F.col("d") / (cut + 1e-9)).cast("int"), "linked": F.expr(link)})
    around = F.explode(F.sequence(F.col("cell") - 1, F.col("cell") + 1)).alias("cell")
    cells = near.groupBy("b", "cell").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("loose"))
    cells = cells.select("b", around, "n", "loose").groupBy("b", "cell").agg(F.sum("n").alias("n"), F.sum("loose").alias("loose")).where("n > 1 and loose > 0")
    cells = tables.write(cells, "cells")
    near = near.join(cells.select("b", "cell"), ["b", "cell"], "left_semi")
    delta = F.greatest(F.lit(cut), F.col("d") - cut)
    deficit = F.greatest(F.lit(0.0), f - (1 - delta) / (2 - delta)) * (F.col("n_a") * (percent / 100) + F.col("n_b"))
    need = F.greatest(F.lit(1), F.ceil(deficit + (1 - f) * (F.col("n_b") - F.col("n_both")) + f * (F.col("n_a") - F.col("n_both")) - 1e-6))
    near = near.withColumn("prefix", F.greatest(F.lit(0), F.col("n_a") + F.col("n_b") - 2 * F.col("n_both") - need + 1).cast("int"))
    apart = F.concat(F.array_except("sa", "sb"), F.transform(F.array_except("sb", "sa"), F.bitwise_not))
    facts = ["a", "b", "linked", "prefix", "d", "n_a", "n_b", "n_both"]
    apart = tables.write(_with_sets(near.select(*facts), sets).select(*facts, apart.alias("apart")), "apart")
    # tokens of a difference in rising order of how many members of the centre have them
    apart = apart.join(groups.select(F.col("id").alias("a"), F.col("component").alias("of")), "a", "left").withColumn("of", F.coalesce("of", "a"))
    tokens = apart.select(*facts, "of", F.explode("apart").alias("token"))
    usual = tokens.groupBy("b", "token").agg(F.count("*").alias("n"), (F.min("of") < F.max("of")).alias("mixed")).where("n > 1")
    tokens = tokens.join(tables.write(usual, "usual"), ["b", "token"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rank = F.row_number().over(W.partitionBy("b", "a").orderBy("n", "token")) - 1
    tokens = tables.write(tokens.withColumn("rank", rank).where("mixed and (not linked or rank < prefix)"), "tokens")
    kept = ["d", "n_a", "n_both", "of"]
    x = tokens.where("not linked").select("b", "token", F.col("a").alias("x"), *[F.col(c).alias(f"{c}_") for c in kept])
    y = tokens.where("rank < prefix").select("b", "token", "rank", F.col("a").alias("y"), "n_b", *kept)
    least = f * (F.col("n_a_") + F.col("n_b")) - F.col("n_both_") + (1 - f) * (F.col("n_b") - F.col("n_both")) + f * (F.col("n_a") - F.col("n_both"))
    rest = F.col("n_a") + F.col("n_b") - 2 * F.col("n_both") - F.col("rank")
    same = [x["b"] == y["b"], x["token"] == y["token"], F.col("of_") != F.col("of"), rest >= least - 1e-6, F.abs(F.col("d") - F.col("d_")) <= cut + 1e-9]
    size = F.least("n_a", "n_a_") * 100 >= F.greatest("n_a", "n_a_") * percent
    met = x.join(y, reduce(and_, [*same, size]))
    todo = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = tables.write(verified(todo, sets), "more").where(link).select("a", "b")
    if more.limit(1).count():
        edges = groups.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)
        groups = components(tables, edges, "cc1-")
    for name in ("members", "centres", "stars", "loose", "loose-members", "second-centres", "checked", "checked-again", "cells", "sets", "apart", "usual", "tokens", "more"):
        tables.drop(name)
    return groups


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, miss: float = 1e-6, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of documents linked at a Jaccard similarity of percent.

    A text's set holds the distinct shingles of n words, words being runs without
    ASCII white space, lower-cased in A-Z; fewer words form one shingle. Null,
    empty and blank texts have no shingles and are linked with nothing. Rows that
    repeat a doc_id are kept as rows of their own with the same component. A row
    with a null doc_id is compared with nothing: its component is null and it is
    kept. Other columns, whatever their names, are ignored. Equal sets are one
    item from the start, so a group of copies costs one row.
    """
    bands, rows = banding(percent / 100, miss, rows)
    tables = Tables(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = tables.write(signature_table(docs, n, bands, rows), "signatures")
    own = sig.where("n_shingles > 0 and doc_id is not null")
    one = tables.write(own.groupBy("set_lo", "set_hi", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "one")  # equal sets have equal bands
    items = tables.write(one.select("id", "n_shingles", "bands").dropDuplicates(["id"]), "items")  # read twice
    groups = grouped(tables, items, lambda ids: set_table(docs.join(ids.withColumnRenamed("id", "doc_id").hint("merge"), "doc_id", "left_semi"), n), percent)
    whole = one.join(groups, "id", "left").select("set_lo", "set_hi", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = sig.select("doc_id", "n_shingles", "set_lo", "set_hi").join(whole, ["set_lo", "set_hi", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
