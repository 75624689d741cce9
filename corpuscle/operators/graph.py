"""Identity graphs: components, hard constraints, canonical members."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.plans.tables import SharedTables

# --- fixed values -----------------------------------------------------------
WEIGHTS = {
    "title_variant": 0.85, "lastname_match": 0.40, "firstname_match": 0.35, "spelling_variant": 0.65, "middle_initial": 0.95,
    "descriptive_synonym": 0.60, "narrator_placeholder": 0.90, "cooccurrence": 0.70, "llm_identified": 0.80, "nickname": 0.75,
    "the_variant": 0.85, "period_abbreviation": 0.80, "name_containment": 0.85, "full_name_fuzzy": 0.70, "surname_family": 0.55,
}
STRENGTHS = {"different_titles": 1.0, "different_first_names": 0.9, "role_conflict": 1.0, "same_scene_distinct": 0.8, "ambiguous_surname": 0.7}
# ----------------------------------------------------------------------------


def weighted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b, kind, weight) between different known nodes; a null weight is that of the kind, 0.5 for others."""
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    known = nodes.select(F.col("id").alias("a"))
    kept = edges.where("a <> b").join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi")
    return kept.select("a", "b", "kind", F.coalesce("weight", F.try_element_at(table, "kind"), F.lit(0.5)).alias("weight"))


def components(edges: DataFrame, tables: SharedTables | None = None, most_rounds: int = 60) -> DataFrame:
    """(id, component) of the nodes of edges (a, b): component is the smallest id reachable.

    Every round takes the least label of a node's neighbours, then the label of
    that label, so the rounds grow with the logarithm of a component's width; each
    is a partial aggregation and a join, and is written to the shared folder.
    """
    tables = tables or SharedTables(edges.sparkSession, "components")
    both = tables.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = tables.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("l")), "labels0")
    for k in range(most_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("m"))
        low = labels.join(near, "id").select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = low.select(F.col("id").alias("l"), F.col("l").alias("far"))
        new = low.join(jump, "l", "left").select("id", "old", F.least("l", F.coalesce("far", "l")).alias("l"))
        new = tables.write(new, f"labels{k + 1}")
        changed = new.where("old <> l").limit(1).count()
        labels = new.select("id", "l")
        if not changed:
            return labels.select("id", F.col("l").alias("component"))
    raise RuntimeError("components did not settle")


def split_by_constraints(groups: DataFrame, blocked: DataFrame) -> DataFrame:
    """(id, component, part): members of a component parted so that no blocked pair (a, b) shares a part.

    Parts are given greedily in order of id: each member joins the first part
    that holds nobody it is blocked from. Only components with a blocked pair
    are looked at member by member.
    """
    pairs = blocked.unionByName(blocked.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("foes"))
    held = groups.join(pairs, "id", "left")
    odd = held.where("foes is not null").select("component").distinct()

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        parts: list[set[int]] = []
        out = []
        for i, foes in sorted(zip(rows["id"], rows["foes"], strict=True), key=lambda x: x[0]):
            foes = set(foes) if foes is not None else set()
            k = next((k for k, p in enumerate(parts) if not p & foes), len(parts))
            if k == len(parts):
                parts.append(set())
            parts[k].add(i)
            out.append((i, k))
        return pd.DataFrame({"id": [i for i, _ in out], "component": rows["component"].iloc[0], "part": [k for _, k in out]})

    mixed = held.join(odd, "component", "left_semi").groupBy("component").applyInPandas(part, "id long, component long, part int")
    plain = held.join(odd, "component", "left_anti").select("id", "component", F.lit(0).alias("part"))
    return plain.unionByName(mixed)


def canonical(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, part, id, members, aliases, mentions): the best member of each group and what it takes over."""
    held = groups.join(nodes, "id")
    best = F.max_by("id", F.struct(F.col("main"), F.size(F.split("name", " ")) > 1, F.col("mentions"), F.length("name"), -F.col("id")))
    return held.groupBy("component", "part").agg(best.alias("id"), F.count("*").alias("members"), F.array_sort(F.collect_set("name")).alias("aliases"), F.sum("mentions").alias("mentions"))


def soft_splits(pairs: DataFrame) -> DataFrame:
    """(a, b, split): if what speaks against a pair (a, b, weight, strength) outweighs what speaks for it."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.sum("strength") > F.sum("weight")).alias("split"))

