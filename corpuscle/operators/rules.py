"""Rules that correct relations, casts and identity evidence, each one table in and one table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpuscle.operators.cast import TITLES, core_tokens, surname

# --- fixed values -----------------------------------------------------------
PARENT = ("father", "mother", "parent")
CHILD = ("son", "daughter", "child")
SAME_PERSON = r"(?i)same person|himself|herself|alias|also known as|alter ego"
#: Relations that a sentence states, the first that fits.
STATED = [
    ("romantic", r"(?i)\b(lover|loves|beloved|romance)\b"), ("rival", r"(?i)\brival\b"), ("enemy", r"(?i)\b(enemy|hates|foe)\b"), ("neighbor", r"(?i)\bneighbou?r\b"),
    ("friend", r"(?i)\bfriends?\b"), ("spouse", r"(?i)\b(husband|wife|married|marries)\b"), ("father", r"(?i)\bfather\b"), ("mother", r"(?i)\bmother\b"),
    ("brother", r"(?i)\bbrother\b"), ("sister", r"(?i)\bsister\b"),
]
#: What kind of being a descriptor names.
BEINGS = [("creature", r"(?i)\b(monster|creature|beast|demon|fiend)\b"), ("object", r"(?i)\b(house|car|ship|letter|ring|city)\b"), ("human", r"(?i)\b(man|woman|boy|girl|doctor|captain|stranger)\b")]
AGES = r"(?i)\b(\d{1,3}|elderly|aged|middle-aged|young|teenage|child|infant|old)\b"
CONVENTIONS = [("numbered", r"(?m)^Chapter \d+"), ("capitals", r"(?m)^CHAPTER "), ("roman", r"(?m)^[IVXLC]+\.?$"), ("breaks", r"(?m)^\s*\*\s*\*\s*\*\s*$"), ("parts", r"(?m)^PART ")]
# ----------------------------------------------------------------------------


def _first(text: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def stated_relation(sentence: Column) -> Column:
    """The relation that a sentence states, the first rule that fits, or null."""
    return _first(sentence, STATED)


def being(descriptor: Column) -> Column:
    return _first(descriptor, BEINGS)


def conventions(text: Column, sample: int = 50_000) -> Column:
    """Which chapter conventions a text follows."""
    head = F.substring(text, 1, sample)
    return F.array_compact(F.array(*[F.when(head.rlike(p), F.lit(n)) for n, p in CONVENTIONS]))


def profile_confidence(has_contents: Column, has_front: Column, n_conventions: Column) -> Column:
    """0.5, with 0.3 for a table of contents and 0.1 each for front matter and any convention."""
    return F.lit(0.5) + F.when(has_contents, 0.3).otherwise(0.0) + F.when(has_front, 0.1).otherwise(0.0) + F.when(n_conventions > 0, 0.1).otherwise(0.0)


def mutual_parents(edges: DataFrame, cast: DataFrame) -> DataFrame:
    """Edges where two who are each other's parents become siblings if they share a surname, else are associated."""
    names = cast.select("book", "id", surname(F.col("name")).alias("s"))
    back = edges.where(F.lower("label").isin(*PARENT)).select("book", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("mutual"))
    rows = edges.join(back, ["book", "src", "dst"], "left").join(names.select("book", F.col("id").alias("src"), F.col("s").alias("s1")), ["book", "src"], "left").join(names.select("book", F.col("id").alias("dst"), F.col("s").alias("s2")), ["book", "dst"], "left")
    both = F.col("mutual") & F.lower("label").isin(*PARENT)
    return rows.select("book", "src", "dst", F.when(both & (F.col("s1") == F.col("s2")), "sibling").when(both, "associated").otherwise(F.col("label")).alias("label"))


def same_person_unknown(edges: DataFrame) -> DataFrame:
    return edges.withColumn("label", F.when(F.col("label").rlike(SAME_PERSON), "unknown").otherwise(F.col("label")))


def supported(edges: DataFrame, evidence: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Edges whose label is one of labels stay only with evidence (book, a, b), in either order; others become 'associated'."""
    proof = evidence.select("book", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("proof", F.lit(True))
    rows = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(proof, ["book", "a", "b"], "left")
    doubt = F.lower("label").isin(*labels) & F.col("proof").isNull()
    return rows.select("book", "src", "dst", F.when(doubt, "associated").otherwise(F.col("label")).alias("label"))


def inverse_consistent(edges: DataFrame, cast: DataFrame) -> DataFrame:
    """Edges whose way back says child become mother, father or parent, by the bearer's gender, unless they say so already."""
    child = edges.where(F.lower("label").isin(*CHILD)).select("book", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("has_child"))
    gender = cast.select("book", F.col("id").alias("src"), "gender")
    rows = edges.join(child, ["book", "src", "dst"], "left").join(gender, ["book", "src"], "left")
    wrong = F.col("has_child") & ~F.lower("label").isin(*PARENT, *CHILD)
    parent = F.when(F.col("gender") == "male", "father").when(F.col("gender") == "female", "mother").otherwise("parent")
    return rows.select("book", "src", "dst", F.when(wrong, parent).otherwise(F.col("label")).alias("label"))


def dominant_role(edges: DataFrame, least: int = 2) -> DataFrame:
    """(book, id, label): the label that a member bears most often (ties: the smallest), where it does so at least so often."""
    rows = edges.groupBy("book", F.col("src").alias("id"), "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    order = W.partitionBy("book", "id").orderBy(F.desc("n"), "label")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("book", "id", "label")


def parenthetical(names: Column) -> Column:
    """What a name says in a trailing parenthesis of kin: struct(base, kin), null where it says nothing."""
    base, kin = (F.regexp_extract(names, r"(?i)^(.+?)\s*\((?:his|her|their|the) (father|mother|son|daughter|brother|sister|wife|husband)\)$", g) for g in (1, 2))
    return F.when(base != "", F.struct(base.alias("base"), F.lower(kin).alias("kin")))


def alias_conflicts(cast: DataFrame, aliases: DataFrame) -> DataFrame:
    """(book, id, into): members whose name is another's alias, and who takes them in: the more mentioned, then the smaller id."""
    hits = aliases.select("book", F.col("id").alias("a"), F.lower(F.trim("alias")).alias("name")).join(cast.select("book", F.col("id").alias("b"), F.lower(F.trim("name")).alias("name")), ["book", "name"]).where("a <> b")
    m = cast.select("book", "id", "mentions")
    rows = hits.join(m.select("book", F.col("id").alias("a"), F.col("mentions").alias("ma")), ["book", "a"]).join(m.select("book", F.col("id").alias("b"), F.col("mentions").alias("mb")), ["book", "b"])
    keep = F.when((F.col("ma") > F.col("mb")) | ((F.col("ma") == F.col("mb")) & (F.col("a") < F.col("b"))), F.col("a")).otherwise(F.col("b"))
    rows = rows.withColumn("into", keep).withColumn("id", F.when(F.col("into") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    return rows.groupBy("book", "id").agg(F.min("into").alias("into"))


def containment(cast: DataFrame, block: int = 256) -> DataFrame:
    """(book, a, b, kind): a name whose parts another holds is an edge, or a constraint if several different ones hold it.

    Different names are compared once a book. Members of two names that match are
    then paired by blocks of ids: a join row stands for block * block pairs at
    most, rows are dealt out evenly, and pairs are made where they are read.
    """
    parts = cast.select("book", "id", F.array_distinct(core_tokens(F.col("name"))).alias("core")).where("size(core) > 0")
    names = parts.select("book", "core").distinct()
    short = names.select("book", F.col("core").alias("small"), F.element_at("core", -1).alias("token"))
    long = names.select("book", F.col("core").alias("large"), F.explode("core").alias("token"))
    held = short.join(long, ["book", "token"]).where("size(small) < size(large) and size(array_except(small, large)) = 0").drop("token")
    # what holds any of a member's names counts for all of them: own is the set of its names
    members = parts.withColumn("own", F.array_sort(F.collect_set("core").over(W.partitionBy("book", "id")))).where("id is not null")
    owned = members.select("book", "own").distinct().select("book", "own", F.explode("own").alias("small")).join(held, ["book", "small"])
    n = owned.groupBy("book", "own").agg(F.countDistinct(F.array_join("large", " ")).alias("n"))
    kinds = owned.join(n, ["book", "own"]).select("book", "own", "small", "large", F.when(F.col("n") > 1, "ambiguous_surname").otherwise("name_containment").alias("kind"))

    def blocks(rows: DataFrame, keys: list[str], ids: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*keys).orderBy("id")) - 1
        return rows.withColumn(f"k{ids}", F.floor(place / block)).groupBy(*keys, f"k{ids}").agg(F.collect_list(F.struct("id"))["id"].alias(ids))

    a = blocks(members.withColumnRenamed("core", "small"), ["book", "own", "small"], "a")
    b = blocks(parts.withColumnRenamed("core", "large"), ["book", "large"], "b")
    pairs = kinds.join(a, ["book", "own", "small"]).join(b, ["book", "large"])
    pairs = pairs.repartition(int(cast.sparkSession.conf.get("spark.sql.shuffle.partitions")), "book", "own", "small", "large", "ka", "kb")
    pairs = pairs.select("book", F.explode("a").alias("a"), "b", "kind")
    return pairs.select("book", "a", F.explode("b").alias("b"), "kind")


def shared_aliases(aliases: DataFrame) -> DataFrame:
    """(book, a, b): members that share a spelling, case aside: a star from the smallest id, as components need no more."""
    rows = aliases.select("book", "id", F.lower(F.trim("alias")).alias("alias")).distinct()
    first = rows.groupBy("book", "alias").agg(F.min("id").alias("a"))
    return rows.join(first, ["book", "alias"]).where("id <> a").select("book", "a", F.col("id").alias("b")).distinct()


def title_constraints(cast: DataFrame) -> DataFrame:
    """(book, surname, titles): surnames whose bearers have different titles, so that they are different people."""
    title = F.lower(F.regexp_extract(F.trim("name"), r"^([A-Za-z]+)\.?\s", 1))
    rows = cast.select("book", surname(F.concat(F.lit("x "), F.col("name"))).alias("surname"), title.alias("title")).where(F.col("title").isin(*TITLES) & F.col("surname").isNotNull())
    return rows.groupBy("book", "surname").agg(F.array_join(F.array_sort(F.collect_set("title")), ",").alias("titles"), F.countDistinct("title").alias("n")).where("n > 1").drop("n")


def renamed(cast: DataFrame, counts: DataFrame, few: int = 10, many: int = 20) -> DataFrame:
    """(book, id, alias): a better canonical name where the present one has under few uses and an alias many and thrice as many.

    counts: (book, id, alias, n, canonical); an alias of several words goes first.
    """
    own = counts.where("canonical").select("book", "id", F.col("n").alias("own"))
    rows = counts.where("not canonical").join(own, ["book", "id"]).where((F.col("own") < few) & (F.col("n") >= many) & (F.col("n") > 3 * F.col("own")))
    order = W.partitionBy("book", "id").orderBy(F.desc(F.col("alias").contains(" ")), F.desc("n"), "alias")
    kept = rows.withColumn("k", F.row_number().over(order)).where("k = 1").select("book", "id", "alias")
    return kept.join(cast.select("book", "id"), ["book", "id"], "left_semi")


def upserted_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(a, b, confidence): unordered pairs of both tables, the surer confidence of each."""
    rows = old.select("a", "b", "confidence").unionByName(new.select("a", "b", "confidence"))
    return rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("confidence").alias("confidence"))


def chapter_flags(presence: DataFrame) -> DataFrame:
    """(book, id, flag): once_only for members of one chapter with a confidence below 0.7, never_active for those only mentioned."""
    rows = presence.groupBy("book", "id").agg(F.countDistinct("chapter").alias("n"), F.max("confidence").alias("c"), F.count_if("active").alias("active"), F.count_if(~F.col("active")).alias("mentioned"))
    once = rows.where("n = 1 and c < 0.7").select("book", "id", F.lit("once_only").alias("flag"))
    return once.unionByName(rows.where("mentioned >= 2 and active = 0").select("book", "id", F.lit("never_active").alias("flag")))


def uncovered(cast: DataFrame, entries: DataFrame) -> DataFrame:
    """(book, id): members of several parts none of which is an entry (book, word)."""
    parts = cast.where(F.size(core_tokens(F.col("name"))) > 1).select("book", "id", F.explode(core_tokens(F.col("name"))).alias("word"))
    met = parts.join(entries.select("book", "word").distinct(), ["book", "word"], "left_semi").select("book", "id").distinct()
    return parts.select("book", "id").distinct().join(met, ["book", "id"], "left_anti")


def age_word(text: Column, pos: Column, before: int = 50, after: int = 300) -> Column:
    """The first age word near a place, or null."""
    start = F.greatest(F.lit(0), pos - before)
    return F.nullif(F.regexp_extract(F.substr(text, start + 1, pos + after - start), AGES, 1), F.lit(""))
