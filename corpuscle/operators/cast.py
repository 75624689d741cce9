"""Names, casts and relations: normalisation, merging rules, label corrections.

A cast is (book, id, name, aliases, mentions, ...); relations are edges (book,
src, dst, label). Everything is keyed by book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
TITLES = (
    "mr mrs ms miss m mlle mme madam madame dr prof professor rev reverend sir lady lord president senator governor mayor judge "
    "chancellor pvt private pfc cpl corporal spc spec specialist sgt ssgt msgt sergeant lt ltc lieutenant cpt capt captain maj major "
    "col colonel gen general cmdr commander adm admiral ensign officer chief staff master first second 1st 2nd 3rd 4th"
).split()
STOPS = "the a an of and de la le van von del di da old young".split()
REVERSES = {
    "father": "son", "mother": "daughter", "son": "father", "daughter": "mother", "brother": "brother", "sister": "sister",
    "grandfather": "grandson", "grandmother": "granddaughter", "grandson": "grandfather", "granddaughter": "grandmother",
    "uncle": "nephew", "aunt": "niece", "nephew": "uncle", "niece": "aunt", "cousin": "cousin", "husband": "wife", "wife": "husband",
    "spouse": "spouse", "partner": "partner", "guardian": "ward", "ward": "guardian", "parent": "child", "child": "parent",
    "employer": "employee", "employee": "employer", "mentor": "protégé", "protégé": "mentor", "creator": "creation", "creation": "creator",
}
SYMMETRIC = (
    "acquaintance", "associate", "associated", "business partner", "close friend", "colleague", "friend", "ally", "neighbor", "rival",
    "enemy", "romantic interest", "love interest", "sibling", "twin", "brother", "sister", "cousin", "co-conspirator", "conspirator",
    "partner", "spouse",
)
#: Labels that say nothing.
VAGUE = ("unknown", "associated", "acquaintance", "none", "n/a", "")
#: Male label and its female form.
GENDERED = {"father": "mother", "son": "daughter", "brother": "sister", "husband": "wife", "uncle": "aunt", "nephew": "niece", "grandfather": "grandmother", "grandson": "granddaughter"}
#: What a name flag says: reason and pattern, the first that fits.
NAME_FLAGS = [
    ("honorific", r"(?i)^(monsieur|madame|mademoiselle|miss|mrs\.?|mr\.?|ms\.?|dr\.?|sir|lady|lord|dame|the\s+(doctor|professor|captain|general|colonel|major|reverend|father|mother|sister|brother))$"),
    ("description", r"(?i)^(an?|the)\s+(old|young|tall|short|pale|dark|rich|poor|strange|unknown)\s+(man|woman|boy|girl|child|person|stranger|servant|soldier|doctor)$"),
    ("literary", r"(?i)the\s+(poet|philosopher|historian|scientist|writer|author|composer|painter)|\b\d{4}\s*-\s*\d{4}\b|\b\d+(st|nd|rd|th)\s+century\b"),
    ("narrator", r"(?i)^(the\s+narrator|narrator|the\s+speaker|speaker|the\s+author|I)$"),
    ("role", r"(?i)^(the\s+)?(protagonist|antagonist|hero|heroine|villain|main\s+character|sidekick|mentor|guide)$"),
    ("group", r"(?i)^(the|a\s+group\s+of|some|several|many|various)\s+(sailors|soldiers|servants|guards|townspeople|villagers|people|citizens|crew|children|men|women|guests|crowd)"),
]
# ----------------------------------------------------------------------------


def core_tokens(name: Column) -> Column:
    """Lower-case parts of a name without punctuation, titles, articles and single letters."""
    parts = F.split(F.replace(F.lower(name), F.lit("."), F.lit(" ")), r"\s+")
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^[,'\"()]+|[,'\"()]+$", ""), "['’]s$", ""))
    return F.filter(clean, lambda p: (F.length(p) > 1) & ~p.isin(*TITLES, *STOPS))


def match_key(name: Column) -> Column:
    """The name by which two spellings are matched: its core, or all of it in lower case if nothing is left."""
    core = core_tokens(name)
    return F.when(F.size(core) > 0, F.array_join(core, " ")).otherwise(F.trim(F.lower(name)))


def surname(name: Column) -> Column:
    """The last core part of a name of two or more."""
    core = core_tokens(name)
    return F.when(F.size(core) > 1, F.element_at(core, -1))


def name_flag(name: Column) -> Column:
    """Why a name is none, the first reason that fits, or null."""
    out = F.lit(None).cast("string")
    for reason, pattern in reversed(NAME_FLAGS):
        out = F.when(F.trim(name).rlike(pattern), F.lit(reason)).otherwise(out)
    return out


def gender_of_title(name: Column) -> Column:
    """male or female by the title that a name begins with, else null."""
    return F.when(name.rlike(r"(?i)^(mr\.?|sir|lord)\s"), "male").when(name.rlike(r"(?i)^(mrs\.?|ms\.?|miss|lady)\s"), "female")


def ambiguous_parts(cast: DataFrame) -> DataFrame:
    """(book, part, ids): parts of names that several members share."""
    parts = cast.select("book", "id", F.explode(F.array_distinct(core_tokens(F.col("name")))).alias("part"))
    return parts.groupBy("book", "part").agg(F.array_sort(F.collect_set("id")).alias("ids")).where("size(ids) > 1")


def fragments(cast: DataFrame) -> DataFrame:
    """(book, id, into): members whose core is part of exactly one longer member's core, with as many mentions."""
    core = cast.select("book", "id", "mentions", F.array_distinct(core_tokens(F.col("name"))).alias("core")).where("size(core) > 0")
    part = core.select("book", "mentions", F.col("id").alias("id"), F.col("core").alias("short"), F.element_at("core", -1).alias("token"))
    whole = core.select("book", "mentions", F.col("id").alias("into"), F.col("core").alias("long"), F.explode("core").alias("token"))
    pairs = part.join(whole, ["book", "mentions", "token"]).where("size(array_except(short, long)) = 0 and size(short) < size(long)")
    return pairs.groupBy("book", "id").agg(F.count("*").alias("n"), F.min("into").alias("into")).where("n = 1").select("book", "id", "into")


def initials(cast: DataFrame) -> DataFrame:
    """(book, id, into): 'A. Last' with the member of fewest id that spells out a first name of that letter."""
    named = cast.select("book", "id", F.upper(F.substring(F.trim("name"), 1, 1)).alias("letter"), F.lower(F.element_at(F.split(F.trim("name"), r"\s+"), -1)).alias("last"), F.trim("name").rlike(r"^[A-Za-z]\.\s").alias("short"))
    full = named.where("not short").groupBy("book", "letter", "last").agg(F.min("id").alias("into"))
    return named.where("short").join(full, ["book", "letter", "last"]).select("book", "id", "into")


def same_first_names(cast: DataFrame) -> DataFrame:
    """(book, first, id, n, mentions): members of several parts with one first name as one, the most mentioned stays."""
    parts = F.split(F.trim("name"), r"\s+")
    rows = cast.where(F.size(parts) > 1).select("book", F.lower(parts[0]).alias("first"), "id", "mentions")
    best = F.max_by("id", F.struct("mentions", -F.col("id")))
    return rows.groupBy("book", "first").agg(best.alias("id"), F.count("*").alias("n"), F.sum("mentions").alias("mentions")).where("n > 1")


def grounded(cast: DataFrame, hits: DataFrame, least: int = 3) -> DataFrame:
    """cast with hits, grounded and confidence, hits (book, id, alias, n) being counts of each spelling in the text."""
    total = hits.groupBy("book", "id").agg(F.sum("n").alias("hits"))
    out = cast.join(total, ["book", "id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return out.withColumn("grounded", F.col("hits") >= least).withColumn("confidence", F.when(F.col("hits") >= least, "high").otherwise("low"))


def background() -> Column:
    """If a member is only mentioned: no narrator, no dialogue, no main role, under six mentions, no evidence."""
    return ~F.col("narrator") & ~F.col("dialogue") & ~F.coalesce(F.lower("role"), F.lit("")).isin("protagonist", "antagonist", "main") & (F.col("mentions") < 6) & (F.col("evidence") == 0)


def _reverse(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in REVERSES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(label)), F.when(F.lower(label).isin(*SYMMETRIC), F.lower(label)))


def with_reverses(edges: DataFrame) -> DataFrame:
    """Edges with the missing way back of each label that has one; vague labels are replaced, others stay."""
    back = edges.select("book", F.col("dst").alias("src"), F.col("src").alias("dst"), _reverse(F.col("label")).alias("label")).where("label is not null")
    both = edges.withColumn("rank", F.when(F.lower("label").isin(*VAGUE), 2).otherwise(0)).unionByName(back.withColumn("rank", F.lit(1)))
    return both.groupBy("book", "src", "dst").agg(F.min(F.struct("rank", "label")).alias("x")).select("book", "src", "dst", F.col("x.label").alias("label"))


def without_contradictions(edges: DataFrame) -> DataFrame:
    """Edges without those pairs that carry one asymmetric label both ways."""
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")]
    bad = edges.where(~F.lower("label").isin(*SYMMETRIC)).select("book", "label", *pair).groupBy("book", "label", "a", "b").count().where("count > 1")
    keyed = edges.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    return keyed.join(bad.drop("count"), ["book", "label", "a", "b"], "left_anti").select("book", "src", "dst", "label")


def without_orphans(edges: DataFrame, cast: DataFrame) -> DataFrame:
    """Edges between different members of the cast."""
    ids = cast.select("book", F.col("id").alias("src")).distinct()
    kept = edges.where("src <> dst").join(ids, ["book", "src"], "left_semi")
    return kept.join(ids.withColumnRenamed("src", "dst"), ["book", "dst"], "left_semi").select("book", "src", "dst", "label")


def one_spouse(edges: DataFrame, weights: DataFrame) -> DataFrame:
    """Edges with one spouse a member at most: the one of most shared mentions (ties: the smallest id)."""
    spouse = F.lower("label").isin("husband", "wife", "spouse")
    ranked = edges.where(spouse).join(weights, ["book", "src", "dst"], "left")
    best = ranked.groupBy("book", "src").agg(F.max_by("dst", F.struct(F.coalesce("weight", F.lit(0)), -F.col("dst"))).alias("dst"))
    return edges.where(~spouse).unionByName(edges.where(spouse).join(best, ["book", "src", "dst"], "left_semi").select(*edges.columns))


def gender_consistent(edges: DataFrame, cast: DataFrame) -> DataFrame:
    """Edges whose gendered labels agree with the gender of the member that bears them."""
    male = F.create_map(*[F.lit(x) for pair in GENDERED.items() for x in pair])
    female = F.create_map(*[F.lit(x) for a, b in GENDERED.items() for x in (b, a)])
    joined = edges.join(cast.select("book", F.col("id").alias("src"), "gender"), ["book", "src"], "left")
    swapped = F.when(F.col("gender") == "female", F.try_element_at(male, F.lower("label"))).when(F.col("gender") == "male", F.try_element_at(female, F.lower("label")))
    return joined.select("book", "src", "dst", F.coalesce(swapped, "label").alias("label"))


def spousal_triangles(edges: DataFrame) -> DataFrame:
    """Edges with a child's label to its parent's spouse where no child label is there."""
    child = F.lower("label").isin("son", "daughter")
    a = edges.where(child).select("book", F.col("src").alias("a"), F.col("dst").alias("b"), "label")
    b = edges.where(F.lower("label").isin("husband", "wife", "spouse")).select("book", F.col("src").alias("b"), F.col("dst").alias("c"))
    new = a.join(b, ["book", "b"]).where("a <> c").groupBy("book", "a", "c").agg(F.min("label").alias("label"))
    new = new.select("book", F.col("a").alias("src"), F.col("c").alias("dst"), "label")
    new = new.join(edges.where(child).select("book", "src", "dst"), ["book", "src", "dst"], "left_anti")
    kept = edges.join(new.select("book", "src", "dst"), ["book", "src", "dst"], "left_anti")
    return kept.select("book", "src", "dst", "label").unionByName(new)


def vague_dropped(edges: DataFrame) -> DataFrame:
    return edges.where(~F.coalesce(F.lower(F.trim("label")), F.lit("")).isin(*VAGUE))


def near_pairs(mentions: DataFrame, window: int) -> DataFrame:
    """(book, a, b, n): pairs of members with mentions (book, id, pos) at most window apart, by cells of that width.

    A mention meets its own cell and the next one only, so the join is linear in
    the text unless one window itself is crowded.
    """
    cell = F.floor(F.col("pos") / window).cast("long")
    left = mentions.select("book", F.col("id").alias("x"), F.col("pos").alias("px"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    right = mentions.select("book", F.col("id").alias("y"), F.col("pos").alias("py"), cell.alias("cell"))
    ahead = left.join(right, ["book", "cell"]).where((F.col("x") != F.col("y")) & (F.col("py") - F.col("px") <= window) & ((F.col("py") > F.col("px")) | ((F.col("py") == F.col("px")) & (F.col("x") < F.col("y")))))
    return ahead.groupBy("book", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))


def shared_chapters(presence: DataFrame, least: int) -> DataFrame:
    """(book, a, b, n): pairs of members that share at least that many chapters (book, id, chapter)."""
    p = presence.distinct()
    pairs = p.select("book", "chapter", F.col("id").alias("a")).join(p.select("book", "chapter", F.col("id").alias("b")), ["book", "chapter"]).where("a < b")
    return pairs.groupBy("book", "a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def handoffs(presence: DataFrame, most_gap: int = 2) -> DataFrame:
    """(book, a, b, gap): b takes over where a leaves off: one chapter in common at most, a gap of 0 to most_gap."""
    spans = presence.groupBy("book", "id").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"), F.collect_set("chapter").alias("all"))
    a = spans.select("book", F.col("id").alias("a"), F.col("all").alias("sa"), F.explode(F.sequence("last", F.col("last") + most_gap)).alias("first"), F.col("last").alias("la"))
    b = spans.select("book", F.col("id").alias("b"), F.col("all").alias("sb"), "first")
    pairs = a.join(b, ["book", "first"]).where("a <> b and size(array_intersect(sa, sb)) <= 1 and (size(sb) <= 5 or size(sb) < size(sa))")
    return pairs.select("book", "a", "b", (F.col("first") - F.col("la")).alias("gap"))


def top_per_chapter_third(passages: DataFrame, most: int) -> DataFrame:
    """The best passages (book, id, chapter, pos, score) of each third of a book's chapters, most // 3 of each."""
    n = F.max("chapter").over(W.partitionBy("book"))
    third = F.least(F.lit(2), F.floor((F.col("chapter") - 1) * 3 / n)).cast("int")
    order = W.partitionBy("book", "id", "third").orderBy(F.desc("score"), "pos")
    return passages.withColumn("third", third).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, most // 3))
