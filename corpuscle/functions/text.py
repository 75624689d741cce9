"""Column functions that clean and repair text. Each takes and returns a Column, null for null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
#: OCR word errors and their repair, applied in this order.
SUBSTITUTIONS = {
    "tlie": "the", "liave": "have", "liis": "his", "lier": "her", "liim": "him", "liow": "how", "wlio": "who",
    "wlien": "when", "wliere": "where", "wliich": "which", "wliat": "what", "wliy": "why", "wliile": "while",
    "wliole": "whole", "tliis": "this", "tliat": "that", "tlien": "then", "tliere": "there", "tliey": "they",
    "tlieir": "their", "tliese": "these", "tliose": "those", "tliougli": "though", "tlirougli": "through",
    "tliouglit": "thought", "witli": "with", "witliout": "without", "witliin": "within", "otlier": "other",
    "altliougli": "although", "notliing": "nothing", "sometliing": "something", "everytliing": "everything",
    "anytliing": "anything", "fatber": "father", "motber": "mother", "brotber": "brother", "togetber": "together",
    "whetber": "whether", "anotber": "another", "ratber": "rather", "eitber": "either", "neitber": "neither",
    "gatber": "gather", "weatlier": "weather", "featber": "feather", "leatber": "leather", "indude": "include",
    "exdude": "exclude", "condude": "conclude", "woulcl": "would", "coulcl": "could", "shoulcl": "should",
}
#: Words run together, and how they are written.
CONCATENATIONS = {
    "Iam": "I am", "Iwas": "I was", "Iwill": "I will", "Ishall": "I shall", "Ihave": "I have", "Ihad": "I had",
    "Ido": "I do", "Idid": "I did", "Ican": "I can", "Icould": "I could", "Imay": "I may", "Imight": "I might",
    "Imust": "I must", "Iknow": "I know", "Ifelt": "I felt", "Ifeel": "I feel", "Ifound": "I found",
    "Iwent": "I went", "Icame": "I came", "Isaw": "I saw", "Itook": "I took", "Itried": "I tried",
    "inthe": "in the", "ofthe": "of the", "tothe": "to the", "onthe": "on the", "atthe": "at the", "bythe": "by the",
    "forthe": "for the", "fromthe": "from the", "withthe": "with the", "ofan": "of an", "ofmy": "of my",
    "tomy": "to my", "asI": "as I", "ifI": "if I", "Doyou": "Do you", "Didyou": "Did you",
}
#: Roman numerals misread by OCR, applied in this order.
ROMAN_ERRORS = {
    "IT": "II", "TI": "II", "Il": "II", "lI": "II", "ll": "II", "1I": "II", "I1": "II", "11": "II",
    "ITI": "III", "IIT": "III", "TII": "III", "TTI": "III", "TIT": "III", "ITT": "III", "Ill": "III", "IIl": "III",
    "Ilt": "III", "lII": "III", "llI": "III", "lll": "III", "111": "III", "1V": "IV", "lV": "IV", "V1": "VI", "Vl": "VI",
    "V1I": "VII", "VI1": "VII", "VIl": "VII", "VlI": "VII", "Vll": "VII", "V11": "VII",
    "V1II": "VIII", "VI1I": "VIII", "VII1": "VIII", "VIIl": "VIII", "VIlI": "VIII", "VlII": "VIII", "Vlll": "VIII", "V111": "VIII",
    "1X": "IX", "lX": "IX", "X1": "XI", "Xl": "XI",
    "X1I": "XII", "XI1": "XII", "XIl": "XII", "XlI": "XII", "Xll": "XII", "X11": "XII",
    "X1II": "XIII", "XI1I": "XIII", "XII1": "XIII", "XIIl": "XIII", "XIlI": "XIII", "XlII": "XIII", "Xlll": "XIII", "X111": "XIII",
}
#: Broken ligatures: pattern and replacement, in order.
LIGATURES = [
    (r"\bf\s+f\s+i", "ffi"), (r"\bf\s+f\s+l", "ffl"), (r"([a-z]{2,})f\s+i([a-z])", "$1fi$2"),
    (r"([a-z]{2,})f\s+l([a-z])", "$1fl$2"), (r"([a-z]{2,})f\s+f([a-z])", "$1ff$2"),
]
#: Ligature glyphs and their letters.
GLYPHS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Spaces that become a plain one, and dashes that become a hyphen.
SPACES, DASHES = "\u00a0\u202f\u2007\u2009\u200a", "\u2010\u2011\u2012\u2013"
#: Frequent words that betray words run together when another follows.
COMMON = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or an will my "
    "one all would there their what so up out if about who get which go me when make can like time no just him know take people "
    "into year your good some could them see other than then now look only come its over think also back after use two how our "
    "work first well way even new want because any these give day most us is was are been has had were said each very may such "
    "much made own upon shall should must before where while through"
).split()
# ----------------------------------------------------------------------------


def words(text: Column) -> Column:
    """The parts of a text between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def normalized(text: Column) -> Column:
    """One form of line ends, at most one blank line, single inner spaces, no trailing space; indents stay."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+(?=\n|$)", "")
    t = F.regexp_replace(t, r"(?<=[^ \t\n])[ \t]+", " ")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def clean_title(title: Column) -> Column:
    """A title without byte-order mark, file suffix and extra spaces; null if nothing is left."""
    t = F.regexp_replace(title, "^\ufeff+", "")
    t = F.regexp_replace(t, r"(?i)\.(pdf|docx|epub|txt)$", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t != "", t)


def without_boilerplate(text: Column) -> Column:
    """The text between the start and end marks of an e-book's licence, where they stand."""
    t = F.regexp_replace(text, r"(?is)\*\*\*\s*END\s+OF\s+(THE\s+)?PROJECT\s+GUTENBERG\s+EBOOK.*?\*\*\*.*$", "")
    return F.regexp_replace(t, r"(?is)^.*?\*\*\*\s*START\s+OF\s+(THE\s+)?PROJECT\s+GUTENBERG\s+EBOOK[^\n]*?\*\*\*", "")


def plain_characters(text: Column) -> Column:
    """Special spaces as plain ones, short dashes as hyphens, control characters dropped; line ends and tabs stay."""
    t = F.translate(text, SPACES + DASHES, " " * len(SPACES) + "-" * len(DASHES))
    return F.regexp_replace(t, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def dehyphenated(text: Column) -> Column:
    """Words that a hyphen splits at a line end as one, if both parts have two letters or more."""
    return F.regexp_replace(text, r"\b([a-zA-Z]{2,})-\s*\n\s*([a-zA-Z]{2,})\b", "$1$2")


def rejoined(text: Column) -> Column:
    """Lower-case word parts on both sides of a single line end as one word."""
    return F.regexp_replace(text, r"\b([A-Z]?[a-z]{2,})\n[ \t]*([a-z]{2,})\b", "$1$2")


def glyphs_spelled(text: Column) -> Column:
    """Ligature glyphs as letters, and lines of digits alone dropped."""
    t = reduce(lambda c, g: F.replace(c, F.lit(g[0]), F.lit(g[1])), GLYPHS.items(), text)
    return F.regexp_replace(t, r"(?m)^[ \t]*\d+[ \t]*$\n?", "")


def ligatures_joined(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), LIGATURES, text)


def substituted(text: Column) -> Column:
    """OCR word errors repaired anywhere, in lower, title and upper case."""
    for wrong, right in SUBSTITUTIONS.items():
        for form in (str.lower, str.capitalize, str.upper):
            text = F.replace(text, F.lit(form(wrong)), F.lit(form(right)))
    return text


def heading_context(line: Column) -> Column:
    """If a line reads as a heading: it begins with a structural word, is short and deeply indented, or a lone numeral, perhaps a misread one."""
    inner = F.regexp_replace(line, r"^\s+|\s+$", "")
    keyword = inner.rlike(r"(?i)^(chapter|part|book|letter|act|scene)\s+")
    indented = line.rlike(r"^\s{10,}\S") & (F.length(inner) < 50)
    lone = (F.length(inner) <= 10) & (inner.rlike(r"(?i)^[IVXLCDMTl1]+\.?$") | F.upper(inner).isin(*(w.upper() for w in ROMAN_ERRORS)))
    return keyword | indented | lone


def romans_repaired(line: Column) -> Column:
    """A heading line with misread Roman numerals repaired; other lines as they are."""
    fixed = reduce(lambda c, p: F.regexp_replace(c, rf"(?<![A-Za-z0-9]){p[0]}(?![A-Za-z0-9])", p[1]), ROMAN_ERRORS.items(), line)
    return F.when(heading_context(line), fixed).otherwise(line)


def concatenation_split(word: Column) -> Column:
    """The known reading of words run together, else null; an initial capital is kept."""
    table = F.create_map(*[F.lit(x) for pair in CONCATENATIONS.items() for x in pair])
    exact, low = F.try_element_at(table, word), F.try_element_at(table, F.lower(word))
    capital = F.substring(word, 1, 1) != F.lower(F.substring(word, 1, 1))
    return F.coalesce(exact, F.when(capital, F.concat(F.upper(F.substring(low, 1, 1)), F.substr(low, F.lit(2)))).otherwise(low))


def looks_run_together(word: Column) -> Column:
    """If a word begins with a frequent word and goes on, has an inner capital, or hides `of` or `my`."""
    known = "|".join(sorted((w for w in COMMON if 2 <= len(w) <= 7), key=len, reverse=True))
    return F.lower(word).rlike(rf"^({known})[a-z]{{3,}}") | word.rlike("[a-z][A-Z]") | ((F.length(word) >= 8) & F.lower(word).rlike("[a-z](of|my)[a-z]"))


def needs_spacing(text: Column, sample: int = 10_000) -> Column:
    """If more than one in twenty of a sample's words look run together (those of eight letters or more)."""
    w = words(F.substring(text, 1, sample))
    odd = F.filter(w, lambda x: x.rlike("[a-z][A-Z]") | ((F.length(F.regexp_replace(x, "[^A-Za-z]", "")) >= 8) & looks_run_together(F.regexp_replace(x, "[^A-Za-z]", ""))))
    return F.coalesce(F.try_divide(F.size(odd), F.size(w)) > 0.05, F.lit(False))


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and navigation dropped, block ends as line ends, entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav)\b[^>]*>.*?</(script|style|nav)>", "")
    t = F.regexp_replace(t, r"(?i)<(br|/p|/div|/h[1-6]|/blockquote|/li)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"[ \t]*\n\s*", "\n"))


def roman_value(numeral: Column) -> Column:
    """The value of a Roman numeral; letters of other kinds count nothing."""
    values = F.create_map(*[F.lit(x) for pair in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in pair])
    digits = F.reverse(F.transform(F.split(F.upper(numeral), ""), lambda c: F.coalesce(F.try_element_at(values, c), F.lit(0))))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    return F.aggregate(digits, start, lambda a, d: F.struct((a["sum"] + F.when(d < a["last"], -d).otherwise(d)).alias("sum"), d.alias("last")), lambda a: a["sum"])


def context(text: Column, position: Column, length: Column, window: int = 100) -> Column:
    """The text around a 0-based position with ... where it is cut, white space collapsed."""
    start = F.greatest(F.lit(0), position - window)
    end = F.least(F.length(text), position + length + window)
    inner = F.trim(F.regexp_replace(F.substr(text, start + 1, end - start), r"\s+", " "))
    return F.concat(F.when(start > 0, "...").otherwise(""), inner, F.when(end < F.length(text), "...").otherwise(""))


def valid_ipa(text: Column) -> Column:
    """If every character is ASCII or one of the phonetic blocks."""
    return text.rlike(r"^[\x{00}-\x{7F}\x{A0}-\x{36F}\x{1D00}-\x{1DBF}]*$")


def possessive(name: Column) -> Column:
    return name.rlike("['’]s$")


def normalized_name(name: Column) -> Column:
    """A name without quotes, possessive, closing punctuation and trailing parenthetical."""
    t = F.trim(F.regexp_replace(name, "^[\"“”‘]+|[\"“”]+$", ""))
    t = F.translate(t, "’ʼ‘", "'''")
    t = F.regexp_replace(t, "'s$|(?<=s)'$", "")
    t = F.regexp_replace(t, r"[.!?,;:]+$", "")
    return F.trim(F.regexp_replace(t, r"\s*\([^)]*\)$", ""))


def json_candidate(reply: Column) -> Column:
    """The JSON text in a model's reply: fenced, or between the outer braces, with common faults repaired."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(reply)
    body = F.coalesce(F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit("")), body)
    body = F.regexp_replace(body, r",\s*([}\]])", "$1")
    body = F.regexp_replace(body, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    for python, js in (("True", "true"), ("False", "false"), ("None", "null")):
        body = F.regexp_replace(body, rf"\b{python}\b", js)
    return F.trim(body)


def without_thinking(reply: Column) -> Column:
    """A reply without its thinking parts, closed or not."""
    return F.trim(F.regexp_replace(reply, r"(?is)<(think|thinking|reasoning|thought)>.*?(</(think|thinking|reasoning|thought)>|$)", ""))
