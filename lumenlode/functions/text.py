"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of two letters or more with hyphenated continuations, single letters that are part of a compound, names that begin with digits, numbers.
TOKEN = r"[\p{L}]{2,}(?:[-'’][\p{L}\p{N}]+)*(?:[0-9]+[A-Za-z]*)?|\p{L}(?:[-'’][\p{L}\p{N}]+)+(?:[0-9]+[A-Za-z]*)?|[0-9]+\p{L}+|[0-9]+(?:[.,][0-9]+)*"
#: Scripts without blanks between words give no terms.
UNSEGMENTED = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
BLANKS = r"[ \t\n\x0B\f\r\x{a0}]+"

# Function words that end a phrase (a default; ``WordSets`` reads longer lists).
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]
# Words that may join two halves of a name.
BRIDGING_WORDS = ["of", "as", "a"]
# Words that make a phrase too general to be a topic (a default; ``WordSets`` reads longer lists).
GENERIC_WORDS = ["analysis", "approach", "data", "method", "methods", "model", "paper", "problem", "process", "research", "result", "results", "study", "system", "systems", "technology"]
# Legal forms of organisations.
LEGAL_FORMS = ["ag", "co", "company", "corp", "corporation", "gmbh", "inc", "limited", "llc", "ltd", "plc", "sa"]
# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["e.g", "i.e", "et al", "etc", "fig", "eq", "ref", "cf", "vs", "approx", "dr", "prof", "no", "vol", "pp", "т.е", "т.д", "т.п", "рис", "табл", "см", "др", "проф", "акад"]
# Function words by which a language is voted for; words that two of them share are left out.
LANGUAGE_WORDS = {
    "en": ["the", "and", "of", "to", "is", "that", "with", "for", "this", "are", "was", "from"],
    "es": ["el", "los", "las", "del", "y", "es", "una", "por", "con", "para", "su", "como"],
    "pt": ["das", "dos", "não", "uma", "para", "são", "pelo", "pela", "também", "você", "está", "ainda", "é", "sem", "seu", "sua", "já", "até", "às"],
    "fr": ["le", "les", "des", "et", "est", "une", "dans", "pour", "sur", "au", "avec", "qui"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "für", "auf", "den", "ein", "eine"],
    "it": ["il", "della", "che", "sono", "gli", "nel", "alla", "anche", "questo", "delle", "degli", "è"],
}
# Parts of names that mark companies, and academic bodies.
CORPORATE = [" inc", " inc.", " llc", " ltd", " ltd.", " limited", " corp", " corp.", " corporation", " gmbh", " s.a.", " sas", " b.v.", " co.", " company", " technologies", " labs", " laboratories inc", " ооо", " оао", " пао", " зао", " ао ", " акционерное общество"]
ACADEMIC = ["universit", "univ.", "institute", "institut", "college", "academy", "school", "cnrs", "университет", "институт", "академия"]


class WordSets:
    """The word lists of the term rules: small defaults, or files of one word a line (# begins a comment)."""

    def __init__(self, stop: list[str] | None = None, generic: list[str] | None = None, boundary: list[str] | None = None):
        self.stop, self.generic = stop or STOP_WORDS, generic or GENERIC_WORDS
        self.boundary = boundary or self.stop

    @classmethod
    def read(cls, spark, **paths: str) -> WordSets:
        """``stop``, ``generic``, ``boundary``: paths that Spark can read; a list has some hundred words."""
        lists = {}
        for name, path in paths.items():
            words = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("w")).where("w <> ''")
            lists[name] = sorted(r["w"] for r in words.distinct().collect())
        return cls(**lists)


def tokens(text: Column) -> Column:
    """The surface forms of a text's tokens."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.when(F.coalesce(text, F.lit("")).rlike(UNSEGMENTED), F.filter(found, lambda x: ~x.rlike(UNSEGMENTED))).otherwise(found)


def normal(surface: Column) -> Column:
    return F.translate(F.lower(surface), "’", "'")


def words(text: Column) -> Column:
    """The normal forms of a text's tokens."""
    return F.transform(tokens(text), normal)


def sentences(text: Column) -> Column:
    """Cut after . ! ? and … with white space, but not after an abbreviation or an initial; trimmed, none empty."""
    known = "|".join(map(re.escape, ABBREVIATIONS))
    cut = rf"(?<=[.!?…])(?<!(?<![\p{{L}}\p{{N}}])(?iu:{known})\.)(?<!(?<!\p{{L}})\p{{Lu}}\.){BLANKS}"
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), cut, "\x01"), "\x01")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def is_stop_word(word: Column) -> Column:
    return word.isin(STOP_WORDS)


def is_number(token: Column) -> Column:
    return token.rlike(r"^[0-9][0-9.,]*$")


def is_year_like(token: Column) -> Column:
    """Four digits from 1500 to 2200."""
    return token.rlike("^[0-9]{4}$") & token.cast("int").between(1500, 2200)


def is_upper(surface: Column) -> Column:
    """Two letters or more, all of them capitals."""
    return surface.rlike(r"\p{L}.*\p{L}") & ~surface.rlike(r"\p{Ll}|\p{Lo}")


def is_capitalised(surface: Column) -> Column:
    return surface.rlike(r"^\p{Lu}")


def nfkc(text: Column) -> Column:
    """Unicode's compatibility composition, which Spark has no function for; texts of ASCII need none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return run(text)


def without_marks(text: Column) -> Column:
    """Compatibility decomposition without combining marks."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", x)) if not unicodedata.combining(c))
        return s.map(lambda x: x if x is None or x.isascii() else plain(x))

    return run(text)


def normalize_text(text: Column) -> Column:
    """Composed, one blank for runs of white space, none at the ends; the letter yo as ye."""
    return F.trim(F.regexp_replace(F.translate(nfkc(text), "ёЁ", "еЕ"), BLANKS, " "))


def normalize_title(title: Column) -> Column:
    """Lower case, letters without their marks, everything else one blank."""
    return F.trim(F.regexp_replace(F.lower(without_marks(title)), r"[^\p{L}\p{N}]+", " "))


def normalize_author(name: Column) -> Column:
    """Surname and first initial: the surname is before a comma, or the last word."""
    comma = F.split(name, ",")
    family, rest = normalize_title(F.get(comma, F.lit(0))), normalize_title(F.coalesce(F.get(comma, F.lit(1)), F.lit("")))
    parts = F.split(normalize_title(name), " ")
    plain = F.concat_ws(" ", F.element_at(parts, -1), F.when(F.size(parts) > 1, F.substring(F.get(parts, F.lit(0)), 1, 1)))
    return F.trim(F.when(F.size(comma) > 1, F.concat_ws(" ", family, F.substring(rest, 1, 1))).otherwise(plain))


def author_key(name: Column) -> Column:
    """As ``normalize_author`` in built-in expressions only (no marks are removed): for arrays."""
    clean = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))
    comma, parts = F.split(name, ","), F.split(clean(name), " ")
    by_comma = F.concat_ws(" ", clean(F.get(comma, F.lit(0))), F.substring(clean(F.coalesce(F.get(comma, F.lit(1)), F.lit(""))), 1, 1))
    plain = F.concat_ws(" ", F.element_at(parts, -1), F.when(F.size(parts) > 1, F.substring(F.get(parts, F.lit(0)), 1, 1)))
    return F.trim(F.when(F.size(comma) > 1, by_comma).otherwise(plain))


def normalize_authors(names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(names, author_key))), ";")


def author_team(names: Column) -> Column:
    """Who wrote a document: last word and first letter of each name, sorted; empty without authors."""
    parts = lambda x: F.filter(F.split(F.lower(F.translate(x, ".", " ")), " +"), lambda w: w != "")
    key = lambda p: F.when(F.size(p) > 1, F.concat(F.element_at(p, -1), F.lit(" "), F.substring(p[0], 1, 1))).when(F.size(p) == 1, p[0])
    named = F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: key(parts(x)))
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def dedup_key(doi: Column, arxiv: Column, title: Column, authors: Column, year: Column) -> Column:
    """SHA-256 of the first of: DOI, arXiv id, normalised title with authors and year."""
    given = lambda x: F.when(F.trim(x) != "", F.lower(F.trim(x)))
    return F.sha2(
        F.coalesce(
            F.concat(F.lit("doi:"), given(doi)),
            F.concat(F.lit("arxiv:"), given(arxiv)),
            F.concat_ws("|", normalize_title(F.coalesce(title, F.lit(""))), F.coalesce(authors, F.lit("")), F.coalesce(year.cast("string"), F.lit(""))),
        ),
        256,
    )


def content_hash(ids: Column) -> Column:
    """An aggregate: SHA-256 of the distinct ids, sorted, a line each. For the ids of one snapshot, whose number is bounded by its budget."""
    return F.sha2(F.array_join(F.sort_array(F.collect_set(ids)), "\n"), 256)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def detect_language(text: Column) -> Column:
    """Two letters, or null: shares of scripts first; among Latin texts votes by function words, English unless another has a clear majority.

    Null with fewer than 20 letters. Another language needs three votes and twice English's and one more; of
    equals the first in LANGUAGE_WORDS wins.
    """
    t = F.coalesce(text, F.lit(""))
    han, kana, hangul = _count(t, r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"), _count(t, r"[\x{3040}-\x{30ff}]"), _count(t, r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}]")
    cyrillic, latin = _count(t, r"[\x{0400}-\x{04ff}]"), _count(t, r"[A-Za-z\x{c0}-\x{24f}]")
    letters = han + kana + hangul + cyrillic + latin
    plain = F.lower(F.regexp_replace(t, r"https?://[^ \t\n\x0B\f\r]+", " "))
    found = F.regexp_extract_all(plain, F.lit(r"[a-z\x{df}-\x{ff}]+"), F.lit(0))
    among = lambda known: F.size(F.filter(found, lambda x: x.isin(known)))
    votes = {k: among(v) for k, v in LANGUAGE_WORDS.items()}
    most = F.greatest(*[v for k, v in votes.items() if k != "en"])
    voted = F.lit("en")
    for k in reversed([k for k in LANGUAGE_WORDS if k != "en"]):
        voted = F.when((votes[k] == most) & (most >= 3) & (most >= 2 * votes["en"] + 1), k).otherwise(voted)
    return (
        F.when(letters < 20, None)
        .when(kana >= 0.05 * letters, "ja")
        .when(hangul >= 0.2 * letters, "ko")
        .when(han >= 0.2 * letters, "zh")
        .when(cyrillic >= 0.3 * letters, "ru")
        .when(latin < 0.5 * letters, None)
        .otherwise(voted)
    )


def stem_prefix(word: Column, n: int = 6) -> Column:
    return F.substring(word, 1, n)


def canonical_organization(name: Column) -> Column:
    """Lower case, & as and, without legal forms at either end."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), "[^a-z0-9]+", " "))
    forms = "|".join(LEGAL_FORMS)
    return F.trim(F.regexp_replace(F.regexp_replace(clean, f"( ({forms}))+$", ""), f"^(({forms}) )+", ""))


def is_corporate(name: Column, kind: Column) -> Column:
    """The given type decides; without one the marks in the name, academic ones first."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit(" "))
    has = lambda marks: padded.rlike("|".join(map(re.escape, marks)))
    return F.when(kind.isNotNull(), kind == "COMPANY").otherwise(~has(ACADEMIC) & has(CORPORATE))


def canonical_url(url: Column) -> Column:
    """Lower case, without scheme, www, fragment and the slashes at the end."""
    u = F.regexp_replace(F.lower(url), "#.*$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, "^https?://", ""), "^www[.]", ""), "/+$", "")


def host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), "^https?://([^/:?#]+)", 1)


def on_host(host_col: Column, hosts: list[str]) -> Column:
    """Whether a host is one of ``hosts`` or under one."""
    return host_col.rlike("(^|[.])(" + "|".join(map(re.escape, hosts)) + ")$")


def label_matches(label: Column, phrase: Column) -> Column:
    """Whether the phrase occurs in the label as whole words."""
    return F.contains(F.concat(F.lit(" "), label, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def snippet(text: Column, limit: int = 400) -> Column:
    """The beginning of a text, cut at a blank, with an ellipsis where it is cut."""
    t = F.trim(text)
    cut = F.regexp_replace(F.regexp_replace(F.substring(t, 1, limit), "(?s)^(.+) [^ ]*$", "$1"), "[ ,;:]+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(cut, F.lit("…")))
