"""Stems of English and Russian words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings of the Snowball algorithm for Russian, longest first where one contains another.
GERUND_1 = "вшись вши в"
GERUND_2 = "ывшись ившись ывши ивши ыв ив"
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею"
PARTICIPLE_1 = "ющ нн вш ем щ"
PARTICIPLE_2 = "ующ ивш ывш"
REFLEXIVE = "ся сь"
VERB_1 = "ешь нно ете йте ла на ли ем ло но ет ют ны ть й л н"
VERB_2 = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю"
NOUN = "иями ями ами иях ией иям ием иев ях ах ов ев ие ье еи ии ей ой ий ям ем ам ом ию ью ия ья а е и й о у ы ь ю я"
SUPERLATIVE = "ейше ейш"
DERIVATIONAL = "ость ост"


def stem_english(word: Column) -> Column:
    """A conservative stemmer: the plural, then -ing or -ed where four letters with a vowel stay; a doubled consonant but l, s and z is then single."""
    w = F.lower(word)
    singular = (
        F.when(w.rlike("sses$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("^..+ies$"), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("^.{2,}(ch|sh|x|z|s)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("s$") & ~w.rlike("(ss|us|is|os)$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )

    def without(s: Column, ending: str) -> tuple[Column, Column]:
        left = F.regexp_replace(s, ending + "$", "")
        return s.rlike(f"^.{{4,}}{ending}$") & left.rlike("[aeiouy]"), F.regexp_replace(left, "([^aeiouylsz])\\1$", "$1")

    (ing, no_ing), (ed, no_ed) = without(singular, "ing"), without(singular, "ed")
    return F.when(F.length(w) <= 3, w).when(ing, no_ing).when(ed, no_ed).otherwise(singular)


def _longest(endings: str) -> re.Pattern:
    return re.compile("(?:" + "|".join(sorted(endings.split(), key=len, reverse=True)) + ")$")


def russian(word: str) -> str:
    """The Snowball stem of a Russian word; applied once, as it is not idempotent."""
    w = word.lower().replace("ё", "е")
    if len(w) <= 2:
        return w
    vowel = re.search("[аеиоуыэюя]", w)
    rv = vowel.end() if vowel else len(w)
    r1 = m.end() if (m := re.search("[аеиоуыэюя][^аеиоуыэюя]", w)) else len(w)
    r2 = r1 + m.end() if (m := re.search("[аеиоуыэюя][^аеиоуыэюя]", w[r1:])) else len(w)

    def cut(s: str, endings: str, region: int = rv, after: str = "") -> str | None:
        """``s`` without the longest ending that lies in the region, and stands after one of ``after``; None if there is none."""
        for e in sorted(endings.split(), key=len, reverse=True):
            at = len(s) - len(e)
            if s.endswith(e) and at >= region and (not after or at and s[at - 1] in after):
                return s[:at]
        return None

    first_of = lambda *found: next((x for x in found if x is not None), None)
    stem = first_of(cut(w, GERUND_1, after="ая"), cut(w, GERUND_2))
    if stem is None:
        base = first_of(cut(w, REFLEXIVE), w)
        adjective = cut(base, ADJECTIVE)
        if adjective is not None:
            stem = first_of(cut(adjective, PARTICIPLE_1, after="ая"), cut(adjective, PARTICIPLE_2), adjective)
        else:
            stem = first_of(cut(base, VERB_1, after="ая"), cut(base, VERB_2), cut(base, NOUN), base)
    stem = first_of(cut(stem, "и"), stem)
    stem = first_of(cut(stem, DERIVATIONAL, r2), stem)
    if stem.endswith("нн"):
        stem = stem[:-1]
    elif (plain := cut(stem, SUPERLATIVE)) is not None:
        stem = plain[:-1] if plain.endswith("нн") else plain
    return re.sub("ь$", "", stem) or w


def stem_russian(word: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else russian(x))

    return run(word)


def stem(word: Column) -> Column:
    """By script: Russian for Cyrillic words, English for others. Use on distinct words."""
    return F.when(word.rlike("(?iu)[а-яё]"), stem_russian(word)).otherwise(stem_english(word))
