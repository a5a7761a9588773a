"""Hard filters as conditions; unset options add nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Parts of words that put a patient, or an age group, among children.
CHILD_WORDS = ("child", "paediatric", "pediatric")


def not_blacklisted(flag: Column) -> Column:
    """Only a flag that is true removes a row."""
    return ~F.coalesce(flag, F.lit(False))


def insured_by(insurers: Column, wanted: str) -> Column:
    """Any insurer that contains the wanted name or is contained in it; no list: no."""
    w = wanted.lower().strip()
    return F.coalesce(F.exists(insurers, lambda x: F.contains(F.lower(x), F.lit(w)) | F.contains(F.lit(w), F.lower(x))), F.lit(False))


def inferred_gender(title: Column, text: Column) -> Column:
    """By title, else by pronouns: at least two and more than of the other kind; else null."""
    t = F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"\.", "")
    body = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(body, r"[^a-z0-9_]+")
    he = F.size(F.filter(words, lambda w: w.isin("he", "him", "his", "himself")))
    she = F.size(F.filter(words, lambda w: w.isin("she", "her", "hers", "herself")))
    return F.when(t == "mr", "male").when(t.isin("mrs", "ms", "miss"), "female").when((he >= 2) & (he > she), "male").when((she >= 2) & (she > he), "female")


def gender_allows(gender: Column, wanted: str | None) -> Column:
    """Unknown gender is kept."""
    if wanted in (None, "", "any", "no preference"):
        return F.lit(True)
    return gender.isNull() | (gender == wanted.lower())


def treats_age(groups: Column, wanted: str) -> Column:
    """A group that contains the wish or the reverse; a wish that speaks of children finds every group that does."""
    w = wanted.lower().strip()
    same = lambda g: F.contains(F.lower(g), F.lit(w)) | F.contains(F.lit(w), F.lower(g))
    child = any(c in w for c in CHILD_WORDS)
    return F.coalesce(F.exists(groups, lambda g: same(g) | (F.lower(g).rlike("|".join(CHILD_WORDS)) if child else F.lit(False))), F.lit(False))


def speaks(languages: Column, wanted: list[str]) -> Column:
    """Any language that contains a wanted one or is contained in it."""
    either = lambda x, w: F.contains(F.lower(x), F.lit(w.lower())) | F.contains(F.lit(w.lower()), F.lower(x))
    return F.coalesce(F.exists(languages, lambda x: reduce(lambda a, b: a | b, (either(x, w) for w in wanted))), F.lit(False))


def composite(insurers=None, gender=None, groups=None, languages=None, *, insurance=None, wanted_gender=None, age=None, wanted_languages=None) -> Column:
    """All the options that are set, joined by AND."""
    parts = []
    if insurance:
        parts.append(insured_by(insurers, insurance))
    if wanted_gender:
        parts.append(F.coalesce(F.lower(F.trim(gender)) == wanted_gender.lower(), F.lit(False)))
    if age:
        parts.append(treats_age(groups, age))
    if wanted_languages:
        parts.append(speaks(languages, wanted_languages))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def specialty_matches(specialty: Column, subspecialties: Column, expertise: Column, title: Column, wanted: str) -> Column:
    """The specialty contains the phrase or the reverse, or a subspecialty, the expertise or the title has the phrase or a word of it longer than two."""
    phrase = "".join(c if c.isascii() and (c.isalnum() or c.isspace()) else " " for c in wanted.lower()).strip()
    terms = [phrase, *(w for w in phrase.split() if len(w) > 2)]
    own = T.normalise_specialty(specialty)
    has = lambda x: reduce(lambda a, b: a | b, (F.contains(x, F.lit(t)) for t in terms))
    either = specialty.isNotNull() & (specialty != "") & (F.contains(own, F.lit(phrase)) | F.contains(F.lit(phrase), own))
    held = F.exists(subspecialties, lambda s: has(T.normalise_specialty(s)))
    return reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in (either, held, (expertise != "") & has(F.lower(expertise)), (title != "") & has(F.lower(title)))))


def has_nhs(base: Column, posts: Column) -> Column:
    return (F.trim(F.coalesce(base, F.lit(""))) != "") | (F.coalesce(F.size(posts), F.lit(0)) > 0)


def name_matches(name: Column, alternatives: Column, wanted: str) -> Column:
    w = F.lit(wanted.lower())
    return F.contains(F.lower(name), w) | F.coalesce(F.exists(alternatives, lambda a: F.contains(F.lower(a), w)), F.lit(False))


def name_search(profiles: DataFrame, wanted: str, most: int = 10) -> DataFrame:
    """The first profiles by id whose name or an alternative contains the text, at most ``most`` (never over 100), and in ``total`` how many there are."""
    hit = profiles.where(name_matches(F.col("name"), F.col("alternatives"), wanted))
    total = hit.agg(F.count(F.lit(1)).alias("total"))  # one row
    return hit.orderBy("doc_id").limit(min(most, 100)).join(F.broadcast(total))


def valid_expansion(terms: Column, required: Column, stop_words: tuple[str, ...], most: int = 50) -> Column:
    """Expansion terms without structure characters, stop words or repeats, at most ``most``, and the required ones."""
    clean = F.filter(F.transform(terms, lambda t: F.lower(F.trim(t))), lambda t: (t != "") & ~t.rlike(r"[{}\[\]:\"]") & ~t.isin(*stop_words))
    return F.array_union(F.slice(F.array_distinct(clean), 1, most), required)


def confident(subspecialties: Column, least: float = 0.4, most: int = 3) -> Column:
    """The first ``most`` of array<struct<name, confidence>> with enough confidence."""
    return F.slice(F.filter(subspecialties, lambda s: s["confidence"] >= least), 1, most)


def where_any_location(profiles: DataFrame, locations: DataFrame, condition: Column) -> DataFrame:
    """Profiles with a location that satisfies the condition (a semi-join on doc_id)."""
    return profiles.join(locations.where(condition).select("doc_id").distinct(), "doc_id", "left_semi")
