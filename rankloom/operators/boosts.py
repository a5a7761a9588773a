"""Multipliers and bonuses of the first ranking stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T


def at_least(value: Column, tiers) -> Column:
    """The factor of the highest tier reached; 1 below all of them or for null."""
    return reduce(lambda rest, t: F.when(value >= t[0], F.lit(float(t[1]))).otherwise(rest), reversed(tiers), F.lit(1.0))


def at_most(value: Column, tiers) -> Column:
    return reduce(lambda rest, t: F.when(value <= t[0], F.lit(float(t[1]))).otherwise(rest), reversed(tiers), F.lit(1.0))


def quality(rating: Column, reviews: Column, years: Column, verified: Column) -> Column:
    return at_least(rating, C.RATING_TIERS) * at_least(reviews, C.REVIEW_TIERS) * at_least(years, C.YEARS_TIERS) * F.when(verified, F.lit(C.VERIFIED_FACTOR)).otherwise(F.lit(1.0))


def meaningful(terms: Column) -> Column:
    """Query terms longer than three characters that are not generic."""
    return F.filter(terms, lambda t: (F.length(t) > 3) & ~F.lower(t).isin(*C.GENERIC_TERMS))


def volume(relevant: Column, total: Column) -> Column:
    """By the volume of matching procedures; a malus for volume that matches nothing."""
    return F.when(relevant > 0, at_least(relevant, C.VOLUME_TIERS)).when(total > 0, F.lit(C.IRRELEVANT_FACTOR)).otherwise(F.lit(1.0))


def proximity(miles: Column, by_postcode: bool = True) -> Column:
    return at_most(miles, C.PROXIMITY_TIERS) if by_postcode else F.lit(1.0)


def phrase_bonus(query: Column, text: Column, longest: int = 3) -> Column:
    """2 for the whole query, 1 for every run of words of it, found in the text."""
    q, t = F.lower(F.trim(query)), F.lower(text)
    bonus = F.when(F.contains(t, q), F.lit(2.0)).otherwise(F.lit(0.0)) + T.count_contained(T.phrases(query, longest), t)
    return F.when((q == "") | (t == ""), F.lit(0.0)).otherwise(bonus)


def negative(matches: Column) -> Column:
    return F.when(matches >= 2, F.lit(0.85)).when(matches == 1, F.lit(0.95)).otherwise(F.lit(1.0))


def session(urgent: Column, available: Column, emergency: Column, specialty: Column, location: Column, symptom: Column) -> Column:
    """Product of the session's boosts; each argument is a condition."""
    factors = ((urgent & available, 1.2), (urgent & emergency, 1.15), (specialty, 1.3), (location, 1.2), (symptom, 1.15))
    return reduce(lambda a, b: a * b, (F.when(c, F.lit(f)).otherwise(F.lit(1.0)) for c, f in factors))


def heuristic(required: list[tuple[Column, float]], optional: list[tuple[Column, float]]) -> Column:
    """Points of conditions: -1, which leaves a profile out, unless all that are required hold; else their points and those of the others that hold.

    A condition that is null does not hold.
    """
    holds = lambda c: F.coalesce(c, F.lit(False))
    total = reduce(lambda a, b: a + b, (F.when(holds(c), F.lit(n)).otherwise(F.lit(0)) for c, n in (*required, *optional)), F.lit(0))
    allowed = reduce(lambda a, b: a & b, (holds(c) for c, _ in required), F.lit(True))
    return F.when(allowed, total).otherwise(F.lit(-1))


def pelvic_specialist(region: Column, specialty: Column, specialties: Column, member: Column, statement: Column, website: Column, practice: Column) -> Column:
    """The heuristic for pelvic-pain physiotherapists in London, best above; -1 for all others."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    says = lambda what: F.contains(low(statement), F.lit(what))
    any_holds = lambda what: F.exists(specialties, lambda s: F.contains(low(s), F.lit(what)))
    there = lambda c: F.coalesce(c, F.lit("")) != ""
    exact = F.coalesce(F.exists(specialties, lambda s: low(s) == "pelvic pain"), F.lit(False))
    required = [(F.contains(low(region), F.lit("london")), 10), (exact | F.contains(low(specialty), F.lit("pelvic pain")), 50)]
    optional = [(F.contains(low(member), F.lit("full member")), 15), *((any_holds(what), n) for what, n in C.PELVIC_SPECIALTIES), *((says(word), 6) for word in C.PELVIC_WORDS)]
    return heuristic(required, [*optional, (says("pelvic pain"), 10), (says("chronic") | says("pain management"), 5), (there(website), 5), (there(practice), 3)])
