"""Second-stage rescoring of a shortlist; all on columns of counts, so it runs after the top-N cut."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of the strongest signal and of procedures; other terms describe a pathway.
HIGH_SIGNAL = ("chest pain", "angina", "coronary artery disease", "ischaemic heart disease", "ct coronary angiography", "stress echo", "chest pain clinic")
PROCEDURE_TERMS = ("interventional cardiology", "coronary angiography", "pci", "stent", "percutaneous coronary intervention")


def term_classes(terms: Column, high=HIGH_SIGNAL, procedures=PROCEDURE_TERMS) -> tuple[Column, Column, Column]:
    """High-signal, procedure and pathway terms, in lower case; repeated terms stay repeated."""
    low = F.transform(terms, lambda t: F.lower(t))
    pick = lambda values: F.filter(low, lambda t: t.isin(*values))
    return pick(high), pick([p for p in procedures if p not in high]), F.filter(low, lambda t: ~t.isin(*high, *procedures))


def negative_delta(n: Column) -> Column:
    return F.when(n >= 4, F.lit(-3.0)).when(n >= 2, F.lit(-2.0)).when(n == 1, F.lit(-1.0)).otherwise(F.lit(0.0))


def additive(score: Column, intent: Column, anchor: Column, negative: Column, subspecialty: Column, ambiguous: Column, w_intent=0.3, w_anchor=0.5, cap=0.5) -> Column:
    """First-stage score (left out for ambiguous queries) plus weighted counts, capped subspecialty and negative tiers; not below 0."""
    delta = w_intent * intent + w_anchor * anchor + negative_delta(negative) + F.least(subspecialty, F.lit(cap))
    return F.greatest(F.lit(0.0), F.when(ambiguous, delta).otherwise(score + delta))


def _step(n: Column, *points: float) -> Column:
    """points[i - 1] for i matches, the last for more, 0 for none."""
    out = F.lit(0.0)
    for i, p in enumerate(points, 1):
        out = F.when(n >= i, F.lit(float(p))).otherwise(out)
    return out


def tiered(high: Column, pathway: Column, procedure: Column, anchor: Column, safe: Column, subspecialty: Column, negative: Column, per_anchor=0.2, anchor_cap=0.6) -> Column:
    """Additive tiers, for ambiguous queries: strong signal, pathway, procedures, anchors, safe terms, subspecialty, negatives."""
    return (
        _step(high, 2, 4) + _step(pathway, 1, 2, 3) + 0.5 * procedure + F.least(per_anchor * anchor, F.lit(anchor_cap))
        + _step(safe, 1, 2, 3) + F.least(subspecialty, F.lit(0.5)) + negative_delta(negative)
    )


def tiered_order(tier: str = "tier", score: str = "score") -> list[Column]:
    """The order of a tiered rescore: by its points, then by the first-stage score."""
    return [F.desc(tier), F.desc(score), F.asc("doc_id")]


def multiplicative(score: Column, high: Column, pathway: Column, procedure: Column, anchor: Column, safe: Column, subspecialty: Column, negative: Column, per_anchor=0.2, anchor_cap=0.6) -> Column:
    """For clear queries: fixed factors, then anchors and safe terms added, then subspecialty and negatives as factors; not below 0."""
    f = F.when(high >= 2, 1.4).when(high == 1, 1.2).otherwise(1.0)
    f = f * F.when(pathway >= 3, 1.3).when(pathway == 2, 1.15).when(pathway == 1, 1.05).otherwise(1.0)
    f = f * F.when(procedure > 0, 1.05).otherwise(1.0)
    raised = score * f + F.least(per_anchor * anchor, F.lit(anchor_cap)) + _step(safe, 1, 2, 3)
    kept = F.when(negative >= 4, 0.70).when(negative >= 2, 0.85).when(negative == 1, 0.95).otherwise(1.0)
    return F.greatest(F.lit(0.0), raised * (1 + F.least(subspecialty, F.lit(0.5))) * kept)


def negatives_only(score: Column, negative: Column) -> Column:
    return F.greatest(F.lit(0.0), score + negative_delta(negative))


def fuzzy(a: Column, b: Column) -> Column:
    """Equal, or one within the other, regardless of case and outer blanks."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (a == b) | F.contains(a, b) | F.contains(b, a)


def subspecialty_matches(held: Column, wanted: Column) -> Column:
    """Equal, contained either way, or sharing a word longer than three characters."""
    words = lambda x: F.filter(F.split(F.lower(x), r"\s+"), lambda w: F.length(w) > 3)
    return fuzzy(F.lower(held), F.lower(wanted)) | F.arrays_overlap(words(held), words(wanted))


def weighted_subspecialty(held: Column, likely: Column, weight: float = 0.3) -> Column:
    """Sum of confidence times weight over likely array<struct<name, confidence>> that match a held name."""
    return F.aggregate(likely, F.lit(0.0), lambda acc, s: acc + F.when(F.exists(held, lambda h: subspecialty_matches(h, s["name"])), s["confidence"] * weight).otherwise(0.0))


def _requirements(items: Column, held: Column, required: float, preferred: float, optional: float, missing: float = 0.0) -> Column:
    """Points for each wanted struct<name, importance> that some held name matches; nameless ones count nothing."""
    points = lambda x: F.when(x["importance"] == "required", F.lit(required)).when(x["importance"] == "preferred", F.lit(preferred)).otherwise(F.lit(optional))
    found = lambda x: F.coalesce(F.exists(held, lambda h: fuzzy(h, x["name"])), F.lit(False))
    one = lambda x: F.when(F.coalesce(x["name"], F.lit("")) == "", F.lit(0.0)).when(found(x), points(x)).when(x["importance"] == "required", F.lit(missing)).otherwise(F.lit(0.0))
    return F.coalesce(F.aggregate(items, F.lit(0.0), lambda acc, x: acc + one(x)), F.lit(0.0))


def _each(values: Column, points: float, found) -> Column:
    return F.coalesce(F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.when(found(v), F.lit(points)).otherwise(F.lit(0.0))), F.lit(0.0))


def ideal_match(profile: Column, ideal: Column) -> Column:
    """Points of a profile against an ideal profile, not below 0; null lists count nothing.

    profile: struct of subspecialties, procedures, conditions, qualifications, age_groups,
    languages (arrays), expertise, description, gender.  ideal: struct of subspecialties,
    procedures, conditions (arrays of struct<name, importance>), areas, keywords,
    avoid_subspecialties, avoid_procedures, qualifications, age_groups, languages, gender.
    """
    p, i = (lambda c: profile[c]), (lambda c: ideal[c])
    expertise, description = (F.lower(F.coalesce(p(c), F.lit(""))) for c in ("expertise", "description"))
    overlap = lambda c, f, points: F.when(F.arrays_overlap(F.transform(p(c), f), F.transform(i(c), f)), F.lit(points)).otherwise(F.lit(0.0))
    same = lambda x: x
    total = (
        _requirements(i("subspecialties"), p("subspecialties"), 5.0, 3.0, 1.0, -2.0)
        + _requirements(i("procedures"), p("procedures"), 4.0, 2.0, 0.5)
        + _requirements(i("conditions"), p("conditions"), 3.0, 1.5, 1.5)
        + _each(i("areas"), 2.0, lambda a: F.contains(expertise, F.lower(a)))
        + _each(i("keywords"), 1.0, lambda k: F.contains(description, F.lower(k)))
        + _each(i("avoid_subspecialties"), -3.0, lambda a: F.coalesce(F.exists(p("subspecialties"), lambda h: fuzzy(h, a)), F.lit(False)))
        + _each(i("avoid_procedures"), -2.0, lambda a: F.coalesce(F.exists(p("procedures"), lambda h: fuzzy(h, a)), F.lit(False)))
        + overlap("qualifications", F.upper, 1.0) + overlap("age_groups", same, 1.5) + overlap("languages", F.lower, 1.0)
        + F.when(F.lower(i("gender")) == F.lower(p("gender")), F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return F.greatest(F.lit(0.0), total)


def checklist_match(value: Column, held: Column) -> Column:
    """1 if ``held`` has the value between blanks (or is it), 0.5 if one is within the other, else null; blanks match nothing."""
    v, h = F.lower(F.trim(value)), F.lower(F.trim(held))
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    space = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return F.when(blank(v) | blank(h), F.lit(None).cast("double")).when(F.contains(space(h), space(v)), F.lit(1.0)).when(F.contains(h, v) | F.contains(v, h), F.lit(0.5))


def checklist(filters: Column, sets: list[Column], least: float = 0.3, most: float = 1.2) -> tuple[Column, Column]:
    """Share of checklist values found and the boost for it.

    A value counts by the first of the sets, in their order and then all together, in
    which it is found at all: a part of the first set goes before a whole word of the second.
    """
    everything = F.array_join(F.filter(F.transform(F.array(*sets), lambda s: F.trim(s)), lambda s: s != ""), " ")
    value = lambda v: F.coalesce(*[checklist_match(v, s) for s in (*sets, everything)], F.lit(0.0))
    ratio = F.when(F.size(filters) > 0, F.aggregate(filters, F.lit(0.0), lambda acc, v: acc + value(v)) / F.size(filters)).otherwise(F.lit(0.0))
    return ratio, F.when(ratio >= least, F.least(1 + (most - 1) * ratio, F.lit(most))).otherwise(F.lit(1.0))
