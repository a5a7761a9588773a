"""Session contexts: what a conversation and its readings make of a query, in six variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rewrite as RW

_STRINGS = "array<string>"
_NAMED = "array<struct<name: string, confidence: double>>"
INSIGHTS = f"struct<symptoms: {_STRINGS}, preferences: {_STRINGS}, urgency: string>"
GENERAL = f"struct<goal: string, specificity: string, confidence: double, expansion_terms: {_STRINGS}, anchor_phrases: {_STRINGS}, negative_terms: {_STRINGS}, likely_subspecialties: {_NAMED}>"
CLINICAL = f"struct<primary_intent: string, expansion_terms: {_STRINGS}, anchor_phrases: {_STRINGS}, negative_terms: {_STRINGS}, likely_subspecialties: {_NAMED}>"
_NEED = "array<struct<name: string, importance: string, confidence: double>>"
IDEAL = f"struct<subspecialties: {_NEED}, procedures: {_NEED}, conditions: {_NEED}, areas: {_STRINGS}, avoid_subspecialties: {_STRINGS}, avoid_procedures: {_STRINGS}>"
VARIANTS = ("algorithmic", "sequential", "parallel", "parallel-v2", "goal-specificity", "v5")


def _list(c: Column, kind: str = _STRINGS) -> Column:
    return F.coalesce(c, F.expr(f"cast(array() as {kind})"))


def then(first: Column, more: Column) -> Column:
    """All of ``first``, then what of ``more`` is not among it, each once."""
    return F.concat(first, F.array_distinct(F.filter(more, lambda x: ~F.array_contains(first, x))))


def likely(clinical: Column, general: Column, least: float = 0.4, most: int = 3) -> Column:
    """The surest subspecialties of both readings: confident enough, each name (regardless of case) at its best, the surest first, then as they come."""
    both = F.filter(F.concat(_list(clinical, _NAMED), _list(general, _NAMED)), lambda s: (F.coalesce(s["name"], F.lit("")) != "") & F.coalesce(s["confidence"] >= least, F.lit(False)))
    names = F.transform(both, lambda s: F.lower(s["name"]))
    placed = F.transform(both, lambda s, i: F.struct((-s["confidence"]).alias("sure"), F.array_position(names, F.lower(s["name"])).alias("first"), i.alias("i"), s["name"].alias("name"), s["confidence"].alias("confidence")))
    order = F.sort_array(placed)
    once = F.filter(order, lambda x, i: ~F.exists(F.slice(order, F.lit(1), i), lambda y: F.lower(y["name"]) == F.lower(x["name"])))
    return F.transform(F.slice(once, 1, most), lambda x: F.struct(x["name"].alias("name"), x["confidence"].alias("confidence")))


def session_context(variant: str, query: Column, insights: Column, general: Column, clinical: Column, ideal: Column) -> Column:
    """The context of a query as a struct, by variant.

    * algorithmic: the query with symptoms, preferences and an urgency that is not routine; no terms;
    * sequential: the general reading's terms;
    * parallel: the clinical reading's terms before the general one's, anchors of the general one,
      negative terms only if the query is clear;
    * parallel-v2: the same with anchors of both readings and safe terms for the first stage;
    * goal-specificity: as parallel, negative terms always;
    * v5: all from an ideal profile (importance already checked), the query itself where that says nothing.

    insights, general, clinical and ideal are structs like INSIGHTS, GENERAL, CLINICAL and IDEAL; null
    lists are empty.  ``ambiguous`` says which rescoring follows; null where a variant does not tell.
    ``enriched_query`` joins the words that are required with the terms that do not repeat them.
    """
    no, none = _list(F.lit(None).cast(_STRINGS)), F.lit(None).cast("string")
    text = F.trim(F.coalesce(query, F.lit("")))
    symptoms = _list(insights["symptoms"])
    out = {"q_patient": text, "safe_lane_terms": no, "intent_terms": no, "anchor_phrases": no, "negative_terms": no, "likely_subspecialties": _list(F.lit(None).cast(_NAMED), _NAMED), "goal": none, "specificity": none, "confidence": F.lit(None).cast("double"), "ambiguous": F.lit(None).cast("boolean")}
    if variant == "algorithmic":
        urgent = F.when(insights["urgency"] != "routine", F.nullif(insights["urgency"], F.lit("")))
        joined = lambda a: F.nullif(F.array_join(_list(a), " "), F.lit(""))
        out["enriched_query"] = F.concat_ws(" ", F.nullif(query, F.lit("")), joined(insights["symptoms"]), joined(insights["preferences"]), urgent)
        out["q_patient"] = F.trim(out["enriched_query"])
    else:
        clear = F.coalesce(RW.is_clear(general["confidence"], general["specificity"]), F.lit(False))
        said = {"goal": general["goal"], "specificity": general["specificity"], "confidence": general["confidence"]}
        terms = then(_list(clinical["expansion_terms"]), _list(general["expansion_terms"]))
        negatives = then(_list(clinical["negative_terms"]), _list(general["negative_terms"]))
        subspecialties = likely(clinical["likely_subspecialties"], general["likely_subspecialties"])
        if variant == "sequential":
            out |= said | {"intent_terms": _list(general["expansion_terms"]), "anchor_phrases": _list(general["anchor_phrases"]), "negative_terms": _list(general["negative_terms"]), "likely_subspecialties": _list(general["likely_subspecialties"], _NAMED)}
        elif variant == "goal-specificity":
            out |= said | {"intent_terms": terms, "anchor_phrases": _list(general["anchor_phrases"]), "negative_terms": negatives, "likely_subspecialties": subspecialties}
        elif variant in ("parallel", "parallel-v2"):
            out |= said | {"intent_terms": terms, "anchor_phrases": _list(general["anchor_phrases"]), "negative_terms": F.when(clear, negatives).otherwise(no), "likely_subspecialties": subspecialties, "ambiguous": ~clear}
            if variant == "parallel-v2":
                out |= {"anchor_phrases": RW.merge_anchors(_list(clinical["anchor_phrases"]), _list(general["anchor_phrases"])), "safe_lane_terms": RW.safe_lane(terms)}
        elif variant == "v5":
            subs = _list(ideal["subspecialties"], _NEED)
            sure = lambda s: F.when(F.coalesce(s["confidence"], F.lit(0.0)) != 0, s["confidence"]).otherwise(0.8)
            required = F.exists(subs, lambda s: s["importance"] == "required")
            terms = RW.ideal_intents(ideal)
            out |= {
                "q_patient": F.coalesce(F.nullif(RW.ideal_sentence(ideal), F.lit("")), text), "safe_lane_terms": RW.safe_lane(terms), "intent_terms": terms, "anchor_phrases": RW.ideal_anchors(ideal),
                "negative_terms": F.concat(_list(ideal["avoid_subspecialties"]), _list(ideal["avoid_procedures"])), "goal": F.lit("ideal_profile_match"), "specificity": F.when(required, "named_procedure").otherwise("symptom_only"),
                "likely_subspecialties": F.slice(F.transform(subs, lambda s: F.struct(s["name"].alias("name"), sure(s).alias("confidence"))), 1, 3), "confidence": F.coalesce(F.array_max(F.transform(subs, sure)), F.lit(0.7)), "ambiguous": ~required,
            }
        else:
            raise ValueError(f"no variant {variant}")
        wanted = RW.merge_required(RW.required_terms(query, symptoms), F.transform(out["intent_terms"], lambda x: F.lower(x)))
        out["enriched_query"] = F.array_join(wanted, " ")
    return F.struct(*[v.alias(k) for k, v in out.items()])
