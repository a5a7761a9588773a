"""Profiles from source records: normalising, source-specific shapes, lists within texts, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import canonical_names, first_present, remote_consultation, stable_id, volumes

STRINGS = "array<string>"
VOLUMES = "array<struct<name: string, volume: double, count: string>>"
# Sources whose addresses go first, in order.
NAMED_URLS = ("cromwell", "hca", "bupa", "spire")


def _none() -> Column:
    return F.array().cast(STRINGS)


def comma_list(text: Column) -> Column:
    """The non-blank parts of a text between commas; null gives none."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def _present(values: Column) -> Column:
    return F.filter(F.coalesce(values, _none()), lambda x: F.trim(x) != "")


def profile_url(explicit: Column, named: Column, urls: Column, order=NAMED_URLS) -> Column:
    """The explicit address, else those of the named sources (a map) in order, else its first other, else the first of a list; blanks and the word null are none."""
    rest = F.filter(F.map_values(named), lambda v: (F.trim(v) != "") & (F.trim(v) != "null"))
    return F.coalesce(first_present(explicit, *[named[k] for k in order]), F.get(rest, 0), F.get(urls, 0))


def profile_id(*candidates: Column, otherwise: Column) -> Column:
    """The first identity that is there, else a hash of the record, the same on every run."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates], otherwise)


def normalise(records: DataFrame) -> DataFrame:
    """Merged source records as ranking profiles.

    Reads id, name, title, specialty, specialties, locations (array of struct with
    hospital, address, postcode), procedures, about, clinical_expertise,
    clinical_interests, bio, gmc_number, profile_url, profile_urls (map), urls, gender,
    languages, qualifications, professional_memberships, patient_age_group, nhs_base,
    nhs_posts, sources, year_qualified, years_experience, blacklisted and rating_value,
    review_count; for insurers insurance_details and accepted_insurers (names), for
    remote consultation the explicit remote_consultation, the flags remote_consultations,
    remote_video_consultations and remote_audio_consultations and consultation_types,
    for volumes procedures_completed and procedures_published; trials, feedback and notes
    are carried.  Columns that a source lacks count as null.  The blacklist flag is carried.
    The record itself goes along as JSON.
    """
    kinds = {"specialties": STRINGS, "procedures": STRINGS, "urls": STRINGS, "languages": STRINGS, "qualifications": STRINGS, "professional_memberships": STRINGS, "patient_age_group": STRINGS, "nhs_posts": STRINGS, "sources": STRINGS,
             "locations": "array<struct<hospital: string, address: string, postcode: string>>", "profile_urls": "map<string, string>", "blacklisted": "boolean", "rating_value": "double", "review_count": "long", "year_qualified": "long", "years_experience": "long",
             "insurance_details": STRINGS, "accepted_insurers": STRINGS, "remote_consultation": "boolean", "remote_consultations": "boolean", "remote_video_consultations": "boolean", "remote_audio_consultations": "boolean", "consultation_types": STRINGS,
             "procedures_completed": VOLUMES, "procedures_published": VOLUMES, "isrctn_trials": STRINGS, "isrctn_relational_trial_links": STRINGS, "reddit_recommendation_sources": STRINGS}
    shown = "patient_feedback patient_satisfaction research_interests reddit_patient_notes reddit_recommendation_level".split()
    strings = "id name title specialty about clinical_expertise clinical_interests bio gmc_number profile_url gender nhs_base".split() + shown
    have = {c.lower() for c in records.columns}
    r = {c: F.col(c) if c in have else F.lit(None).cast(kinds.get(c, "string")) for c in (*kinds, *strings)}
    text = lambda c: F.nullif(r[c], F.lit(""))
    place = F.get(r["locations"], 0)
    listed = lambda c: F.coalesce(r[c], _none())
    others = F.filter(F.transform(F.filter(listed("specialties"), lambda s: s != F.coalesce(r["specialty"], F.lit(""))), lambda s: F.trim(s)), lambda s: s != "")
    procedures = listed("procedures")
    insurers = F.filter(F.transform(F.concat(listed("insurance_details"), listed("accepted_insurers")), lambda x: F.trim(x)), lambda x: x != "")
    remote = remote_consultation(r["remote_consultation"], [r[c] for c in ("remote_consultations", "remote_video_consultations", "remote_audio_consultations")], listed("consultation_types"), F.transform(r["locations"], lambda x: x["hospital"]))
    record = F.to_json(F.struct(*records.columns))
    return records.select(
        profile_id(r["id"], otherwise=stable_id(record)).alias("practitioner_id"), r["id"].alias("id"),
        F.coalesce(text("name"), F.lit("Unknown")).alias("name"), text("title").alias("title"), text("specialty").alias("specialty"), others.alias("subspecialties"),
        F.coalesce(r["about"], F.lit("")).alias("description"), F.coalesce(r["about"], F.lit("")).alias("about"),
        F.coalesce(text("clinical_expertise"), text("clinical_interests"), text("bio"), F.lit("")).alias("clinical_expertise"),
        profile_url(r["profile_url"], r["profile_urls"], r["urls"]).alias("profile_url"),
        F.coalesce(F.nullif(place["hospital"], F.lit("")), F.nullif(F.get(F.split(place["address"], ","), 0), F.lit(""))).alias("address_locality"),
        F.get(F.filter(F.transform(r["locations"], lambda x: x["postcode"]), lambda x: x != ""), 0).alias("postal_code"), F.lit("United Kingdom").alias("address_country"),
        text("gmc_number").isNotNull().alias("verified"), text("gmc_number").alias("gmc_number"), r["year_qualified"].alias("year_qualified"), r["years_experience"].alias("years_experience"),
        text("gender").alias("gender"), *[listed(c).alias(c) for c in ("languages", "qualifications", "professional_memberships")], listed("professional_memberships").alias("memberships"),
        listed("patient_age_group").alias("patient_age_group"), text("nhs_base").alias("nhs_base"), listed("nhs_posts").alias("nhs_posts"), listed("sources").alias("sources"),
        r["rating_value"].alias("rating_value"), F.coalesce(r["review_count"], F.lit(0)).alias("review_count"), F.transform(procedures, lambda p: F.struct(p.alias("procedure_group_name"))).alias("procedure_groups"),
        F.size(procedures).alias("procedure_count"), F.coalesce(r["blacklisted"], F.lit(False)).alias("blacklisted"), r["locations"].alias("locations"),
        insurers.alias("insurers"), F.lit(0).cast("long").alias("total_admission_count"), remote.alias("remote_consultation"), volumes(r["procedures_completed"], r["procedures_published"]).alias("procedure_volumes"),
        r["isrctn_trials"].alias("isrctn_trials"), r["isrctn_relational_trial_links"].alias("isrctn_relational_trial_links"), (F.coalesce(F.size("isrctn_trials") if "isrctn_trials" in have else F.lit(0), F.lit(0)) > 0).alias("has_isrctn_trials"), r["reddit_recommendation_sources"].alias("reddit_recommendation_sources"),
        *[r[c].alias(c) for c in shown], record.alias("original"),
    )


def complete(records: DataFrame, aliases: DataFrame) -> DataFrame:
    """``normalise`` with ``insurers`` by their canonical names, each once, in the order given; aliases: (variant, canonical)."""
    made = normalise(records)
    named = canonical_names(made.select(F.col("practitioner_id").alias("id"), F.col("insurers").alias("names")).distinct(), aliases)
    return made.drop("insurers").join(named.select(F.col("id").alias("practitioner_id"), F.col("names").alias("insurers")), "practitioner_id", "left").withColumn("insurers", F.coalesce("insurers", _none()))


def from_rated_source(rows: DataFrame) -> DataFrame:
    """(url, name, score, ...) of a source that rates to ten: rating to five and an id hashed from address, name and row."""
    row = F.to_json(F.struct(*rows.columns))
    return rows.select(F.md5(F.concat(F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("name"), F.lit("")), row).cast("binary")).alias("practitioner_id"), "name", (F.col("score") / 2).alias("rating_value"), F.col("url").alias("profile_url"))


def from_listing(rows: DataFrame, source: str, specialty: str, membership: str) -> DataFrame:
    """Records of a register whose lists are texts between commas, in the shape of merged records.

    Reads id, name, title, bio, industry_services, clinical_expertise, company_name,
    contact_address, geographical_areas, procedures, languages.  Expertise becomes
    ``Condition: ...`` segments with the whole as interests; the contact address and
    every area served become locations.
    """
    c = lambda name: F.nullif(F.col(name), F.lit(""))
    conditions = comma_list(F.col("clinical_expertise"))
    said = F.array_join(F.transform(conditions, lambda x: F.concat(F.lit("Condition: "), x)), "; ")
    expertise = F.when(F.size(conditions) > 0, F.concat(said, F.lit("; Clinical Interests: "), F.col("clinical_expertise"))).otherwise(F.lit(""))
    place = lambda hospital, address: F.struct(hospital.alias("hospital"), address.alias("address"), F.lit("").alias("postcode"), F.lit(source).alias("source"))
    contact = F.when(c("contact_address").isNotNull(), F.array(place(F.coalesce(c("company_name"), F.lit("Practice")), F.col("contact_address"))))
    areas = F.transform(comma_list(F.col("geographical_areas")), lambda a: place(F.lit(""), a))
    empty = F.filter(areas, lambda x: F.lit(False))
    about = F.when(c("bio").isNotNull() & c("industry_services").isNotNull(), F.concat("bio", F.lit("\n\nServices: "), "industry_services")).otherwise(F.coalesce(c("bio"), c("industry_services"), F.lit("")))
    return rows.select(
        profile_id(F.col("id"), otherwise=stable_id(F.to_json(F.struct(*rows.columns)))).alias("id"), F.coalesce(c("name"), F.lit("Unknown")).alias("name"), c("title").alias("title"),
        F.lit(specialty).alias("specialty"), F.lit(source).alias("specialty_source"), F.array(F.lit(specialty)).alias("specialties"), expertise.alias("clinical_expertise"), conditions.alias("conditions"),
        comma_list(F.col("procedures")).alias("procedures"), comma_list(F.col("languages")).alias("languages"), about.alias("about"), F.concat(F.coalesce(contact, empty), areas).alias("locations"),
        F.array(F.lit(membership)).alias("professional_memberships"), F.array(F.lit(source)).alias("sources"),
    )


def from_regional_register(rows: DataFrame, source: str, specialty: str) -> DataFrame:
    """Records of a register by region (profile_url, name, member_type, region, specialties) in the shape of merged records; the id ends the address."""
    listed = _present(F.col("specialties"))
    conditions = F.filter(listed, lambda s: F.lower(s).rlike("pain|dysfunction|incontinence|disease|disorder"))
    tagged = lambda tag, a: F.transform(a, lambda x: F.concat(F.lit(f"{tag}: "), x))
    interests = F.array_join(listed, ", ")
    expertise = F.array_join(F.concat(tagged("Procedure", listed), tagged("Condition", conditions), F.array(F.concat(F.lit("Clinical Interests: "), interests))), "; ")
    say = lambda tag, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(tag), value, F.lit(".")))
    about = F.concat_ws(" ", F.lit(f"{specialty}."), say("Member type: ", F.col("member_type")), say("Region: ", F.col("region")), say("Specialties and areas: ", interests))
    last = F.get(F.reverse(F.filter(F.split("profile_url", "/"), lambda x: x != "")), 0)
    return rows.select(
        profile_id(last, otherwise=stable_id(F.to_json(F.struct(*rows.columns)))).alias("id"), F.coalesce(F.nullif("name", F.lit("")), F.lit("Unknown")).alias("name"), F.nullif("member_type", F.lit("")).alias("title"),
        F.lit(specialty).alias("specialty"), F.lit(source).alias("specialty_source"), listed.alias("specialties"), listed.alias("procedures"), conditions.alias("conditions"), expertise.alias("clinical_expertise"), about.alias("about"),
        F.when(F.coalesce("region", F.lit("")) != "", F.array(F.struct(F.lit("Practice").alias("hospital"), F.col("region").alias("address"), F.lit("").alias("postcode"), F.lit(source).alias("source")))).alias("locations"),
        F.array(F.lit(source)).alias("professional_memberships"), F.array(F.lit(source)).alias("sources"),
    )


def expertise_any_case(text: Column) -> Column:
    """Like ``merge.expertise`` with keys in any case, found before the first colon; parts without a colon or a value are left out."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: F.contains(p, F.lit(":")))
    pairs = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, ":", 1))).alias("k"), F.trim(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v")))
    of = lambda key: F.transform(F.filter(pairs, lambda x: (x["k"] == key) & (x["v"] != "")), lambda x: x["v"])
    return F.struct(of("procedure").alias("procedures"), of("condition").alias("conditions"), F.get(F.reverse(of("clinical interests")), 0).alias("interests"))


def distinct_terms(names: Column, parsed: Column) -> Column:
    """Lower-case names and, of parsed texts, single words longer than two characters; each once, in order."""
    words = F.filter(F.flatten(F.transform(F.coalesce(parsed, _none()), lambda p: F.split(p, r"\s+"))), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(F.concat(F.filter(F.transform(F.coalesce(names, _none()), lambda n: F.trim(n)), lambda n: n != ""), words), lambda t: F.lower(t)))


def card(description: Column, procedures: Column, most_chars: int = 500, most: int = 25) -> Column:
    """What a reviewer sees of a profile: the beginning of its description and its distinct procedures, the first ``most``."""
    seen = F.filter(procedures, lambda p, i: ~F.exists(F.slice(procedures, F.lit(1), i), lambda q: F.lower(q) == F.lower(p)))
    return F.struct(F.substring(description, 1, most_chars).alias("description"), F.slice(seen, 1, most).alias("procedures"))


def fees(value: Column) -> Column:
    """struct<new_appointment, follow_up, currency> as text: ``£250 (new), £175 (follow-up)``; null if neither is known."""
    symbol = F.when(value["currency"] == "GBP", "£").otherwise(F.coalesce(value["currency"], F.lit("")))
    plain = lambda x: F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    part = lambda name, kind: F.concat(symbol, plain(value[name].cast("double")), F.lit(f" ({kind})"))
    return F.nullif(F.concat_ws(", ", part("new_appointment", "new"), part("follow_up", "follow-up")), F.lit(""))


def response(ranking: DataFrame, profiles: DataFrame, shown: int = 200) -> DataFrame:
    """What a search answers for each ranked profile.

    ranking: (query_id, doc_id, rank, score, bm25_score) and, where there is an evaluation, tier,
    reason and iteration_found; profiles: doc_id and what ``normalise`` makes, with fees (see ``fees``)
    where they are known.  The expertise is cut to ``shown`` characters beside its full text; the gain of the second stage
    is the score less the first stage's, null where there was no second stage.
    """
    have, ranked_by = set(profiles.columns), set(ranking.columns)
    p = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    r = lambda c, kind="string": F.col(c) if c in ranked_by else F.lit(None).cast(kind)
    both = ranking.join(profiles.drop(*(ranked_by - {"doc_id"})), "doc_id")
    text = F.nullif(p("clinical_expertise"), F.lit(""))
    kept = [p(c).alias(c) for c in ("name", "title", "specialty", "subspecialties", "gmc_number", "about", "procedure_groups", "locations", "profile_url", "sources", "has_isrctn_trials", "research_interests", "remote_consultation", "nhs_base", "nhs_posts", "procedure_volumes")]
    count = F.coalesce(F.when(F.size(p("procedure_volumes", VOLUMES)) > 0, F.size(p("procedure_volumes", VOLUMES))), p("procedure_count", "int"), F.lit(0))
    return both.select(
        "query_id", "doc_id", "rank", "score", r("bm25_score", "double").alias("bm25_score"), (F.col("score") - r("bm25_score", "double")).alias("rescoring_score"), *kept,
        F.when(text.isNotNull(), F.concat(F.substring(text, 1, shown), F.lit("..."))).alias("clinical_expertise"), text.alias("clinical_expertise_full"),
        (fees(F.col("fees")) if "fees" in have else F.lit(None).cast("string")).alias("pricing"), count.alias("procedure_count"),
        r("tier").alias("fit_category"), r("reason").alias("evaluation_reason"), r("iteration_found", "int").alias("iteration_found"),
    )
